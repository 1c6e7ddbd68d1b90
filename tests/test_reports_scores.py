"""Reports, differences, parity and score vectors against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenmill.functions.hashing import seeded_fraction
from tokenmill.functions.vectors import pick, softmax, top_k
from tokenmill.operators import diff, reports, scores
from tokenmill.sources import cache


def test_split_summary(spark):
    rows = spark.createDataFrame([("train",)] * 3 + [("val",)], "split string")
    found = {r["split"]: r["rows"] for r in reports.split_summary(rows).collect()}
    assert found == {"train": 3, "val": 1, "total": 4}


def test_token_budget(spark):
    plans = spark.createDataFrame([("p", 2, 384, 20000)], "plan string, batch long, block long, steps long")
    counts = spark.createDataFrame([("train", 1000), ("val", 50)], "split string, tokens long")
    r = reports.token_budget(counts, plans).first()
    assert (r["tokens_per_step"], r["planned_tokens"], r["dataset_tokens"]) == (768, 15_360_000, 1050)
    assert r["epochs"] == 15_360.0 and r["coverage_percent"] == 1_536_000.0
    empty = reports.token_budget(counts.where("false"), plans).first()
    assert empty["train_tokens"] == 0 and empty["epochs"] == 15_360_000.0


def test_length_stats(spark):
    rng = random.Random(2)
    lengths = [rng.randint(1, 40) for _ in range(501)]
    df = spark.createDataFrame([(n,) for n in lengths], "n int").repartition(4)
    r = reports.length_stats(df, F.col("n"), (10, 39)).first()
    assert (r["rows"], r["min_len"], r["max_len"]) == (501, min(lengths), max(lengths))
    assert r["mean_len"] == pytest.approx(np.mean(lengths))
    for name, q in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99)):
        assert r[name] == pytest.approx(np.quantile(lengths, q))
    assert r["over_10"] == pytest.approx(np.mean([n > 10 for n in lengths]))
    assert r["over_39"] == pytest.approx(np.mean([n > 39 for n in lengths]))


def test_vector_parity_and_match_rate(spark):
    a = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.5, -1.0])], "k int, v array<double>")
    b = spark.createDataFrame([(1, [1.5, 2.0]), (2, [0.5, -4.0])], "k int, v array<double>")
    r = reports.vector_parity(a, b, "k", "v").first()
    assert (r["vectors"], r["max_abs_diff"], r["mean_abs_diff"]) == (2, 3.0, 3.5 / 4)
    left = spark.createDataFrame([(1, [9, 1, 2, 3]), (2, [9, 5])], "k int, ids array<int>")
    right = spark.createDataFrame([(1, [9, 1, 0, 3]), (2, [8, 5])], "k int, ids array<int>")
    r = reports.match_rate(left, right, "k", "ids", skip=1).first()
    assert (r["matches"], r["total"], r["match_percent"]) == (3, 4, 75.0)
    r = reports.match_rate(left, right, "k", "ids", skip=9).first()
    assert (r["matches"], r["total"], r["match_percent"]) == (0, 0, 0.0)


def test_parity_reports_one_sided_keys_and_longer_tails(spark):
    schema = "k int, v array<double>"
    a = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.5]), (4, None)], schema)
    b = spark.createDataFrame([(1, [1.5, 2.0]), (3, [9.0])], schema)
    r = reports.vector_parity(a, b, "k", "v").first()
    assert (r["vectors"], r["unmatched"], r["max_abs_diff"], r["mean_abs_diff"]) == (1, 3, 0.5, 0.25)
    short = spark.createDataFrame([(1, [1.0]), (2, [0.5])], schema)
    with pytest.raises(Exception, match="differ in length"):
        reports.vector_parity(a, short, "k", "v").collect()
    schema = "k int, ids array<int>"
    left = spark.createDataFrame([(1, [9, 1, 2, 3]), (2, [9, 5])], schema)
    right = spark.createDataFrame([(1, [9, 1]), (3, [8, 5, 6])], schema)
    r = reports.match_rate(left, right, "k", "ids", skip=1).first()
    assert (r["matches"], r["total"], r["unmatched"]) == (1, 3 + 1 + 2, 2)


def test_diff(spark):
    a = spark.createDataFrame([("w", [2, 3]), ("x", [1]), ("n", None)], "key string, shape array<int>")
    b = spark.createDataFrame([("w", [2, 3]), ("x", [4]), ("y", [7]), ("n", None)], "key string, shape array<int>")
    d = diff.keyed_diff(a, b, "key", "shape")
    assert {r["key"]: r["status"] for r in d.collect()} == {
        "w": "same", "x": "mismatch", "y": "only_right", "n": "same",
    }
    assert tuple(diff.diff_counts(d).first()) == (3, 4, 1, 0, 1)
    assert [tuple(r) for r in diff.one_sided(a, b, "key", "shape").collect()] == [("y", [7], "right")]
    assert tuple(diff.diff_counts(d.where("false")).first()) == (0, 0, 0, 0, 0)


def test_softmax_topk_argmax(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=12) * 50]) for i in range(40)]
    rows.append((40, [3.0, 3.0, 1.0, 3.0]))
    rows.append((41, [1000.0, 999.0]))
    df = spark.createDataFrame(rows, "k long, s array<double>")
    out = scores.probabilities(df, "s", 0.7).collect()
    for r in out:
        z = np.array(r["s"]) / 0.7
        p = np.exp(z - z.max())
        assert np.allclose(r["probs"], p / p.sum(), rtol=1e-12)
    best = df.select("k", "s", top_k(F.col("s"), 5).alias("t")).collect()
    for r in best:
        order = sorted(range(len(r["s"])), key=lambda i: (-r["s"][i], i))[:5]
        assert [(t["rank"], t["index"], t["score"]) for t in r["t"]] == [
            (n + 1, i, r["s"][i]) for n, i in enumerate(order)
        ]
    greedy = scores.sampled_choice(df, "k", "s", 1, temperature=0.0).collect()
    assert all(r["choice"] == int(np.argmax(r["s"])) for r in greedy)
    opened = scores.top_choices(df, "s", 99)
    assert opened.count() == sum(len(s) for _, s in rows)


def test_temperature_floor(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0])], "k int, s array<double>")
    r = scores.probabilities(df, "s", 0.0, floor=scores.MIN_TEMPERATURE).first()
    assert r["probs"] == [0.0, 1.0]
    with pytest.raises(ValueError):
        scores.probabilities(df, "s", 0.0)


@pytest.mark.parametrize("u, index", [(0.0, 0), (0.0999, 0), (0.1, 1), (0.39, 1), (0.41, 2), (0.99999, 2)])
def test_pick_boundaries(spark, u, index):
    df = spark.createDataFrame([([1.0, 3.0, 6.0],)], "w array<double>")
    assert df.select(pick(F.col("w"), F.lit(u))).first()[0] == index


@pytest.mark.parametrize("k", [None, 3, 99])
def test_draws_follow_the_probabilities(spark, k):
    weights = [math.log(x) for x in (1, 2, 3, 4)]
    df = spark.range(4000).select("id", F.array(*[F.lit(w) for w in weights]).alias("s"))
    drawn = scores.sampled_choice(df, "id", "s", 5, k)
    share = {r["choice"]: r["count"] / 4000 for r in drawn.groupBy("choice").count().collect()}
    kept = {1: 2, 2: 3, 3: 4} if k == 3 else {0: 1, 1: 2, 2: 3, 3: 4}
    assert set(share) == set(kept)
    for i, w in kept.items():
        assert share[i] == pytest.approx(w / sum(kept.values()), abs=0.03)
    again = scores.sampled_choice(df.repartition(7), "id", "s", 5, k)
    assert sorted(again.select("id", "choice").collect()) == sorted(drawn.select("id", "choice").collect())


def test_fraction_is_below_one(spark):
    low, high = spark.range(2000).select(seeded_fraction(1, F.col("id")).alias("u")).agg(F.min("u"), F.max("u")).first()
    assert 0.0 <= low < 0.01 and 0.99 < high < 1.0


def test_softmax_does_linear_work(spark):
    wide = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(30_000)), lambda x: x / 1e4).alias("s"))
    total = wide.select(F.aggregate(softmax(F.col("s")), F.lit(0.0), lambda a, b: a + b)).first()[0]
    assert total == pytest.approx(1.0)


def test_histograms_of_parts_add_up(spark, tmp_path):
    """Statistics from stored histograms equal those of all rows, quantiles included."""
    rng = random.Random(4)
    rows = [(rng.choice("ab"), int(rng.paretovariate(1.1)), rng.randint(0, 5)) for _ in range(900)]
    df = spark.createDataFrame(rows, "split string, length int, supervised int")
    parts = [df.where(F.pmod(F.hash("length", "supervised"), F.lit(3)) == i) for i in range(3)]
    stored = []
    for i, part in enumerate(parts):
        known = {"data": f"{tmp_path}/part{i}"}
        make = lambda d: reports.length_histogram(d, F.col("length"), ["split"], F.col("supervised"))
        first = cache.stored_histogram(part, known, make)
        again = cache.stored_histogram(part.where("false"), known, make)
        assert sorted(first.collect()) == sorted(again.collect())
        stored.append(again)
    every = stored[0].unionByName(stored[1]).unionByName(stored[2])
    merged = reports.merged_histograms(every)
    assert merged.count() == len({n for _, n, _ in rows})
    wanted = reports.length_stats(df, F.col("length"), [3, 50]).first()
    assert reports.histogram_stats(merged, [3, 50]).first() == wanted
    by = {r["split"]: tuple(r)[1:] for r in reports.histogram_stats(every, [3], ["split"]).collect()}
    for name in "ab":
        own = reports.length_stats(df.where(F.col("split") == name), F.col("length"), [3]).first()
        assert by[name] == tuple(own)
    left, right = (sorted(map(tuple, x.collect())) for x in (
        reports.histogram_supervised(every), reports.supervised_stats(df)))
    assert left == right
    nothing = reports.length_histogram(df.where("false"), F.col("length"))
    assert reports.histogram_stats(nothing, [3]).first()["rows"] is None
