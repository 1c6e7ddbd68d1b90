"""Vectors in blocks against whole rows."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from tokenmill.operators import score_blocks, scores

VECTORS = [(i, [random.Random(i).gauss(0, 3) for _ in range(1 + 7 * i % 50)]) for i in range(60)]
VECTORS += [(100, [1.0] * 9), (101, [2.0, 5.0, 5.0, 1.0]), (102, [-800.0, 0.0, 800.0]), (103, [1e308, -1e308])]


@pytest.fixture(scope="module")
def whole(spark):
    return spark.createDataFrame(VECTORS, "key long, s array<double>").repartition(4)


@pytest.fixture(params=[1, 3, 16, 1000])
def blocks(whole, request):
    return score_blocks.cut_blocks(whole, "key", "s", request.param).repartition(5)


def by_key(df, *columns):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r["key"]].append(tuple(r[c] for c in columns))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("k", [1, 4, 100])
def test_best_entries(whole, blocks, k):
    wanted = by_key(scores.top_choices(whole, "s", k), "rank", "index", "score")
    assert by_key(score_blocks.top_choices(blocks, "key", "s", k), "rank", "index", "score") == wanted
    greedy = by_key(scores.greedy_choice(whole, "s"), "choice")
    assert by_key(score_blocks.greedy_choice(blocks, "key", "s"), "choice") == greedy


@pytest.mark.parametrize("temperature", [0.7, 2.0])
def test_softmax(whole, blocks, temperature):
    wanted = {r["key"]: r["probs"] for r in scores.probabilities(whole, "s", temperature).collect()}
    parts = by_key(score_blocks.probabilities(blocks, "key", "s", temperature), "first", "probs")
    found = {k: [x for _, p in rows for x in p] for k, rows in parts.items()}
    assert found.keys() == wanted.keys()
    for k, probs in wanted.items():
        assert found[k] == pytest.approx(probs, rel=1e-12)
    top = by_key(score_blocks.top_probabilities(blocks, "key", "s", 3, temperature), "rank", "index", "prob")
    for k, rows in top.items():
        assert [p for *_, p in rows] == pytest.approx(sorted(wanted[k], reverse=True)[:3], rel=1e-12)
    with pytest.raises(ValueError):
        score_blocks.probabilities(blocks, "key", "s", 0.0)


def test_draws_from_the_best(whole, blocks):
    for k, temperature in ((5, 1.0), (2, 0.5), (3, 0.0)):
        wanted = by_key(scores.sampled_choice(whole, "key", "s", 7, k, temperature), "choice")
        found = score_blocks.sampled_top_choice(blocks, "key", "s", 7, k, temperature)
        assert by_key(found, "choice") == wanted


def test_draws_from_the_whole_do_not_depend_on_blocks(whole, blocks):
    one = score_blocks.cut_blocks(whole, "key", "s", 10**6)
    for temperature in (1.0, 0.5, 0.0):
        wanted = by_key(score_blocks.sampled_choice(one, "key", "s", 7, temperature), "choice")
        assert by_key(score_blocks.sampled_choice(blocks, "key", "s", 7, temperature), "choice") == wanted


def test_draws_follow_the_softmax(spark):
    vector = [0.0, 1.0, 2.0, -1.0]
    df = spark.range(20_000).select(F.col("id").alias("key"), F.array(*map(F.lit, vector)).alias("s"))
    drawn = score_blocks.sampled_choice(score_blocks.cut_blocks(df, "key", "s", 3), "key", "s", 3)
    counts = {r["choice"]: r["count"] for r in drawn.groupBy("choice").count().collect()}
    total = sum(map(math.exp, vector))
    for i, x in enumerate(vector):
        assert counts[i] / 20_000 == pytest.approx(math.exp(x) / total, abs=0.012)


def test_empty_blocks_and_tables(spark):
    rows = [(1, 0, []), (1, 0, [1.0, 3.0]), (1, 2, [9.0]), (1, 3, []), (2, 0, [])]
    df = spark.createDataFrame(rows, "key long, first long, s array<double>")
    assert by_key(score_blocks.greedy_choice(df, "key", "s"), "choice") == {1: [(2,)]}
    assert by_key(score_blocks.sampled_choice(df, "key", "s", 1).where("key = 2"), "choice") == {}
    nothing = df.where("false")
    for found in (
        score_blocks.top_choices(nothing, "key", "s", 2), score_blocks.masses(nothing, "key", "s"),
        score_blocks.sampled_choice(nothing, "key", "s", 1),
    ):
        assert found.count() == 0


def test_blocks_are_not_shuffled(blocks):
    """Only states leave the tasks that hold the blocks."""
    plan = score_blocks.masses(blocks, "key", "s", k=2)._jdf.queryExecution().executedPlan().toString()
    last = plan[: plan.index("Exchange hashpartitioning(key")]
    assert "Join" not in last and "_mass" in plan
