"""Filter audit against removal one order at a time."""

import collections
import itertools
import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from tokenmill.llm import filter_audit

from .edge_rows import awkward, clashing, prose

SCHEMA = "doc_id long, text string, lang string"
LABELS = "doc_id long, quality int, toxic int"


def failed(doc, text, texts):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    return {
        name
        for name, fails in (
            ("A", len(words) < 200),
            ("B", 100 * len(set(words)) < 50 * len(words)),
            ("C", 100 * len(re.findall("[A-Z]", text)) > 3 * len(text)),
            ("D", bool(re.search("[#$%&*|]", text))),
            ("E", doc is not None and any(d is not None and d < doc for d in texts[text])),
        )
        if fails
    }


def plain_audit(rows, labels):
    texts = collections.defaultdict(set)
    for doc, text, _ in rows:
        texts[text or ""].add(doc)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    parts = collections.defaultdict(list)
    for doc, text, lang in rows:
        parts[lang or ""].append((doc, failed(doc, text, texts)))
    out = {}
    for part, docs in parts.items():
        sums = collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                sums[f] += len(gone)
                out[part, order, step] = [
                    len(left), len(gone), sum(f in x for _, x in docs) - len(gone),
                    sum(x == {f} for _, x in docs),
                    sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(sums[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def corpus():
    pick = random.Random(7)
    rows = [(*r, pick.choice(["en", "de", None, ""])) for r in awkward()]
    bodies = [prose(i, pick.choice([30, 250, 400])) for i in range(12)]
    bodies += [b + " # 5 %" for b in bodies[:5]] + [b.upper() for b in bodies[:4]]
    bodies += ["same words " * 150, "SAME words | " * 120, "é" * 10]
    rows += [(pick.choice([d, d, d, None]), pick.choice(bodies), pick.choice(["en", "en", "fr", None]))
             for d in range(20, 160)]
    rows += rows[-6:] + [(500, "shared", "en"), (500, "shared", "fr"), (499, None, "fr")]
    labels = [(d, pick.randint(0, 1), pick.choice([0, 0, 1, None])) for d in range(-5, 160, 2)]
    return rows, labels + labels[:9] + [(None, 1, 1), (20, 1, 0), (20, 0, 1)]


def run(spark, rows, labels):
    docs = clashing(spark.createDataFrame(rows, SCHEMA).repartition(5), "part", "doc", "n", "failed")
    marked = clashing(spark.createDataFrame(labels, LABELS).repartition(3), "good", "doc")
    return filter_audit.audit(
        filter_audit.count_failures(filter_audit.failed_filters(docs), marked)
    )


def test_audit_equals_plain_one(spark):
    rows, labels = corpus()
    found = run(spark, rows, labels)
    assert found.columns == [
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost",
        "toxic_lost", "shapley",
    ]
    assert dict(found.dtypes)["step"] == "int" and dict(found.dtypes)["shapley"] == "bigint"
    got = {tuple(r[:3]): tuple(r[3:]) for r in found.collect()}
    assert got == plain_audit(rows, labels)
    assert all(any(v[i] for v in got.values()) for i in range(7))


def test_empty_tables(spark):
    assert run(spark, [], []).count() == 0
    only = {tuple(r) for r in run(spark, [(1, None, None)], []).collect()}
    assert len(only) == 600
    assert {r[3:] for r in only if r[1][0] == "A" and r[2] == 1} == {(0, 1, 0, 1, 0, 0, 120)}
    assert {r[3:] for r in only if r[1][0] == "B" and r[2] == 1} == {(1, 0, 0, 0, 0, 0, 0)}


def test_shapley_by_potential_sums_to_what_all_remove(spark):
    rows, labels = corpus()
    found = run(spark, rows, labels).where(F.col("filter_order") == "ABCDE")
    for part, group in itertools.groupby(sorted(found.collect()), key=lambda r: r["part"]):
        group = list(group)
        gone = group[0]["kept"] + group[0]["removed"] - group[-1]["kept"]
        assert sum(r["shapley"] for r in group) == 120 * gone


def test_other_numbers_of_filters(spark):
    counts = spark.createDataFrame(
        [("x", 0b000, 5, 1, 0), ("x", 0b011, 4, 0, 2), ("x", 0b100, 3, 1, 1)],
        "part string, failed int, n long, good long, toxic long",
    )
    found = filter_audit.audit(counts, "pqr")
    rows = {(r["filter_order"], r["step"]): r for r in found.collect()}
    assert len(rows) == 18
    assert rows["pqr", 1]["removed"] == 4 and rows["pqr", 2]["redundant"] == 4
    assert [rows["pqr", s]["shapley"] for s in (1, 2, 3)] == [12, 12, 18]


def test_hot_text_meets_its_smallest_id_in_many_tasks(spark):
    rows = [(d, "one text", "en") for d in range(3000)]
    failures = filter_audit.failed_filters(spark.createDataFrame(rows, SCHEMA).repartition(5))
    plan = failures._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "collect_list" not in plan
    assert failures.where(F.col("failed") < filter_audit.REPEATED).collect()[0]["doc"] == 0
    assert failures.where(F.col("failed") >= filter_audit.REPEATED).count() == 2999


def test_long_texts_are_read_in_pieces(monkeypatch):
    from tokenmill.llm import arrays

    texts = ["some word " * 40_000, None, "", "x" * 300_000 + " y", "a b a"] * 2
    monkeypatch.setattr(arrays.text_slabs, "__defaults__", (1000,))
    words, distinct = filter_audit._word_counts(pa.array(texts))
    assert list(words) == [80_000, 0, 0, 2, 3] * 2
    assert list(distinct) == [2, 0, 0, 2, 2] * 2
    capitals, points, symbols = filter_audit._byte_counts(pa.array(["éA#" * 999, None, "É"]))
    assert (list(capitals), list(points), list(symbols)) == ([999, 0, 0], [2997, 0, 1], [999, 0, 0])
