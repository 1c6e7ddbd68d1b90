"""What filters remove together, alone and in every order: games over coalitions of filters.

The removal game of a part of the corpus gives each coalition of filters the number of documents that
fail at least one of them. It is summed once, from counts by (part, set of failed filters). The rest
follows from its values:

- Steps of an order are differences of coalitions: what the filters so far and the next one remove,
  less what the filters so far remove.
- The potential of a coalition is its value plus the potentials of all coalitions with one filter less,
  divided by its number of filters; the empty one has 0. A filter's Shapley value is the potential of
  all filters less the potential without it. Potentials are kept as integers, times the factorial of
  the coalition's size, so the sum of a filter's removals over all orders is exact.

Filters of ``failed_filters``: A, fewer than 200 words; B, fewer than half of the words distinct; C,
more than 3 percent capitals (A-Z); D, one of ``#$%&*|``; E, the text of a smaller id. Words are runs
without ASCII white space. A null text is an empty one, a null part an empty string. A document
without an id never fails E, gives nobody a smaller id and has no labels. Repeated rows count as often
as they occur; those that share an id are no repeats of each other. A document is good or toxic if any
of its label rows says so. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.arrays import Words, byte_class, row_sums, text_bytes, text_slabs
from tokenmill.session import materialize

FILTERS = "ABCDE"
MIN_WORDS = 200
DISTINCT_PERCENT = 50
CAPITALS_PERCENT = 3
SYMBOLS = b"#$%&*|"
REPEATED = 1 << FILTERS.index("E")

_CAPITAL = byte_class(bytes(range(65, 91)))
_SYMBOL = byte_class(SYMBOLS)
_STARTS_POINT = ~byte_class(bytes(range(0x80, 0xC0)))


def _word_counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words, distinct words) of each row; a long row is read in pieces."""
    words, distinct = np.zeros((2, len(column)), np.int64)
    row, seen = -1, np.zeros(0, np.uint64)
    for lo, texts in text_slabs(column):
        found = Words(texts, lower=False)
        counts = found.counts()
        words[lo : lo + len(texts)] += counts
        if len(texts) == 1:
            seen = np.union1d(seen if lo == row else seen[:0], found.hashes)
            row, distinct[lo] = lo, len(seen)
            continue
        rows = np.repeat(np.arange(len(texts)), counts)
        order = np.lexsort((found.hashes, rows))
        hashes, rows = found.hashes[order], rows[order]
        new = np.ones(len(rows), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
        distinct[lo : lo + len(texts)] = np.bincount(rows[new], minlength=len(texts))
    return words, distinct


def _byte_counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(capitals, code points, symbols) of each row."""
    counts = np.zeros((3, len(column)), np.int64)
    for lo, texts in text_slabs(column):
        data, offsets = text_bytes(texts)
        for own, members in zip(counts, (_CAPITAL, _STARTS_POINT, _SYMBOL)):
            own[lo : lo + len(texts)] += row_sums(members[data], offsets)
    return counts[0], counts[1], counts[2]


def failed_texts(docs: DataFrame, key: str, text: str, part: str) -> DataFrame:
    """(doc, part, digest, failed): bits of the failed filters A to D, and what the text is known by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            words, distinct = _word_counts(column)
            capitals, points, symbols = _byte_counts(column)
            failed = (
                (words < MIN_WORDS)
                + 2 * (100 * distinct < DISTINCT_PERCENT * words)
                + 4 * (100 * capitals > CAPITALS_PERCENT * points)
                + 8 * (symbols > 0)
            )
            data, offsets = text_bytes(column)
            digests = [
                hashlib.blake2b(data[a:b], digest_size=16).digest()
                for a, b in zip(offsets[:-1], offsets[1:])
            ]
            columns = [
                batch.column("doc"), batch.column("part"), pa.array(digests, pa.binary()),
                pa.array(failed.astype(np.int32)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "part", "digest", "failed"])

    rows = docs.select(
        F.col(key).cast("long").alias("doc"),
        F.coalesce(F.col(part), F.lit("")).alias("part"),
        F.col(text).alias("text"),
    )
    return rows.mapInArrow(run, "doc long, part string, digest binary, failed int")


def failed_filters(
    docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang"
) -> DataFrame:
    """(doc, part, failed, n): bits of all failed filters, and how many rows are alike.

    Rows are counted before texts are compared, and a text meets its smallest id by (text, id), so no
    task gets all rows of a text that very many documents share.
    """
    facts = failed_texts(docs, key, text, part).groupBy("doc", "part", "digest", "failed")
    facts = materialize(facts.agg(F.count(F.lit(1)).alias("n")), "failed-filters")
    smallest = facts.where(F.col("doc").isNotNull()).groupBy("digest").agg(F.min("doc").alias("doc"))
    matched = facts.join(smallest.withColumn("_first", F.lit(True)), ["digest", "doc"], "left")
    repeat = F.col("doc").isNotNull() & F.col("_first").isNull()
    failed = F.col("failed") + F.when(repeat, REPEATED).otherwise(0)
    return matched.select("doc", "part", failed.alias("failed"), "n")


def count_failures(failures: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(part, failed, n, good, toxic): documents by part and failed filters."""
    known = labels.groupBy(F.col(key).cast("long").alias("doc")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"),
        F.max((F.col("toxic") == 1).cast("int")).alias("toxic"),
    )
    named = failures.where(F.col("doc").isNotNull()).join(known, "doc", "left")
    unnamed = failures.where(F.col("doc").isNull()).select(
        "*", F.lit(None).cast("int").alias("good"), F.lit(None).cast("int").alias("toxic")
    )
    marked = [F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")]
    return named.unionByName(unnamed).groupBy("part", "failed").agg(F.sum("n").alias("n"), *marked)


def removal_games(counts: DataFrame, filters: int) -> DataFrame:
    """(part, documents, v): what every coalition removes, by its number, as (n, good, toxic).

    ``counts`` has at most 2 ** filters rows for a part.
    """
    coalition = F.explode(F.sequence(F.lit(0), F.lit((1 << filters) - 1)))
    every = counts.withColumn("s", coalition)
    touched = (F.col("s") == 0) | (F.col("failed").bitwiseAND(F.col("s")) != 0)  # 0 for the total
    sums = every.where(touched).groupBy("part", "s").agg(*(F.sum(c).alias(c) for c in MEASURES))
    values = F.map_from_entries(F.collect_list(F.struct("s", F.struct(*MEASURES))))
    found = sums.groupBy("part").agg(values.alias("sums"))
    none = F.struct(*(F.lit(0).cast("long").alias(c) for c in MEASURES))
    removed = F.transform(
        F.sequence(F.lit(0), F.lit((1 << filters) - 1)),
        lambda s: F.when(s == 0, none).otherwise(F.coalesce(F.element_at("sums", s), none)),
    )
    return found.select(
        "part", F.element_at("sums", F.lit(0))["n"].alias("documents"), removed.alias("v")
    )


MEASURES = ("n", "good", "toxic")


def potentials(values: Column, filters: int) -> Column:
    """Potentials of all coalitions, each times the factorial of its size.

    A coalition without one of its filters has a smaller number, so one walk by number is enough.
    """

    def without_one(known: Column, s: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(0), F.lit(filters - 1)),
            F.lit(0).cast("long"),
            lambda total, i: F.when(
                F.getbit(s, i) == 1, total + F.get(known, s.bitwiseXOR(_bit(i)))
            ).otherwise(total),
        )

    def grown(known: Column, s: Column) -> Column:
        own = F.factorial(F.bit_count(s) - 1) * F.get(values, s)["n"]
        return F.array_append(known, own + without_one(known, s))

    first = F.array(F.lit(0).cast("long"))
    return F.aggregate(F.sequence(F.lit(1), F.lit((1 << filters) - 1)), first, grown)


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), i)


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row per part, order of the filters and step; zeros included.

    ``filters`` names the bits of ``failed``, the lowest first, one character each.
    """
    k, whole = len(filters), (1 << len(filters)) - 1
    games = removal_games(counts, k)
    games = games.select("*", potentials(F.col("v"), k).alias("q"))
    orders = F.array(*(F.lit("".join(o)) for o in permutations(filters)))
    steps = games.withColumn("filter_order", F.explode(orders)).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(k)))
    )

    def place(step: Column) -> Column:
        return F.instr(F.lit(filters), F.substr("filter_order", step, F.lit(1))) - 1

    before = F.aggregate(
        F.sequence(F.lit(1), F.lit(k)),
        F.lit(0),
        lambda mask, i: F.when(i < F.col("step"), mask.bitwiseOR(_bit(place(i)))).otherwise(mask),
    )
    steps = steps.withColumns({"before": before, "own": _bit(place(F.col("step")))})
    after = F.col("before").bitwiseOR(F.col("own"))

    def lost(measure: str) -> Column:
        return F.get("v", after)[measure] - F.get("v", F.col("before"))[measure]

    others = F.lit(whole).bitwiseXOR(F.col("own"))
    return steps.select(
        "part", "filter_order", "step",
        (F.col("documents") - F.get("v", after)["n"]).alias("kept"),
        lost("n").alias("removed"),
        (F.get("v", F.col("own"))["n"] - lost("n")).alias("redundant"),
        (F.get("v", F.lit(whole))["n"] - F.get("v", others)["n"]).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        (F.get("q", F.lit(whole)) - k * F.get("q", others)).alias("shapley"),
    )
