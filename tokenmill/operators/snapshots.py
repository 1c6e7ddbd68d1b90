"""Differences of two snapshots of a large keyed table, by digests of key ranges.

A snapshot is stored in key order, with a tree of digests: a leaf sums the hashes of the rows in a range
of ``width`` keys, a node those of FANOUT neighbors. Two trees are compared from the top, children of
differing nodes only, and rows are read only where leaves differ. The work follows what changed, not the
size of the table; equal snapshots cost two small reads.

Nodes are numbered by key, so trees over other sets of keys fit each other. Differing ranges are made
into at most MOST_INTERVALS filters, the nearest ones joined: rows between them are read without need,
and none is missed. Two rows differ unseen if two 64-bit sums over a range agree by chance.
Keys are unique integers without nulls; a null shape is a value of its own.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.operators.diff import keyed_diff
from tokenmill.operators.order import in_order, key_histogram
from tokenmill.session import materialize

WIDTH = 4096
FANOUT = 64
MOST_INTERVALS = 200
BLOCK_BYTES = 8 << 20  # of a row group, so that ranges of a file can be skipped
SUMS = ("n", "total", "parity")


def _node(number: str, size: int) -> Column:
    """The range of ``size`` numbers that a number is in, without overflow."""
    return F.expr(f"(`{number}` - pmod(`{number}`, {size}L)) div {size}L")


def write_snapshot(df: DataFrame, key: str, shape: str, path: str, width: int = WIDTH) -> None:
    """Rows (key, shape) in key order and the digests of their ranges, the description last."""
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias(key), shape)
    in_order(rows, [key]).write.option("parquet.block.size", BLOCK_BYTES).parquet(f"{path}/rows")
    stored = spark.read.parquet(f"{path}/rows")
    leaves = stored.select(
        _node(key, width).alias("node"),
        F.xxhash64(key, shape, F.col(shape).isNull()).cast("decimal(20,0)").alias("h"),
        F.xxhash64(F.lit(1), key, shape, F.col(shape).isNull()).alias("g"),
    )
    level = leaves.groupBy("node").agg(
        F.count(F.lit(1)).alias("n"), F.sum("h").alias("total"), F.bit_xor("g").alias("parity")
    )
    levels = 0
    while True:
        place = f"{path}/digests/{levels}"
        level.repartitionByRange("node").sortWithinPartitions("node").write.parquet(place)
        written = spark.read.parquet(place)
        levels += 1
        if written.count() <= FANOUT:
            break
        level = written.groupBy(_node("node", FANOUT).alias("node")).agg(
            F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total"),
            F.bit_xor("parity").alias("parity"),
        )
    known = json.dumps({"key": key, "shape": shape, "width": width, "levels": levels})
    spark.createDataFrame([(known,)], "value string").coalesce(1).write.text(f"{path}/description")


def _description(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/description").first()["value"])


def _intervals(nodes: DataFrame) -> list[tuple[int, int]]:
    """Ranges that hold all nodes, MOST_INTERVALS at most; what is joined is what lies nearest."""
    bins = [(r["lo"], r["hi"]) for r in key_histogram(nodes, "node")]
    gaps = sorted(range(1, len(bins)), key=lambda i: bins[i - 1][1] - bins[i][0])[: MOST_INTERVALS - 1]
    cuts = [0, *sorted(i for i in gaps if bins[i][0] > bins[i - 1][1] + 1), len(bins)]
    return [(bins[a][0], bins[b - 1][1]) for a, b in zip(cuts, cuts[1:]) if a < b]


def _within(name: str, intervals: list[tuple[int, int]], size: int) -> Column:
    """Whether a number lies in one of the intervals of nodes of ``size`` numbers."""
    each = [F.col(name).between(lo * size, hi * size + size - 1) for lo, hi in intervals]
    return reduce(lambda a, b: a | b, each, F.lit(False))


def changed_ranges(spark: SparkSession, before: str, after: str) -> list[tuple[int, int]]:
    """Intervals [low, high] of keys outside of which two snapshots are the same."""
    known = [_description(spark, p) for p in (before, after)]
    if known[0]["width"] != known[1]["width"]:
        raise ValueError("the snapshots have ranges of different widths")
    intervals = None
    for level in reversed(range(min(k["levels"] for k in known))):
        sides = [spark.read.parquet(f"{p}/digests/{level}") for p in (before, after)]
        if intervals is not None:
            sides = [s.where(_within("node", intervals, FANOUT)) for s in sides]
        left, right = (s.select("node", F.struct(*SUMS).alias(c)) for s, c in zip(sides, "ab"))
        differing = left.join(right, "node", "full").where(~F.col("a").eqNullSafe(F.col("b")))
        intervals = _intervals(materialize(differing.select("node"), "differing-ranges"))
        if not intervals:
            return []
    width = known[0]["width"]
    return [(lo * width, hi * width + width - 1) for lo, hi in intervals]


def changed_rows(spark: SparkSession, before: str, after: str) -> DataFrame:
    """(key, left_shape, right_shape, status) of the keys that are not the same on both sides."""
    known = _description(spark, before)
    key, shape = known["key"], known["shape"]
    near = _within(key, changed_ranges(spark, before, after), 1)
    left, right = (spark.read.parquet(f"{p}/rows").where(near) for p in (before, after))
    return keyed_diff(left, right, key, shape).where(F.col("status") != "same")
