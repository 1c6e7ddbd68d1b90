"""Ordered operators without a global sort: prefix sums, order statistics, first-n, shuffles.

A DataFrame has no order, so every operator here takes an explicit unique order key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window

from tokenmill.functions.hashing import HASH_BITS, seeded_hash
from tokenmill.session import materialize

BUCKET = "_bucket"
GROUP = "_group"
ROWS_PER_BUCKET = 20_000
MAX_QUANTILES = 1_000
BYTES_PER_PARTITION = 256 << 20  # of an ordered table; smaller neighboring ranges share one
HISTOGRAM_BINS = 16_384


def _cell(key: str, low: int, width: int) -> Column:
    """Number of the key's range of ``width``; ranges begin at multiples of it, low's is 0.

    The key is rounded before anything is subtracted, so keys far apart cannot overflow.
    """
    value = f"cast(`{key}` as bigint)"
    return F.expr(f"({value} - pmod({value}, {width}L)) div {width}L - {low // width}L")


@dataclass(frozen=True)
class KeyRanges:
    """Order-preserving buckets of a numeric key, as a fixed function of the key.

    It holds literals only, so buckets survive recomputation and any partitioning. Either equal
    ranges of ``width`` from ``low`` on, or the ranges between ``edges``, each of them cut into
    ``cells`` of equal width.
    """

    key: str
    count: int
    low: int = 0
    width: int = 0
    edges: tuple[float, ...] = ()
    cells: int = 1

    def add(self, df: DataFrame) -> DataFrame:
        """``df`` with its bucket number."""
        if self.width:
            return df.withColumn(BUCKET, _cell(self.key, self.low, self.width))
        if len(self.edges) < 3:
            return df.withColumn(BUCKET, F.lit(0).cast("long"))
        splits = [-float("inf"), *self.edges[1:-1], float("inf")]
        split = Bucketizer(splits=splits, inputCol="_key", outputCol="_range")
        keyed = split.transform(df.withColumn("_key", F.col(self.key).cast("double")))
        number, edges = F.col("_range").cast("int"), F.lit(list(self.edges))
        low, high = F.get(edges, number), F.get(edges, number + 1)
        share = (F.col("_key") - low) / F.greatest(high - low, F.lit(1e-300))
        cell = F.least(F.greatest(F.floor(share * self.cells), F.lit(0)), F.lit(self.cells - 1))
        return keyed.withColumn(BUCKET, (number * self.cells + cell).cast("long")).drop(
            "_key", "_range"
        )


def key_ranges(df: DataFrame, key: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> KeyRanges:
    """Ranges of about ``rows_per_bucket`` rows each. Only the key column is read.

    Dense unique integers get equal ranges, which cannot hold more rows than their width. Other
    numeric keys get up to MAX_QUANTILES quantiles, and equal cells within these beyond that.
    Keys of other types, strings say, have no cells: ``dense_key`` numbers them first.
    """
    if not isinstance(df.schema[key].dataType, NumericType):
        kind = df.schema[key].dataType.simpleString()
        raise TypeError(f"order key '{key}' is {kind}, not a number: use dense_key")
    low, high, rows, known = df.agg(
        F.min(key), F.max(key), F.count(F.lit(1)), F.count(key)
    ).first()
    if known < rows:
        raise ValueError(f"{rows - known} rows have no order key '{key}'")
    if not rows:
        return KeyRanges(key, 1)
    parallel = 2 * df.sparkSession.sparkContext.defaultParallelism
    buckets = max(-(-rows // rows_per_bucket), min(parallel, rows))
    if isinstance(low, int) and high - low < 4 * rows:
        width = -(-(high - low + 1) // buckets)
        return KeyRanges(key, high // width - low // width + 1, low, width)
    quantiles = min(buckets, MAX_QUANTILES)
    probabilities = [i / quantiles for i in range(quantiles + 1)]
    numeric = df.select(F.col(key).cast("double").alias("_key"))
    found = numeric.approxQuantile("_key", probabilities, 0.5 / quantiles)
    edges = tuple(sorted(set(found)))
    if len(edges) < 3:
        return KeyRanges(key, 1)
    cells = -(-buckets // quantiles)
    return KeyRanges(key, (len(edges) - 1) * cells, edges=edges, cells=cells)


def key_buckets(df: DataFrame, key: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``df`` with a bucket column from its own key ranges."""
    return key_ranges(df, key, rows_per_bucket).add(df)


def dense_key(df: DataFrame, key: str, out: str) -> DataFrame:
    """``df`` with ``out``, the rank from 0 of a unique key of any sortable type.

    Spark deals the keys alone to ranges and sorts within each; a rank is the number of keys in
    earlier ranges plus the place in its own, so neither a window nor a task sees them all.
    """
    keys = df.select(F.col(key).alias("_key"))
    if keys.where(F.col("_key").isNull()).limit(1).count():
        raise ValueError(f"rows have no order key '{key}'")
    dealt = keys.repartitionByRange("_key").sortWithinPartitions("_key")
    placed = materialize(dealt.withColumn("_place", F.monotonically_increasing_id()), "sorted-keys")
    part = F.shiftright("_place", 33).alias("_part")
    parts = placed.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.withColumn("_base", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    ranked = placed.withColumn("_part", part).join(materialize(bases, "parts"), "_part")
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    ranks = ranked.select("_key", (F.col("_base") + inside).cast("long").alias(out))
    return df.join(ranks, F.col(key) == F.col("_key")).drop("_key")


def in_key_ranges(df: DataFrame, key: str, count: int) -> DataFrame:
    """Rows of dense numbers 0 to ``count`` - 1 placed by ranges of them and sorted."""
    partitions = max(1, min(count, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    number = F.expr(f"cast({key} * {partitions} div {max(count, 1)} as int)")
    return df.repartitionById(partitions, number).sortWithinPartitions(key)


def _partitions(df: DataFrame, ranges: KeyRanges) -> int:
    """As many partitions as the estimated bytes ask for, one per range at most."""
    estimate = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    wanted = max(-(-estimate // BYTES_PER_PARTITION), df.sparkSession.sparkContext.defaultParallelism)
    return min(ranges.count, wanted)


def in_order(df: DataFrame, keys: Sequence[str], ranges: KeyRanges | None = None) -> DataFrame:
    """Rows sorted by ``keys`` over all partitions, each a range of the first key.

    A plain sort would run everything before it twice, once to sample the keys. Ranges taken
    from the key column of the source table cost next to nothing.
    """
    ranges = ranges or key_ranges(df.select(keys[0]), keys[0])
    partitions = _partitions(df, ranges)
    # Keys outside the ranges, if there are any, belong to the first or the last one.
    inside = f"least(greatest({BUCKET}, 0L), {ranges.count - 1}L)"
    number = F.expr(f"cast({inside} * {partitions} div {ranges.count} as int)")
    placed = ranges.add(df).repartitionById(partitions, number)
    return placed.sortWithinPartitions(*keys).drop(BUCKET)


def _with_group(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """A struct is never null, so rows without a group meet their sums by plain equality."""
    return df.withColumn(GROUP, F.struct(*by)) if by else df


def bucket_bases(df: DataFrame, value: Column, by: Sequence[str] = ()) -> DataFrame:
    """Per bucket: sum of ``value`` and its sum over all earlier buckets (of the same ``by``).

    Partial sums leave each task, so a hot key costs no more than a cold one. The window runs
    over one row per bucket, not over the data. The result is written out because both the
    stream total and the positions are taken from it.
    """
    group = [GROUP] if by else []
    totals = _with_group(df, by).groupBy(*group, BUCKET).agg(
        F.sum(value).cast("long").alias("_total")
    )
    earlier = (
        Window.partitionBy(*group).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    )
    bases = totals.withColumn("_base", F.coalesce(F.sum("_total").over(earlier), F.lit(0)))
    return materialize(bases, "bases")


def stream_total(bases: DataFrame) -> int:
    return bases.agg(F.coalesce(F.sum("_total"), F.lit(0))).first()[0]


def place(
    df: DataFrame,
    bases: DataFrame,
    order: Sequence[str],
    value: Column,
    by: Sequence[str] = (),
    out: str = "start",
) -> DataFrame:
    """Exclusive running sum of ``value`` by ``order``, from a window within each bucket.

    The window and the join with the bases go by the same columns: one shuffle of the rows.
    """
    keys = [GROUP, BUCKET] if by else [BUCKET]
    within = (
        Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    local = _with_group(df, by).withColumn("_local", F.coalesce(F.sum(value).over(within), F.lit(0)))
    total = (F.col("_base") + F.col("_local")).cast("long")
    return local.join(bases, keys).withColumn(out, total).drop("_local", GROUP)


def running_total(
    df: DataFrame,
    order: Sequence[str],
    value: Column,
    by: Sequence[str] = (),
    out: str = "start",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Exclusive running sum over the whole table, or over each ``by`` group, in key order.

    ``order[0]`` must be numeric; the whole of ``order`` must be unique (per group).
    """
    keyed = df if BUCKET in df.columns else key_buckets(df, order[0], rows_per_bucket)
    placed = place(keyed, bucket_bases(keyed, value, by), order, value, by, out)
    return placed.drop(BUCKET, "_base", "_total")


def _histogram(df: DataFrame, key: str, low: int, high: int) -> list[Row]:
    """(n, lo, hi) of the keys from ``low`` to ``high``, in at most HISTOGRAM_BINS ranges."""
    width = -(-(high - low + 1) // HISTOGRAM_BINS)
    inside = df.where(F.col(key).between(low, high))
    return (
        inside.groupBy(_cell(key, low, width).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"))
        .orderBy("bin")
        .collect()
    )


def key_histogram(df: DataFrame, key: str) -> list[Row]:
    low, high = df.agg(F.min(key), F.max(key)).first()
    return [] if low is None else _histogram(df, key, low, high)


def kth_smallest(
    df: DataFrame, keys: Sequence[str], k: int, known: list[Row] | None = None
) -> tuple[int, ...] | None:
    """The k-th smallest (from 1) combination of integer ``keys``; None beyond the last row.

    Histograms of at most HISTOGRAM_BINS rows narrow the range until one value is left, so
    neither a sort nor a collect of rows is needed at any size. ``known`` is the ``key_histogram``
    of the first key, if there is one already.
    """
    key, rest = keys[0], keys[1:]
    bins = key_histogram(df, key) if known is None else known
    if k < 1 or k > sum(row["n"] for row in bins):
        return None
    while True:
        for row in bins:
            if k <= row["n"]:
                low, high = row["lo"], row["hi"]
                break
            k -= row["n"]
        if low == high:
            break
        bins = _histogram(df, key, low, high)
    if not rest:
        return (low,)
    tail = kth_smallest(df.where(F.col(key) == low), rest, k)
    return (low, *tail)


def at_most(keys: Sequence[str], bound: Sequence[int]) -> Column:
    """Lexicographic ``keys <= bound`` as a plain predicate on literals."""
    key, limit = F.col(keys[0]), F.lit(bound[0])
    if len(keys) == 1:
        return key <= limit
    return (key < limit) | ((key == limit) & at_most(keys[1:], bound[1:]))


def first_rows(
    df: DataFrame, keys: Sequence[str], n: int, keep: Column | None = None
) -> DataFrame:
    """The first ``n`` rows, in the order of integer keys, for which ``keep`` holds.

    The key of the last such row is found first; the rows are then kept by a filter on it, which
    reaches the scan. No task and no driver holds the n rows, as a sorted limit would. The bound
    is looked for among all keys, so what ``keep`` reads is read up to there and no further.
    """
    kept = df if keep is None else df.where(keep)
    if n <= 0:
        return kept.where(F.lit(False))
    every, rank = df.select(*keys), n
    known = key_histogram(every, keys[0])
    while True:
        bound = kth_smallest(every, keys, rank, known)
        if bound is None:
            break
        below = kept.where(at_most(keys, bound))
        found = n if keep is None else below.count()
        if found == n:
            return below
        if found > n:
            kept = below
            break
        rank *= 2
    last = kth_smallest(kept.select(*keys), keys, n)
    return kept if last is None else kept.where(at_most(keys, last))


def hash_ranges(df: DataFrame, column: str = "_hash") -> KeyRanges:
    """Even ranges of a seeded hash: it is uniform, so only the number of rows matters."""
    parallel = 2 * df.sparkSession.sparkContext.defaultParallelism
    buckets = max(-(-df.count() // ROWS_PER_BUCKET), parallel)
    width = -(-(1 << HASH_BITS) // buckets)
    return KeyRanges(column, buckets, 0, width)


def shuffle_ranks(df: DataFrame, key: str, seed: int, out: str = "rank") -> DataFrame:
    """Rank from 0 of every row in the order of a seeded hash of its key."""
    hashed = df.withColumn("_hash", seeded_hash(seed, F.col(key)))
    keyed = hash_ranges(df).add(hashed)
    return running_total(keyed, ["_hash", key], F.lit(1), out=out).drop("_hash")


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows in seeded random order over all partitions, the same on every cluster."""
    hashed = df.withColumn("_hash", seeded_hash(seed, F.col(key)))
    return in_order(hashed, ["_hash", key], hash_ranges(df)).drop("_hash")


__all__ = [
    "BUCKET",
    "KeyRanges",
    "at_most",
    "bucket_bases",
    "dense_key",
    "first_rows",
    "hash_ranges",
    "in_key_ranges",
    "in_order",
    "key_buckets",
    "key_ranges",
    "kth_smallest",
    "place",
    "running_total",
    "shuffle_ranks",
    "shuffled",
    "stream_total",
]
