"""Counts, budgets, length and supervision statistics, prediction parity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.functions.vectors import abs_difference, bind, equal_positions, vector_sum

QUANTILES = (0.5, 0.9, 0.95, 0.99)


def split_summary(df: DataFrame, split: str = "split") -> DataFrame:
    """(split, rows) per split, and one row for all of them named 'total'."""
    counted = df.groupBy(split).agg(F.count(F.lit(1)).alias("rows"))
    rolled = counted.rollup(split).agg(F.sum("rows").alias("rows"), F.grouping(split).alias("g"))
    name = F.when(F.col("g") == 1, "total").otherwise(F.col(split))
    return rolled.select(name.alias("split"), F.col("rows").cast("long").alias("rows"))


def token_counts(df: DataFrame, tokens: Column, split: str = "split") -> DataFrame:
    """(split, rows, tokens)."""
    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(tokens).cast("long").alias("tokens")
    )


def token_budget(counts: DataFrame, plans: DataFrame) -> DataFrame:
    """Planned against available tokens, for each plan (plan, batch, block, steps).

    ``counts`` are (split, tokens) rows. They become one row of literals, so that no join is
    needed; plans may be many.
    """
    train, val = (
        F.coalesce(F.sum(F.when(F.col("split") == s, F.col("tokens"))), F.lit(0)).cast("long")
        for s in ("train", "val")
    )
    have = counts.agg(train.alias("train"), val.alias("val")).first()
    step = F.col("batch") * F.col("block")
    planned = (step * F.col("steps")).cast("long")
    ratio = planned / F.lit(float(max(have["train"], 1)))
    return plans.select(
        "plan",
        F.lit(have["train"]).cast("long").alias("train_tokens"),
        F.lit(have["val"]).cast("long").alias("val_tokens"),
        F.lit(have["train"] + have["val"]).cast("long").alias("dataset_tokens"),
        step.cast("long").alias("tokens_per_step"),
        planned.alias("planned_tokens"),
        (ratio * 100.0).alias("coverage_percent"),
        ratio.alias("epochs"),
    )


def length_histogram(
    df: DataFrame, length: Column, by: Sequence[str] = (), supervised: Column | None = None
) -> DataFrame:
    """(by, len, n, supervised): rows of each length, and their ids that carry loss.

    A row per distinct length, which grows with the longest text and not with the table. Histograms
    of parts add up (``merged_histograms``), so one kept beside each part replaces reading it again.
    """
    carried = F.lit(0) if supervised is None else supervised
    counted = df.select(*by, length.cast("long").alias("len"), carried.cast("long").alias("_s"))
    return counted.groupBy(*by, "len").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_s"), F.lit(0)).alias("supervised")
    )


def merged_histograms(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One histogram from the rows of any number of them."""
    sums = [F.sum(c).alias(c) for c in ("n", "supervised")]
    return parts.groupBy(*by, "len").agg(*sums)


def histogram_stats(counted: DataFrame, limits: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """Per ``by``: count, range, mean, exact quantiles and, per limit, the share of longer rows."""
    rows = F.sum("n")
    quantiles = F.percentile("len", F.lit(list(QUANTILES)), F.col("n"))
    over = [
        (F.sum(F.when(F.col("len") > x, F.col("n")).otherwise(0)) / rows).alias(f"over_{x}")
        for x in limits
    ]
    stats = (counted.groupBy(*by) if by else counted).agg(
        rows.cast("long").alias("rows"),
        F.min("len").alias("min_len"),
        F.max("len").alias("max_len"),
        (F.sum(F.col("len") * F.col("n")) / rows).alias("mean_len"),
        quantiles.alias("q"),
        *over,
    )
    named = [F.col("q")[i].alias(f"p{round(q * 100)}") for i, q in enumerate(QUANTILES)]
    return stats.select(
        *by, "rows", "min_len", "max_len", "mean_len", *named, *[f"over_{x}" for x in limits]
    )


def histogram_supervised(counted: DataFrame, split: str = "split") -> DataFrame:
    """As ``supervised_stats``, from histograms by split."""
    tokens = F.sum(F.col("len") * F.col("n")).cast("long")
    return counted.groupBy(split).agg(
        F.sum("n").alias("examples"),
        tokens.alias("tokens"),
        F.sum("supervised").cast("long").alias("supervised"),
        (F.sum("supervised") / F.greatest(tokens, F.lit(1))).alias("ratio"),
    )


def length_stats(df: DataFrame, length: Column, limits: Sequence[int]) -> DataFrame:
    """One row: count, range, mean, quantiles and, per limit, the share of longer rows.

    Lengths are counted first. What reaches the last task is one row per distinct length, and
    quantiles stay exact.
    """
    return histogram_stats(length_histogram(df, length).drop("supervised"), limits)


def supervised_stats(rows: DataFrame, split: str = "split") -> DataFrame:
    """Per split: examples, ids, ids that carry loss, and their ratio."""
    return rows.groupBy(split).agg(
        F.count(F.lit(1)).alias("examples"),
        F.sum("length").cast("long").alias("tokens"),
        F.sum("supervised").cast("long").alias("supervised"),
        (F.sum("supervised") / F.greatest(F.sum("length"), F.lit(1))).alias("ratio"),
    )


def _paired(left: DataFrame, right: DataFrame, key: str, a: Column, b: Column) -> DataFrame:
    """(_a, _b, _both): the values of both sides; a key of one side only has null on the other."""
    return (
        left.select(key, a.alias("_a"), F.lit(True).alias("_left"))
        .join(right.select(key, b.alias("_b"), F.lit(True).alias("_right")), key, "full")
        .select("_a", "_b", (F.col("_left") & F.col("_right")).alias("_both"))
    )


def _unmatched() -> Column:
    return F.count_if(F.col("_both").isNull()).alias("unmatched")


def vector_parity(
    left: DataFrame, right: DataFrame, key: str, vector: str, other: str | None = None
) -> DataFrame:
    """One row: vectors compared, keys of one side only, largest and mean absolute difference.

    Vectors of one key must have the same length; others fail the job.
    """
    pairs = _paired(left, right, key, F.col(vector), F.col(other or vector))
    unequal = F.col("_both") & ~F.size("_a").eqNullSafe(F.size("_b"))
    checked = F.when(unequal, F.raise_error(F.lit("vectors of one key differ in length"))).otherwise(
        abs_difference(F.col("_a"), F.col("_b"))
    )
    measured = pairs.select(
        "_both",
        bind(
            checked.cast("array<double>"),
            lambda d: F.struct(
                F.array_max(d).alias("top"), vector_sum(d).alias("sum"), F.size(d).alias("n")
            ),
        ).alias("d"),
    )
    return measured.agg(
        F.count("_both").alias("vectors"),
        _unmatched(),
        F.max("d.top").alias("max_abs_diff"),
        (F.sum("d.sum") / F.sum(F.when(F.col("_both"), F.col("d.n")))).alias("mean_abs_diff"),
    )


def match_rate(
    left: DataFrame, right: DataFrame, key: str, ids: str, skip: int = 0
) -> DataFrame:
    """One row: equal positions, positions of the longer side, their percentage, one-sided keys.

    The first ``skip`` ids of a row are the prompt and do not count. A position that one side
    lacks, or a whole row, counts as unequal.
    """
    tail = F.greatest(F.size(ids) - skip, F.lit(0))
    kept = F.slice(F.col(ids), skip + 1, tail)
    pairs = _paired(left, right, key, kept, kept)
    sizes = [F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)) for c in ("_a", "_b")]
    same = F.when(F.col("_both"), equal_positions(F.col("_a"), F.col("_b"))).otherwise(0)
    sums = pairs.agg(
        F.coalesce(F.sum(same), F.lit(0)).alias("matches"),
        F.coalesce(F.sum(F.greatest(*sizes)), F.lit(0)).alias("total"),
        _unmatched(),
    )
    share = F.col("matches") * 100.0 / F.greatest("total", F.lit(1))
    return sums.select("matches", "total", share.alias("match_percent"), "unmatched")
