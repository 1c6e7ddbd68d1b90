"""Seeded train/val splits of rows: exact sizes, no collected rows, no global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.functions.hashing import seeded_hash
from tokenmill.operators.order import kth_smallest


def _first_by_hash(ids: DataFrame, key: str, seed: int, count: int) -> Column:
    """Predicate on ``key``: among the first ``count`` rows in seeded order.

    The count-th hash is found from histograms. Membership is then a comparison with literals,
    evaluated wherever the rows are: no join and no shuffle of rows.
    """
    hashed = ids.select(seeded_hash(seed, F.col(key)).alias("_hash"), F.col(key).alias("_id"))
    bound = kth_smallest(hashed, ["_hash", "_id"], count)
    if bound is None:
        return F.lit(count > 0)
    top, last = bound
    hash_now = seeded_hash(seed, F.col(key))
    return (hash_now < top) | ((hash_now == top) & (F.col(key) <= last))


def seeded_order(df: DataFrame, key: str, seed: int, out: str = "hash") -> DataFrame:
    """Add the number by which seeded splits order their rows (ties go by ``key``)."""
    return df.withColumn(out, seeded_hash(seed, F.col(key)))


def _check(fraction: float, rows: int) -> None:
    if not 0.0 < fraction < 1.0:
        raise ValueError("fraction must lie between 0 and 1")
    if rows < 2:
        raise ValueError("a split needs two rows or more")


def example_split(
    examples: DataFrame, key: str, val_ratio: float, seed: int, ids: DataFrame | None = None
) -> DataFrame:
    """Add ``split``: the first max(1, int(n * val_ratio)) rows in seeded order are val.

    ``ids`` may hold the keys of ``examples`` in a cheaper table.
    """
    keys = (ids if ids is not None else examples).select(key)
    rows = keys.count()
    _check(val_ratio, rows)
    chosen = _first_by_hash(keys, key, seed, max(1, int(rows * val_ratio)))
    return examples.withColumn("split", F.when(chosen, "val").otherwise("train"))


def row_split(raw: DataFrame, key: str, train_fraction: float, seed: int) -> DataFrame:
    """Add ``split`` to raw rows, before any of them is found unusable.

    The first int(n * train_fraction) rows in seeded order, but at least one and not all, are
    train.
    """
    rows = raw.count()
    _check(train_fraction, rows)
    size = min(max(int(rows * train_fraction), 1), rows - 1)
    chosen = _first_by_hash(raw.select(key), key, seed, size)
    return raw.withColumn("split", F.when(chosen, "train").otherwise("val"))


def require_both(rows: DataFrame) -> DataFrame:
    """Fail unless both splits have a row left."""
    if rows.select("split").distinct().count() < 2:
        raise ValueError("train or val has no usable row")
    return rows


def members(df: DataFrame, key: str, chosen: DataFrame) -> DataFrame:
    """Rows whose key is among the chosen ones."""
    return df.join(chosen.select(key), key, "left_semi")


def others(df: DataFrame, key: str, chosen: DataFrame) -> DataFrame:
    """Rows whose key is not among the chosen ones."""
    return df.join(chosen.select(key), key, "left_anti")

