"""Differences of two keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyed_diff(left: DataFrame, right: DataFrame, key: str, shape: str) -> DataFrame:
    """(key, left_shape, right_shape, status) over the union of the keys.

    Status is 'same', 'mismatch', 'only_left' or 'only_right'; two nulls are the same shape.
    """
    a = left.select(F.col(key), F.col(shape).alias("left_shape"), F.lit(1).alias("_l"))
    b = right.select(F.col(key), F.col(shape).alias("right_shape"), F.lit(1).alias("_r"))
    status = (
        F.when(F.col("_r").isNull(), "only_left")
        .when(F.col("_l").isNull(), "only_right")
        .when(F.col("left_shape").eqNullSafe(F.col("right_shape")), "same")
        .otherwise("mismatch")
    )
    return a.join(b, key, "full_outer").select(
        key, "left_shape", "right_shape", status.alias("status")
    )


def diff_counts(diff: DataFrame) -> DataFrame:
    """One row: left_keys, right_keys, missing (only right), extra (only left), mismatched."""

    def count(*statuses: str):
        return F.coalesce(
            F.sum(F.col("status").isin(*statuses).cast("long")), F.lit(0).cast("long")
        )

    return diff.agg(
        count("same", "mismatch", "only_left").alias("left_keys"),
        count("same", "mismatch", "only_right").alias("right_keys"),
        count("only_right").alias("missing"),
        count("only_left").alias("extra"),
        count("mismatch").alias("mismatched"),
    )


def one_sided(left: DataFrame, right: DataFrame, key: str, shape: str) -> DataFrame:
    """(side, key, shape) of keys found on one side only."""
    a, b = left.select(key, shape), right.select(key, shape)
    only_left = a.join(b.select(key), key, "left_anti").withColumn("side", F.lit("left"))
    only_right = b.join(a.select(key), key, "left_anti").withColumn("side", F.lit("right"))
    return only_left.unionByName(only_right)
