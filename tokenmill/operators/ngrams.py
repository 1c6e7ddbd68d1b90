"""Next-token statistics of a stream: counts, likeliest followers, held-out loss.

A count model with add-one smoothing; it is no substitute for a trained network's loss.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


PAIR_SCHEMA = "split string, cur int, next int, n long"
IDS_AT_ONCE = 1 << 20  # ids that a task counts in one step


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of one task: (split, first, stop, ids) rows to distinct pairs per step."""
    for batch in batches:
        splits = batch.column("split").to_pylist()
        first, stop = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("first", "stop"))
        ids = batch.column("ids")
        ends = np.asarray(ids.offsets).astype(np.int64)
        values = ids.values.to_numpy(zero_copy_only=False)
        row = 0
        while row < len(splits):
            # Rows of one split, up to IDS_AT_ONCE ids or a single longer row.
            limit = max(int(np.searchsorted(ends, ends[row] + IDS_AT_ONCE, "right")) - 1, row + 1)
            same = next((r for r in range(row, limit) if splits[r] != splits[row]), limit)
            rows = slice(row, same)
            begin = ends[rows]
            inside = np.zeros(int(ends[same] - ends[row]) + 1, dtype=np.int64)
            np.add.at(inside, begin + first[rows] - ends[row], 1)
            np.add.at(inside, begin + stop[rows] - 1 - ends[row], -1)
            wanted = np.flatnonzero(np.cumsum(inside[:-1])) + ends[row]
            cur, after = values[wanted].astype(np.int64), values[wanted + 1]
            pairs, counts = np.unique(cur << 32 | after, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([splits[row]] * len(pairs), type=pa.string()),
                    pa.array((pairs >> 32).astype(np.int32)),
                    pa.array((pairs & 0xFFFFFFFF).astype(np.int32)),
                    pa.array(counts),
                ],
                names=["split", "cur", "next", "n"],
            )
            row = same


def pair_counts(
    chunks: DataFrame, ids: str, size: int, parts: dict[str, tuple[int, int]]
) -> DataFrame:
    """(split, cur, next, n): adjacent pairs whose both tokens lie in a part [lo, hi) of the stream.

    ``chunks`` hold ``size`` tokens and one of overlap, so that every pair is in exactly one
    chunk. All parts are counted in one pass. A row per token never exists: each task turns its
    Arrow batches into distinct pairs, which are summed before and after one small shuffle.
    """
    column = F.col(ids)
    begin = F.col("chunk_id") * size
    bounds = F.array(
        *[
            F.struct(
                F.lit(name).alias("split"),
                F.greatest(F.lit(lo) - begin, F.lit(0)).cast("int").alias("first"),
                F.least(F.lit(hi) - begin, F.size(column).cast("long")).cast("int").alias("stop"),
            )
            for name, (lo, hi) in parts.items()
        ]
    )
    wanted = F.filter(bounds, lambda b: b["stop"] - b["first"] > 1)
    return (
        chunks.select(F.inline(wanted), column.alias("ids"))
        .mapInArrow(_count_pairs, PAIR_SCHEMA)
        .groupBy("split", "cur", "next")
        .agg(F.sum("n").alias("n"))
    )


def top_next(counts: DataFrame, k: int) -> DataFrame:
    """(cur, rank, next, n): the k most frequent followers. A group has one row per follower."""
    order = Window.partitionBy("cur").orderBy(F.col("n").desc(), F.col("next"))
    ranked = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("cur", "rank", "next", "n")


def perplexity(mean_loss: Column) -> Column:
    """exp(loss), or infinity from a loss of 20 on."""
    return F.when(mean_loss < 20, F.exp(mean_loss)).otherwise(F.lit(float("inf")))


def held_out_loss(train: DataFrame, val: DataFrame, vocab_size: int) -> DataFrame:
    """One row: pairs, mean -ln p and perplexity of val pairs under add-one smoothed counts.

    Both sides are counted pairs, so the joins see distinct pairs and not tokens.
    """
    totals = train.groupBy("cur").agg(F.sum("n").alias("cur_n"))
    seen = train.withColumnRenamed("n", "train_n")
    scored = val.join(seen, ["cur", "next"], "left").join(totals, "cur", "left")
    p = (F.coalesce("train_n", F.lit(0)) + 1) / (F.coalesce("cur_n", F.lit(0)) + vocab_size)
    sums = scored.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"),
        F.coalesce(F.sum(F.col("n") * -F.log(p)), F.lit(0.0)).alias("loss"),
    )
    mean = sums.select("pairs", (F.col("loss") / F.greatest("pairs", F.lit(1))).alias("mean_loss"))
    return mean.withColumn("perplexity", perplexity(F.col("mean_loss")))
