"""Choosing from score vectors that are cut into blocks, one row (key, first, scores) each.

``first`` is the place of the block's first entry in its vector, and blocks may have any sizes. A block is
reduced where it is to a state that adds up: its highest scaled score, the sum of powers in proportion to
that, its ``k`` best entries, and its best entry with noise. States, not scores, are shuffled: a vector of
a whole vocabulary, or one longer than a row may be, is a few numbers per block. Results do not depend
on where vectors are cut, save for the last digits of sums.

Ties go to the lower index. An empty block changes nothing; a vector of empty blocks has no choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.functions.hashing import seeded_fraction
from tokenmill.functions.vectors import bind, pick, vector_sum

FIRST = "first"


def cut_blocks(df: DataFrame, key: str, scores: str, size: int) -> DataFrame:
    """(key, first, scores): whole vectors in blocks of ``size`` entries."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(scores) - 1, F.lit(0)), F.lit(size))
    opened = df.select(key, scores, F.explode(starts).alias(FIRST))
    part = F.slice(scores, F.col(FIRST) + 1, F.lit(size))
    return opened.select(key, FIRST, part.alias(scores))


def _scaled(scores: str, temperature: float, floor: float) -> Column:
    divisor = max(temperature, floor)
    if divisor <= 0.0:
        raise ValueError("a temperature of zero has no softmax; use greedy_choice")
    return F.transform(scores, lambda x: x.cast("double") / F.lit(float(divisor)))


def _best(scores: Column, k: int) -> Column:
    """array<struct<neg,index>> of the k best entries, the best first."""
    keyed = F.transform(
        scores, lambda x, i: F.struct((-x).alias("neg"), (i + F.col(FIRST)).cast("long").alias("index"))
    )
    return F.slice(F.array_sort(keyed), 1, k)


def _merged_best(k: int) -> Column:
    """Aggregate: the k best entries of all blocks of a vector."""
    return F.slice(F.array_sort(F.flatten(F.collect_list("_top"))), 1, k)


def masses(
    blocks: DataFrame, key: str, scores: str, temperature: float = 1.0, floor: float = 0.0, k: int = 1
) -> DataFrame:
    """(key, peak, mass, top): highest scaled score, sum of powers over it, k best entries by vector."""
    scaled = _scaled(scores, temperature, floor)
    filled = blocks.where(F.size(scores) > 0).select(key, FIRST, scaled.alias("_s"))
    states = filled.select(
        key,
        FIRST,
        F.array_max("_s").alias("_peak"),
        bind(
            F.array_max("_s"), lambda m: vector_sum(F.transform("_s", lambda x: F.exp(x - m)))
        ).alias("_mass"),
        _best(F.col("_s"), k).alias("_top"),
    )
    parts = F.array_sort(F.collect_list(F.struct(FIRST, "_peak", "_mass")))
    merged = states.groupBy(key).agg(
        F.max("_peak").alias("peak"), parts.alias("_parts"), _merged_best(k).alias("top")
    )
    rescaled = F.transform("_parts", lambda p: p["_mass"] * F.exp(p["_peak"] - F.col("peak")))
    return merged.select(key, "peak", vector_sum(rescaled).alias("mass"), "top")


def probabilities(
    blocks: DataFrame, key: str, scores: str, temperature: float = 1.0, floor: float = 0.0
) -> DataFrame:
    """``blocks`` with ``probs``, each block's part of the vector's softmax."""
    sums = masses(blocks, key, scores, temperature, floor).drop("top")
    powers = F.transform(
        _scaled(scores, temperature, floor), lambda x: F.exp(x - F.col("peak")) / F.col("mass")
    )
    return blocks.join(sums, key, "left").withColumn("probs", powers).drop("peak", "mass")


def top_choices(blocks: DataFrame, key: str, scores: str, k: int) -> DataFrame:
    """(key, rank, index, score) of the k best entries of each vector."""
    states = blocks.select(key, _best(F.col(scores), k).alias("_top"))
    best = states.groupBy(key).agg(_merged_best(k).alias("_top"))
    return _opened(best, key, lambda e: (-e["neg"]).alias("score"))


def top_probabilities(
    blocks: DataFrame, key: str, scores: str, k: int, temperature: float = 1.0, floor: float = 0.0
) -> DataFrame:
    """(key, rank, index, prob) of the k likeliest entries of each vector."""
    sums = masses(blocks, key, scores, temperature, floor, k).withColumnRenamed("top", "_top")
    prob = lambda e: (F.exp(-e["neg"] - F.col("peak")) / F.col("mass")).alias("prob")
    return _opened(sums, key, prob)


def _opened(best: DataFrame, key: str, value) -> DataFrame:
    rows = F.transform(
        "_top",
        lambda e, r: F.struct((r + 1).alias("rank"), e["index"].cast("int").alias("index"), value(e)),
    )
    return best.select(key, F.inline(rows))


def greedy_choice(blocks: DataFrame, key: str, scores: str) -> DataFrame:
    """(key, choice): the index of the best entry."""
    return top_choices(blocks, key, scores, 1).select(key, F.col("index").alias("choice"))


def sampled_top_choice(
    blocks: DataFrame, key: str, scores: str, seed: int, k: int, temperature: float = 1.0
) -> DataFrame:
    """(key, choice) drawn from the k likeliest entries in proportion, as ``scores.sampled_choice``."""
    if temperature <= 0.0:
        return greedy_choice(blocks, key, scores)
    sums = masses(blocks, key, scores, temperature, k=k)
    weights = F.transform("top", lambda e: F.exp(-e["neg"] - F.col("peak")) / F.col("mass"))
    chosen = F.get("top", pick(weights, seeded_fraction(seed, F.col(key))))["index"]
    return sums.select(key, chosen.cast("int").alias("choice"))


def sampled_choice(
    blocks: DataFrame, key: str, scores: str, seed: int, temperature: float = 1.0
) -> DataFrame:
    """(key, choice) drawn from whole vectors in proportion to their softmax.

    Every entry gets noise of its own from seed, key and index, and the highest sum is the draw (the
    Gumbel-max rule), so one pass over the blocks is enough.
    """
    if temperature <= 0.0:
        return greedy_choice(blocks, key, scores)
    scaled = _scaled(scores, temperature, 0.0)

    def noisy(x: Column, i: Column) -> Column:
        uniform = seeded_fraction(seed, F.col(key), F.col(FIRST) + i) + F.lit(0.5 / (1 << 60))
        return x - F.log(-F.log(uniform))

    filled = blocks.where(F.size(scores) > 0)
    states = filled.select(key, _best(F.transform(scaled, noisy), 1).alias("_top"))
    best = states.groupBy(key).agg(F.min(F.get("_top", F.lit(0))).alias("_b"))
    return best.select(key, F.col("_b.index").cast("int").alias("choice"))
