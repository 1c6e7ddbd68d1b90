"""Choosing from tables of score vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.functions.hashing import seeded_fraction
from tokenmill.functions.vectors import argmax, pick, softmax, top_k

MIN_TEMPERATURE = 1e-5  # fixed value: smallest divisor when a floor is asked for


def probabilities(
    df: DataFrame, scores: str, temperature: float = 1.0, floor: float = 0.0
) -> DataFrame:
    """Add ``probs``, the softmax of a score column at a temperature (at least ``floor``)."""
    if max(temperature, floor) <= 0.0:
        raise ValueError("a temperature of zero has no softmax; use greedy_choice")
    return df.withColumn("probs", softmax(F.col(scores), temperature, floor))


def top_choices(df: DataFrame, scores: str, k: int) -> DataFrame:
    """Rows opened to (rank, index, score) for the k best entries; k beyond the length is cut."""
    others = [c for c in df.columns if c != scores]
    return df.select(*others, F.inline(top_k(F.col(scores), k)))


def greedy_choice(df: DataFrame, scores: str) -> DataFrame:
    """Add ``choice``, the index of the best entry."""
    return df.withColumn("choice", argmax(F.col(scores)))


def sampled_choice(
    df: DataFrame,
    key: str,
    scores: str,
    seed: int,
    k: int | None = None,
    temperature: float = 1.0,
) -> DataFrame:
    """Add ``choice``, an index drawn from the k likeliest entries in proportion.

    Without ``k`` the whole vector takes part, in its own order. A temperature of zero or less is
    the greedy choice. The draw depends on seed and key alone.
    """
    if temperature <= 0.0:
        return greedy_choice(df, scores)
    u = seeded_fraction(seed, F.col(key))
    with_probs = df.withColumn("_p", softmax(F.col(scores), temperature))
    if k is None:
        return with_probs.withColumn("choice", pick(F.col("_p"), u).cast("int")).drop("_p")
    best = with_probs.withColumn("_top", top_k(F.col("_p"), k))
    weights = F.transform("_top", lambda t: t["score"])
    chosen = F.get("_top", pick(weights, u))["index"]
    return best.withColumn("choice", chosen.cast("int")).drop("_p", "_top")
