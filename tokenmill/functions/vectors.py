"""Expressions over score vectors (arrays of floating-point numbers)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, also where ``use`` reads it in a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def vector_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def softmax(scores: Column, temperature: float = 1.0, floor: float = 0.0) -> Column:
    """Probabilities of a score vector. The maximum is subtracted first so exp cannot overflow."""
    divisor = F.lit(float(max(temperature, floor)))
    scaled = F.transform(scores, lambda x: x.cast("double") / divisor)
    powers = bind(
        scaled,
        lambda s: bind(F.array_max(s), lambda m: F.transform(s, lambda x: F.exp(x - m))),
    )
    return bind(
        powers, lambda p: bind(vector_sum(p), lambda t: F.transform(p, lambda x: x / t))
    )


def top_k(scores: Column, k: int) -> Column:
    """array<struct<rank,index,score>> of the k largest scores; ties go to the lower index."""
    keyed = F.transform(scores, lambda x, i: F.struct((-x).alias("neg"), i.alias("index")))
    best = F.slice(F.array_sort(keyed), 1, k)
    return F.transform(
        best,
        lambda e, r: F.struct(
            (r + 1).alias("rank"), e["index"].alias("index"), (-e["neg"]).alias("score")
        ),
    )


def argmax(scores: Column) -> Column:
    """Index of the largest score, the first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def pick(weights: Column, u: Column) -> Column:
    """Index drawn in proportion to ``weights`` by a uniform ``u`` in [0, 1).

    One pass: carry the running sum and the number of entries whose running sum stays at or
    below ``u * total``.
    """
    start = F.struct(F.lit(0.0).alias("mass"), F.lit(0).alias("below"))
    passed = bind(
        u * vector_sum(weights),
        lambda target: F.aggregate(
            weights,
            start,
            lambda acc, w: F.struct(
                (acc["mass"] + w).alias("mass"),
                (acc["below"] + (acc["mass"] + w <= target).cast("int")).alias("below"),
            ),
            lambda acc: acc["below"],
        ),
    )
    return F.least(passed, F.size(weights) - 1)


def abs_difference(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: F.abs(a.cast("double") - b.cast("double")))


def equal_positions(left: Column, right: Column) -> Column:
    """Number of positions, up to the shorter length, that hold equal values."""
    return F.size(F.filter(F.zip_with(left, right, lambda a, b: a == b), lambda same: same))

