"""Connected components by alternating star contractions, each round written out.

Every round hooks the larger neighbors of a node to its smallest one, then the smaller ones; the
number of rounds grows with the logarithm of the largest component. Rows are edges, nothing is
collected, and a node of very many edges is pre-aggregated before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.session import materialize


def _fingerprint(edges: DataFrame) -> tuple:
    sums = edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))
    ).first()
    return tuple(sums)


def _smallest(neighbors: DataFrame) -> DataFrame:
    """(n, m): the smallest of a node and its neighbors.

    It is written, so that the join with it is an ordinary one: broadcast if its size allows, else
    a shuffle whose hot nodes adaptive execution can split.
    """
    found = neighbors.groupBy("n").agg(F.least(F.min("o"), F.col("n")).alias("m"))
    return materialize(found, "smallest")


def _large_star(edges: DataFrame) -> DataFrame:
    """Edges (a, b) from every larger neighbor of a node to the smallest one; rows may repeat."""
    ends = F.array(
        F.struct(F.col("a").alias("n"), F.col("b").alias("o")),
        F.struct(F.col("b").alias("n"), F.col("a").alias("o")),
    )
    both = edges.select(F.explode(ends).alias("e")).select("e.n", "e.o")
    joined = both.join(_smallest(both), "n").where(F.col("o") > F.col("n"))
    return joined.select(F.col("o").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges from a node and its smaller neighbors to the smallest of them."""
    down = edges.select(
        F.greatest("a", "b").alias("n"), F.least("a", "b").alias("o")
    ).where(F.col("n") > F.col("o"))
    joined = down.join(_smallest(down), "n")
    hooked = F.explode(F.array("n", "o")).alias("a")
    return joined.select(hooked, F.col("m").alias("b")).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for each node of the edges (a, b)."""
    state = materialize(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where(F.col("a") != F.col("b"))
        .distinct(),
        "edges",
    )
    before = _fingerprint(state)
    while True:
        state = materialize(_small_star(materialize(_large_star(state), "hooks")), "stars")
        after = _fingerprint(state)
        if after == before:
            break
        before = after
    return state.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
