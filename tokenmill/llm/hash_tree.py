"""Shards as the leaves of a weighted hash tree: region, rack, shard.

From the root on, every child of a node draws -ln(u) / weight for a document, where u is a hash of
the document's key and the child's name and the weight is the sum of the child's leaves; the
smallest draw wins. A draw depends on nothing but its own child, so a changed weight moves
documents into or out of the subtrees whose weights changed and nowhere else. A shard that is
added as a region of its own therefore takes documents only into itself.

All of it is column expressions, as large as the tree has nodes. A null key is hashed like a key
named ``null``. Documents that repeat get the same shard and slots of their own. Slots number a
shard's documents from 0 in the order of key, size and checksum. An empty table has no slots.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.operators import order
from tokenmill.session import materialize

LAW = "key"
REPEATS_PER_ROW = 1 << 16


@dataclass(frozen=True)
class Node:
    """An inner node has children; a leaf has a shard number and a weight."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int | None = None
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def leaf(name: str, shard: int, weight: float = 1.0) -> Node:
    return Node(name, shard=shard, own_weight=weight)


def even_tree(regions: int, racks: int, shards: int) -> Node:
    """``regions`` of ``racks`` of ``shards`` equal leaves, numbered in order."""
    number = 0
    top = []
    for r in range(regions):
        middle = []
        for k in range(racks):
            leaves = tuple(leaf(f"{r}/{k}/{s}", number + s) for s in range(shards))
            number += shards
            middle.append(Node(f"{r}/{k}", leaves))
        top.append(Node(f"{r}", tuple(middle)))
    return Node("", tuple(top))


def with_shard(tree: Node, shard: int, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a region and rack of its own."""
    name = str(len(tree.children))
    rack = Node(f"{name}/0", (leaf(f"{name}/0/0", shard, weight),))
    return Node(tree.name, (*tree.children, Node(name, (rack,))))


def _draw(key: Column, node: Node) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(F.concat(key, F.lit(f":{node.name}"))), 11)
    uniform = (bits.cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(uniform) / F.lit(float(node.weight))


def shard_of(key: Column, tree: Node) -> Column:
    """The shard of a key, descending from the root."""
    text = F.coalesce(key.cast("string"), F.lit("null"))
    return _descend(text, tree)


def _descend(key: Column, node: Node) -> Column:
    if not node.children:
        return F.lit(node.shard).cast("int")
    if len(node.children) == 1:
        return _descend(key, node.children[0])
    draws = F.array(*[_draw(key, child) for child in node.children])
    chosen = F.array_position(draws, F.array_min(draws))
    below = F.when(chosen == 1, _descend(key, node.children[0]))
    for number, child in enumerate(node.children[1:], 2):
        below = below.when(chosen == number, _descend(key, child))
    return below


def assign(docs: DataFrame, tree: Node, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard): size is the text's UTF-8 bytes plus 1."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        shard_of(F.col(key), tree).alias("shard"),
    )


def with_slots(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """``rows`` with ``slot``, their rank within the shard.

    Equal rows are counted before anything is ordered. Ranges of the key are summed per shard, and
    a window runs only within a range, never over a shard.
    """
    columns = rows.columns
    counted = materialize(rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")), "shard-rows")
    ranges = order.key_ranges(counted.select(key).dropna(), key)
    bucketed = ranges.add(counted).withColumn(
        order.BUCKET, F.coalesce(F.col(order.BUCKET), F.lit(-1).cast("long"))
    )
    bases = order.bucket_bases(bucketed, F.col("_n"), by=["shard"])
    rest = [c for c in columns if c not in (key, "shard")]
    placed = order.place(bucketed, bases, [key, *rest], F.col("_n"), by=["shard"], out="_start")
    parts = F.expr(f"explode(sequence(0L, (_n - 1) div {REPEATS_PER_ROW}L))")
    blocks = placed.select(*columns, "_start", "_n", parts.alias("_part"))
    last = F.least(F.col("_n"), (F.col("_part") + 1) * REPEATS_PER_ROW) - 1
    slots = F.explode(F.sequence(F.col("_part") * REPEATS_PER_ROW, last))
    return blocks.select(*columns, "_start", slots.alias("_i")).select(
        *columns, (F.col("_start") + F.col("_i")).alias("slot")
    )
