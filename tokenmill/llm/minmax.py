"""Near-duplicates by min-max hashing, confirmed on full shingle sets.

A document's set are the hashes of its distinct word shingles. Each permutation gives the set's
minimum and its maximum, so a signature needs half as many hash evaluations as values. Values are
banded; the number of bands follows from the threshold so that a pair just at it is missed with a
probability below MISS. Equal sets form one class, and only classes go on:

1. Classes that share a band with the smallest one of a bucket are hooked to it. Connected components
   of these hooks are groups: two classes that share any band are in one group.
2. A group's sets are compared in blocks of bounded size, every pair of blocks in its own task, so
   a group of any size spans many tasks. A task counts intersections from an inverted index, for
   one set against all others, and skips sets that are linked already: only links that join two
   parts leave it, never all pairs.
3. Connected components of the confirmed links are the result.

Words are runs of characters other than the six ASCII white-space ones, A-Z lower-cased. A document
with fewer words than a shingle has one shingle, all its words; without words (or text) its set is
empty and it is linked with nothing. Rows that share an id are one document. Rows without an id are
linked with nothing, have no component and are kept. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.arrays import (
    ODD,
    Words,
    distinct_per_row,
    mix,
    row_pieces,
    shingles,
    text_bytes,
)
from tokenmill.llm.components import components
from tokenmill.session import materialize

PERMUTATIONS_PER_BAND = 3  # two values each
MISS = 1e-7
BLOCK_SHINGLES = 100_000
BATCH_SHINGLES = 1 << 16


def band_count(percent: int) -> int:
    """Bands that miss a pair of ``percent`` similarity with a probability of at most MISS."""
    share = (percent / 100) ** (2 * PERMUTATIONS_PER_BAND)
    return max(1, math.ceil(math.log(MISS) / math.log1p(-share))) if percent < 100 else 1


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, values, offsets): the sets of a text column, a part at a time."""
    for begin, end in row_pieces(text_bytes(column)[1]):
        words = Words(column.slice(begin, end - begin))
        for lo, hi in row_pieces(words.first, BATCH_SHINGLES):
            first = words.first[lo : hi + 1]
            found = shingles(words.hashes[first[0] : first[-1]], first - first[0], width)
            yield begin + lo, begin + hi, *distinct_per_row(*found)


@lru_cache(maxsize=2)
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(7)
    return tuple(random.integers(0, 1 << 64, (2, n), np.uint64) | np.uint64(1))


def band_keys(values: np.ndarray, offsets: np.ndarray, bands: int) -> np.ndarray:
    """rows x bands: a key of the minima and maxima of each band; zeros for an empty set."""
    rows = len(offsets) - 1
    keys = np.zeros((rows, bands), np.uint64)
    full = np.flatnonzero(np.diff(offsets))
    if not len(full):
        return keys
    starts = offsets[full]
    shifts, factors = _permutations(bands * PERMUTATIONS_PER_BAND)
    for band in range(bands):
        key = np.full(len(full), band + 1, np.uint64)
        for p in range(band * PERMUTATIONS_PER_BAND, (band + 1) * PERMUTATIONS_PER_BAND):
            permuted = (values ^ shifts[p]) * factors[p]
            key = key * ODD + np.minimum.reduceat(permuted, starts)
            key = key * ODD + np.maximum.reduceat(permuted, starts)
        keys[full, band] = mix(key)
    return keys


def sketches(docs: DataFrame, key: str, text: str, width: int, bands: int) -> DataFrame:
    """(doc, n, f1, f2, bands): size, fingerprint and band keys of every document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("_text")
            for lo, hi, values, offsets in shingle_sets(column, width):
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(v)]) for v in (
                    mix(values), mix(values ^ ODD)
                )]
                f1, f2 = ((s[offsets[1:]] - s[offsets[:-1]]).view(np.int64) for s in sums)
                keys = band_keys(values, offsets, bands).view(np.int64)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), pa.array(keys.ravel())
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_doc").slice(lo, hi - lo), pa.array(np.diff(offsets)),
                        pa.array(f1), pa.array(f2), lists,
                    ],
                    ["doc", "n", "f1", "f2", "bands"],
                )

    named = docs.select(F.col(key).cast("long").alias("_doc"), F.col(text).alias("_text"))
    return named.mapInArrow(run, "doc long, n long, f1 long, f2 long, bands array<long>")


def candidate_groups(classes: DataFrame) -> DataFrame:
    """(node, group) of classes (doc, bands) that share a band with another class."""
    buckets = classes.select("doc", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.min("doc").alias("head"), F.max("doc").alias("last"))
    heads = materialize(shared.where(F.col("head") < F.col("last")).drop("last"), "band-heads")
    hooks = buckets.join(heads, "key").where(F.col("doc") > F.col("head"))
    edges = materialize(
        hooks.select(F.col("doc").alias("a"), F.col("head").alias("b")).distinct(), "band-hooks"
    )
    found = components(edges)
    grouped = found.unionByName(
        found.select(F.col("component").alias("node"), "component").distinct()
    )
    return grouped.select("node", F.col("component").alias("group"))


def _blocked(members: DataFrame) -> DataFrame:
    """(node, group, i, j): a row for each pair of blocks that a member takes part in."""
    sizes = members.groupBy("group").agg(F.sum("n").alias("_total"))
    blocks = materialize(
        sizes.select(
            "group", F.ceil(F.col("_total") / F.lit(BLOCK_SHINGLES)).cast("long").alias("_blocks")
        ),
        "group-blocks",
    )
    own = F.pmod(F.xxhash64("node", F.lit(11)), F.col("_blocks"))
    other = F.explode(F.expr("sequence(0L, _blocks - 1)"))
    return (
        members.join(blocks, "group")
        .select("node", "group", own.alias("_own"), other.alias("_other"))
        .select(
            "node", "group", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j")
        )
    )


class _Parts:
    """Disjoint sets of numbers, the size of each part at its root."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.size = [1] * n

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        a, b = (a, b) if self.size[a] >= self.size[b] else (b, a)
        self.parent[b] = a
        self.size[a] += self.size[b]
        return True


def confirmed_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect all sets which pairs of at least ``percent`` similarity connect.

    Every set outside the largest part is compared with all others; pairs inside it need not be.
    """
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    values, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    parts, links = _Parts(n), []
    done = [False] * n
    largest = 0

    def compare(one: int) -> None:
        low = np.searchsorted(values, sets[one], "left")
        high = np.searchsorted(values, sets[one], "right")
        spans = high - low
        at = np.repeat(low - (np.cumsum(spans) - spans), spans) + np.arange(spans.sum())
        common = np.bincount(owner[at], minlength=n)
        near = np.flatnonzero(100 * common >= percent * (sizes + sizes[one] - common))
        for other in near.tolist():
            if other != one and parts.join(one, other):
                links.append((one, other))

    compare(0)
    done[0] = True
    while True:
        waiting = [x for x in range(n) if not done[x] and parts.find(x) != parts.find(largest)]
        if not waiting:
            return links
        for x in waiting:
            if parts.find(x) == parts.find(largest):
                continue
            compare(x)
            done[x] = True
            if parts.size[parts.find(x)] > parts.size[parts.find(largest)]:
                largest = x


def links(docs: DataFrame, members: DataFrame, key: str, text: str, width: int, percent: int):
    """(a, b): confirmed links between members (node, group, n) that connect each component."""
    wanted = members.select(F.col("node").alias("_doc"))
    chosen = docs.select(F.col(key).cast("long").alias("_doc"), F.col(text).alias("_text")).join(
        wanted, "_doc", "left_semi"
    )

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, values, offsets in shingle_sets(batch.column("_text"), width):
                rows = [values[a:b].tobytes() for a, b in zip(offsets, offsets[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_doc").slice(lo, hi - lo), pa.array(rows, pa.binary())],
                    ["node", "shingles"],
                )

    sets = chosen.mapInArrow(make, "node long, shingles binary")
    placed = sets.join(_blocked(members), "node")

    def compare(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_numpy()
        rows = [np.frombuffer(s.as_py(), np.uint64) for s in table.column("shingles")]
        parts = _Parts(len(rows))
        for one, other in confirmed_links(rows, percent):
            parts.join(one, other)
        # Links of a part become a star: what lies in one block needs no further contraction.
        roots = np.array([parts.find(x) for x in range(len(rows))])
        smallest = np.full(len(rows), np.iinfo(np.int64).max)
        np.minimum.at(smallest, roots, nodes)
        hub = smallest[roots]
        return pa.table({"a": nodes[nodes != hub], "b": hub[nodes != hub]})

    return placed.groupBy("group", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row."""
    bands = band_count(percent)
    made = materialize(sketches(docs, key, text, width, bands), "sketches")
    known = made.where((F.col("n") > 0) & F.col("doc").isNotNull())
    classes = materialize(
        known.groupBy("f1", "f2").agg(
            F.min("doc").alias("doc"), F.max("n").alias("n"), F.first("bands").alias("bands")
        ),
        "set-classes",
    )
    groups = materialize(candidate_groups(classes.select("doc", "bands")), "candidate-groups")
    sizes = classes.groupBy(F.col("doc").alias("node")).agg(F.max("n").alias("n"))
    members = materialize(groups.join(sizes, "node"), "group-members")
    found = materialize(links(docs, members, key, text, width, percent), "links")
    # Rows that share an id are one document, whatever their sets.
    several = known.groupBy("doc").agg(
        F.min(F.struct("f1", "f2")).alias("x"), F.max(F.struct("f1", "f2")).alias("y")
    )
    several = several.where(F.col("x") != F.col("y")).select("doc")
    repeated = known.join(several, "doc", "left_semi").select("f1", "f2", F.col("doc").alias("a"))
    hooks = repeated.join(classes.select("f1", "f2", F.col("doc").alias("b")), ["f1", "f2"])
    labels = components(found.unionByName(hooks.select("a", "b")))
    named = classes.select("f1", "f2", F.col("doc").alias("node")).join(labels, "node", "left")
    component = F.when(
        F.col("n") > 0, F.coalesce("component", "node", "doc")
    ).otherwise(F.col("doc"))
    return (
        made.select("doc", "n", "f1", "f2")
        .join(named, ["f1", "f2"], "left")
        .select(
            F.col("doc").alias(key),
            F.col("n").alias("n_shingles"),
            F.when(F.col("doc").isNotNull(), component).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
    )
