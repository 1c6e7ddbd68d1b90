"""Benchmark decontamination: shared n-grams as seeds, then Smith-Waterman alignment around them.

The score is twice the matched words, less one for each changed, missing or added word, over twice
the item's words; a document leaks an item if some stretch of it scores at least ``similarity``.
Seeds lose no such stretch. With s for the similarity and n for the item's words,

1. a stretch has at most 2(1-s)n added words, so it is no longer than n + 2(1-s)n words;
2. its matched words are at most n and each error parts at most two of them, so at least
   (2s-1)n - 1 pairs of neighbours match: that many places of its 2-grams are the item's.

All 2-grams of all items are seeds, frequent or not. Documents are read once per group of items, of
bounded size. Where a document holds that many seeds of an item within that many words, it is
aligned with the item, from the longest stretch before the first of them to the longest after the
last. False seeds only cost work. The second bound says nothing for items of up to 1/(2s-1) words
(5 at 0.6; all of them for similarities up to a half). Their seeds are single words: a stretch matches
at least sn of them, and every place with that many of the item's words is aligned. An item of one
word therefore leaks into every document that has the word.

Words are runs of characters other than the six ASCII white-space ones, all letters lower-cased.
Items without words are never found, null texts have none. Items that share
an id are all tried, the best counts. Rows that repeat are one leak; documents without an id are
found with a null id. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.arrays import Words, row_pieces, shingles, text_bytes
from tokenmill.session import materialize

GRAM = 2
SIMILARITY = 0.6
BITS_PER_GRAM = 64
MATCH, CHANGE, SKIP = 2, -1, -1
ALIGNED_CELLS = 1 << 18  # of one array of alignments
ITEM_WORDS = 1 << 20  # of one group of items
MATCHED_SEEDS = 1 << 21  # expanded at a time, or those of one document
ALIGNED_WORDS = 1 << 20  # of stretches handed over at a time, or one stretch


def _full_grams(
    hashes: np.ndarray, first: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram, row, word position in the row) of all whole n-grams of ``width`` words."""
    counts = np.diff(first)
    grams, offsets = shingles(hashes, first, width)
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(counts)), sizes)
    position = np.arange(len(grams)) - np.repeat(offsets[:-1], sizes)
    whole = counts[row] >= width
    return grams[whole], row[whole], position[whole]


def _lists(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])
    return pa.ListArray.from_arrays(
        pa.array(offsets.astype(np.int32)), pa.array(values[at].view(np.int64))
    )


def item_words(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, version, words): a row per distinct item text with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch.column("_text"))
            lists = _lists(words.hashes, words.first[:-1], words.first[1:])
            yield pa.RecordBatch.from_arrays([batch.column("_item"), lists], ["item", "words"])

    named = items.select(F.col(key).cast("long").alias("_item"), F.lower(text).alias("_text"))
    found = named.mapInArrow(run, "item long, words array<long>").where(F.size("words") > 0)
    return found.distinct().select("item", F.xxhash64("words").alias("version"), "words")


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.to_numpy().view(np.uint64)
    return values[offsets[0] : offsets[-1]], offsets - offsets[0]


class Seeds(NamedTuple):
    """The n-grams of a group of items, sorted, with a bit table to rule out most others."""

    table: np.ndarray
    grams: np.ndarray
    item: np.ndarray  # number of each gram's item in the group
    words: np.ndarray  # of all items
    first: np.ndarray
    ids: pa.Array
    longest: np.ndarray  # words of a stretch, by item
    least: np.ndarray  # places with seeds of a stretch, by item
    width: int  # words of a seed


def least_pairs(n: np.ndarray, similarity: float) -> np.ndarray:
    """Pairs of neighbours that match in a stretch; below 1 if there need not be any."""
    return np.ceil((2 * similarity - 1) * n - 1 - 1e-9).astype(np.int64)


def seeds(items: pa.Table, similarity: float, width: int = GRAM) -> Seeds:
    items = items.combine_chunks()
    words, first = _flat(items["words"].combine_chunks())
    grams, item, _ = _full_grams(words, first, width)
    order = np.lexsort((item, grams))
    grams, item = grams[order], item[order]
    new = np.append(True, (np.diff(grams) != 0) | (np.diff(item) != 0))
    grams, item = grams[new], item[new]
    bits = max(1 << 16, 1 << math.ceil(math.log2(BITS_PER_GRAM * max(len(grams), 1))))
    place = grams & np.uint64(bits - 1)
    table = np.zeros(bits // 64, np.uint64)
    np.bitwise_or.at(table, place >> np.uint64(6), np.uint64(1) << (place & np.uint64(63)))
    n = np.diff(first)
    longest = n + np.floor(2 * (1 - similarity) * n + 1e-9).astype(np.int64)
    matched = np.ceil(similarity * n - 1e-9).astype(np.int64)
    least = np.maximum(least_pairs(n, similarity) if width == GRAM else matched, 1)
    ids = items["item"].combine_chunks()
    return Seeds(table, grams, item, words, first, ids, longest, least, width)


def _hits(table: np.ndarray, grams: np.ndarray) -> np.ndarray:
    place = grams & np.uint64(len(table) * 64 - 1)
    return table[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1) > 0


def stretches(known: Seeds, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, item, begin, end) of all stretches that may reach the similarity; words of ``hashes``."""
    width = known.width
    grams, row, at = _full_grams(hashes, first, width)
    hit = np.flatnonzero(_hits(known.table, grams))
    low = np.searchsorted(known.grams, grams[hit], "left")
    amount = np.searchsorted(known.grams, grams[hit], "right") - low
    row, at = row[hit], at[hit]
    per_row = np.bincount(row, amount, len(first) - 1).astype(np.int64)
    of_row = np.searchsorted(row, np.arange(len(first)))
    for lo, hi in row_pieces(np.concatenate([[0], np.cumsum(per_row)]), MATCHED_SEEDS):
        part = slice(of_row[lo], of_row[hi])
        sizes = amount[part]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        if not offsets[-1]:
            continue
        entry = np.repeat(low[part] - offsets[:-1], sizes) + np.arange(offsets[-1])
        item, r, place = known.item[entry], np.repeat(row[part], sizes), np.repeat(at[part], sizes)
        order = np.lexsort((place, item, r))
        item, r, place = item[order], r[order], place[order]
        # A seed counts if it is one of ``least`` that follow each other within ``longest`` words.
        n, least, longest = len(item), known.least[item], known.longest[item]
        last = np.arange(n) + least - 1
        inside = np.flatnonzero(last < n)
        end = last[inside]
        inside = inside[
            (r[end] == r[inside]) & (item[end] == item[inside])
            & (place[end] + width - place[inside] <= longest[inside])
        ]
        change = np.zeros(n + 1, np.int64)
        np.add.at(change, inside, 1)
        np.add.at(change, last[inside] + 1, -1)
        good = np.flatnonzero(np.cumsum(change[:-1]) > 0)
        if not len(good):
            continue
        item, r, place, longest = item[good], r[good], place[good], longest[good]
        cut = np.flatnonzero(
            (np.diff(r) != 0) | (np.diff(item) != 0) | (np.diff(place) > longest[1:])
        ) + 1
        begin, last = np.append(0, cut), np.append(cut, len(item)) - 1
        r, item, longest = r[begin], item[begin], longest[begin]
        yield (
            r, item,
            np.maximum(first[r] + place[begin] + width - longest, first[r]),
            np.minimum(first[r] + place[last] + longest, first[r + 1]),
        )


def align(passages: list[np.ndarray], items: list[np.ndarray]) -> np.ndarray:
    """Best local alignment of each passage with its item, over twice the item's words."""
    best = np.zeros(len(passages))
    order = sorted(range(len(passages)), key=lambda x: (len(passages[x]), len(items[x])))
    while order:
        width = len(passages[order[-1]])
        few = max(1, ALIGNED_CELLS // max(width, 1))
        part, order = order[-few:], order[:-few]
        height = max(len(items[x]) for x in part)
        text = np.zeros((len(part), width), np.uint64)
        inside = np.zeros((len(part), width), bool)
        item = np.zeros((len(part), height), np.uint64)
        rows = np.zeros((len(part), height), bool)
        for i, x in enumerate(part):
            text[i, : len(passages[x])], inside[i, : len(passages[x])] = passages[x], True
            item[i, : len(items[x])], rows[i, : len(items[x])] = items[x], True
        score = np.zeros((len(part), width + 1), np.int32)
        top = np.zeros(len(part), np.int32)
        slope = np.arange(width + 1, dtype=np.int32) * -SKIP
        for r in range(height):
            same = (text == item[:, r, None]) & inside & rows[:, r, None]
            new = np.maximum(score + SKIP, 0)
            np.maximum(new[:, 1:], score[:, :-1] + np.where(same, MATCH, CHANGE), out=new[:, 1:])
            score = np.maximum.accumulate(new + slope, axis=1) - slope
            np.maximum(top, score.max(axis=1), out=top)
        best[part] = top / (MATCH * np.array([len(items[x]) for x in part]))
    return best


def _leaks_of(docs: DataFrame, known: Seeds, similarity: float) -> DataFrame:
    """(doc, item, score) of stretches of (_doc, _text) that reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text")
            for lo, hi in row_pieces(text_bytes(texts)[1]):
                words = Words(texts.slice(lo, hi - lo))
                for row, item, begin, end in stretches(known, words.hashes, words.first):
                    sizes = np.concatenate([[0], np.cumsum(end - begin)])
                    for a, b in row_pieces(sizes, ALIGNED_WORDS):
                        scores = align(
                            [words.hashes[x:y] for x, y in zip(begin[a:b], end[a:b])],
                            [known.words[known.first[i] : known.first[i + 1]] for i in item[a:b]],
                        )
                        near = np.flatnonzero(scores >= similarity)
                        if not len(near):
                            continue
                        yield pa.RecordBatch.from_arrays(
                            [
                                batch.column("_doc").take(pa.array(row[a:b][near] + lo)),
                                known.ids.take(pa.array(item[a:b][near])),
                                pa.array(scores[near]),
                            ],
                            ["doc", "item", "score"],
                        )

    return docs.mapInArrow(run, "doc long, item long, score double")


def leaks(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    similarity: float = SIMILARITY,
) -> DataFrame:
    """(key, item_key, similarity) of every document and item that leaks into it."""
    schema = f"`{key}` long, `{item_key}` long, similarity double"
    tested = materialize(item_words(items, item_key, item_text), "test-items")
    named = docs.select(F.col(key).cast("long").alias("_doc"), F.lower(text).alias("_text"))
    sizes = [r["n"] for r in tested.select(F.size("words").alias("n")).distinct().collect()]
    short = [n for n in sizes if least_pairs(np.array(n), similarity) < 1]
    is_short = F.size("words") <= max(short, default=0)
    found = []
    for width, some in ((GRAM, tested.where(~is_short)), (1, tested.where(is_short))):
        total = some.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
        groups = math.ceil(total / ITEM_WORDS)
        for group in range(groups):
            part = some.where(F.pmod("version", F.lit(groups)) == group).toArrow()
            if part.num_rows:
                found.append(_leaks_of(named, seeds(part, similarity, width), similarity))
    if not found:
        return docs.sparkSession.createDataFrame([], schema)
    return (
        reduce(DataFrame.unionAll, found)
        .groupBy(F.col("doc").alias(key), F.col("item").alias(item_key))
        .agg(F.max("score").alias("similarity"))
    )
