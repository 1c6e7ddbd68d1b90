"""Array arithmetic on text columns: byte views, word and shingle hashes, added columns.

Everything here works on one Arrow batch at a time, in pieces of about a megabyte of text, so
memory follows neither the batch nor the longest text by more than a small factor. A null text
counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

PIECE = 1 << 20
POWERS = PIECE + (PIECE >> 3)  # bytes that kept powers are enough for: a piece and the ends of its rows
ODD = np.uint64(0x9E3779B97F4A7C15)


def byte_class(members: bytes) -> np.ndarray:
    """Lookup table of 256 entries, true for the given bytes."""
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


SPACE = byte_class(b" \t\n\x0b\x0c\r")
_WORD = ~SPACE
_CODES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER_CODES = _CODES.copy()
_LOWER_CODES[65:91] = _CODES[97:123]


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed one-to-one scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column, without a copy of the text where it has no null."""
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize)
    at = at.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _power_rows(n + 1)


def _power_rows(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(ODD), -1, 1 << 64))
    rows = []
    for base in (ODD, inverse):
        row = np.full(n, base, np.uint64)
        row[0] = 1
        rows.append(np.multiply.accumulate(row))
    return rows[0], rows[1]


class Words:
    """The words of a text column: runs of bytes other than the six ASCII white-space ones.

    ``hashes``, ``starts`` and ``ends`` have an entry per word (byte positions in ``data``);
    ``first`` has the number of each row's first word, and the total at its end.
    """

    def __init__(self, column: pa.Array, lower: bool = True):
        self.data, self.offsets = text_bytes(column)
        codes = _LOWER_CODES if lower else _CODES
        row_start = np.zeros(len(self.data) + 1, bool)
        row_start[self.offsets] = True
        parts = [_piece(self.data, row_start, lo, hi, codes) for lo, hi in self._pieces(row_start)]
        if parts:
            self.starts, self.ends, self.hashes = (np.concatenate(p) for p in zip(*parts))
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
            self.hashes = np.zeros(0, np.uint64)
        self.first = np.searchsorted(self.starts, self.offsets)

    def _pieces(self, row_start: np.ndarray) -> Iterator[tuple[int, int]]:
        """Byte ranges of about PIECE that cut no word."""
        lo, n = 0, len(self.data)
        while lo < n:
            hi = min(lo + PIECE, n)
            if hi < n and not row_start[hi]:
                free = SPACE[self.data[lo:hi]] | row_start[lo + 1 : hi + 1]
                back = np.flatnonzero(free[::-1][:4096])
                if not len(back):
                    back = np.flatnonzero(free[::-1])
                if len(back):
                    hi -= int(back[0])
                else:  # one word longer than a piece
                    while hi < n:
                        ahead = SPACE[self.data[hi : hi + PIECE]] | row_start[hi : hi + PIECE][
                            : len(self.data[hi : hi + PIECE])
                        ]
                        found = np.flatnonzero(ahead)
                        hi = hi + int(found[0]) if len(found) else min(hi + PIECE, n)
                        if len(found):
                            break
            yield lo, hi
            lo = hi

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def _piece(data, row_start, lo, hi, codes):
    raw = data[lo:hi]
    word = _WORD[raw]
    begin = word.copy()
    begin[1:] &= ~word[:-1] | row_start[lo + 1 : hi]
    end = word.copy()
    end[:-1] &= ~word[1:] | row_start[lo + 1 : hi]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts + lo, ends + lo, run_hashes(raw, starts, ends, codes)


def run_hashes(
    raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray = _CODES
) -> np.ndarray:
    """Hashes of runs of bytes, from one running sum; they do not depend on where a run lies."""
    if len(raw) <= POWERS:
        power, inverse = _powers(POWERS if len(raw) > POWERS // 2 else POWERS // 2)
    else:
        power, inverse = _power_rows(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    terms = codes[raw]
    terms *= power[: len(raw)]
    np.cumsum(terms, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, row offsets) of all runs of ``width`` words of each row, in order, with repeats.

    A row with fewer words has one, the whole sequence; a row without words has none.
    """
    counts = np.diff(first)
    n = len(hashes)
    full = np.maximum(counts - width + 1, 0)
    amounts = np.where(counts == 0, 0, np.maximum(full, 1))
    offsets = np.concatenate([[0], np.cumsum(amounts)])
    if n == 0:
        return np.zeros(0, np.uint64), offsets
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled[: n - k] = rolled[: n - k] * ODD + hashes[k:] if k else hashes
    at = np.repeat(first[:-1] - offsets[:-1], amounts) + np.arange(offsets[-1])
    out = rolled[at]
    for k in range(1, width):
        rows = np.flatnonzero(counts == k)
        if len(rows):
            whole = np.zeros(len(rows), np.uint64)
            for j in range(k):
                whole = whole * ODD + hashes[first[rows] + j]
            out[offsets[rows]] = whole + np.uint64(k)
    return mix(out), offsets


def distinct_per_row(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets): each row's distinct values in ascending order."""
    sets = [np.unique(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
    sizes = np.fromiter((len(s) for s in sets), np.int64, len(sets))
    joined = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return joined, np.concatenate([[0], np.cumsum(sizes)])


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values of each row; 0 for an empty one."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def row_pieces(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` units in all; a longer row is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def text_slabs(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, pa.Array]]:
    """(number of the first row, texts): whole rows of about ``limit`` bytes in all, or part of one.

    A row of more than twice the limit comes in several arrays of one text each, cut in front of white
    space, so that no word is cut.
    """
    data, offsets = text_bytes(column)
    for lo, hi in row_pieces(offsets, limit):
        at, end = int(offsets[lo]), int(offsets[hi])
        if hi - lo > 1 or end - at <= 2 * limit:
            yield lo, _texts(data[at:end], offsets[lo : hi + 1] - at)
            continue
        while at < end:
            cut = min(at + limit, end)
            while cut < end and not SPACE[data[cut]]:
                found = np.flatnonzero(SPACE[data[cut : min(cut + limit, end)]])
                cut = cut + int(found[0]) if len(found) else min(cut + limit, end)
            yield lo, _texts(data[at:cut], np.array([0, cut - at]))
            at = cut


def _texts(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    buffers = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, buffers)


def add_columns(
    df: DataFrame,
    fields: Sequence[StructField],
    kernel: Callable[[pa.RecordBatch], Sequence[pa.Array]],
) -> DataFrame:
    """``df`` with columns that ``kernel`` computes from whole batches; equal names are replaced."""
    new = {f.name.lower() for f in fields}
    kept = [f.name for f in df.schema if f.name.lower() not in new]
    schema = StructType([df.schema[name] for name in kept] + list(fields))
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                old = [batch.column(name) for name in kept]
                yield pa.RecordBatch.from_arrays([*old, *kernel(batch)], names)

    return df.mapInArrow(run, schema)


def hash_sample(key: Column, share: float, seed: int) -> Column:
    """Keeps about ``share`` of the keys, the same ones on any cluster."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
