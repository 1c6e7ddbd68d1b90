"""Lines repeated across documents: range-partitioned line hashes, streamed in document order.

Every line key gets a 128-bit hash. Rows (hash, document, position) are dealt to tasks by ranges
of hash and document, so a line that a third of all documents share spans many tasks, and sorted
within each. A task streams its rows: a hash that lies inside its range is complete and leaves the
task only if enough documents hold it; the first and the last hash of a range leave as partial
sums, which add up exactly because equal (hash, document) rows meet in one range. The result is a
compressed bitmap of kept lines for each document that loses any, never text.

A null or empty text is one empty line, too short for a key. Documents without an id count as one
document below all others. Repeated rows are one document; rows that share an id but not the text
count as one document and get a bitmap each. Columns other than the id and the text are kept as
they are; columns named like the outputs are replaced.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField

from tokenmill.llm.arrays import add_columns
from tokenmill.session import materialize

STRIPPED = " \t\n\x0b\x0c\r"
MIN_LENGTH = 40
MIN_DOCS = 5
NO_ID = -(1 << 63)


def _identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(_doc, _text_hash, _text): what a document is recognized by."""
    return docs.select(
        F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("_doc"),
        F.xxhash64(text).alias("_text_hash"),
        F.col(text).alias("_text"),
    )


def line_rows(docs: DataFrame, key: str, text: str, min_length: int = MIN_LENGTH) -> DataFrame:
    """(h1, h2, doc, text_hash, pos): a row for each line whose key is long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, at, positions = [], [], []
            for row, scalar in enumerate(batch.column("_text")):
                for pos, line in enumerate((scalar.as_py() or "").split("\n")):
                    line = line.strip(STRIPPED)
                    if len(line) >= min_length:
                        digests.append(xxhash.xxh3_128_digest(line.encode().lower()))
                        at.append(row)
                        positions.append(pos)
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.ascontiguousarray(halves[:, 0])),
                    pa.array(np.ascontiguousarray(halves[:, 1])),
                    batch.column("_doc").take(rows),
                    batch.column("_text_hash").take(rows),
                    pa.array(positions, pa.int32()),
                ],
                ["h1", "h2", "doc", "text_hash", "pos"],
            )

    schema = "h1 long, h2 long, doc long, text_hash long, pos int"
    return _identified(docs, key, text).mapInArrow(run, schema)


def _summaries(min_docs: int):
    """Stream sorted rows; yield (h1, h2, docs, last) of hashes, partial at the range's ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_run = None  # h1, h2, documents so far, last document, whether it began the range
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, doc = (batch.column(c).to_numpy() for c in ("h1", "h2", "doc"))
            new_hash = np.empty(len(h1), bool)
            new_hash[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            new_doc = np.empty(len(h1), bool)
            new_doc[1:] = doc[1:] != doc[:-1]
            new_hash[0] = open_run is None or (h1[0], h2[0]) != open_run[:2]
            new_doc[0] = open_run is None or doc[0] != open_run[3]
            new_doc |= new_hash
            starts = np.flatnonzero(new_hash)
            ends = np.append(starts[1:], len(h1))
            out = []
            head = starts[0] if len(starts) else len(h1)
            if head:
                docs = open_run[2] + int(new_doc[:head].sum())
                open_run = (*open_run[:2], docs, doc[head - 1], open_run[4])
            if len(starts):
                if open_run and (open_run[4] or open_run[2] >= min_docs):
                    out.append(open_run[:4])
                seen = np.cumsum(new_doc)
                counts = seen[ends - 1] - seen[starts] + 1
                full = counts[:-1] >= min_docs
                if open_run is None and len(full):
                    full[0] = True
                for i in np.flatnonzero(full):
                    out.append((h1[starts[i]], h2[starts[i]], counts[i], doc[ends[i] - 1]))
                first = open_run is None and len(starts) == 1
                open_run = (h1[-1], h2[-1], int(counts[-1]), doc[-1], first)
            yield _summary_batch(out)
        if open_run:
            yield _summary_batch([open_run[:4]])

    return run


def _summary_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = np.array(rows, np.int64).reshape(-1, 4)
    arrays = [pa.array(np.ascontiguousarray(columns[:, i])) for i in range(4)]
    return pa.RecordBatch.from_arrays(arrays, ["h1", "h2", "docs", "last"])


def repeated_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(h1, h2, docs, last): hashes that at least ``min_docs`` documents hold, and the largest id."""
    dealt = lines.select("h1", "h2", "doc").repartitionByRange("h1", "h2", "doc")
    streamed = dealt.sortWithinPartitions("h1", "h2", "doc").mapInArrow(
        _summaries(min_docs), "h1 long, h2 long, docs long, last long"
    )
    summed = streamed.groupBy("h1", "h2").agg(
        F.sum("docs").alias("docs"), F.max("last").alias("last")
    )
    return summed.where(F.col("docs") >= min_docs)


def pack(dropped: list[int]) -> bytes:
    """Compressed bitmap, a bit per line up to the last dropped one: 0 is kept, 1 is dropped."""
    bits = np.zeros(max(dropped) + 1, bool)
    bits[dropped] = True
    return zlib.compress(np.packbits(bits).tobytes())


def unpack(bitmap: bytes | None, n_lines: int) -> np.ndarray:
    keep = np.ones(n_lines, bool)
    if bitmap is not None:
        dropped = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:n_lines]
        keep[: len(dropped)] = dropped == 0
    return keep


def keep_bitmaps(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    min_docs: int = MIN_DOCS,
    min_length: int = MIN_LENGTH,
) -> DataFrame:
    """(doc, text_hash, keep_bitmap) of every document that loses a line.

    A repeated line stays only in the largest id that holds it.
    """
    lines = materialize(line_rows(docs, key, text, min_length), "line-hashes")
    repeated = materialize(repeated_lines(lines, min_docs), "repeated-lines")
    lost = lines.join(repeated, ["h1", "h2"]).where(F.col("doc") < F.col("last"))
    positions = lost.groupBy("doc", "text_hash").agg(F.collect_set("pos").alias("_dropped"))

    def kernel(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([pack(r.as_py()) for r in batch.column("_dropped")], pa.binary())]

    packed = add_columns(positions, [StructField("keep_bitmap", BinaryType())], kernel)
    return packed.drop("_dropped")


def with_bitmaps(docs: DataFrame, key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """``docs`` with ``keep_bitmap``, null where all lines stay."""
    bitmaps = keep_bitmaps(docs, key, text, **limits).select(
        F.col("doc").alias("_doc"), F.col("text_hash").alias("_text_hash"), "keep_bitmap"
    )
    kept = [c for c in docs.columns if c != "keep_bitmap"]
    named = docs.select(  # as one column, so that no name of theirs meets one of these
        F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_row"),
        F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("_doc"),
        F.xxhash64(text).alias("_text_hash"),
    )
    joined = named.join(bitmaps, ["_doc", "_text_hash"], "left")
    return joined.select("_row.*", "keep_bitmap")


def _kept(batch: pa.RecordBatch, text: str) -> Iterator[tuple[int, int, str]]:
    for scalar, bitmap in zip(batch.column(text), batch.column("keep_bitmap")):
        whole = scalar.as_py() or ""
        if not bitmap.is_valid:
            yield whole.count("\n") + 1, 0, whole
            continue
        lines = whole.split("\n")
        keep = unpack(bitmap.as_py(), len(lines))
        yield len(lines), int((~keep).sum()), "\n".join([x for x, k in zip(lines, keep) if k])


def digests(marked: DataFrame, text: str = "text") -> DataFrame:
    """``marked`` (with bitmaps) with n_lines, n_dropped and kept_sha256 in place of the bitmap."""

    def kernel(batch: pa.RecordBatch) -> list[pa.Array]:
        rows = [
            (n, dropped, hashlib.sha256(kept.encode()).hexdigest())
            for n, dropped, kept in _kept(batch, text)
        ]
        n, dropped, kept = zip(*rows)
        return [pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())]

    fields = [
        StructField("n_lines", LongType()),
        StructField("n_dropped", LongType()),
        StructField("kept_sha256", StringType()),
    ]
    return add_columns(marked, fields, kernel).drop("keep_bitmap")


def kept_text(marked: DataFrame, text: str = "text") -> DataFrame:
    """``marked`` with each text reduced to its kept lines; a null text becomes an empty one."""

    def kernel(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([kept for _, _, kept in _kept(batch, text)], pa.string())]

    columns = [c for c in marked.columns if c != "keep_bitmap"]
    return add_columns(marked, [StructField(text, StringType())], kernel).select(*columns)
