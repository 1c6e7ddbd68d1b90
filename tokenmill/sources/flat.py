"""Flat binary caches: plain files of ids that trainers map into memory.

Layout (fixed, all little-endian):

- ``<prefix>.tokens.bin``: the token stream as uint32, nothing else;
- ``<prefix>.input_ids.bin`` and ``<prefix>.labels.bin``: ids and labels of fine-tuning rows as int32, one
  row after the other without gaps; ``<prefix>.offsets.npy``: int64[N, 2], start and length of each row;
- ``<prefix>.tokens.meta.json`` or ``<prefix>.meta.json``: counts and settings, written last.

Both directions are data sources of Spark. A reading task gets a range of bytes and reads it a few
megabytes at a time. A writing task puts every row at the place its position names, so tasks need no
order, rows are not shuffled, and a task that runs twice writes the same bytes twice. The files grow
under another name and get theirs, and the manifest, once all rows are there and no gap is left.

Files are read from anywhere Arrow's file systems reach. They are written to folders that all
executors see as local ones: what cannot be written in the middle cannot be mapped either.
"""

from __future__ import annotations

import io
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from tokenmill.functions.sequences import IGNORE_INDEX

TOKENS, EXAMPLES = "flat_tokens", "flat_examples"
WIDTH = 4  # bytes of an id or label
PAIR = 16  # bytes of a row's start and length
SPLIT_BYTES = 128 << 20
MOST_RANGES = 256  # of a file that is read in ranges of less than SPLIT_BYTES
READ_BYTES = 4 << 20
CHUNK = 1024
TOKEN_SCHEMA = "chunk_id long, ids array<int>, next_id int"
EXAMPLE_SCHEMA = "index long, start long, length int, input_ids array<int>, labels array<int>"


def token_files(prefix: str) -> tuple[str, str]:
    return f"{prefix}.tokens.bin", f"{prefix}.tokens.meta.json"


def example_files(prefix: str) -> tuple[str, str, str, str]:
    return tuple(f"{prefix}.{x}" for x in ("input_ids.bin", "labels.bin", "offsets.npy", "meta.json"))


class ByteRange:
    """Reads of one file, by place."""

    def __init__(self, path: str):
        system, name = _file_system(path)
        self.size = system.get_file_info(name).size
        if self.size is None:
            raise FileNotFoundError(path)
        self._file = system.open_input_file(name)

    def read(self, at: int, size: int) -> bytes:
        found = self._file.read_at(size, at)
        if len(found) < size:
            raise EOFError(f"the file ends at {at + len(found)}, not {at + size}")
        return found


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), local_path(path)
    return fs.FileSystem.from_uri(path)


def local_path(path: str) -> str:
    """The path as the operating system has it; raises if it names another kind of storage."""
    if path.startswith("file:"):
        return "/" + path[len("file:") :].lstrip("/")
    if "://" in path:
        raise ValueError(f"flat caches are written to folders that every executor mounts, not to {path}")
    return path


def read_meta(path: str) -> dict | None:
    """The manifest, or None if there is none."""
    system, name = _file_system(path)
    if system.get_file_info(name).type != fs.FileType.File:
        return None
    return json.loads(system.open_input_file(name).read())


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


@dataclass
class Range(InputPartition):
    """Rows ``first`` to ``last`` - 1 of a file: chunks or examples."""

    first: int
    last: int


def _ranges(first: int, last: int, rows: int) -> list[Range]:
    return [Range(i, min(i + rows, last)) for i in range(first, last, rows)]


def _range_bytes(size: int, split: int) -> int:
    """``split``, or more: a task starts at a cost, so small ranges grow with the file up to SPLIT_BYTES."""
    return max(split, min(-(-size // MOST_RANGES), SPLIT_BYTES))


class TokenReader(DataSourceReader):
    """(chunk_id, ids, next_id) of chunks of ``size`` ids, all or those of the ids from lo to hi - 1."""

    def __init__(self, options: dict):
        self.path, meta = token_files(options["path"])
        self.chunk = int(options.get("chunk", CHUNK))
        self.split = int(options.get("split", SPLIT_BYTES))
        size = ByteRange(self.path).size
        if size % WIDTH:
            raise ValueError(f"{self.path} has {size} bytes, which are no whole ids")
        self.total = size // WIDTH
        known = read_meta(meta)
        if known is not None and known["num_tokens"] != self.total:
            raise ValueError(f"{self.path} has {self.total} ids, its manifest {known['num_tokens']}")
        self.lo = max(int(options.get("lo", 0)), 0)
        self.hi = min(int(options.get("hi", self.total)), self.total)

    def partitions(self) -> list[Range]:
        size = _range_bytes((self.hi - self.lo) * WIDTH, self.split)
        rows = max(size // (WIDTH * self.chunk), 1)
        ranges = _ranges(self.lo // self.chunk, -(-self.hi // self.chunk), rows)
        return (ranges if self.hi > self.lo else []) or [Range(0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        """The range's ids, and the one that follows it."""
        if partition.first == partition.last:
            return
        source = ByteRange(self.path)
        step = max(READ_BYTES // (WIDTH * self.chunk), 1)
        for part in _ranges(partition.first, partition.last, step):
            lo, hi = part.first * self.chunk, min(part.last * self.chunk, self.total)
            more = min(hi + 1, self.total)
            found = np.frombuffer(source.read(lo * WIDTH, (more - lo) * WIDTH), "<u4")
            if len(found) and found.max() > 0x7FFFFFFF:
                raise ValueError(f"{self.path} has an id above 2^31 - 1")
            found = found.view("<i4")
            ends = np.minimum(np.arange(part.first + 1, part.last + 1) * self.chunk, hi) - lo
            after = [int(found[e]) if e < len(found) else None for e in ends]
            columns = [
                pa.array(np.arange(part.first, part.last)), _lists(found[: hi - lo], ends),
                pa.array(after, pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["chunk_id", "ids", "next_id"])


class ExampleReader(DataSourceReader):
    """(index, start, length, input_ids, labels) of fine-tuning rows, in ranges of rows."""

    def __init__(self, options: dict):
        self.ids, self.labels, self.offsets, meta = example_files(options["path"])
        split = int(options.get("split", SPLIT_BYTES))
        sizes = [ByteRange(p).size for p in (self.ids, self.labels)]
        self.rows, self.body = _npy_rows(ByteRange(self.offsets))
        known = read_meta(meta)
        tokens = sizes[0] // WIDTH
        if sizes[0] != sizes[1] or sizes[0] % WIDTH:
            raise ValueError(f"{self.ids} and {self.labels} do not have as many whole numbers")
        if known is not None and (known["num_samples"], known["num_tokens"]) != (self.rows, tokens):
            raise ValueError(f"{self.ids} does not have what its manifest says")
        size = 2 * sizes[0] + PAIR * self.rows
        parts = max(-(-size // _range_bytes(size, split)), 1)
        self.per_part = max(-(-self.rows // parts), 1)

    def partitions(self) -> list[Range]:
        return _ranges(0, self.rows, self.per_part) or [Range(0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.first == partition.last:
            return
        ids, labels, offsets = map(ByteRange, (self.ids, self.labels, self.offsets))
        for part in _ranges(partition.first, partition.last, READ_BYTES // PAIR):
            raw = offsets.read(self.body + part.first * PAIR, (part.last - part.first) * PAIR)
            starts, lengths = np.frombuffer(raw, "<i8").reshape(-1, 2).T
            ends = starts + lengths
            if (starts[1:] != ends[:-1]).any():
                raise ValueError(f"rows of {self.offsets} do not follow each other")
            a = 0
            while a < len(starts):
                b = int(np.searchsorted(ends, starts[a] + READ_BYTES // WIDTH, side="right"))
                b = max(b, a + 1)
                at, size = int(starts[a]) * WIDTH, int(ends[b - 1] - starts[a]) * WIDTH
                found = [np.frombuffer(x.read(at, size), "<i4") for x in (ids, labels)]
                columns = [
                    pa.array(np.arange(part.first + a, part.first + b)),
                    pa.array(starts[a:b]), pa.array(lengths[a:b].astype(np.int32)),
                    *(_lists(x, ends[a:b] - starts[a]) for x in found),
                ]
                names = ["index", "start", "length", "input_ids", "labels"]
                yield pa.RecordBatch.from_arrays(columns, names)
                a = b


def _npy_rows(source: ByteRange) -> tuple[int, int]:
    """(rows, bytes of the header) of an int64[N, 2] array; an empty one may have any shape."""
    head = io.BytesIO(source.read(0, min(source.size, 4096)))
    version = np.lib.format.read_magic(head)
    read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}
    shape, fortran, dtype = read[version](head)
    empty = 0 in shape
    if fortran or dtype != np.dtype("<i8") or not (empty or (len(shape) == 2 and shape[1] == 2)):
        raise ValueError(f"offsets are {dtype}{list(shape)}, not int64[N, 2]")
    return (0 if empty else shape[0]), head.tell()


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: rows, ids, the ends of the last row and of the last id."""

    rows: int = 0
    ids: int = 0
    last_row: int = 0
    last_id: int = 0


class _PlacedWriter(DataSourceArrowWriter):
    """Files that tasks fill at places of their own."""

    def __init__(self, options: dict, overwrite: bool, names: tuple[str, ...]):
        self.entries = json.loads(options.get("entries", "{}"))
        self.names = tuple(map(local_path, names))
        mark = uuid.uuid4().hex
        self.growing = tuple(f"{n}.{mark}.part" for n in self.names)
        if not overwrite and os.path.exists(self.names[-1]):
            raise FileExistsError(f"{self.names[-1]} exists")
        os.makedirs(PurePosixPath(self.names[0]).parent, exist_ok=True)
        for name in self.growing[:-1]:
            open(name, "wb").close()

    def abort(self, messages) -> None:
        for name in self.growing:
            if os.path.exists(name):
                os.unlink(name)

    def _finish(self, messages: list[Written | None], entries: dict) -> None:
        """Names the files, the manifest last; refuses gaps and doubles."""
        done = [m for m in messages if m is not None]
        rows, ids = sum(m.rows for m in done), sum(m.ids for m in done)
        last_row = max((m.last_row for m in done), default=0)
        last_id = max((m.last_id for m in done), default=0)
        if (rows, ids) != (last_row, last_id):
            self.abort(messages)
            raise ValueError(f"{rows} rows with {ids} ids end at row {last_row} and id {last_id}")
        with open(self.growing[-1], "w", encoding="utf-8") as out:
            json.dump({**self.entries, **entries}, out, indent=2)
        if os.path.exists(self.names[-1]):
            os.unlink(self.names[-1])  # an old manifest never names new files
        for growing, name in zip(self.growing, self.names):
            os.replace(growing, name)


def _put(file: int, starts: np.ndarray, lengths: np.ndarray, values: np.ndarray, width: int) -> None:
    """Write runs of rows that follow each other; ``values`` has all rows one after the other."""
    if not len(starts):
        return
    ends = np.cumsum(lengths)
    breaks = np.flatnonzero(starts[1:] != (starts + lengths)[:-1]) + 1
    data = memoryview(np.ascontiguousarray(values)).cast("B")
    for a, b in zip(np.append(0, breaks), np.append(breaks, len(starts))):
        at = int(starts[a]) * width
        part = data[int(ends[a] - lengths[a]) * width : int(ends[b - 1]) * width]
        while len(part):
            n = os.pwrite(file, part, at)
            part, at = part[n:], at + n


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, values) of a list column."""
    if column.null_count or column.flatten().null_count:
        raise ValueError("a flat cache has no place for nulls")
    lengths = column.value_lengths().to_numpy().astype(np.int64)
    return lengths, column.flatten().to_numpy()


class TokenWriter(_PlacedWriter):
    """Rows (chunk_id, ids): chunk c has the ids from ``c * chunk`` on."""

    def __init__(self, options: dict, overwrite: bool):
        super().__init__(options, overwrite, token_files(options["path"]))
        self.chunk = int(options.get("chunk", CHUNK))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done = Written()
        file = os.open(self.growing[0], os.O_WRONLY)
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                chunks = batch.column("chunk_id").to_numpy().astype(np.int64)
                lengths, values = _flat(batch.column("ids"))
                if lengths.max() > self.chunk:
                    raise ValueError(f"a chunk has more than {self.chunk} ids")
                starts = chunks * self.chunk
                _put(file, starts, lengths, values.astype("<u4"), WIDTH)
                done.rows += len(chunks)
                done.ids += int(lengths.sum())
                done.last_row = max(done.last_row, int(chunks.max()) + 1)
                done.last_id = max(done.last_id, int((starts + lengths).max()))
            os.fsync(file)
        finally:
            os.close(file)
        return done

    def commit(self, messages: list[Written | None]) -> None:
        ids = sum(m.ids for m in messages if m is not None)
        entries = {"dtype": "uint32", "num_tokens": ids, "bin_path": self.names[0]}
        self._finish(messages, entries)


class ExampleWriter(_PlacedWriter):
    """Rows (index, start, input_ids, labels), both numbers counted from 0 without gaps."""

    def __init__(self, options: dict, overwrite: bool):
        super().__init__(options, overwrite, example_files(options["path"]))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done = Written()
        files = [os.open(name, os.O_WRONLY) for name in self.growing[:3]]
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                index, starts = (batch.column(c).to_numpy().astype(np.int64) for c in ("index", "start"))
                lengths, ids = _flat(batch.column("input_ids"))
                label_lengths, labels = _flat(batch.column("labels"))
                if (lengths != label_lengths).any():
                    raise ValueError("a row has not as many labels as ids")
                _put(files[0], starts, lengths, ids.astype("<i4"), WIDTH)
                _put(files[1], starts, lengths, labels.astype("<i4"), WIDTH)
                pairs = np.stack([starts, lengths], axis=1).astype("<i8")
                places = index + len(_npy_header(0)) // PAIR
                _put(files[2], places, np.ones(len(index), np.int64), pairs, PAIR)
                done.rows += len(index)
                done.ids += int(lengths.sum())
                done.last_row = max(done.last_row, int(index.max()) + 1)
                done.last_id = max(done.last_id, int((starts + lengths).max()))
            for file in files:
                os.fsync(file)
        finally:
            for file in files:
                os.close(file)
        return done

    def commit(self, messages: list[Written | None]) -> None:
        rows = sum(m.rows for m in messages if m is not None)
        ids = sum(m.ids for m in messages if m is not None)
        file = os.open(self.growing[2], os.O_WRONLY)
        os.pwrite(file, _npy_header(rows), 0)
        os.close(file)
        paths = dict(zip(("input_path", "label_path", "offsets_path"), self.names))
        counts = {"num_samples": rows, "num_tokens": ids, "ignore_index": IGNORE_INDEX}
        self._finish(messages, {**counts, **paths})


def _npy_header(rows: int) -> bytes:
    """Of an int64[rows, 2] array; as long for every number of rows."""
    out = io.BytesIO()
    shape = {"descr": "<i8", "fortran_order": False, "shape": (rows, 2)}
    np.lib.format.write_array_header_1_0(out, shape)
    return out.getvalue()


class FlatTokens(DataSource):
    @classmethod
    def name(cls) -> str:
        return TOKENS

    def schema(self) -> str:
        return TOKEN_SCHEMA

    def reader(self, schema: StructType) -> TokenReader:
        return TokenReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> TokenWriter:
        return TokenWriter(self.options, overwrite)


class FlatExamples(DataSource):
    @classmethod
    def name(cls) -> str:
        return EXAMPLES

    def schema(self) -> str:
        return EXAMPLE_SCHEMA

    def reader(self, schema: StructType) -> ExampleReader:
        return ExampleReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> ExampleWriter:
        return ExampleWriter(self.options, overwrite)


def _save(df: DataFrame, source: type[DataSource], prefix: str, **options) -> dict:
    df.sparkSession.dataSource.register(source)
    writer = df.write.format(source.name()).mode("overwrite")
    writer.options(**options).save(prefix)
    files = token_files(prefix) if source is FlatTokens else example_files(prefix)
    return read_meta(files[-1])


def write_tokens(cache: DataFrame, prefix: str, chunk: int = CHUNK, **entries) -> dict:
    """Write chunks (chunk_id, ids) of ``chunk`` ids as one flat file; returns the manifest.

    ``entries`` (source_file, split_name, tokenizer ...) go into the manifest. Fails if a chunk is
    missing, comes twice or is not full, save the last one.
    """
    rows = cache.select("chunk_id", "ids")
    return _save(rows, FlatTokens, prefix, chunk=str(chunk), entries=json.dumps(entries))


def read_tokens(
    spark: SparkSession,
    prefix: str,
    chunk: int = CHUNK,
    tokens: tuple[int, int] | None = None,
    split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """(chunk_id, ids, next_id) of a flat file, or of its chunks with ids of ``tokens`` = [lo, hi).

    The form of a token cache, so windows and batches are drawn from it the same way.
    """
    spark.dataSource.register(FlatTokens)
    reader = spark.read.format(TOKENS).option("chunk", chunk).option("split", split_bytes)
    if tokens is not None:
        reader = reader.option("lo", tokens[0]).option("hi", tokens[1])
    return reader.load(prefix)


def write_examples(rows: DataFrame, prefix: str, index: str = "index", **entries) -> dict:
    """Write (index, start, input_ids, labels) rows as flat files; returns the manifest."""
    rows = rows.select(F.col(index).alias("index"), "start", "input_ids", "labels")
    return _save(rows, FlatExamples, prefix, entries=json.dumps(entries))


def read_examples(spark: SparkSession, prefix: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(index, start, length, input_ids, labels) of flat files."""
    spark.dataSource.register(FlatExamples)
    return spark.read.format(EXAMPLES).option("split", split_bytes).load(prefix)


def gather(
    starts: DataFrame, prefix: str, length: int, tokens: tuple[int, int], start: str = "start"
) -> DataFrame:
    """``starts`` with ``ids``, the ``length`` ids from ``start`` on; all of them must exist.

    Starts are dealt to tasks by ranges of ``tokens`` = [lo, hi) and sorted there, so a task walks
    through its own part of the file. Windows that overlap or nearly meet are one read; of the rest of
    the file nothing is read, and none of it is shuffled.
    """
    spark = starts.sparkSession
    path, (lo, hi) = token_files(prefix)[0], tokens
    others = [c for c in starts.columns if c != "ids"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    number = F.floor((F.col(start) - lo).cast("double") / max(hi - lo, 1) * parts)
    number = F.least(F.greatest(number, F.lit(0)), F.lit(parts - 1)).cast("int")
    dealt = starts.select(*others).repartitionById(parts, number).sortWithinPartitions(start)
    schema = StructType([*dealt.schema.fields, StructField("ids", ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = None
        for batch in batches:
            source = source or ByteRange(path)
            at = batch.column(start).to_numpy()
            step = max(READ_BYTES // (WIDTH * length), 1)
            for i in range(0, len(at), step):
                part = batch.slice(i, step)
                values = _windows(source, at[i : i + step], length)
                lists = _lists(values.reshape(-1), np.arange(1, len(values) + 1) * length)
                yield pa.RecordBatch.from_arrays([*part.columns, lists], schema.names)

    return dealt.mapInArrow(run, schema)


def _windows(source: ByteRange, starts: np.ndarray, length: int) -> np.ndarray:
    """The windows at ascending starts, one row each; READ_BYTES at a time."""
    out = np.empty((len(starts), length), "<i4")
    a = 0
    while a < len(starts):
        b, most = a + 1, starts[a] + READ_BYTES // WIDTH
        while b < len(starts) and starts[b] <= starts[b - 1] + 2 * length and starts[b] + length <= most:
            b += 1
        size = int(starts[b - 1] - starts[a]) + length
        found = np.frombuffer(source.read(int(starts[a]) * WIDTH, size * WIDTH), "<i4")
        for i in range(a, b):
            out[i] = found[starts[i] - starts[a] : starts[i] - starts[a] + length]
        a = b
    return out
