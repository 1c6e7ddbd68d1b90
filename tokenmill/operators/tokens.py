"""Tokenizers as column expressions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenmill.functions.text import line_ends

MAX_CODE_POINT = 0x10FFFF  # fixed value: the end of Unicode
NATIVE_TABLE_LIMIT = 65_536  # code points that a literal lookup table may span
SEGMENT = 1_024  # ids in a stored row
AT_ONCE = 1 << 20  # characters, or ids, that a kernel holds in unpacked form
LIBRARY_AT_ONCE = 1 << 15  # those in the hands of a tokenizer library, some hundred bytes each


def _row_groups(lengths: np.ndarray, limit: int = AT_ONCE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` units, one longer row at least."""
    ends = np.cumsum(lengths)
    row = 0
    while row < len(ends):
        done = ends[row - 1] if row else 0
        stop = max(int(np.searchsorted(ends, done + limit, "right")), row + 1)
        yield row, stop
        row = stop


def _pieces(batches: Iterator[pa.Array], units: Callable) -> Iterator[pa.Array]:
    """The rows of all batches in arrays of about AT_ONCE units, however large the batches are."""
    for batch in batches:
        for low, high in _row_groups(_sizes(units(batch))):
            yield batch[low:high]


def _lists(rows: list[np.ndarray], lengths: np.ndarray, missing: pa.Array) -> pa.ListArray:
    values = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int32)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(
        pa.array(offsets), pa.array(values.astype(np.int32, copy=False)), mask=missing
    )


def _sizes(lengths: pa.Array) -> np.ndarray:
    return pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _distinct_chars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every character of a task's texts once, from the code points of whole batches."""
    seen = np.zeros(0, dtype=np.uint32)
    for batch in batches:
        texts = batch.column(0)
        for low, high in _row_groups(_sizes(pc.utf8_length(texts))):
            joined = "".join(t for t in texts[low:high].to_pylist() if t is not None)
            points = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
            seen = np.union1d(seen, points)
    chars = pa.array([chr(p) for p in seen.tolist()], pa.string())
    yield pa.RecordBatch.from_arrays([chars], ["ch"])


def char_vocabulary(df: DataFrame, text: str = "line", also: str = "\n") -> DataFrame:
    """(id, ch): the distinct characters in code point order, ids from 0.

    Each task sends a character once. The window numbers the distinct characters only, of which
    Unicode has 1,114,112 at most.
    """
    found = df.select(text).mapInArrow(_distinct_chars, "ch string")
    if also:
        # The stream puts these characters between the lines, so they exist if any line does.
        extra = df.limit(1).select(F.explode(F.split(F.lit(also), "")).alias("ch"))
        found = found.union(extra.where("ch <> ''"))
    rank = F.row_number().over(Window.orderBy(F.ascii("ch")))
    return found.distinct().select((rank - 1).cast("int").alias("id"), "ch")


@dataclass(frozen=True)
class CharTokenizer:
    """One id per character; the end-of-sequence id follows the last character."""

    chars: tuple[str, ...]

    @classmethod
    def fit(cls, df: DataFrame, text: str = "line", also: str = "\n") -> CharTokenizer:
        """Vocabulary of a column. At most MAX_CODE_POINT + 1 rows reach the driver."""
        rows = char_vocabulary(df, text, also).select("ch").collect()
        return cls(tuple(sorted(r["ch"] for r in rows)))

    @property
    def name(self) -> str:
        return f"char-{len(self.chars)}"

    @property
    def identity(self) -> str:
        """Digest of the whole definition."""
        return hashlib.md5("".join(self.chars).encode("utf-8")).hexdigest()

    @property
    def eos_id(self) -> int:
        return len(self.chars)

    @property
    def vocab_size(self) -> int:
        return len(self.chars) + 1

    def ids_of(self, text: str) -> list[int]:
        return [self.chars.index(c) for c in text]

    def encode(self, text: Column) -> Column:
        """array<int>; an unknown character fails the job.

        About a million characters are encoded by one table lookup, about twice as
        fast as the built-in form below (whose array lambdas run outside code generation).
        """
        return self._encoder()(text)

    def _encoder(self) -> Callable[[Column], Column]:
        known = np.array([ord(c) for c in self.chars], dtype=np.int64)

        @F.arrow_udf("array<int>")
        def encode_chars(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            table = np.full(int(known.max(initial=0)) + 2, -1, dtype=np.int32)
            table[known] = np.arange(len(known), dtype=np.int32)
            for piece in _pieces(batches, pc.utf8_length):
                joined = "".join(t for t in piece.to_pylist() if t is not None)
                points = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
                ids = table[np.minimum(points, len(table) - 1)]
                unknown = int((ids < 0).sum())
                if unknown:
                    raise ValueError(f"{unknown} characters are not in the vocabulary")
                yield _lists([ids], _sizes(pc.utf8_length(piece)), piece.is_null())

        return encode_chars

    def encode_native(self, text: Column) -> Column:
        """The same ids from built-in functions alone; for clusters without Python workers."""
        points = [ord(c) for c in self.chars]
        if points and max(points) < NATIVE_TABLE_LIMIT:
            table = [-1] * (max(points) + 1)
            for i, p in enumerate(points):
                table[p] = i
            lookup = F.lit(table)
            ids = F.transform(
                F.split(text, ""), lambda c: F.coalesce(F.get(lookup, F.ascii(c)), F.lit(-1))
            )
        else:
            pairs = [F.lit(x) for i, c in enumerate(self.chars) for x in (c, i)]
            lookup = F.create_map(*pairs)
            ids = F.transform(F.split(text, ""), lambda c: F.coalesce(lookup[c], F.lit(-1)))
        checked = F.when(
            F.array_contains(ids, -1),
            F.raise_error(
                F.concat(
                    F.size(F.filter(ids, lambda i: i == -1)).cast("string"),
                    F.lit(" characters are not in the vocabulary"),
                )
            ),
        ).otherwise(ids)
        return F.when(text == "", F.array().cast("array<int>")).otherwise(checked)

    def decode(self, ids: Column, skip_special: bool = True) -> Column:
        """Text of an id array; the end-of-sequence id is skipped, or fails if not."""
        return self._decoder(skip_special)(ids)

    def _decoder(self, skip_special: bool) -> Callable[[Column], Column]:
        points = np.array([ord(c) for c in self.chars], dtype="<u4")
        eos = self.eos_id

        @F.arrow_udf("string")
        def decode_chars(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for piece in _pieces(batches, pc.list_value_length):
                values = piece.flatten().to_numpy(zero_copy_only=False)
                keep = values != eos if skip_special else np.ones(len(values), dtype=bool)
                kept = np.concatenate([[0], np.cumsum(keep)])
                lengths = _sizes(pc.list_value_length(piece))
                ends = kept[np.concatenate([[0], np.cumsum(lengths)])]
                text = points[values[keep]].tobytes().decode("utf-32-le")
                found = [text[a:b] for a, b in zip(ends, ends[1:])]
                yield pa.array(found, type=pa.string(), mask=np.asarray(piece.is_null()))

        return decode_chars

    def decode_native(self, ids: Column, skip_special: bool = True) -> Column:
        chars = F.lit(list(self.chars))
        kept = F.filter(ids, lambda i: i != self.eos_id) if skip_special else ids
        return F.array_join(F.transform(kept, lambda i: F.element_at(chars, i + 1)), "")


@dataclass(frozen=True)
class SubwordTokenizer:
    """Any tokenizer file of the ``tokenizers`` library, run per Arrow batch.

    ``definition`` is the file's JSON text. It is read once on the driver and loaded once per
    task; its size is that of a vocabulary, not of the data.
    """

    definition: str
    name: str = "subword"
    eos_token: str | None = None

    @classmethod
    def from_file(cls, path: str, eos_token: str | None = None) -> SubwordTokenizer:
        with open(path, encoding="utf-8") as f:
            return cls(f.read(), path.rsplit("/", 1)[-1], eos_token)

    @property
    def identity(self) -> str:
        """Digest of the whole definition and the end-of-sequence token."""
        text = f"{self.eos_token!r}\n{self.definition}"
        return hashlib.md5(text.encode("utf-8")).hexdigest()

    def _load(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.definition)

    @property
    def eos_id(self) -> int | None:
        return None if self.eos_token is None else self._load().token_to_id(self.eos_token)

    @property
    def vocab_size(self) -> int:
        return self._load().get_vocab_size(with_added_tokens=True)

    def ids_of(self, text: str) -> list[int]:
        return self._load().encode(text, add_special_tokens=False).ids

    def encode(self, text: Column) -> Column:
        return self._encoder(None)(text)

    def encode_lines(self, line: Column) -> Column:
        """Ids of the line and of its newline; a carriage return ends a line as well."""
        return self._encoder(self.ids_of("\n"))(line)

    def _encoder(self, newline: list[int] | None) -> Callable[[Column], Column]:
        definition = self.definition

        @F.arrow_udf("array<int>")
        def encode_subwords(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_str(definition)
            end = np.array(newline or [], dtype=np.int32)
            for piece in _pieces(batches, pc.utf8_length):
                rows = []
                # An encoding takes some hundred bytes per id, so few are held at a time.
                sizes = _sizes(pc.utf8_length(piece))
                for low, high in _row_groups(sizes, LIBRARY_AT_ONCE):
                    texts = [t if t is not None else "" for t in piece[low:high].to_pylist()]
                    parts = [[t] if newline is None else t.split("\r") for t in texts]
                    encoded = iter(
                        tokenizer.encode_batch_fast(
                            [p for row in parts for p in row], add_special_tokens=False
                        )
                    )
                    for row in parts:
                        ids = [np.array(next(encoded).ids, dtype=np.int32) for _ in row]
                        rows.append(np.concatenate([x for i in ids for x in (i, end)]))
                lengths = np.array([len(r) for r in rows], dtype=np.int64)
                yield _lists(rows, lengths, piece.is_null())

        return encode_subwords

    def decode(self, ids: Column, skip_special: bool = True) -> Column:
        return self._decoder(skip_special)(ids)

    def _decoder(self, skip_special: bool) -> Callable[[Column], Column]:
        definition = self.definition

        @F.arrow_udf("string")
        def decode_subwords(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_str(definition)
            for piece in _pieces(batches, pc.list_value_length):
                found = []
                sizes = _sizes(pc.list_value_length(piece))
                for low, high in _row_groups(sizes, LIBRARY_AT_ONCE):
                    ids = [r if r is not None else [] for r in piece[low:high].to_pylist()]
                    found += tokenizer.decode_batch(ids, skip_special_tokens=skip_special)
                yield pa.array(found, type=pa.string(), mask=np.asarray(piece.is_null()))

        return decode_subwords


Tokenizer = CharTokenizer | SubwordTokenizer


def encode_lines(df: DataFrame, tokenizer: Tokenizer, line: str = "line") -> DataFrame:
    """Add ``ids``: the line's ids and then the newline's, also for a blank or the last line."""
    if isinstance(tokenizer, CharTokenizer):
        text = F.concat(line_ends(F.col(line)), F.lit("\n"))
        return df.withColumn("ids", tokenizer.encode(text))
    return df.withColumn("ids", tokenizer.encode_lines(F.col(line)))


def encoded_segments(
    df: DataFrame, key: str, tokenizer: Tokenizer, line: str = "line", size: int = SEGMENT
) -> DataFrame:
    """(key, seg, ids, n): the ids of each line and its newline in rows of at most ``size``.

    The stored form of a token stream: a row stays small however long its document is.
    """
    if isinstance(tokenizer, CharTokenizer):
        text = F.concat(line_ends(F.col(line)), F.lit("\n"))
        parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
        cut = df.select(key, F.posexplode(parts).alias("seg", "text"))
        rows = cut.select(key, "seg", tokenizer.encode(F.col("text")).alias("ids"))
    else:
        # No filter on the ids: it would be moved below the encoder's result and encode once more.
        whole = encode_lines(df, tokenizer, line)
        starts = F.when(
            F.size("ids") > 0, F.sequence(F.lit(0), F.size("ids") - 1, F.lit(size))
        ).otherwise(F.array().cast("array<int>"))
        parts = F.transform(starts, lambda i: F.slice("ids", i + 1, size))
        rows = whole.select(key, F.posexplode(parts).alias("seg", "ids"))
    return rows.withColumn("n", F.size("ids"))


def append_eos(ids: Column, tokenizer: Tokenizer) -> Column:
    eos = tokenizer.eos_id
    return ids if eos is None else F.concat(ids, F.array(F.lit(eos).cast("int")))
