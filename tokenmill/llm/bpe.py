"""Byte-level BPE by a subword library whose model is written from the ranks alone.

The model file has one piece per rank: the token's bytes mapped to one character each, scored by
the negative rank. It normalizes nothing and adds nothing. The library then merges the adjacent
pair of the best score first, the left one of equal pairs, which is the merge order of the ranks. A
pre-token that is itself a token is that token. Decoding maps ids back to bytes.

Texts are taken whole. Null and empty texts have no ids. Rows that repeat are encoded alike, and
columns other than the text are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField

from tokenmill.llm.arrays import add_columns, row_pieces, text_bytes

FIRST_CHAR = 0x100
CACHED_PRE_TOKENS = 300_000  # of a worker; the cache starts anew beyond
CACHED_LENGTH = 64
_TO_CHARS = {b: chr(FIRST_CHAR + b) for b in range(256)}

# Field numbers and values of the public model format.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_TYPE = 1, 2, 3
NORMAL, UNKNOWN = 1, 2
MODEL_TYPE, BPE = 3, 2
NORMALIZER_NAME, DUMMY_PREFIX, REMOVE_SPACES, ESCAPE_SPACES = 1, 3, 4, 5


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file with a base64 token and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _block(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _piece(text: str, score: float, kind: int) -> bytes:
    body = _block(PIECE_TEXT, text.encode()) + _varint(PIECE_SCORE << 3 | 5)
    return _block(PIECES, body + struct.pack("<f", score) + _number(PIECE_TYPE, kind))


def mapped(token: bytes) -> str:
    return token.decode("latin-1").translate(_TO_CHARS)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The model file. Ranks must be 0 to n-1 and hold every single byte."""
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must be 0 to n-1")
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("every single byte must have a rank")
    pieces = [_piece("<unk>", 0.0, UNKNOWN)]
    pieces += [_piece(mapped(t), -float(rank), NORMAL) for rank, t in enumerate(tokens)]
    plain = _block(NORMALIZER_NAME, b"identity") + b"".join(
        _number(field, 0) for field in (DUMMY_PREFIX, REMOVE_SPACES, ESCAPE_SPACES)
    )
    return (
        b"".join(pieces)
        + _block(TRAINER, _number(MODEL_TYPE, BPE))
        + _block(NORMALIZER, plain)
    )


class Codec:
    """Encodes and decodes with a model written by ``model_bytes``."""

    def __init__(self, model: bytes, pattern: str):
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        back = {chr(FIRST_CHAR + b): b for b in range(256)}
        names = [self.pieces.id_to_piece(i) for i in range(1, self.pieces.vocab_size())]
        self.tokens = [bytes(map(back.__getitem__, name)) for name in names]
        self.ranks = {t: i for i, t in enumerate(self.tokens)}
        self.sizes = np.fromiter(map(len, self.tokens), np.int64, len(self.tokens))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.cache: dict[str, bytes] = {}

    def _encode_pre_tokens(self, pre_tokens: list[str]) -> list[bytes]:
        raw = [p.encode() for p in pre_tokens]
        found = self.pieces.encode(list(map(mapped, raw)), num_threads=1)
        whole = map(self.ranks.get, raw)
        return [
            struct.pack(f"<{len(ids)}I", *[i - 1 for i in ids]) if w is None else struct.pack("<I", w)
            for w, ids in zip(whole, found)
        ]

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        parts = list(map(self.split, texts))
        if len(self.cache) > CACHED_PRE_TOKENS:
            self.cache.clear()
        new = list(set().union(*parts).difference(self.cache))
        self.cache.update(zip(new, self._encode_pre_tokens(new)))
        ids = [b"".join(map(self.cache.__getitem__, p)) for p in parts]
        for pre_token in new:
            if len(pre_token) > CACHED_LENGTH:
                del self.cache[pre_token]
        return ids

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, one after the other."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        shift = np.repeat(self.starts[ids] - (ends - sizes), sizes)
        return self.bytes[shift + np.arange(len(shift))]


@lru_cache(maxsize=2)
def _codec(model: bytes, pattern: str) -> Codec:
    return Codec(model, pattern)


def _id_lists(ids: list[bytes]) -> pa.Array:
    sizes = np.cumsum([0, *(len(i) // 4 for i in ids)]).astype(np.int32)
    values = pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
    return pa.ListArray.from_arrays(pa.array(sizes), values)


def _pieces(column: pa.Array) -> Iterator[list[str]]:
    """The texts in lists of about a megabyte."""
    offsets = text_bytes(column)[1]
    for lo, hi in row_pieces(offsets):
        yield [t or "" for t in column.slice(lo, hi - lo).to_pylist()]


def encode(df: DataFrame, model: bytes, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with ``ids`` (array of int) for every text."""

    def kernel(batch: pa.RecordBatch) -> list[pa.Array]:
        codec = _codec(model, pattern)
        ids = [i for texts in _pieces(batch.column(text)) for i in codec.encode(texts)]
        return [_id_lists(ids)]

    return add_columns(df, [StructField("ids", ArrayType(IntegerType()))], kernel)


def decode(df: DataFrame, model: bytes, pattern: str, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded`` (binary) for every array of ids; null for null."""

    def kernel(batch: pa.RecordBatch) -> list[pa.Array]:
        codec = _codec(model, pattern)
        rows = (s.values if s.is_valid else None for s in batch.column(ids))
        decoded = [
            None if r is None else codec.decode(r.to_numpy().astype(np.int64)).tobytes()
            for r in rows
        ]
        return [pa.array(decoded, pa.binary())]

    return add_columns(df, [StructField("decoded", BinaryType())], kernel)


def round_trip(
    df: DataFrame, model: bytes, pattern: str, text: str = "text", with_ids: bool = False
) -> DataFrame:
    """``df`` with n_tokens, ids_sha256 and decoded_sha256 of every text, encoded and decoded.

    Bytes stay in the task that makes them, a megabyte of text at a time, and so do ids unless
    they are asked for.
    """

    def kernel(batch: pa.RecordBatch) -> list[pa.Array]:
        codec = _codec(model, pattern)
        n, of_ids, of_bytes, every = [], [], [], []
        for texts in _pieces(batch.column(text)):
            ids = codec.encode(texts)
            n += [len(i) // 4 for i in ids]
            every += ids if with_ids else []
            of_ids += [hashlib.sha256(i).hexdigest() for i in ids]
            flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
            decoded = memoryview(codec.decode(flat))
            ends = np.concatenate([[0], np.cumsum(codec.sizes[flat])])
            cuts = ends[np.cumsum([0, *(len(i) // 4 for i in ids)])].tolist()
            of_bytes += [hashlib.sha256(decoded[a:b]).hexdigest() for a, b in zip(cuts, cuts[1:])]
        digests = [pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]
        return [pa.array(n, pa.int64()), *digests, *([_id_lists(every)] if with_ids else [])]

    fields = [
        StructField("n_tokens", LongType()),
        StructField("ids_sha256", StringType()),
        StructField("decoded_sha256", StringType()),
    ]
    if with_ids:
        fields.append(StructField("ids", ArrayType(IntegerType())))
    return add_columns(df, fields, kernel)
