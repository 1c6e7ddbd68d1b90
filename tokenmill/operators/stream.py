"""The token stream: every document placed at its global position, cut into chunks and splits.

A row's content is either a line with its line feed (a character is a token) or an array of ids, a
whole document's or a segment of it. Nothing here makes a row per token.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from tokenmill.operators.order import (
    BUCKET,
    bucket_bases,
    key_buckets,
    place,
    stream_total,
)

SEGMENT = 1_024  # small chunks are first cut together, about this many tokens at a time


def is_text(df: DataFrame, content: str) -> bool:
    return not isinstance(df.schema[content].dataType, ArrayType)


def token_count(df: DataFrame, content: str) -> Column:
    column = F.col(content)
    return F.length(column) if is_text(df, content) else F.size(column)


def cut(df: DataFrame, content: str, skip: Column, size: Column) -> Column:
    """``size`` tokens of the content after the first ``skip``."""
    column, first = F.col(content), (skip + 1).cast("int")
    if is_text(df, content):
        return F.substring(column, first, size.cast("int"))
    return F.slice(column, first, size.cast("int"))


@dataclass(frozen=True)
class Stream:
    """Rows with their ``start`` and ``n``, and the number of tokens in all."""

    rows: DataFrame
    content: str
    total: int

    def split_at(self, fraction: float) -> dict[str, tuple[int, int]]:
        """Token ranges [lo, hi) of the train and val parts of the stream."""
        if not 0.0 < fraction < 1.0:
            raise ValueError("fraction must lie between 0 and 1")
        middle = int(self.total * fraction)
        if middle < 2 or self.total - middle < 2:
            raise ValueError("a side of the split has fewer than two tokens")
        return {"train": (0, middle), "val": (middle, self.total)}


def token_stream(df: DataFrame, order: Sequence[str], content: str) -> Stream:
    """Place rows in the order of unique numeric keys.

    A column ``n`` is taken as the token count if there is one (a written table then gives it
    without its contents being read); a bucket column is used if there is one.
    """
    keyed = df if BUCKET in df.columns else key_buckets(df, order[0])
    sized = keyed if "n" in df.columns else keyed.withColumn("n", token_count(df, content))
    bases = bucket_bases(sized, F.col("n"))
    return Stream(place(sized, bases, order, F.col("n")), content, stream_total(bases))


def _segments(df: DataFrame, content: str, size: int) -> DataFrame:
    """Rows that end at every multiple of ``size`` tokens of the stream.

    Finding a place in a text means walking to it. Cutting a long document at once, in a single
    pass, keeps the work linear in its length, where looking up every chunk's place would not.
    """
    column, start, n = F.col(content), F.col("start"), F.col("n")
    head = F.expr(f"cast(least({size} - start % {size}, n) as int)")
    rest = cut(df, content, head, n - head)
    if is_text(df, content):
        parts = F.regexp_extract_all(rest, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    else:
        parts = F.transform(
            F.sequence(head, n - 1, F.lit(size)), lambda i: F.slice(column, i + 1, size)
        )
    first = cut(df, content, F.lit(0), head)
    others = [c for c in df.columns if c not in (content, "start", "n")]
    opened = df.select(
        *others,
        "start",
        F.posexplode(
            F.when(n <= head, F.array(column)).otherwise(F.concat(F.array(first), parts))
        ).alias("_i", content),
    )
    begin = F.when(F.col("_i") == 0, start).otherwise(
        F.expr(f"(start div {size} + _i) * {size}")
    )
    return opened.select(
        *others, begin.alias("start"), content, token_count(opened, content).alias("n")
    )


def _chunk_range(size: int, overlap: int) -> tuple[Column, Column]:
    """First and last chunk that a row at ``start`` with ``n`` tokens has a part in."""
    return (
        F.expr(f"greatest((start - {overlap}) div {size}, 0L)"),
        F.expr(f"(start + n - 1) div {size}"),
    )


def stream_pieces(stream: Stream, size: int, overlap: int = 0, keep: tuple = ()) -> DataFrame:
    """(chunk_id, pos, n, content): each document cut at the borders of chunks.

    Chunk c covers the tokens from ``c * size`` on, ``size + overlap`` of them.
    """
    content = stream.content
    rows = _segments(stream.rows.where("n > 0"), content, size * max(SEGMENT // size, 1))
    start, end = F.col("start"), F.col("start") + F.col("n")
    opened = rows.withColumn("chunk_id", F.explode(F.sequence(*_chunk_range(size, overlap))))
    low = F.col("chunk_id") * size
    pos = F.greatest(start, low)
    stop = F.least(end, low + (size + overlap))
    return opened.select(
        *keep,
        "chunk_id",
        pos.alias("pos"),
        (stop - pos).alias("n"),
        cut(opened, content, pos - start, stop - pos).alias(content),
    )


def token_chunks(stream: Stream, size: int, overlap: int = 0) -> DataFrame:
    """(chunk_id, content): the stream in rows of ``size`` tokens, plus ``overlap`` from the next.

    A chunk that lies inside one bucket is put together where the bucket's documents already
    are, without another shuffle; only chunks across a bucket border (two or so per bucket) move.
    Both parts read the one shuffle by bucket. A group holds at most size + overlap pieces.
    """
    content, total = stream.content, stream.total

    def inside(chunk: Column) -> Column:
        low = chunk * size
        high = F.least(low + (size + overlap), F.lit(total))
        return (low >= F.col("_base")) & (high <= F.col("_base") + F.col("_total"))

    def pieces(part: Stream) -> DataFrame:
        return stream_pieces(part, size, overlap, keep=(BUCKET, "_base", "_total"))

    first, last = _chunk_range(size, overlap)
    at_border = stream.rows.where("n > 0").where(~(inside(first) & inside(last)))
    chunk = F.col("chunk_id")
    whole = _assemble(pieces(stream).where(inside(chunk)), [BUCKET, "chunk_id"], content)
    edges = _assemble(
        pieces(replace(stream, rows=at_border)).where(~inside(chunk)), ["chunk_id"], content
    )
    return whole.select("chunk_id", content).unionByName(edges.select("chunk_id", content))


def _assemble(pieces: DataFrame, keys: list[str], content: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("pos", content)))
    grouped = pieces.groupBy(*keys).agg(parts.alias("parts"))
    texts = F.transform("parts", lambda p: p[content])
    joined = F.array_join(texts, "") if is_text(pieces, content) else F.flatten(texts)
    return grouped.select(*keys, joined.alias(content))


def position_split(stream: Stream, fraction: float) -> DataFrame:
    """(split, start, n, content, ...): the rows of both sides; one across the cut is divided.

    ``start`` counts from the beginning of the row's own side.
    """
    middle = stream.split_at(fraction)["val"][0]
    start, n, content = F.col("start"), F.col("n"), stream.content
    ahead = F.least(F.greatest(F.lit(middle) - start, F.lit(0)), n)
    rows = stream.rows.withColumn("_ahead", ahead)
    sides = rows.withColumn(
        "_side",
        F.explode(
            F.filter(
                F.array(
                    F.struct(
                        F.lit("train").alias("split"),
                        F.lit(0).cast("long").alias("skip"),
                        F.col("_ahead").cast("long").alias("size"),
                    ),
                    F.struct(
                        F.lit("val").alias("split"),
                        F.col("_ahead").cast("long").alias("skip"),
                        (n - F.col("_ahead")).cast("long").alias("size"),
                    ),
                ),
                lambda s: s["size"] > 0,
            )
        ),
    )
    others = [
        c
        for c in stream.rows.columns
        if c not in ("start", "n", content, BUCKET, "_base", "_total")
    ]
    skip, size = F.col("_side.skip"), F.col("_side.size")
    offset = F.when(F.col("_side.split") == "val", F.lit(middle)).otherwise(F.lit(0))
    return sides.select(
        *others,
        F.col("_side.split").alias("split"),
        (start + skip - offset).alias("start"),
        size.cast("int").alias("n"),
        cut(sides, content, skip, size).alias(content),
    )
