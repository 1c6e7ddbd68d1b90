"""From corpus rows to a token stream, its cache and training windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.functions.text import clean_line, has_text, line_ends
from tokenmill.operators.lines import corpus_lines
from tokenmill.operators.order import BUCKET, in_key_ranges, key_buckets
from tokenmill.operators.stream import (
    Stream,
    is_text,
    stream_pieces,
    token_chunks,
    token_count,
    token_stream,
)
from tokenmill.operators.tokens import (
    CharTokenizer,
    SubwordTokenizer,
    Tokenizer,
    encoded_segments,
)
from tokenmill.operators.windows import (
    chunk_pieces,
    epoch_batches,
    gather_windows,
    micro_batches,
    sequential_starts,
    shifted_pair,
    window_starts,
)
from tokenmill.session import materialize
from tokenmill.sources import flat
from tokenmill.sources.cache import data_identity, reuse_or_build, write_bucketed

CONTENT = "content"
BUCKET_BYTES = 256 << 20


def corpus_vocabulary(df: DataFrame, key: str, text_field: str = "text") -> CharTokenizer:
    """Characters of a corpus as its token stream has them."""
    lines = corpus_lines(df, key, text_field)
    return CharTokenizer.fit(lines.select(line_ends(F.col("line")).alias("line")))


def stream_of_lines(
    lines: DataFrame, key: str, tokenizer: Tokenizer | None = None, line: str = "line"
) -> Stream:
    """Token stream of (key, line) rows, blank ones included; numbered lines of files, say.

    One id per character (or no tokenizer yet): the stream is text until the very end. It is
    shuffled once, as UTF-8; ids, four bytes a character, are made last. Subword ids come in
    segments (see ``seg``) of documents. Encoding is the costly step, so it is written once; the
    sums read its counts only.
    """
    if isinstance(tokenizer, SubwordTokenizer):
        segments = encoded_segments(lines, key, tokenizer, line)
        written = materialize(segments.withColumnRenamed("ids", CONTENT), "encoded")
        return token_stream(written, [key, "seg"], CONTENT)
    content = F.concat(line_ends(F.col(line)), F.lit("\n")).alias(CONTENT)
    bucket = [c for c in lines.columns if c == BUCKET]
    return token_stream(lines.select(key, *bucket, content), [key], CONTENT)


def line_stream(df: DataFrame, key: str, text_field: str = "text") -> Stream:
    """Character stream of a corpus. Buckets come from the key column, before any text is read."""
    lines = key_buckets(df, key).where(has_text(F.col(text_field))).select(
        key, BUCKET, clean_line(F.col(text_field)).alias("line")
    )
    return stream_of_lines(lines, key)


def corpus_stream(
    df: DataFrame, key: str, tokenizer: Tokenizer, text_field: str = "text"
) -> Stream:
    if isinstance(tokenizer, CharTokenizer):
        return line_stream(df, key, text_field)
    return stream_of_lines(corpus_lines(df, key, text_field), key, tokenizer)


def id_chunks(stream: Stream, tokenizer: Tokenizer, size: int, overlap: int = 0) -> DataFrame:
    """(chunk_id, ids)."""
    return _ids(token_chunks(stream, size, overlap), stream.content, tokenizer)


def _ids(chunks: DataFrame, content: str, tokenizer: Tokenizer) -> DataFrame:
    ids = tokenizer.encode(F.col(content)) if is_text(chunks, content) else F.col(content)
    return chunks.select("chunk_id", ids.alias("ids"))


def token_cache(
    spark: SparkSession,
    df: DataFrame,
    key: str,
    tokenizer: Tokenizer,
    root: str,
    source: str,
    size: int = 1024,
    split: str = "full",
    text_field: str | None = "text",
    rebuild: bool = False,
    version: str | None = None,
) -> tuple[DataFrame, dict]:
    """Cached (chunk_id, ids, next_id): chunks and the id that follows each of them.

    Files hold ranges of chunks, so a range of chunks skips whole files. Without a text field,
    ``df`` holds (key, line) rows as read from text files. Another tokenizer, end of sequence,
    key, field or other data lead to another cache; ``version`` may name the data instead of
    having it looked at.
    """
    parameters = {
        "source": source,
        "version": version or data_identity(df),
        "split": split,
        "tokenizer": tokenizer.name,
        "tokenizer_digest": tokenizer.identity,
        "eos_id": tokenizer.eos_id,
        "vocab_size": tokenizer.vocab_size,
        "key": key,
        "text_field": text_field,
        "chunk_size": size,
    }

    def build() -> DataFrame:
        if text_field is None:
            stream = stream_of_lines(df, key, tokenizer)
        else:
            stream = corpus_stream(df, key, tokenizer, text_field)
        chunks = token_chunks(stream, size, overlap=1)
        # Where the stream leaves off, the overlap alone would make a chunk of its own.
        some = chunks.where(token_count(chunks, stream.content) > 0)
        placed = in_key_ranges(some, "chunk_id", -(-stream.total // size))
        # Text is dealt out and sorted, a byte a character or so; its ids would be four.
        return _ids(placed, stream.content, tokenizer).select(
            "chunk_id", F.slice("ids", 1, size).alias("ids"), F.get("ids", F.lit(size)).alias("next_id")
        )

    return reuse_or_build(spark, root, "tokens", parameters, build, F.size("ids"), rebuild)


def write_flat_cache(cache: DataFrame, known: dict, prefix: str) -> dict:
    """Write a token cache as one flat file (see ``sources.flat``); returns its manifest."""
    return flat.write_tokens(
        cache, prefix, int(known["chunk_size"]), source_file=known["source"],
        split_name=known["split"], tokenizer=known["tokenizer"],
    )


def training_windows(
    spark: SparkSession,
    stream: Stream,
    tokens: tuple[int, int],
    draws: int,
    batch: int,
    block: int,
    seed: int,
    accumulate: int = 1,
    rank: int = 0,
    world: int = 1,
) -> DataFrame:
    """(step, micro, row, start, x, y) drawn from the token range [lo, hi) of a stream.

    x and y have the stream's own content: text, or ids.
    """
    lo, hi = tokens
    starts = _named_starts(spark, tokens, draws, batch, block, seed, accumulate, rank, world)
    pieces = stream_pieces(stream, block)
    found = gather_windows(pieces, starts, block, block, stream.content, base=tokens[0])
    return _pairs(found, stream.content, block)


def cached_windows(
    spark: SparkSession,
    cache: DataFrame,
    size: int,
    tokens: tuple[int, int],
    draws: int,
    batch: int,
    block: int,
    seed: int,
    accumulate: int = 1,
    rank: int = 0,
    world: int = 1,
) -> DataFrame:
    """The same draws from a token cache of chunks of ``size`` ids: nothing is tokenized again.

    Chunks outside the token range are skipped by the statistics of the files.
    """
    lo, hi = tokens
    starts = _named_starts(spark, tokens, draws, batch, block, seed, accumulate, rank, world)
    near = cache.where(F.col("chunk_id").between(lo // size, (hi - 1) // size))
    found = gather_windows(chunk_pieces(near, size, "ids"), starts, block, size, "ids", base=lo)
    return _pairs(found, "ids", block)


def bucketed_cache(
    cache: DataFrame, known: dict, path: str, buckets: int | None = None
) -> DataFrame:
    """A token cache in files by a hash of the chunk number, for many draws: see ``write_bucketed``.

    ``cached_windows`` then shuffles draws and what they ask for, never the cache. There are as many
    buckets as make files of about BUCKET_BYTES, and no fewer than shuffles have partitions.
    """
    if buckets is None:
        least = int(cache.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        buckets = max(-(-int(known["num_tokens"]) * 4 // BUCKET_BYTES), least)
    return write_bucketed(cache, path, "chunk_id", buckets)


def flat_windows(
    spark: SparkSession,
    prefix: str,
    tokens: tuple[int, int],
    draws: int,
    batch: int,
    block: int,
    seed: int,
    accumulate: int = 1,
    rank: int = 0,
    world: int = 1,
) -> DataFrame:
    """The same draws from a flat file: the draws move, and only the ids that they ask for are read."""
    starts = _named_starts(spark, tokens, draws, batch, block, seed, accumulate, rank, world)
    found = flat.gather(starts.withColumn("start", F.col("start") + tokens[0]), prefix, block + 1, tokens)
    return _pairs(found, "ids", block)


def cached_epoch(
    spark: SparkSession, cache: DataFrame, size: int, tokens: int, rows: int, block: int
) -> DataFrame:
    """(batch, row, x, y) of one sequential pass over a token cache.

    Blocks that divide the chunks are cut where the chunks are, with no shuffle at all; others
    are gathered from the chunks they touch.
    """
    if size % block == 0 and "next_id" in cache.columns:
        last = epoch_batches(tokens, rows, block) * rows
        per_chunk = size // block
        ids = F.when(F.col("next_id").isNull(), F.col("ids")).otherwise(
            F.concat("ids", F.array("next_id"))
        )
        number = F.col("chunk_id") * per_chunk + F.col("part")
        parts = F.explode(F.sequence(F.lit(0), F.lit(per_chunk - 1))).alias("part")
        cut = cache.select("chunk_id", ids.alias("ids"), parts).where(number < last)
        low = F.col("part") * block + 1
        return cut.select(
            F.expr(f"(chunk_id * {per_chunk} + part) div {rows}").alias("batch"),
            F.expr(f"(chunk_id * {per_chunk} + part) % {rows}").alias("row"),
            F.slice("ids", low, F.lit(block)).alias("x"),
            F.slice("ids", low + 1, F.lit(block)).alias("y"),
        )
    starts = sequential_starts(spark, tokens, rows, block)
    found = gather_windows(chunk_pieces(cache, size, "ids"), starts, block, size, "ids")
    x, y = shifted_pair(found, "ids", block)
    return found.select("batch", "row", x.alias("x"), y.alias("y"))


def _named_starts(
    spark: SparkSession,
    tokens: tuple[int, int],
    draws: int,
    batch: int,
    block: int,
    seed: int,
    accumulate: int,
    rank: int,
    world: int,
) -> DataFrame:
    lo, hi = tokens
    drawn = window_starts(spark, draws, hi - lo, block, seed, rank, world)
    return micro_batches(drawn, batch, accumulate).withColumn("window_start", F.col("start"))


def _pairs(windows: DataFrame, content: str, block: int) -> DataFrame:
    x, y = shifted_pair(windows, content, block)
    return windows.select(
        "step", "micro", "row", F.col("window_start").alias("start"), x.alias("x"), y.alias("y")
    )
