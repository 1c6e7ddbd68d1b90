"""Training windows, sequential batches and the draws that choose them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.functions.hashing import seeded_hash
from tokenmill.operators.stream import cut, is_text, token_count

DRAW_KEYS = ("step", "micro", "row")


def micro_batches(draws: DataFrame, batch: int, accumulate: int = 1) -> DataFrame:
    """Name each draw by (step, micro, row): ``accumulate`` batches of ``batch`` rows per step."""
    per_step = batch * accumulate
    return draws.select(
        F.expr(f"draw div {per_step}").alias("step"),
        F.expr(f"(draw % {per_step}) div {batch}").alias("micro"),
        F.expr(f"draw % {batch}").alias("row"),
        *[c for c in draws.columns if c != "draw"],
    )


def draw_indices(spark: SparkSession, count: int, domain: int, seed: int | str) -> DataFrame:
    """(draw, index): ``count`` draws with replacement from [0, domain), each from its own hash."""
    if domain <= 0:
        raise ValueError("nothing to draw from")
    return spark.range(count).select(
        F.col("id").alias("draw"), (seeded_hash(seed, F.col("id")) % domain).alias("index")
    )


def window_starts(
    spark: SparkSession,
    count: int,
    tokens: int,
    block: int,
    seed: int,
    rank: int = 0,
    world: int = 1,
) -> DataFrame:
    """(draw, start): starts congruent to ``rank`` modulo ``world``, drawn with replacement.

    Starts lie in [0, tokens - block), so that a window and its shifted copy both fit. Each rank
    has a seed of its own.
    """
    if tokens <= block:
        raise ValueError(f"a block of {block} does not fit {tokens} tokens")
    slots = -(-(tokens - block - rank) // world)
    drawn = draw_indices(spark, count, slots, seed + rank)
    return drawn.select("draw", (F.col("index") * world + rank).alias("start"))


def gather_windows(
    pieces: DataFrame, starts: DataFrame, block: int, size: int, content: str, base: int = 0
) -> DataFrame:
    """One row per draw with ``block + 1`` tokens from ``base + start`` on.

    ``pieces`` are (chunk_id, pos, n, content) rows on chunks of ``size`` tokens: cut documents
    or whole chunks (see ``chunk_pieces``). A window asks for the few chunks it touches, so an equi-join finds its tokens,
    and only the wanted part of a piece leaves the join. ``starts`` holds a few numbers per draw;
    Spark broadcasts it if it is small and shuffles both sides if not.
    """
    keys = [c for c in starts.columns if c != "start"]
    wanted = starts.select(*keys, (F.col("start") + base).alias("begin")).select(
        "*",
        F.expr(f"explode(sequence(begin div {size}, (begin + {block}) div {size}))").alias(
            "chunk_id"
        ),
    )
    met = pieces.join(wanted, "chunk_id").where(
        (F.col("pos") <= F.col("begin") + block) & (F.col("pos") + F.col("n") > F.col("begin"))
    )
    low = F.greatest("pos", "begin")
    high = F.least(F.col("pos") + F.col("n"), F.col("begin") + (block + 1))
    parts = met.select(
        *keys,
        F.struct(low.alias("at"), cut(met, content, low - F.col("pos"), high - low).alias("part"))
        .alias("part"),
    )
    grouped = parts.groupBy(*keys).agg(F.array_sort(F.collect_list("part")).alias("parts"))
    texts = F.transform("parts", lambda p: p["part"])
    joined = F.array_join(texts, "") if is_text(pieces, content) else F.flatten(texts)
    return grouped.select(*keys, joined.alias(content))


def chunk_pieces(chunks: DataFrame, size: int, content: str) -> DataFrame:
    """Stored chunks of ``size`` tokens in the form that gather_windows takes."""
    return chunks.select(
        "chunk_id",
        (F.col("chunk_id") * size).alias("pos"),
        token_count(chunks, content).alias("n"),
        content,
    )


def shifted_pair(df: DataFrame, content: str, block: int) -> tuple[Column, Column]:
    """Input and target of ``block + 1`` tokens: the target is the input moved on by one."""
    whole = F.lit(block)
    return cut(df, content, F.lit(0), whole), cut(df, content, F.lit(1), whole)


def epoch_batches(tokens: int, rows: int, block: int, full: bool = False) -> int:
    """Batches before a sequential reader wraps around.

    The reader wraps as soon as another batch and its look-ahead might not fit, which can leave
    out one full batch at the end; ``full`` counts that one too.
    """
    span = rows * block
    if tokens < span + 1:
        raise ValueError(f"a batch of {span} tokens and its look-ahead do not fit {tokens} tokens")
    if full:
        return (tokens - 1) // span
    return max(1, -(-(tokens - span - 1) // span))


def sequential_starts(
    spark: SparkSession, tokens: int, rows: int, block: int, full: bool = False
) -> DataFrame:
    """(batch, row, start) of a sequential reader, to gather its batches from stored chunks."""
    batches = epoch_batches(tokens, rows, block, full)
    return spark.range(batches * rows).select(
        F.expr(f"id div {rows}").alias("batch"),
        F.expr(f"id % {rows}").alias("row"),
        (F.col("id") * block).alias("start"),
    )


def sequential_batches(
    chunks: DataFrame, tokens: int, rows: int, block: int, full: bool = False
) -> DataFrame:
    """(batch, row, content) from chunks of ``block`` tokens with one token of overlap."""
    batches = epoch_batches(tokens, rows, block, full)
    content = [c for c in chunks.columns if c != "chunk_id"]
    return chunks.where(F.col("chunk_id") < batches * rows).select(
        F.expr(f"chunk_id div {rows}").alias("batch"),
        F.expr(f"chunk_id % {rows}").alias("row"),
        *content,
    )
