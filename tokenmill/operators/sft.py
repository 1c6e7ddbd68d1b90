"""Fine-tuning rows: token ids, label masks, offsets, padded batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.functions.sequences import (
    IGNORE_INDEX,
    last_ids,
    next_token_labels,
    pad_to,
    supervised_count,
    truncate_pair,
)
from tokenmill.functions.text import as_text
from tokenmill.operators.chat import PROMPT_OPENING
from tokenmill.operators.order import running_total
from tokenmill.operators.tokens import CharTokenizer, Tokenizer, append_eos
from tokenmill.operators.windows import draw_indices
from tokenmill.session import materialize

PAD_ID = 0  # fixed value: filler id of padded rows


def sft_rows(
    examples: DataFrame,
    tokenizer: Tokenizer,
    max_len: int,
    key: str,
    prompt_field: str = "prompt",
    response_field: str = "response",
) -> DataFrame:
    """(key, input_ids, labels, length, supervised) for every usable example.

    Usable means that neither side is null and both have ids. The response ends with the
    end-of-sequence id; overlong pairs lose ids from the left, prompt first.
    """
    # A blank side has no ids under any tokenizer, so it goes before the encoding.
    texts = examples.select(
        key, as_text(F.col(prompt_field)).alias("p"), as_text(F.col(response_field)).alias("r")
    ).where("p <> '' and r <> ''")
    ids = tokenizer.encode(F.col("p")).alias("p"), tokenizer.encode(F.col("r")).alias("r")
    if isinstance(tokenizer, CharTokenizer):
        encoded = texts.select(key, *ids)
    else:
        # Opening a one-element array keeps the filter above the encoder, which would otherwise
        # run once for the filter and once for the result.
        encoded = texts.select(key, F.inline(F.array(F.struct(*ids)))).where(
            (F.size("p") > 0) & (F.size("r") > 0)
        )
    return masked_rows(encoded, tokenizer, max_len, key)


def masked_rows(pairs: DataFrame, tokenizer: Tokenizer, max_len: int, key: str) -> DataFrame:
    """Fine-tuning rows from ids (key, p, r) of prompts, or of their tails, and responses."""
    if max_len <= 1:
        raise ValueError("max_len must be above 1")
    ended = pairs.withColumn("r", append_eos(F.col("r"), tokenizer))
    kept_prompt, kept_response = truncate_pair(F.col("p"), F.col("r"), max_len)
    joined = ended.select(
        key,
        F.size(kept_prompt).alias("prompt_len"),
        F.concat(kept_prompt, kept_response).alias("input_ids"),
    )
    labelled = joined.withColumn(
        "labels", next_token_labels(F.col("input_ids"), F.col("prompt_len"))
    )
    return labelled.select(
        key,
        "input_ids",
        "labels",
        F.size("input_ids").alias("length"),
        supervised_count(F.col("labels")).alias("supervised"),
    )


def turn_pairs(parts: DataFrame, tokenizer: CharTokenizer, max_len: int) -> DataFrame:
    """(conv_id, p, r) from the texts (conv_id, turn, text, last) that examples are made of.

    Every text is encoded in a row of its own, so an unknown character anywhere fails the job. A
    running sum from the end tells which texts truncation can reach; only those are put together,
    ``max_len`` ids at most and one text more, however long the conversation is.
    """
    ids = parts.select("conv_id", "turn", "last", tokenizer.encode(F.col("text")).alias("ids"))
    written = materialize(
        ids.select(
            "conv_id", (-F.col("turn")).alias("_back"), "last", F.size("ids").alias("n"),
            last_ids(F.col("ids"), max_len).alias("ids"),
        ),
        "turn-ids",
    )
    placed = running_total(written, ["_back"], F.col("n"), by=["conv_id"], out="_after")
    reached = placed.where(F.col("_after") < max_len)
    tail = F.array_sort(F.collect_list(F.when(~F.col("last"), F.struct(-F.col("_back"), "ids"))))
    grouped = reached.groupBy("conv_id").agg(
        F.transform(tail, lambda t: t["ids"]).alias("parts"),
        F.max(F.when(F.col("last"), F.col("ids"))).alias("r"),
    )
    opening = F.lit(tokenizer.ids_of(PROMPT_OPENING)).cast("array<int>")
    return grouped.select("conv_id", F.concat(F.flatten("parts"), opening).alias("p"), "r")


def example_lengths(
    examples: DataFrame,
    tokenizer: Tokenizer,
    key: str,
    prompt_field: str = "prompt",
    response_field: str = "response",
) -> DataFrame:
    """(key, prompt_len, response_len, length) in ids, before any truncation.

    The response counts its end-of-sequence id. This is what a sequence length is chosen from.
    """
    texts = examples.select(
        key,
        as_text(F.col(prompt_field)).alias("p"),
        as_text(F.col(response_field)).alias("r"),
    ).where("p <> '' and r <> ''")

    def ids(text: str) -> Column:
        if isinstance(tokenizer, CharTokenizer):
            return F.length(text)
        return F.size(tokenizer.encode(F.col(text)))

    eos = 0 if tokenizer.eos_id is None else 1
    sized = texts.select(key, ids("p").alias("prompt_len"), (ids("r") + eos).alias("response_len"))
    return sized.withColumn("length", F.col("prompt_len") + F.col("response_len"))


def with_offsets(rows: DataFrame, key: str) -> DataFrame:
    """Add ``start``, the position of the row's first token among all rows in key order."""
    return running_total(rows, [key], F.col("length"))


def with_index(rows: DataFrame, key: str) -> DataFrame:
    """Add ``index``, the row's number from 0 in key order."""
    return running_total(rows, [key], F.lit(1), out="index")


def padded(rows: DataFrame, key: list[str], block: int, pad_id: int = PAD_ID) -> DataFrame:
    """(key, x, y): ids filled up with ``pad_id`` and labels with IGNORE_INDEX, ``block`` each.

    A row longer than the block fails the job: ids are never cut here.
    """
    too_long = F.raise_error(F.lit(f"a row is longer than the block of {block} ids"))
    ids = F.when(F.size("input_ids") <= block, F.col("input_ids")).otherwise(too_long)
    return rows.select(
        *key,
        pad_to(ids, block, pad_id).alias("x"),
        pad_to(F.col("labels"), block, IGNORE_INDEX).alias("y"),
    )


def draw_examples(
    spark: SparkSession, indexed: DataFrame, count: int, examples: int, seed: int | str
) -> DataFrame:
    """(draw, row columns): examples drawn with replacement by their index."""
    draws = draw_indices(spark, count, examples, seed)
    return indexed.join(draws, "index").drop("index")
