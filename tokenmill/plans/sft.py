"""From conversations to fine-tuning rows and batches."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.operators.chat import chat_examples, clean_turns, example_parts
from tokenmill.operators.reports import length_histogram
from tokenmill.operators.sft import (
    draw_examples,
    masked_rows,
    padded,
    sft_rows,
    turn_pairs,
    with_index,
    with_offsets,
)
from tokenmill.operators.splits import row_split
from tokenmill.operators.tokens import CharTokenizer, Tokenizer
from tokenmill.operators.windows import micro_batches
from tokenmill.session import materialize
from tokenmill.sources import flat
from tokenmill.sources.cache import data_identity, reuse_or_build, stored_histogram


def chat_vocabulary(turns: DataFrame) -> CharTokenizer:
    """Characters of cleaned messages and of the prompt layout."""
    layout = "Human: Assistant: System: \n"
    return CharTokenizer.fit(clean_turns(turns), "content", also=layout)


def chat_rows(
    turns: DataFrame, tokenizer: Tokenizer, max_len: int, min_turns: int = 2
) -> DataFrame:
    """(conv_id, input_ids, labels, length, supervised) from long chat rows.

    With an id per character, turns are encoded apart and only those that truncation reaches are
    put together. A subword tokenizer may join what stands on both sides of a turn's end, so it
    needs the whole prompt, as one string.
    """
    cleaned = clean_turns(turns)
    if isinstance(tokenizer, CharTokenizer):
        pairs = turn_pairs(example_parts(cleaned, min_turns), tokenizer, max_len)
        return masked_rows(pairs, tokenizer, max_len, "conv_id")
    return sft_rows(chat_examples(cleaned, min_turns), tokenizer, max_len, "conv_id")


def _cache(
    spark: SparkSession,
    root: str,
    parameters: dict,
    tokenizer: Tokenizer,
    rows: Callable[[], DataFrame],
    key: str,
    rebuild: bool,
) -> tuple[DataFrame, dict]:
    named = {
        "tokenizer": tokenizer.name, "tokenizer_digest": tokenizer.identity,
        "eos_id": tokenizer.eos_id, "vocab_size": tokenizer.vocab_size, "key": key, **parameters,
    }

    def build() -> DataFrame:
        return with_offsets(materialize(rows(), "sft-rows"), key)

    return reuse_or_build(spark, root, "sft", named, build, F.col("length"), rebuild)


def sft_cache(
    spark: SparkSession,
    turns: DataFrame,
    tokenizer: Tokenizer,
    root: str,
    source: str,
    max_len: int,
    split: str = "train",
    min_turns: int = 2,
    rebuild: bool = False,
    version: str | None = None,
) -> tuple[DataFrame, dict]:
    """Cached (conv_id, input_ids, labels, length, supervised, start) of chat rows.

    ``version`` may name the data instead of having it looked at.
    """
    parameters = {
        "source": source, "version": version or data_identity(turns), "split": split,
        "max_len": max_len, "min_turns": min_turns,
    }

    def rows() -> DataFrame:
        return chat_rows(turns, tokenizer, max_len, min_turns)

    return _cache(spark, root, parameters, tokenizer, rows, "conv_id", rebuild)


def sft_split_caches(
    spark: SparkSession,
    raw: DataFrame,
    key: str,
    tokenizer: Tokenizer,
    root: str,
    source: str,
    max_len: int,
    train_fraction: float = 0.95,
    seed: int = 42,
    fields: tuple[str, str] = ("prompt", "response"),
    rebuild: bool = False,
    version: str | None = None,
) -> dict[str, tuple[DataFrame, dict]]:
    """Train and val caches from one table of examples, split before unusable rows are dropped.

    Fails if either side has no usable row.
    """
    data = version or data_identity(raw)
    split = cache(lambda: materialize(row_split(raw, key, train_fraction, seed), "split-rows"))
    caches = {}
    for name in ("train", "val"):
        parameters = {
            "source": source, "version": data, "split": name, "max_len": max_len,
            "fields": list(fields), "train_fraction": train_fraction, "seed": seed,
        }

        def rows(name=name) -> DataFrame:
            return sft_rows(split().where(F.col("split") == name), tokenizer, max_len, key, *fields)

        caches[name] = _cache(spark, root, parameters, tokenizer, rows, key, rebuild)
    if not all(known["num_rows"] for _, known in caches.values()):
        raise ValueError("train or val has no usable row")
    return caches


def sft_file_caches(
    spark: SparkSession,
    sides: dict[str, DataFrame],
    key: str,
    tokenizer: Tokenizer,
    root: str,
    sources: dict[str, str],
    max_len: int,
    fields: tuple[str, str] = ("prompt", "response"),
    rebuild: bool = False,
    versions: dict[str, str] | None = None,
) -> dict[str, tuple[DataFrame, dict]]:
    """A cache per side from examples that were brought apart, a train and a validation file say.

    ``sides`` are tables with a key (see ``number_rows``) and the two fields; ``versions`` may name
    the data of a side instead of having it looked at. Fails if a side has no usable row.
    """
    caches = {}
    for name, raw in sides.items():
        parameters = {
            "source": sources[name], "split": name,
            "version": (versions or {}).get(name) or data_identity(raw),
            "max_len": max_len, "fields": list(fields),
        }

        def rows(raw=raw) -> DataFrame:
            return sft_rows(raw, tokenizer, max_len, key, *fields)

        caches[name] = _cache(spark, root, parameters, tokenizer, rows, key, rebuild)
        if not caches[name][1]["num_rows"]:
            raise ValueError(f"{name} has no usable row")
    return caches


def cache_histogram(rows: DataFrame, known: dict) -> DataFrame:
    """(split, len, n, supervised) of a fine-tuning cache, kept beside it: see ``reports``.

    Statistics of several caches come from the union of their histograms, and none of them is read.
    """

    def histogram(cache: DataFrame) -> DataFrame:
        split = cache.withColumn("split", F.lit(known["split"]))
        return length_histogram(split, F.col("length"), ["split"], F.col("supervised"))

    return stored_histogram(rows, known, histogram)


def write_flat_cache(rows: DataFrame, known: dict, prefix: str) -> dict:
    """Write a fine-tuning cache as flat files (see ``sources.flat``); returns their manifest."""
    fields = known.get("fields") or ["prompt", "response"]
    return flat.write_examples(
        with_index(rows, known["key"]), prefix, source_file=known["source"],
        split_name=known["split"], tokenizer=known["tokenizer"], max_seq_len=int(known["max_len"]),
        prompt_field=fields[0], response_field=fields[1],
    )


def sft_batches(
    spark: SparkSession,
    rows: DataFrame,
    key: str,
    draws: int,
    batch: int,
    block: int,
    seed: int,
    accumulate: int = 1,
    manifest: dict | None = None,
) -> DataFrame:
    """(step, micro, row, key, x, y): padded batches of examples drawn with replacement.

    ``rows`` should be a written table: it is counted, numbered and read. Given the manifest of
    its cache, a block other than the cache's length is refused; a longer row fails the job in
    any case.
    """
    if manifest is not None and manifest["max_len"] != block:
        raise ValueError(f"the cache was built for {manifest['max_len']} ids, not {block}")
    indexed = with_index(rows, key)
    drawn = draw_examples(spark, indexed, draws, rows.count(), seed)
    named = micro_batches(drawn, batch, accumulate)
    return padded(named, ["step", "micro", "row", key], block)
