"""Whole exports: resolve the splits, convert, write each one with a manifest, sum up."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.operators.chat import chat_array_examples, prompt_response_rows
from tokenmill.operators.lines import corpus_lines
from tokenmill.operators.order import KeyRanges, first_rows, hash_ranges, key_ranges
from tokenmill.operators.splits import example_split, seeded_order
from tokenmill.session import materialize
from tokenmill.sources.cache import write_manifest
from tokenmill.sources.files import write_jsonl, write_lines
from tokenmill.sources.splits import corpus_splits, sft_splits, split_path

FORMATS = ("prompt_response", "chat_messages")
FIELDS = {"prompt": "prompt", "response": "response", "messages": "messages"}


def manifest_path(out: str) -> str:
    return f"{out}.meta.json"


def _summary(spark: SparkSession, written: Mapping[str, tuple[str, int]]) -> DataFrame:
    rows = [(split, path, rows) for split, (path, rows) in written.items()]
    return spark.createDataFrame(rows, "split string, output string, rows long")


def export_total(summary: DataFrame) -> DataFrame:
    """(split, rows) of an export and their total."""
    totals = summary.rollup("split").agg(F.sum("rows").alias("rows"))
    return totals.select(F.coalesce("split", F.lit("total")).alias("split"), "rows")


def export_corpus(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    requested: str,
    out: str,
    key: str,
    text_field: str = "text",
    max_rows: int | None = None,
    source: str | None = None,
    subset: str | None = None,
) -> DataFrame:
    """Write the requested splits as text lines in key order; (split, output, rows) of each.

    ``source`` and ``subset`` name the dataset in the manifests.
    """
    available = sorted(tables)
    splits = corpus_splits(requested, available)
    written = {}
    for split in splits:
        path = split_path(out, split, len(splits) > 1)
        lines = corpus_lines(tables[split], key, text_field, max_rows)
        rows = write_lines(lines, path, key=key, ranges=key_ranges(tables[split], key))
        entries = {
            "source": source,
            "subset": subset,
            "requested_split": requested,
            "actual_split": split,
            "text_field": text_field,
            "max_samples": max_rows,
            "written_samples": rows,
            "output": path,
            "available_splits": available,
        }
        write_manifest(spark, entries, manifest_path(path))
        written[split] = (path, rows)
    return _summary(spark, written)


def examples_of(
    df: DataFrame, key: str, form: str, fields: Mapping[str, str], min_turns: int
) -> DataFrame:
    """(key, prompt, response) from either input form."""
    if form == "chat_messages":
        return chat_array_examples(df, key, fields.get("messages", "messages"), min_turns=min_turns)
    if form == "prompt_response":
        return prompt_response_rows(
            df, key, fields.get("prompt", "prompt"), fields.get("response", "response")
        )
    raise ValueError(f"format must be one of {FORMATS}")


def export_sft(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    requested: str,
    out: str,
    key: str,
    form: str = "prompt_response",
    fields: Mapping[str, str] | None = None,
    min_turns: int = 2,
    max_rows: int | None = None,
    val_ratio: float = 0.05,
    seed: int = 42,
    source: str | None = None,
    subset: str | None = None,
) -> DataFrame:
    """Write the requested splits as prompt/response JSON lines; (split, output, rows) of each.

    If both splits are asked for and there is only 'train', the usable examples are split here, in
    seeded order, and written in that order. The cap holds for each split.
    """
    names, available = {**FIELDS, **(fields or {})}, sorted(tables)
    common = {
        "source": source,
        "subset": subset,
        "requested_split": requested,
        "format": form,
        "min_turns": min_turns,
        "max_samples": max_rows,
        "available_splits": available,
        **{f"{k}_field": v for k, v in names.items()},
    }

    def convert(split: str) -> DataFrame:
        return examples_of(tables[split], key, form, names, min_turns)

    if requested.lower() == "both" and available == ["train"]:
        # Examples are counted, ranked and written twice: their conversion is worth one write.
        examples = materialize(convert("train"), "examples")
        parts = example_split(seeded_order(examples, key, seed), key, val_ratio, seed)
        even = hash_ranges(examples, "hash")
        local = {
            "local_split": True,
            "local_val_ratio": val_ratio,
            "split_seed": seed,
            "source_total_examples": examples.count(),
        }
        splits = {s: parts.where(F.col("split") == s) for s in ("train", "val")}
        ranges = {s: even for s in splits}
        return _write_examples(
            spark, splits, out, ["hash", key], max_rows, {**common, **local}, ranges
        )
    resolved = sft_splits(requested, available)
    splits = {s: convert(s) for s in resolved}
    # Ranges come from the source's keys, so no conversion runs just to place its rows.
    ranges = {s: key_ranges(tables[s].select(key), key) for s in resolved}
    return _write_examples(spark, splits, out, [key], max_rows, common, ranges)


def _write_examples(
    spark: SparkSession,
    splits: Mapping[str, DataFrame],
    out: str,
    order: list[str],
    max_rows: int | None,
    entries: dict,
    ranges: Mapping[str, KeyRanges],
) -> DataFrame:
    written = {}
    for split, rows in splits.items():
        path = split_path(out, split, len(splits) > 1)
        kept = rows if max_rows is None else first_rows(rows, order, max_rows)
        count = write_jsonl(kept, path, ["prompt", "response"], order, ranges[split])
        write_manifest(
            spark,
            {**entries, "actual_split": split, "written_samples": count, "output": path},
            manifest_path(path),
        )
        written[split] = (path, count)
    return _summary(spark, written)

