"""One query per operator of the package, over the given tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.functions.sequences import digest, last_ids
from tokenmill.operators import (
    chat, diff, lines, ngrams, order, reports, runlog, score_blocks, scores, sft,
    snapshots,
)
from tokenmill.operators import splits as row_splits
from tokenmill.operators import stream as token_streams
from tokenmill.operators import tokens, windows
from tokenmill.plans import corpus as corpus_plan
from tokenmill.plans import export, growing
from tokenmill.plans import sft as sft_plan
from tokenmill.session import bound_batches, materialize, new_path
from tokenmill.sources import cache, files, flat
from tokenmill.sources import splits as named_splits
from tokenmill.streaming import runs, sinks

SEED = 42
FIRST_ROWS = 100
CHUNK = 256
BLOCK = 128
BATCH_ROWS = 4
MAX_LEN = 256
TRAIN_FRACTION = 0.9
VAL_RATIO = 0.05
LENGTH_LIMITS = (256, 512, 1024, 4096)
TOKENS_PER_STEP = 384
TOP_K = 5
TEMPERATURE = 0.1
MERGES = ("th", "ou", "er", "in", "al")  # no letter occurs twice
PLANS = [("small", 2, 128, 1000), ("recipe", 2, 384, 20000), ("wide", 64, 1024, 500)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return files.read_table(spark, f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.corpus_lines(table(spark, sf_dir, "documents"), "doc_id")


def spread_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.corpus_lines(files.spread(documents, "doc_id"), "doc_id")


def corpus_stream(spark: SparkSession, sf_dir: str) -> token_streams.Stream:
    return corpus_plan.line_stream(table(spark, sf_dir, "documents"), "doc_id")


def fitted(spark: SparkSession, sf_dir: str) -> tokens.CharTokenizer:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return corpus_plan.corpus_vocabulary(files.spread(documents, "doc_id"), "doc_id")


# --- text -------------------------------------------------------------------------------------


def clean_lines(spark, sf_dir):
    return corpus(spark, sf_dir)


def clean_pages(spark, sf_dir):
    cleaned = lines.corpus_lines(table(spark, sf_dir, "pages"), "page_id", "html")
    return cleaned.select("page_id", F.length("line").alias("n"), F.md5("line").alias("line_md5"))


def first_n_lines(spark, sf_dir):
    return lines.corpus_lines(
        table(spark, sf_dir, "documents"), "doc_id", max_rows=FIRST_ROWS
    )


def string_key_order(spark, sf_dir):
    """Rank and number of characters before each document, by its id as a string."""
    named = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("name"), F.length("text").cast("long").alias("n")
    )
    ranked = order.dense_key(named, "name", "rank")
    placed = order.running_total(materialize(ranked, "ranked"), ["rank"], F.col("n"))
    return placed.select("name", "rank", "start")


def shuffled_order(spark, sf_dir):
    keys = table(spark, sf_dir, "documents").select("doc_id")
    return order.shuffle_ranks(keys, "doc_id", SEED).select("doc_id", "rank")


def _written_lines(spark, sf_dir) -> str:
    path = new_path(spark, "lines")
    ranges = order.key_ranges(table(spark, sf_dir, "documents"), "doc_id")
    files.write_lines(corpus(spark, sf_dir), path, key="doc_id", ranges=ranges)
    return path


def text_round_trip(spark, sf_dir):
    path = _written_lines(spark, sf_dir)
    back = files.read_lines(spark, path)
    return back.groupBy(F.md5("line").alias("line_md5")).agg(
        F.count(F.lit(1)).alias("copies"), F.max(F.length("line")).cast("long").alias("n")
    )


def numbered_lines(spark, sf_dir):
    lines_read = files.read_lines(spark, _written_lines(spark, sf_dir), keyed=True)
    return files.number_rows(lines_read).select("row", F.md5("line").alias("line_md5"))


def whole_file(spark, sf_dir):
    text = files.read_whole(spark, _written_lines(spark, sf_dir))
    return text.agg(
        F.sum(F.length("text")).alias("chars"),
        F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n")))).alias("newlines"),
    )


# --- splits, manifests ------------------------------------------------------------------------


def _split_corpus(spark, sf_dir) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    # The split is looked for among the keys in several passes; the text is read for them once.
    keys = documents.where("text is not null and text <> ''").select("doc_id")
    ids = materialize(keys, "keys")
    return row_splits.example_split(corpus(spark, sf_dir), "doc_id", VAL_RATIO, SEED, ids=ids)


def split_summary(spark, sf_dir):
    return reports.split_summary(_split_corpus(spark, sf_dir))


def split_files(spark, sf_dir):
    """Train and validation files brought along, written apart and read back."""
    benchmark = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id")
    whole = named_splits.tagged_splits(
        {"train": corpus(spark, sf_dir), "validation": lines.corpus_lines(benchmark, "doc_id")}
    )
    wanted = named_splits.corpus_splits("both", ["train", "validation"])
    base = new_path(spark, "splits") + ".txt"
    written = named_splits.write_splits(
        whole, wanted, base, lambda part, path: files.write_lines(part, path, key="doc_id")
    )
    back = named_splits.tagged_splits(
        {
            split: files.read_lines(spark, path).withColumn("written", F.lit(rows).cast("long"))
            for split, (path, rows) in written.items()
        }
    )
    return back.groupBy("split", "written", F.md5("line").alias("line_md5")).agg(
        F.count(F.lit(1)).alias("copies")
    )


def _exported_corpus(spark, sf_dir) -> tuple[str, DataFrame]:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    benchmark = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id")
    out = new_path(spark, "corpus") + ".txt"
    return out, export.export_corpus(
        spark, {"train": documents, "validation": benchmark}, "both", out, "doc_id"
    )


def export_summary(spark, sf_dir):
    return export.export_total(_exported_corpus(spark, sf_dir)[1])


def export_manifest(spark, sf_dir):
    out, _ = _exported_corpus(spark, sf_dir)
    read = [
        spark.read.json(export.manifest_path(named_splits.split_path(out, split, True)))
        for split in ("train", "validation")
    ]
    return read[0].unionByName(read[1]).select(
        "requested_split",
        "actual_split",
        "text_field",
        F.array_join("available_splits", ",").alias("available_splits"),
        F.col("written_samples").cast("long").alias("written_samples"),
    )


def export_manifest_fields(spark, sf_dir):
    """Manifest of an export of prompt/response rows with a cap: all fields, unset ones as null."""
    out, _ = _lenient_export(spark, sf_dir)
    parts = [
        spark.read.json(export.manifest_path(named_splits.split_path(out, split, True)))
        for split in ("train", "test")
    ]
    return parts[0].unionByName(parts[1]).select(
        "source", "subset", "requested_split", "actual_split", "format", "prompt_field",
        "response_field", "messages_field", F.col("max_samples").cast("long").alias("max_samples"),
        F.array_join("available_splits", ",").alias("available_splits"),
        F.col("written_samples").cast("long").alias("written_samples"),
    )


def _lenient_export(spark, sf_dir):
    """Both splits of a dataset that has 'train' and 'test': the latter stands for validation."""
    sides = materialize(row_split(spark, sf_dir).join(chat_examples(spark, sf_dir), "conv_id"), "sides")
    tables = {
        name: sides.where(F.col("split") == side).select("conv_id", "prompt", "response")
        for name, side in (("train", "train"), ("test", "val"))
    }
    out = new_path(spark, "lenient") + ".jsonl"
    summary = export.export_sft(
        spark, tables, "both", out, "conv_id", max_rows=FIRST_ROWS, source="conversations"
    )
    return out, summary


def export_lenient_split(spark, sf_dir):
    """The first prompt/response rows of each split, written as JSON lines and read back."""
    out, _ = _lenient_export(spark, sf_dir)
    return named_splits.tagged_splits(
        {
            split: files.read_jsonl(spark, named_splits.split_path(out, split, True))
            for split in ("train", "test")
        }
    )


def export_local_split(spark, sf_dir):
    """Chat rows with a train split only: split, written as JSON lines, read back."""
    arrays = chat.message_arrays(table(spark, sf_dir, "conversations"))
    out = new_path(spark, "sft") + ".jsonl"
    export.export_sft(
        spark, {"train": arrays}, "both", out, "conv_id", "chat_messages", val_ratio=VAL_RATIO,
        seed=SEED,
    )
    parts = {}
    for split in ("train", "val"):
        path = named_splits.split_path(out, split, True)
        known = cache.read_manifest(spark, export.manifest_path(path))
        parts[split] = files.read_jsonl(spark, path).select(
            "prompt",
            "response",
            F.lit(known["source_total_examples"]).cast("long").alias("source_total"),
            F.lit(known["written_samples"]).cast("long").alias("written"),
        )
    return named_splits.tagged_splits(parts)


def example_split(spark, sf_dir):
    examples = materialize(chat_examples(spark, sf_dir).select("conv_id"), "examples")
    return row_splits.example_split(examples, "conv_id", VAL_RATIO, SEED)


def _conversations(spark, sf_dir) -> DataFrame:
    """One raw row per conversation."""
    return table(spark, sf_dir, "conversations").select("conv_id").distinct()


def row_split(spark, sf_dir):
    raw = materialize(_conversations(spark, sf_dir), "conversations")
    return row_splits.row_split(raw, "conv_id", TRAIN_FRACTION, SEED)


def split_members(spark, sf_dir):
    """Usable examples on either side of a split of the raw rows."""
    raw = materialize(row_split(spark, sf_dir), "split")
    examples = chat_examples(spark, sf_dir).select("conv_id")
    train = raw.where("split = 'train'")
    return (
        row_splits.members(examples, "conv_id", train)
        .withColumn("side", F.lit("train"))
        .unionByName(
            row_splits.others(examples, "conv_id", train).withColumn("side", F.lit("val"))
        )
    )


# --- chat -------------------------------------------------------------------------------------


def chat_examples(spark, sf_dir):
    return chat.chat_examples(chat.clean_turns(table(spark, sf_dir, "conversations")))


def chat_array_examples(spark, sf_dir):
    arrays = chat.message_arrays(table(spark, sf_dir, "conversations"))
    return chat.chat_array_examples(arrays, "conv_id")


def json_text_examples(spark, sf_dir):
    """Examples from message lists that are stored as JSON text."""
    arrays = chat.message_arrays(table(spark, sf_dir, "conversations"))
    stored = arrays.select("conv_id", F.to_json("messages").alias("messages"))
    parsed = stored.withColumn("messages", chat.parsed_messages(F.col("messages")))
    return chat.chat_array_examples(parsed, "conv_id")


def adjacent_pairs(spark, sf_dir):
    return chat.adjacent_turns(table(spark, sf_dir, "conversations"))


def jsonl_round_trip(spark, sf_dir):
    path = new_path(spark, "jsonl")
    ranges = order.key_ranges(table(spark, sf_dir, "conversations").select("conv_id"), "conv_id")
    files.write_jsonl(chat_examples(spark, sf_dir), path, ["prompt", "response"], "conv_id", ranges)
    return files.read_jsonl(spark, path)


# --- tokenizers -------------------------------------------------------------------------------


def char_vocab(spark, sf_dir):
    return tokens.char_vocabulary(corpus(spark, sf_dir))


def encoded_lines(spark, sf_dir):
    encoded = tokens.encode_lines(spread_corpus(spark, sf_dir), fitted(spark, sf_dir))
    return encoded.select("doc_id", F.size("ids").alias("n"), digest(F.col("ids")).alias("ids_md5"))


def decode_round_trip(spark, sf_dir):
    tokenizer = fitted(spark, sf_dir)
    ids = tokens.append_eos(tokenizer.encode(F.col("line")), tokenizer)
    return spread_corpus(spark, sf_dir).select("doc_id", tokenizer.decode(ids).alias("line"))


def byte_pair_definition(merges=MERGES, end="<|end|>") -> str:
    """A small byte-level tokenizer file: id = byte value, then the merges, then the end mark.

    Bytes without a printable Latin-1 character are written as characters from U+0100 on, which
    is the public byte-level convention.
    """
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in printable]
    names = {b: chr(b) if b in printable else chr(256 + hidden.index(b)) for b in range(256)}
    vocab = {names[b]: b for b in range(256)}
    vocab.update({m: 256 + i for i, m in enumerate(merges)})
    byte_level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True,
                  "use_regex": False}
    special = {"id": len(vocab), "content": end, "single_word": False, "lstrip": False,
               "rstrip": False, "normalized": False, "special": True}
    return json.dumps({
        "version": "1.0",
        "added_tokens": [special],
        "pre_tokenizer": byte_level,
        "decoder": byte_level,
        "model": {"type": "BPE", "vocab": vocab, "merges": [" ".join(m) for m in merges]},
    })


def subword_tokenizer() -> tokens.SubwordTokenizer:
    return tokens.SubwordTokenizer(byte_pair_definition(), "bytes", "<|end|>")


def subword_encode(spark, sf_dir):
    encoded = tokens.encode_lines(spread_corpus(spark, sf_dir), subword_tokenizer())
    return encoded.select("doc_id", F.size("ids").alias("n"), digest(F.col("ids")).alias("ids_md5"))


def subword_round_trip(spark, sf_dir):
    tokenizer = subword_tokenizer()
    ids = tokens.append_eos(tokenizer.encode(F.col("line")), tokenizer)
    return spread_corpus(spark, sf_dir).select("doc_id", tokenizer.decode(ids).alias("line"))


def subword_positions(spark, sf_dir):
    documents = files.spread(
        table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"
    )
    stream = corpus_plan.corpus_stream(documents, "doc_id", subword_tokenizer())
    return stream.rows.groupBy("doc_id").agg(
        F.min("start").alias("start"), F.sum("n").alias("n")
    )


def subword_chunks(spark, sf_dir):
    documents = files.spread(
        table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"
    )
    tokenizer = subword_tokenizer()
    stream = corpus_plan.corpus_stream(documents, "doc_id", tokenizer)
    return corpus_plan.id_chunks(stream, tokenizer, CHUNK).select(
        "chunk_id", F.size("ids").alias("n"), digest(F.col("ids")).alias("ids_md5")
    )


# --- fine-tuning rows -------------------------------------------------------------------------


def _sft_rows(spark, sf_dir) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return sft_plan.chat_rows(turns, sft_plan.chat_vocabulary(turns), MAX_LEN)



def sft_examples(spark, sf_dir):
    return _sft_rows(spark, sf_dir).select(
        "conv_id",
        F.col("length").alias("n_tokens"),
        F.col("supervised").alias("n_supervised"),
        digest(F.col("input_ids")).alias("ids_md5"),
        digest(F.col("labels")).alias("labels_md5"),
    )


def sft_subword_examples(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    rows = sft_plan.chat_rows(turns, subword_tokenizer(), MAX_LEN)
    return rows.select(
        "conv_id",
        F.col("length").alias("n_tokens"),
        F.col("supervised").alias("n_supervised"),
        digest(F.col("input_ids")).alias("ids_md5"),
        digest(F.col("labels")).alias("labels_md5"),
    )


def sft_padded(spark, sf_dir):
    rows = sft.padded(_sft_rows(spark, sf_dir), ["conv_id"], MAX_LEN)
    return rows.select("conv_id", digest(F.col("x")).alias("x_md5"), digest(F.col("y")).alias("y_md5"))


def sft_offsets(spark, sf_dir):
    rows = materialize(_sft_rows(spark, sf_dir).select("conv_id", "length"), "lengths")
    return sft.with_offsets(rows, "conv_id").select("conv_id", "start", "length")


def sft_cache(spark, sf_dir):
    """Built, reused, rebuilt; the last copy is read."""
    turns = table(spark, sf_dir, "conversations")
    tokenizer = sft_plan.chat_vocabulary(turns)
    root = new_path(spark, "caches")
    arguments = (spark, turns, tokenizer, root, "conversations", MAX_LEN)
    _, first = sft_plan.sft_cache(*arguments)
    _, again = sft_plan.sft_cache(*arguments)
    rows, built = sft_plan.sft_cache(*arguments, rebuild=True)
    return rows.select(
        "conv_id",
        "start",
        "length",
        digest(F.col("input_ids")).alias("ids_md5"),
        digest(F.col("labels")).alias("labels_md5"),
        F.lit(first["data"] == again["data"]).alias("reused"),
        F.lit(first["data"] != built["data"]).alias("rebuilt"),
        F.lit(built["num_tokens"]).cast("long").alias("num_tokens"),
    )


def sft_split_caches(spark, sf_dir):
    """Examples as JSON lines, read back, numbered, split as raw rows, cached per side."""
    turns = table(spark, sf_dir, "conversations")
    path = new_path(spark, "jsonl")
    ranges = order.key_ranges(turns.select("conv_id"), "conv_id")
    files.write_jsonl(chat_examples(spark, sf_dir), path, ["prompt", "response"], "conv_id", ranges)
    raw = files.number_rows(files.read_jsonl(spark, path, keyed=True))
    caches = sft_plan.sft_split_caches(
        spark, raw, "row", sft_plan.chat_vocabulary(turns), new_path(spark, "caches"),
        "examples", MAX_LEN, TRAIN_FRACTION, SEED,
    )
    rows = named_splits.tagged_splits({name: df for name, (df, _) in caches.items()})
    return rows.select(
        "split", "row", "start", "length",
        digest(F.col("input_ids")).alias("ids_md5"), digest(F.col("labels")).alias("labels_md5"),
    )


def _file_caches(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    named = row_split(spark, sf_dir).join(chat_examples(spark, sf_dir), "conv_id")
    named = materialize(named, "sides")
    sides, sources = {}, {}
    for side in ("train", "val"):
        sources[side] = new_path(spark, f"{side}-jsonl")
        files.write_jsonl(
            named.where(F.col("split") == side), sources[side], ["prompt", "response"], key="conv_id"
        )
        sides[side] = files.number_rows(files.read_jsonl(spark, sources[side], keyed=True))
    return sft_plan.sft_file_caches(
        spark, sides, "row", sft_plan.chat_vocabulary(turns), new_path(spark, "caches"), sources, MAX_LEN
    )


def sft_file_caches(spark, sf_dir):
    """Train and validation examples as two files, read back, numbered, cached per file."""
    caches = _file_caches(spark, sf_dir)
    rows = named_splits.tagged_splits({name: df for name, (df, _) in caches.items()})
    return rows.select(
        "split", "row", "start", "length",
        digest(F.col("input_ids")).alias("ids_md5"), digest(F.col("labels")).alias("labels_md5"),
    )


def sft_batches(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    rows, known = sft_plan.sft_cache(
        spark, turns, sft_plan.chat_vocabulary(turns), new_path(spark, "caches"), "conversations", MAX_LEN
    )
    draws = 4 * known["num_rows"]
    batches = sft_plan.sft_batches(
        spark, rows, "conv_id", draws, BATCH_ROWS, MAX_LEN, SEED, accumulate=2, manifest=known
    )
    return batches.select(
        "step", "micro", "row", "conv_id",
        digest(F.col("x")).alias("x_md5"), digest(F.col("y")).alias("y_md5"),
    )


# --- the token stream -------------------------------------------------------------------------


def token_positions(spark, sf_dir):
    rows = corpus_stream(spark, sf_dir).rows
    return rows.select("doc_id", "start", F.col("n").cast("long").alias("n"))


def token_chunks(spark, sf_dir):
    chunks = token_streams.token_chunks(corpus_stream(spark, sf_dir), CHUNK)
    return chunks.select(
        "chunk_id", F.length("content").alias("n"), F.md5("content").alias("content_md5")
    )


def _cached(spark, sf_dir):
    tokenizer = fitted(spark, sf_dir)
    documents = table(spark, sf_dir, "documents")
    return corpus_plan.token_cache(
        spark, documents, "doc_id", tokenizer, new_path(spark, "caches"), "documents", size=1024
    )


def token_cache(spark, sf_dir):
    rows, known = _cached(spark, sf_dir)
    return rows.select(
        "chunk_id",
        F.size("ids").alias("n"),
        digest(F.col("ids")).alias("ids_md5"),
        F.lit(known["num_tokens"]).cast("long").alias("num_tokens"),
    )


def cached_windows(spark, sf_dir):
    """Windows of ids from the cache, over the train part of the stream."""
    rows, known = _cached(spark, sf_dir)
    cut = int(known["num_tokens"] * TRAIN_FRACTION)
    drawn = corpus_plan.cached_windows(
        spark, rows, 1024, (0, cut), max(cut // 1024, 1), BATCH_ROWS, BLOCK, SEED, accumulate=2
    )
    return drawn.select(
        "step", "micro", "row", "start",
        digest(F.col("x")).alias("x_md5"), digest(F.col("y")).alias("y_md5"),
    )


def _flat(spark, sf_dir):
    rows, known = _cached(spark, sf_dir)
    prefix = new_path(spark, "flat")
    return prefix, corpus_plan.write_flat_cache(rows, known, prefix)


def flat_token_cache(spark, sf_dir):
    """The cache as one flat file, read back in ranges of bytes."""
    prefix, known = _flat(spark, sf_dir)
    rows = flat.read_tokens(spark, prefix, split_bytes=1 << 20)
    return rows.select(
        "chunk_id",
        F.size("ids").alias("n"),
        digest(F.col("ids")).alias("ids_md5"),
        F.lit(known["num_tokens"]).cast("long").alias("num_tokens"),
    )


def flat_windows(spark, sf_dir):
    """Windows of ids that tasks read from the flat file, over the train part of the stream."""
    prefix, known = _flat(spark, sf_dir)
    cut = int(known["num_tokens"] * TRAIN_FRACTION)
    drawn = corpus_plan.flat_windows(
        spark, prefix, (0, cut), max(cut // 1024, 1), BATCH_ROWS, BLOCK, SEED, accumulate=2
    )
    return drawn.select(
        "step", "micro", "row", "start",
        digest(F.col("x")).alias("x_md5"), digest(F.col("y")).alias("y_md5"),
    )


def flat_sft_cache(spark, sf_dir):
    """Fine-tuning rows as flat files of ids, labels and offsets, read back in ranges of bytes."""
    turns = table(spark, sf_dir, "conversations")
    rows, known = sft_plan.sft_cache(
        spark, turns, sft_plan.chat_vocabulary(turns), new_path(spark, "caches"), "conversations", MAX_LEN
    )
    prefix = new_path(spark, "flat")
    written = sft_plan.write_flat_cache(rows, known, prefix)
    return flat.read_examples(spark, prefix, split_bytes=1 << 18).select(
        "index", "start", "length",
        digest(F.col("input_ids")).alias("ids_md5"), digest(F.col("labels")).alias("labels_md5"),
        F.lit(written["num_tokens"]).cast("long").alias("num_tokens"),
    )


def bucketed_windows(spark, sf_dir):
    """Windows of ids from a cache in buckets, which stays where it is."""
    rows, known = _cached(spark, sf_dir)
    rows = corpus_plan.bucketed_cache(rows, known, new_path(spark, "buckets"))
    cut = int(known["num_tokens"] * TRAIN_FRACTION)
    drawn = corpus_plan.cached_windows(
        spark, rows, 1024, (0, cut), max(cut // 1024, 1), BATCH_ROWS, BLOCK, SEED, accumulate=2
    )
    return drawn.select(
        "step", "micro", "row", "start",
        digest(F.col("x")).alias("x_md5"), digest(F.col("y")).alias("y_md5"),
    )


def grown_token_cache(spark, sf_dir):
    """The cache from two folders of text lines, of which the second one comes later."""
    lines, folder = corpus(spark, sf_dir), new_path(spark, "lines")
    low, high = table(spark, sf_dir, "documents").agg(F.min("doc_id"), F.max("doc_id")).first()
    early = F.col("doc_id") <= (low + high) // 2
    arguments = spark, f"{folder}/*", fitted(spark, sf_dir), new_path(spark, "caches")
    files.write_lines(lines.where(early), f"{folder}/a", key="doc_id")
    growing.refresh(*arguments)
    files.write_lines(lines.where(~early), f"{folder}/b", key="doc_id")
    stream, known = growing.refresh(*arguments)
    return token_streams.token_chunks(stream, 1024).select(
        "chunk_id",
        F.size("ids").alias("n"),
        digest(F.col("ids")).alias("ids_md5"),
        F.lit(known["num_tokens"]).cast("long").alias("num_tokens"),
    )


def cached_epoch(spark, sf_dir):
    """One sequential pass of batches over the cache."""
    rows, known = _cached(spark, sf_dir)
    batches = corpus_plan.cached_epoch(
        spark, rows, 1024, known["num_tokens"], BATCH_ROWS, CHUNK
    )
    return batches.select(
        "batch", "row", digest(F.col("x")).alias("x_md5"), digest(F.col("y")).alias("y_md5")
    )


def file_token_cache(spark, sf_dir):
    """The cache from text lines on disk: written, read back, numbered, tokenized."""
    lines_read = files.read_lines(spark, _written_lines(spark, sf_dir), keyed=True)
    rows, known = corpus_plan.token_cache(
        spark, files.number_rows(lines_read), "row", fitted(spark, sf_dir),
        new_path(spark, "caches"), "lines", size=1024, text_field=None,
    )
    return rows.select(
        "chunk_id",
        F.size("ids").alias("n"),
        digest(F.col("ids")).alias("ids_md5"),
        F.lit(known["num_tokens"]).cast("long").alias("num_tokens"),
    )


def position_split(spark, sf_dir):
    parts = token_streams.position_split(corpus_stream(spark, sf_dir), TRAIN_FRACTION)
    return parts.select("split", "doc_id", "start", "n", F.md5("content").alias("content_md5"))


def split_token_counts(spark, sf_dir):
    parts = token_streams.position_split(corpus_stream(spark, sf_dir), TRAIN_FRACTION)
    return reports.token_counts(parts, F.col("n"))


def _windows(spark, sf_dir, split, seed, rank=0, world=1):
    stream = corpus_stream(spark, sf_dir)
    lo, hi = stream.split_at(TRAIN_FRACTION)[split]
    drawn = corpus_plan.training_windows(
        spark, stream, (lo, hi), max((hi - lo) // 1024, 1), BATCH_ROWS, BLOCK, seed,
        accumulate=2, rank=rank, world=world,
    )
    return drawn.select(
        "step", "micro", "row", "start", F.md5("x").alias("x_md5"), F.md5("y").alias("y_md5")
    )


def train_windows(spark, sf_dir):
    return _windows(spark, sf_dir, "train", SEED, rank=1, world=3)


def val_windows(spark, sf_dir):
    return _windows(spark, sf_dir, "val", SEED)


def sharded_starts(spark, sf_dir):
    total = corpus_stream(spark, sf_dir).total
    ranks = [
        windows.window_starts(spark, max(total // 1024, 1), total, BLOCK, SEED, r, 3).withColumn(
            "rank", F.lit(r)
        )
        for r in range(3)
    ]
    return ranks[0].unionByName(ranks[1]).unionByName(ranks[2])


def sequential_batches(spark, sf_dir):
    stream = corpus_stream(spark, sf_dir)
    chunks = token_streams.token_chunks(stream, CHUNK, overlap=1)
    batches = windows.sequential_batches(chunks, stream.total, BATCH_ROWS, CHUNK)
    x, y = windows.shifted_pair(batches, "content", CHUNK)
    return batches.select("batch", "row", F.md5(x).alias("x_md5"), F.md5(y).alias("y_md5"))


def context_tail(spark, sf_dir):
    tokenizer = fitted(spark, sf_dir)
    tail = last_ids(tokenizer.encode(F.col("line")), BLOCK)
    return spread_corpus(spark, sf_dir).select("doc_id", tokenizer.decode(tail).alias("tail"))


# --- reports ----------------------------------------------------------------------------------


def token_budget(spark, sf_dir):
    plans = spark.createDataFrame(PLANS, "plan string, batch long, block long, steps long")
    budget = reports.token_budget(split_token_counts(spark, sf_dir), plans)
    return budget.withColumns(
        {c: F.round(c, 6) for c in ("coverage_percent", "epochs")}
    )


def length_stats(spark, sf_dir):
    stats = reports.length_stats(corpus(spark, sf_dir), F.length("line") + 1, LENGTH_LIMITS)
    return stats.withColumns(
        {c: F.round(c, 6) for c in stats.columns if c not in ("rows", "min_len", "max_len")}
    )


def sft_length_stats(spark, sf_dir):
    lengths = sft.example_lengths(chat_examples(spark, sf_dir), subword_tokenizer(), "conv_id")
    stats = reports.length_stats(lengths, F.col("length"), LENGTH_LIMITS)
    return stats.withColumns(
        {c: F.round(c, 6) for c in stats.columns if c not in ("rows", "min_len", "max_len")}
    )


def supervised_stats(spark, sf_dir):
    rows = _sft_rows(spark, sf_dir).select("conv_id", "length", "supervised")
    stats = reports.supervised_stats(rows.join(row_split(spark, sf_dir), "conv_id"))
    return stats.withColumn("ratio", F.round("ratio", 6))


def _cache_histograms(spark, sf_dir):
    """Histograms beside the caches of both sides, taken twice: the second time none is read."""
    caches = _file_caches(spark, sf_dir).values()
    for rows, known in caches:
        sft_plan.cache_histogram(rows, known)
    first, second = (sft_plan.cache_histogram(rows.where("false"), known) for rows, known in caches)
    return first.unionByName(second)


def cached_length_stats(spark, sf_dir):
    """Length statistics of all caches from the histograms beside them."""
    counted = reports.merged_histograms(_cache_histograms(spark, sf_dir))
    stats = reports.histogram_stats(counted, LENGTH_LIMITS)
    return stats.withColumns(
        {c: F.round(c, 6) for c in stats.columns if c not in ("rows", "min_len", "max_len")}
    )


def cached_supervised_stats(spark, sf_dir):
    stats = reports.histogram_supervised(_cache_histograms(spark, sf_dir))
    return stats.withColumn("ratio", F.round("ratio", 6))


def vector_parity(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    rounded = vectors.select(
        "vec_id",
        F.transform("embedding", lambda x: F.round(x.cast("double"), 2)).alias("embedding"),
    )
    parity = reports.vector_parity(vectors, rounded, "vec_id", "embedding")
    return parity.withColumns({c: F.round(c, 6) for c in ("max_abs_diff", "mean_abs_diff")})


def match_rate(spark, sf_dir):
    tokenizer = fitted(spark, sf_dir)
    whole = spread_corpus(spark, sf_dir)
    left = whole.select("doc_id", tokenizer.encode(F.col("line")).alias("ids"))
    moved = whole.select("doc_id", tokenizer.encode(F.substring("line", 2, 2**31 - 1)).alias("ids"))
    rate = reports.match_rate(left, moved, "doc_id", "ids", skip=8)
    return rate.withColumn("match_percent", F.round("match_percent", 6))


def _snapshots(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select(
        "doc_id", (F.col("n_chars") % 2).cast("long").alias("shape")
    )
    labels = table(spark, sf_dir, "labels").select(
        "doc_id", F.col("quality").cast("long").alias("shape")
    )
    return documents, labels


def snapshot_diff(spark, sf_dir):
    return diff.keyed_diff(*_snapshots(spark, sf_dir), "doc_id", "shape")


def snapshot_counts(spark, sf_dir):
    return diff.diff_counts(snapshot_diff(spark, sf_dir))


def digest_diff(spark, sf_dir):
    """Keys that differ between two stored snapshots, found by digests of key ranges."""
    paths = []
    for side in _snapshots(spark, sf_dir):
        paths.append(new_path(spark, "snapshot"))
        snapshots.write_snapshot(side, "doc_id", "shape", paths[-1], width=16)
    return snapshots.changed_rows(spark, *paths)


def one_sided_keys(spark, sf_dir):
    return diff.one_sided(*_snapshots(spark, sf_dir), "doc_id", "shape")


# --- score vectors ----------------------------------------------------------------------------


def _scores(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def softmax_topk(spark, sf_dir):
    probs = scores.probabilities(_scores(spark, sf_dir), "embedding", TEMPERATURE)
    top = scores.top_choices(probs.select("vec_id", "probs"), "probs", TOP_K)
    return top.select("vec_id", "rank", "index", F.round("score", 6).alias("prob"))


def argmax_scores(spark, sf_dir):
    return scores.greedy_choice(_scores(spark, sf_dir), "embedding").select("vec_id", "choice")


def draw_topk(spark, sf_dir):
    drawn = scores.sampled_choice(
        _scores(spark, sf_dir), "vec_id", "embedding", SEED, TOP_K, TEMPERATURE
    )
    return drawn.select("vec_id", "choice")


def draw_whole(spark, sf_dir):
    drawn = scores.sampled_choice(
        _scores(spark, sf_dir), "vec_id", "embedding", SEED, temperature=TEMPERATURE
    )
    return drawn.select("vec_id", "choice")


def _score_blocks(spark, sf_dir) -> DataFrame:
    return score_blocks.cut_blocks(_scores(spark, sf_dir), "vec_id", "embedding", 24)


def blocked_softmax_topk(spark, sf_dir):
    """The likeliest entries of vectors in blocks."""
    top = score_blocks.top_probabilities(
        _score_blocks(spark, sf_dir), "vec_id", "embedding", TOP_K, TEMPERATURE
    )
    return top.withColumn("prob", F.round("prob", 6))


def blocked_argmax(spark, sf_dir):
    return score_blocks.greedy_choice(_score_blocks(spark, sf_dir), "vec_id", "embedding")


def blocked_draw_topk(spark, sf_dir):
    return score_blocks.sampled_top_choice(
        _score_blocks(spark, sf_dir), "vec_id", "embedding", SEED, TOP_K, TEMPERATURE
    )


def blocked_draw_whole(spark, sf_dir):
    """Draws from whole vectors in blocks, by noise on every entry."""
    return score_blocks.sampled_choice(
        _score_blocks(spark, sf_dir), "vec_id", "embedding", SEED, TEMPERATURE
    )


# --- run log ----------------------------------------------------------------------------------


def run_log(events: DataFrame) -> DataFrame:
    split = F.when(F.col("event_id") % 10 == 0, "val").otherwise("train")
    log = runlog.metric_rows(
        events, "event_type", "user_id", "ts", "event_id", "value", F.concat(split, F.lit("/loss"))
    )
    return log.withColumn("split", F.split_part("metric", F.lit("/"), F.lit(1)))


def _log(spark, sf_dir) -> DataFrame:
    return run_log(table(spark, sf_dir, "events"))


def log_append(spark, sf_dir):
    path = new_path(spark, "metrics")
    log = _log(spark, sf_dir).drop("split")
    for split in ("train", "val"):
        runlog.append_metrics(log.where(F.col("metric") == f"{split}/loss"), path)
    return spark.read.parquet(path).select("run", "step", "event_id", "metric", "value")


def log_latest(spark, sf_dir):
    return runlog.latest(_log(spark, sf_dir)).select("run", "step", "metric", "event_id", "value")


def log_interval(spark, sf_dir):
    log = runlog.latest(_log(spark, sf_dir))
    return runlog.interval_steps(log, 10).select("run", "step", "metric", "value")


def log_saved_steps(spark, sf_dir):
    log = runlog.latest(_log(spark, sf_dir))
    return runlog.interval_steps(log, 25, offset=1).select("run", "step", "metric", "value")


def log_tokens(spark, sf_dir):
    """Tokens seen after each training step; a step that was run again counts once."""
    train = runlog.latest(_log(spark, sf_dir).where("metric = 'train/loss'"))
    seen = runlog.tokens_seen(materialize(train, "train-steps"), ["step"], F.lit(TOKENS_PER_STEP))
    return seen.select("run", "step", "tokens_seen")


def log_loss(spark, sf_dir):
    loss = runlog.mean_loss(_log(spark, sf_dir), ["run", "step"], digits=8)
    return loss.withColumn("perplexity", F.round("perplexity", 3))


def log_split_losses(spark, sf_dir):
    losses = runlog.split_losses(_log(spark, sf_dir), "split", ["run", "step"])
    return losses.withColumns({c: F.round(c, 6) for c in ("train", "val")})


def log_rates(spark, sf_dir):
    rates = runlog.period_rates(
        _log(spark, sf_dir), "1 day", 86400.0, F.lit(TOKENS_PER_STEP)
    )
    return rates.select(
        "run",
        F.date_format("period_start", "yyyy-MM-dd").alias("day"),
        "batches",
        F.round("mean_value", 6).alias("mean_value"),
        F.round("tokens_per_sec", 6).alias("tokens_per_sec"),
    )


def log_throughput(spark, sf_dir):
    rates = runlog.throughput(
        _log(spark, sf_dir), F.lit(TOKENS_PER_STEP), runlog.elapsed_seconds()
    )
    return rates.withColumns({c: F.round(c, 6) for c in ("seconds", "tokens_per_sec")})


def log_generation(spark, sf_dir):
    stats = runlog.generation_stats(_log(spark, sf_dir))
    return stats.withColumns({c: F.round(c, 6) for c in ("seconds", "tokens_per_sec")})


def log_sweep_rows(spark, sf_dir):
    rows = runlog.sweep_rows(_log(spark, sf_dir), baseline="click")
    return rows.withColumns({c: F.round(c, 6) for c in ("value", "delta")})


def log_sweep(spark, sf_dir):
    wide = runlog.sweep(_log(spark, sf_dir), baseline="click")
    return wide.select("step", *[F.round(c, 6).alias(c) for c in wide.columns if c != "step"])


# --- next-token statistics --------------------------------------------------------------------


def _pairs(spark, sf_dir):
    tokenizer = fitted(spark, sf_dir)
    stream = corpus_stream(spark, sf_dir)
    chunks = corpus_plan.id_chunks(stream, tokenizer, 1024, overlap=1)
    parts = stream.split_at(TRAIN_FRACTION)
    return tokenizer, ngrams.pair_counts(chunks, "ids", 1024, parts)


def _train_pairs(counts: DataFrame) -> DataFrame:
    return counts.where("split = 'train'").drop("split")


def next_token_counts(spark, sf_dir):
    return _pairs(spark, sf_dir)[1]


def next_token_topk(spark, sf_dir):
    return ngrams.top_next(_train_pairs(_pairs(spark, sf_dir)[1]), 3)


def held_out_loss(spark, sf_dir):
    tokenizer, counts = _pairs(spark, sf_dir)
    counts = materialize(counts, "pairs")
    val = counts.where("split = 'val'").drop("split")
    loss = ngrams.held_out_loss(_train_pairs(counts), val, len(tokenizer.chars))
    return loss.withColumns({c: F.round(c, 6) for c in ("mean_loss", "perplexity")})


# --- streams ----------------------------------------------------------------------------------


def _new_rows(spark, sf_dir, name) -> DataFrame:
    schema = table(spark, sf_dir, name).schema
    return sinks.read_new(spark, f"{sf_dir}/{name}*.parquet", schema)


def stream_clean(spark, sf_dir):
    out = new_path(spark, "stream-lines")
    sinks.export_lines(_new_rows(spark, sf_dir, "documents"), out, f"{out}-state", "doc_id")
    return spark.read.parquet(out)


def stream_split(spark, sf_dir):
    """A split of a named subset, read as a stream of its files."""
    root, out = new_path(spark, "dataset"), new_path(spark, "stream-split")
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    documents.write.parquet(files.split_folder(root, "train", "plain"))
    names = files.available_splits(spark, root, "plain")
    stream = files.read_split(spark, root, names[0], "plain", streaming=True)
    sinks.export_lines(stream, out, f"{out}-state", "doc_id")
    return spark.read.parquet(out)


def stream_tokens(spark, sf_dir):
    root = new_path(spark, "stream-cache")
    sinks.extend_token_cache(
        _new_rows(spark, sf_dir, "documents"), root, f"{root}-state", "doc_id",
        fitted(spark, sf_dir),
    )
    rows = sinks.read_token_cache(spark, root)
    return rows.select("doc_id", "seg", "start", "n", digest(F.col("ids")).alias("ids_md5"))


def stream_chat(spark, sf_dir):
    source, out = new_path(spark, "messages"), new_path(spark, "stream-chat")
    arrays = chat.message_arrays(table(spark, sf_dir, "conversations"))
    arrays.write.parquet(source)
    sinks.export_chat(
        sinks.read_new(spark, source, arrays.schema), out, f"{out}-state", "conv_id"
    )
    return spark.read.parquet(out)


def stream_pairs(spark, sf_dir):
    source, out = new_path(spark, "pairs"), new_path(spark, "stream-pairs")
    pairs = chat.adjacent_turns(table(spark, sf_dir, "conversations"))
    keyed = pairs.select(F.struct("conv_id", "turn").alias("key"), "prompt", "response")
    keyed.write.parquet(source)
    sinks.export_prompt_response(
        sinks.read_new(spark, source, keyed.schema), out, f"{out}-state", "key"
    )
    return spark.read.parquet(out).select("key.conv_id", "key.turn", "prompt", "response")


def _new_log(spark, sf_dir) -> DataFrame:
    events = _new_rows(spark, sf_dir, "events")
    return run_log(events.withColumn("ts", F.col("ts").cast("timestamp")))


def stream_append(spark, sf_dir):
    out = new_path(spark, "stream-metrics")
    sinks.export_metrics(_new_log(spark, sf_dir).drop("split"), out, f"{out}-state")
    return spark.read.parquet(out).select("run", "step", "event_id", "metric", "value")


def stream_latest(spark, sf_dir):
    root = new_path(spark, "stream-latest")
    sinks.maintain_latest(_new_log(spark, sf_dir), root, f"{root}-state")
    return sinks.read_latest(spark, root).select("run", "step", "metric", "event_id", "value")


def stream_tokens_seen(spark, sf_dir):
    """Tokens seen after each training step, from sums that a keyed state keeps."""
    root = new_path(spark, "stream-runs")
    train = _new_log(spark, sf_dir).where("metric = 'train/loss'")
    runs.maintain_runs(train, root, f"{root}-state", F.lit(TOKENS_PER_STEP))
    return runs.read_runs(spark, root).select("run", "step", "tokens_seen")


def stream_rate(spark, sf_dir):
    root = new_path(spark, "stream-rates")
    sinks.export_rates(
        _new_log(spark, sf_dir), root, f"{root}-state", "1 day", F.lit(TOKENS_PER_STEP)
    )
    return sinks.read_rates(spark, root, 86400.0).select(
        "run",
        F.date_format("period_start", "yyyy-MM-dd").alias("day"),
        "batches",
        F.round("mean_value", 6).alias("mean_value"),
        F.round("tokens_per_sec", 6).alias("tokens_per_sec"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        clean_lines, clean_pages, first_n_lines, shuffled_order, string_key_order, text_round_trip, numbered_lines,
        whole_file,
        split_summary, split_files, export_summary, export_manifest, export_manifest_fields,
        export_lenient_split, export_local_split,
        example_split, row_split, split_members,
        chat_examples, chat_array_examples, json_text_examples, adjacent_pairs, jsonl_round_trip,
        char_vocab, encoded_lines, decode_round_trip,
        subword_encode, subword_round_trip, subword_positions, subword_chunks,
        sft_examples, sft_subword_examples, sft_padded, sft_offsets, sft_cache, sft_split_caches, sft_file_caches,
        sft_batches,
        token_positions, token_chunks, token_cache, file_token_cache, cached_windows,
        cached_epoch, flat_token_cache, flat_windows, flat_sft_cache, bucketed_windows,
        grown_token_cache,
        position_split, split_token_counts,
        train_windows, val_windows, sharded_starts, sequential_batches, context_tail,
        token_budget, length_stats, sft_length_stats, supervised_stats, cached_length_stats,
        cached_supervised_stats, vector_parity, match_rate,
        snapshot_diff, snapshot_counts, one_sided_keys, digest_diff,
        softmax_topk, argmax_scores, blocked_softmax_topk, blocked_argmax, blocked_draw_topk, blocked_draw_whole,
        draw_topk, draw_whole,
        log_append, log_latest, log_interval, log_saved_steps, log_tokens, log_loss,
        log_split_losses, log_rates, log_throughput, log_generation, log_sweep, log_sweep_rows,
        next_token_counts, next_token_topk, held_out_loss,
        stream_clean, stream_split, stream_tokens, stream_chat, stream_pairs, stream_append, stream_latest, stream_tokens_seen,
        stream_rate,
    )
}
