"""The queries of this subpackage: one per operator, over whole tables, and the pipeline."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.llm import (
    bpe, filter_audit, hash_tree, langid, leaks, line_crf, line_dedup, minmax, phrases, pii, secrets,
    unigram, warc,
)
from tokenmill.session import bound_batches, new_path

BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SHARDS = 8
TREE = hash_tree.even_tree(regions=2, racks=2, shards=2)
HELD_OUT = 2  # remainder of crc32(doc_id) by 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_minmax_dedup(spark, sf_dir):
    """Near-duplicate component of every document: 3-word shingles, similarity 0.85."""
    return minmax.near_duplicates(texts(spark, sf_dir), width=3, percent=85)


def op2_seeded_alignment(spark, sf_dir):
    """Every document and benchmark item that leaks into it."""
    return leaks.leaks(texts(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op3_pii_boosting(spark, sf_dir):
    """Counts and places of personal data in every document."""
    return pii.digests(pii.spans(texts(spark, sf_dir)))


def op4_byte_bpe(spark, sf_dir):
    """Ids and decoded bytes of every document, as digests."""
    model = bpe.model_bytes(bpe.read_ranks(BYTE_BPE))
    return bpe.round_trip(texts(spark, sf_dir), model, public_tokenizers.PATTERN).drop("text")


def op5_line_dedup(spark, sf_dir):
    """Line counts of every document and the digest of its kept lines."""
    marked = line_dedup.with_bitmaps(texts(spark, sf_dir))
    return line_dedup.digests(marked).drop("text")


def op6_warc_segments(spark, sf_dir):
    """Digest and record type of every page, from archives that were written and read back."""
    path = new_path(spark, "archives")
    warc.write_archives(table(spark, sf_dir, "pages").select("page_id", "html"), path)
    return warc.page_digests(spark, path)


def op7_unigram_counts(spark, sf_dir):
    """Token count of every document."""
    vocabulary = unigram.read_vocabulary(PIECES)
    return unigram.count_tokens(texts(spark, sf_dir), vocabulary, split=False).drop("text")


def op8_line_crf(spark, sf_dir):
    """Plain counts of every document, the share of its content lines and the verdict."""
    documents = texts(spark, sf_dir)
    field = line_crf.fit(documents, table(spark, sf_dir, "labels"))
    return line_crf.judge(documents, field).drop("text")


def op9_hash_tree(spark, sf_dir):
    """Shard and slot of every document, and its shard once there is one more."""
    assigned = hash_tree.assign(texts(spark, sf_dir), TREE)
    grown = hash_tree.shard_of(F.col("doc_id"), hash_tree.with_shard(TREE, SHARDS))
    return hash_tree.with_slots(assigned).select(
        "*", F.lit(hash_tree.LAW).alias("law"), grown.alias("grown_shard")
    )


def held_out(doc_id: str = "doc_id"):
    remainder = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4
    return F.coalesce(remainder == HELD_OUT, F.lit(False))


def op10_ecoc_language(spark, sf_dir):
    """Predicted language of every document, learned from three quarters of them."""
    documents = table(spark, sf_dir, "documents")
    model = langid.fit(documents.where(~held_out() & F.col("doc_id").isNotNull()))
    tested = documents.select("doc_id", "text", held_out().alias("held_out"))
    return langid.predict(tested, model).drop("text")


def op11_toivonen_phrases(spark, sf_dir):
    """The strongest phrases of each language."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_trigram_secrets(spark, sf_dir):
    """Counts and places of secrets in every document."""
    return secrets.digests(secrets.spans(texts(spark, sf_dir)))


def op13_filter_potential(spark, sf_dir):
    """What five filters remove, by language, order and step."""
    failures = filter_audit.failed_filters(table(spark, sf_dir, "documents"))
    labels = table(spark, sf_dir, "labels")
    return filter_audit.audit(filter_audit.count_failures(failures, labels))


QUERIES = {
    f.__name__: f
    for f in (
        op1_minmax_dedup, op2_seeded_alignment, op3_pii_boosting, op4_byte_bpe, op5_line_dedup,
        op6_warc_segments, op7_unigram_counts, op8_line_crf, op9_hash_tree, op10_ecoc_language,
        op11_toivonen_phrases, op12_trigram_secrets, op13_filter_potential,
    )
}
QUERIES["pipeline"] = corpus_pipeline.run
