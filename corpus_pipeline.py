"""A training-data pipeline over ``documents``: five stages, each written and read back.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before has kept. All but
the last return the columns of ``documents``, whatever else they may be named like. Null texts have
no language and go in the first stage; documents without an id are never duplicates or leaks.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.llm import bpe, langid, leaks, line_dedup, minmax
from tokenmill.session import bound_batches, materialize

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def _stage(work: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage with Arrow batches of bounded size."""

    @wraps(work)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return work(spark, docs, sf_dir)

    return stage


def _wrapped(docs: DataFrame) -> DataFrame:
    """Rows as one column, so that no column of theirs meets an operator's."""
    return docs.select(F.struct("*").alias("row"), F.col("doc_id"), F.col("text"))


@_stage
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language, or with one that the codewords leave ambiguous."""
    model = langid.fit(docs)
    found = langid.predict(_wrapped(docs), model)
    clear = (F.col("lang_pred") != langid.UNKNOWN) & ~F.col("ambiguous")
    return found.where(clear).select("row.*")


@_stage
def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop repeated lines from all documents but the last one that holds them."""
    reduced = line_dedup.kept_text(line_dedup.with_bitmaps(_wrapped(docs)))
    row = F.col("row").withField("text", F.col("text"))
    row = row.withField("n_chars", F.char_length("text").cast("long"))
    return reduced.select(row.alias("row")).select("row.*")


@_stage
def single_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates, the one with the smallest id."""
    marks = minmax.near_duplicates(docs, width=SHINGLE_WORDS, percent=SIMILAR_PERCENT)
    ids = materialize(
        marks.where(F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows")),
        "near-duplicates",
    )
    kept = docs.join(ids.where(~F.col("kept")).select("doc_id"), "doc_id", "left_anti")
    several = ids.where(F.col("kept") & (F.col("rows") > 1)).select("doc_id")
    if not several.isEmpty():  # rows that share an id are copies too
        once = kept.join(several, "doc_id", "left_anti")
        kept = once.unionByName(
            kept.join(several, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        )
    return kept.select(*docs.columns)


@_stage
def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    found = leaks.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    ids = materialize(found.select("doc_id").distinct(), "leaking-documents")
    return docs.join(ids, "doc_id", "left_anti").select(*docs.columns)


@_stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of every document."""
    model = bpe.model_bytes(bpe.read_ranks(VOCABULARY))
    encoded = bpe.round_trip(
        docs.select("doc_id", "text"), model, public_tokenizers.PATTERN, with_ids=True
    )
    return encoded.drop("text")


STAGES = [
    ("language_id", known_language),
    ("line_dedup", fresh_lines),
    ("near_dedup", single_copies),
    ("decontamination", without_leaks),
    ("byte_bpe", tokens),
]
ORACLE_SQL = None  # the classifiers, hashes and merges of the stages are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
