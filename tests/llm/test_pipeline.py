"""The registered queries and the pipeline over the smallest tables."""

import hashlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tokenmill.llm import bpe, langid
from tokenmill.llm.queries import QUERIES, held_out

from .edge_rows import prose
from .test_groups import plain_dedup
from .test_lines_and_quality import kept_lines

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_queries_are_registered():
    names = set(__spark_entry__.queries())
    assert set(QUERIES) <= names and "pipeline" in names
    assert {int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")} == set(range(1, 14))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"pipeline"}))
def test_queries_return_whole_tables(spark, name):
    out = QUERIES[name](spark, SF_DIR)
    rows = out.count()
    if name.startswith("op2_"):
        assert 0 < rows and out.columns == ["doc_id", "item_id", "similarity"]
    elif name.startswith("op11_"):
        assert 0 < rows <= 2000 * out.select("lang").distinct().count()
    elif name.startswith("op13_"):
        assert rows == 600 * out.select("part").distinct().count() > 0
    else:
        source = "pages" if name.startswith("op6_") else "documents"
        assert rows == spark.read.parquet(f"{SF_DIR}/{source}.parquet").count()


def test_language_is_held_out(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang")
    out = QUERIES["op10_ecoc_language"](spark, SF_DIR).join(documents, "doc_id").where("held_out")
    assert out.where("lang_pred = lang").count() >= 0.97 * out.count() > 0
    assert documents.where(held_out()).count() == out.count()


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


@pytest.fixture(scope="module")
def documents(spark):
    given = spark.read.parquet(f"{SF_DIR}/documents.parquet").select(*COLUMNS)
    item = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").first()["text"]
    long_line = "a line that very many documents have in common, word for word"
    extra = [
        (9001, None, "en", "s", 0), (9002, "12345 !!", "en", "s", 8), (9003, None, None, None, None),
        (9004, prose(1, 80), "en", "s", 1), (9004, prose(1, 80), "en", "s", 1),
        (9005, prose(1, 80), "en", "s", 1), (None, prose(2, 90), "en", "s", 1),
        (9006, prose(3, 60) + " " + item + " " + prose(4, 60), "en", "s", 1),
        *((9010 + i, prose(50 + i, 70) + "\n" + long_line, "en", "s", 1) for i in range(8)),
    ]
    rows = spark.createDataFrame(extra, given.schema)
    return given.unionByName(rows).withColumns({"kept": F.lit("own"), "ambiguous": F.lit(1)})


def test_stages(spark, documents, tmp_path):
    columns = documents.columns
    known = corpus_pipeline.known_language(spark, documents, SF_DIR).cache()
    assert known.columns == columns
    model = langid.fit(documents)
    judged = langid.predict(documents.select(*COLUMNS), model).where(
        "lang_pred <> 'und' and not ambiguous"
    )
    assert rows_of(known) == rows_of(judged)
    assert not {9001, 9002, 9003} & {r[0] for r in rows_of(known)}

    fresh = corpus_pipeline.fresh_lines(spark, known, SF_DIR).cache()
    assert fresh.columns == columns
    wanted = kept_lines([(r[0], r[1]) for r in rows_of(known)])
    assert len(rows_of(fresh)) == len(rows_of(known))
    digests = sorted((str(r[0]), hashlib.sha256(r[1].encode()).hexdigest()) for r in rows_of(fresh))
    assert digests == sorted(
        (str(r[0]), wanted[r[0], r[1]][2]) for r in rows_of(known)
    )
    assert all(r["n_chars"] == len(r["text"]) for r in fresh.collect())
    assert sum("in common, word for word" in r["text"] for r in fresh.collect()) == 1

    single = corpus_pipeline.single_copies(spark, fresh, SF_DIR).cache()
    assert single.columns == columns
    component = plain_dedup([(r["doc_id"], r["text"]) for r in fresh.collect()], 5, 80)
    kept = sorted(d for d, c in component.items() if d == c)
    assert sorted(r["doc_id"] for r in single.collect() if r["doc_id"] is not None) == kept
    assert [r["text"] for r in single.where("doc_id is null").collect()] == [prose(2, 90)]

    free = corpus_pipeline.without_leaks(spark, single, SF_DIR).cache()
    assert free.columns == columns
    gone = {r["doc_id"] for r in single.collect()} - {r["doc_id"] for r in free.collect()}
    assert 9006 in gone and 9004 not in gone

    out = corpus_pipeline.tokens(spark, free, SF_DIR).collect()
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, special_tokens={},
        mergeable_ranks=bpe.read_ranks(corpus_pipeline.VOCABULARY),
    )
    texts = sorted((r["text"] for r in free.collect()))
    assert sorted(tuple(r["ids"]) for r in out) == sorted(tuple(library.encode_ordinary(t)) for t in texts)


def test_run_equals_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
    run = corpus_pipeline.run(spark, SF_DIR)
    assert sorted(map(str, run.collect())) == sorted(map(str, docs.collect()))


def test_empty_documents(spark, documents):
    docs = documents.where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
        assert docs.count() == 0
