"""Flat binary caches against numpy's own files, and the identity of cached data."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tokenmill.plans import corpus, sft
from tokenmill.sources import cache, flat


def chunk_rows(ids, chunk):
    return [(i // chunk, [int(x) for x in ids[i : i + chunk]]) for i in range(0, len(ids), chunk)]


def chunk_frame(spark, ids, chunk, parts=5):
    return spark.createDataFrame(chunk_rows(ids, chunk), "chunk_id long, ids array<int>").repartition(parts)


@pytest.mark.parametrize("n, chunk, again", [(0, 4, 4), (1, 4, 4), (999, 16, 7), (1000, 10, 64), (5000, 1024, 512)])
def test_tokens_round_trip(spark, tmp_path, n, chunk, again):
    ids = np.random.default_rng(n).integers(0, 2**31 - 1, n)
    prefix = f"file:{tmp_path}/a b[1]/x"
    known = flat.write_tokens(chunk_frame(spark, ids, chunk), prefix, chunk, tokenizer="t", split_name="full")
    path = flat.token_files(f"{tmp_path}/a b[1]/x")
    assert known == json.load(open(path[1])) and known["num_tokens"] == n and known["tokenizer"] == "t"
    assert (np.fromfile(path[0], np.uint32) == ids).all()
    read = flat.read_tokens(spark, prefix, again, split_bytes=600)
    rows = sorted(read.collect())
    assert [(r["chunk_id"], r["ids"]) for r in rows] == chunk_rows(ids, again)
    assert [r["next_id"] for r in rows] == [*(r["ids"][0] for r in rows[1:]), None][: len(rows)]
    assert sorted(p.name for p in (tmp_path / "a b[1]").iterdir()) == ["x.tokens.bin", "x.tokens.meta.json"]


def test_tokens_of_a_range_come_from_its_bytes_alone(spark, tmp_path, monkeypatch):
    ids = np.arange(10_000)
    prefix = str(tmp_path / "x")
    ids.astype("<u4").tofile(prefix + ".tokens.bin")  # as another program writes it
    rows = flat.read_tokens(spark, prefix, 64, tokens=(1000, 2000)).orderBy("chunk_id").collect()
    assert [r["chunk_id"] for r in rows] == list(range(1000 // 64, -(-2000 // 64)))
    assert rows[0]["ids"] == list(range(960, 1024))
    monkeypatch.setattr(flat, "READ_BYTES", 1024)
    seen = []
    read = flat.ByteRange.read
    monkeypatch.setattr(flat.ByteRange, "read", lambda s, at, n: seen.append((at, n)) or read(s, at, n))
    reader = flat.TokenReader({"path": prefix, "chunk": "64", "split": "4096"})
    parts = reader.partitions()
    assert len(parts) == 10
    for part in parts:
        seen.clear()
        got = [x for b in reader.read(part) for x in b.column("ids").flatten().to_pylist()]
        lo, hi = part.first * 64, min(part.last * 64, 10_000)
        assert got == list(range(lo, hi))
        assert min(at for at, _ in seen) == 4 * lo
        assert max(at + n for at, n in seen) <= 4 * (hi + 1)  # one id ahead
        assert max(n for _, n in seen) <= 1024 + 4


def test_bad_token_files_are_refused(spark, tmp_path):
    ids = np.arange(100)
    prefix = str(tmp_path / "x")
    whole = chunk_frame(spark, ids, 10)
    for bad in (
        whole.where("chunk_id <> 4"), whole.union(whole.where("chunk_id = 3")),
        whole.withColumn("ids", F.when(F.col("chunk_id") == 5, F.slice("ids", 1, 9)).otherwise(F.col("ids"))),
        whole.withColumn("ids", F.concat("ids", "ids")),
        whole.withColumn("ids", F.when(F.col("chunk_id") != 5, F.col("ids"))),
    ):
        with pytest.raises(Exception, match="end at row|more than 10 ids|no place for nulls"):
            flat.write_tokens(bad, prefix, 10)
        assert list(tmp_path.iterdir()) == []
    with pytest.raises(Exception, match="every executor mounts"):
        flat.write_tokens(whole, "s3://bucket/x", 10)
    flat.write_tokens(whole, prefix, 10)
    with open(prefix + ".tokens.bin", "ab") as out:
        out.write(b"\1\0\0\0")
    with pytest.raises(Exception, match="its manifest 100"):
        flat.read_tokens(spark, prefix).count()
    with open(prefix + ".tokens.bin", "ab") as out:
        out.write(b"\1")
    with pytest.raises(Exception, match="no whole ids"):
        flat.read_tokens(spark, prefix).count()
    np.array([2**31], "<u4").tofile(str(tmp_path / "y.tokens.bin"))
    with pytest.raises(Exception, match="above 2"):
        flat.read_tokens(spark, str(tmp_path / "y")).count()


def test_a_task_may_run_twice(tmp_path):
    writer = flat.TokenWriter({"path": str(tmp_path / "x"), "chunk": "3"}, True)
    batch = pa.RecordBatch.from_pydict({"chunk_id": [2, 0, 1], "ids": [[6], [0, 1, 2], [3, 4, 5]]})
    writer.write(iter([batch]))
    writer.commit([writer.write(iter([batch.slice(0, 1)])), None, writer.write(iter([batch.slice(1)]))])
    assert list(np.fromfile(tmp_path / "x.tokens.bin", "<u4")) == list(range(7))


def example_rows(n, seed=1):
    pick, rows, at = random.Random(seed), [], 0
    for i in range(n):
        ids = [pick.randint(0, 10**6) for _ in range(pick.randint(1, 40))]
        rows.append((i, at, ids, [-100, *ids[1:]]))
        at += len(ids)
    return rows


EXAMPLE = "index long, start long, input_ids array<int>, labels array<int>"


@pytest.mark.parametrize("n", [0, 1, 300])
def test_examples_round_trip(spark, tmp_path, n):
    rows = example_rows(n)
    prefix = str(tmp_path / "x")
    df = spark.createDataFrame(rows, EXAMPLE).repartition(4)
    known = flat.write_examples(df, prefix, max_seq_len=40)
    assert (known["num_samples"], known["max_seq_len"], known["ignore_index"]) == (n, 40, -100)
    paths = flat.example_files(prefix)
    offsets = np.load(paths[2])
    assert offsets.dtype == np.int64 and offsets.shape == (n, 2)
    assert offsets.tolist() == [[r[1], len(r[2])] for r in rows]
    assert np.fromfile(paths[0], np.int32).tolist() == [x for r in rows for x in r[2]]
    assert np.fromfile(paths[1], np.int32).tolist() == [x for r in rows for x in r[3]]
    read = sorted(flat.read_examples(spark, prefix, split_bytes=4000).collect())
    assert [tuple(r) for r in read] == [(i, at, len(x), x, y) for i, at, x, y in rows]


def test_examples_by_another_program_are_read_in_ranges(spark, tmp_path, monkeypatch):
    rows = example_rows(500, 2)
    ids, labels, offsets, _ = flat.example_files(str(tmp_path / "x"))
    np.array([x for r in rows for x in r[2]], np.int32).tofile(ids)
    np.array([x for r in rows for x in r[3]], np.int32).tofile(labels)
    np.save(offsets, np.array([(r[1], len(r[2])) for r in rows], np.int64))
    assert flat.read_examples(spark, str(tmp_path / "x")).count() == 500
    monkeypatch.setattr(flat, "READ_BYTES", 512)
    reader = flat.ExampleReader({"path": str(tmp_path / "x"), "split": "9000"})
    seen = []
    read = flat.ByteRange.read
    monkeypatch.setattr(flat.ByteRange, "read", lambda s, at, n: seen.append(n) or read(s, at, n))
    parts, got = reader.partitions(), []
    for part in parts:
        seen.clear()
        got += [r for b in reader.read(part) for r in b.to_pylist()]
        assert sum(seen) <= 2 * 4 * sum(len(r[2]) for r in rows[part.first : part.last]) + 16 * 500
        assert max(seen) <= 1024
    assert len(parts) > 5 and [(r["index"], r["input_ids"]) for r in got] == [(r[0], r[2]) for r in rows]
    np.save(offsets, np.array([(r[1] + (r[0] == 9), len(r[2])) for r in rows], np.int64))
    with pytest.raises(Exception, match="do not follow each other"):
        flat.read_examples(spark, str(tmp_path / "x")).count()
    np.save(offsets, np.zeros((5, 3), np.int64))
    with pytest.raises(Exception, match="not int64"):
        flat.read_examples(spark, str(tmp_path / "x")).count()


def test_example_gaps_are_refused(spark, tmp_path):
    df = spark.createDataFrame(example_rows(30), EXAMPLE)
    for bad in (df.where("index <> 7"), df.withColumn("labels", F.slice("labels", 1, 1))):
        with pytest.raises(Exception, match="end at row|as many labels"):
            flat.write_examples(bad, str(tmp_path / "x"))
    assert list(tmp_path.iterdir()) == []


def test_gather_reads_what_is_asked_for(spark, tmp_path, monkeypatch):
    ids = np.random.default_rng(1).integers(0, 1000, 50_000)
    prefix = str(tmp_path / "x")
    ids.astype("<u4").tofile(prefix + ".tokens.bin")
    pick = random.Random(1)
    starts = [pick.randint(100, 49_000) for _ in range(200)] + [100, 100, 49_000]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(starts)], "draw long, start long")
    found = flat.gather(df, prefix, 33, (100, 49_033))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "flat_tokens" not in plan and plan.count("Exchange") == 1
    rows = found.collect()
    assert sorted((r["draw"], r["ids"]) for r in rows) == [(i, ids[s : s + 33].tolist()) for i, s in enumerate(starts)]
    seen = []
    read = flat.ByteRange.read
    monkeypatch.setattr(flat.ByteRange, "read", lambda s, at, n: seen.append(n) or read(s, at, n))
    at = np.array(sorted(starts[:40]))
    assert flat._windows(flat.ByteRange(prefix + ".tokens.bin"), at, 33).shape == (40, 33)
    assert sum(seen) <= 4 * 3 * 33 * 40
    with pytest.raises(Exception, match="the file ends"):
        flat.gather(df.limit(1).withColumn("start", F.lit(49_990)), prefix, 33, (0, 50_000)).collect()


# --- identity of cached data ---------------------------------------------------------------------


@pytest.fixture
def stored(spark, tmp_path):
    path = f"{tmp_path}/my docs [x]"
    spark.range(50).selectExpr("id", "concat('Text ', id) as text").repartition(3).write.parquet(path)
    return path


def test_identity_sees_every_column_of_a_wide_table(spark, stored):
    def wide(last):
        df = spark.read.parquet(stored.replace("[", "\\[").replace("]", "\\]"))
        return df.select("id", *[F.lower("text").alias(f"c{i}") for i in range(40)], last("text").alias("last"))

    assert cache.data_identity(wide(F.lower)) == cache.data_identity(wide(F.lower))
    assert cache.data_identity(wide(F.lower)) != cache.data_identity(wide(F.upper))


def test_identity_sees_what_a_function_does(spark, stored):
    df = spark.read.parquet(stored.replace("[", "\\[").replace("]", "\\]"))
    one, two = (F.udf(lambda x, end=end: x + end, "string") for end in "ab")
    assert cache.data_identity(df.select(one("text"))) != cache.data_identity(df.select(two("text")))

    def through(end):
        return df.mapInPandas(lambda frames: (f.assign(text=f["text"] + end) for f in frames), df.schema)

    assert cache.data_identity(through("a")) != cache.data_identity(through("b"))
    assert cache.data_identity(through("a")) == cache.data_identity(through("a"))


def test_identity_sees_files_options_and_columns_of_the_same_name(spark, tmp_path):
    path = f"{tmp_path}/lines"
    spark.createDataFrame([("a;b,c",), ("d;e,f",)], "x string").coalesce(1).write.text(path)
    semi, comma = (spark.read.option("sep", s).csv(path) for s in ";,")
    assert cache.data_identity(semi) != cache.data_identity(comma)
    before = cache.data_identity(spark.read.text(path))
    assert before == cache.data_identity(spark.read.text(path))
    spark.createDataFrame([("more",)], "x string").coalesce(1).write.mode("append").text(path)
    assert before != cache.data_identity(spark.read.text(path))
    left, right = semi.alias("l"), spark.read.option("sep", ";").csv(path).alias("r")
    both = left.join(right, F.col("l._c0") == F.col("r._c1"))
    assert cache.data_identity(both.select("l._c0")) != cache.data_identity(both.select("r._c0"))


def test_identity_of_rows_in_memory(spark):
    rows = [cache.data_identity(spark.createDataFrame([(x,)], "a int")) for x in (1, 2, 1)]
    assert rows[0] == rows[2] != rows[1]


def test_file_caches_take_versions(spark, tmp_path):
    sides = {s: spark.createDataFrame([(0, "ab", "ba")], "row long, prompt string, response string") for s in ("a", "b")}
    tokenizer = sft.CharTokenizer.fit(sides["a"].select(F.lit("ab").alias("line")))
    made = sft.sft_file_caches(
        spark, sides, "row", tokenizer, str(tmp_path), {"a": "x", "b": "y"}, 8, versions={"a": "v1"}
    )
    assert made["a"][1]["version"] == "v1" != made["b"][1]["version"]


def test_plans_write_flat_caches(spark, tmp_path):
    docs = spark.createDataFrame([(i, "some text " * (i % 7)) for i in range(60)], "doc_id long, text string")
    tokenizer = corpus.corpus_vocabulary(docs, "doc_id")
    rows, known = corpus.token_cache(spark, docs, "doc_id", tokenizer, f"{tmp_path}/c", "docs", size=50)
    written = corpus.write_flat_cache(rows, known, f"{tmp_path}/f")
    assert written["num_tokens"] == known["num_tokens"] and written["source_file"] == "docs"
    read = flat.read_tokens(spark, f"{tmp_path}/f", 50)
    assert sorted(read.collect()) == sorted(rows.select("chunk_id", "ids", "next_id").collect())
    total = known["num_tokens"]
    drawn = corpus.flat_windows(spark, f"{tmp_path}/f", (100, total), 40, 4, 16, seed=3, accumulate=2)
    wanted = corpus.cached_windows(spark, rows, 50, (100, total), 40, 4, 16, seed=3, accumulate=2)
    assert sorted(drawn.collect()) == sorted(wanted.collect())


def test_ranges_of_a_large_file_are_few(tmp_path, monkeypatch):
    monkeypatch.setattr(flat, "MOST_RANGES", 5)
    prefix = str(tmp_path / "many")
    np.arange(1000, dtype="<u4").tofile(flat.token_files(prefix)[0])
    reader = flat.TokenReader({"path": prefix, "chunk": "8", "split": "32"})
    ranges = reader.partitions()
    assert len(ranges) == 5 and [r.first for r in ranges[1:]] == [r.last for r in ranges[:-1]]
    read = [b.column("ids").flatten().to_numpy() for r in ranges for b in reader.read(r)]
    assert np.concatenate(read).tolist() == list(range(1000))
    monkeypatch.setattr(flat, "SPLIT_BYTES", 64)  # no range grows beyond it
    assert len(reader.partitions()) == 63
    ids, labels, offsets, _ = flat.example_files(prefix)
    for name in (ids, labels):
        np.arange(1000, dtype="<i4").tofile(name)
    np.save(offsets, np.stack([np.arange(0, 1000, 4), np.full(250, 4)], axis=1))
    monkeypatch.setattr(flat, "SPLIT_BYTES", 1 << 20)
    examples = flat.ExampleReader({"path": prefix, "split": "32"})
    assert len(examples.partitions()) == 5
    assert sum(b.num_rows for r in examples.partitions() for b in examples.read(r)) == 250
