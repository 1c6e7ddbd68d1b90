"""A cache that follows a folder, and gathering from buckets."""

import os
import random

import pytest

from tokenmill.operators.stream import token_chunks
from tokenmill.operators.tokens import CharTokenizer
from tokenmill.plans import corpus, growing
from tokenmill.sources import cache, files


def write(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w", encoding="utf-8") as out:
        out.write("".join(f"{x}\n" for x in lines))


def some_lines(seed, most=30):
    pick = random.Random(seed)
    return ["".join(pick.choices("ab cé", k=pick.choice([0, 3, 40]))) for _ in range(pick.randint(1, most))]


def plain_ids(folder, tokenizer):
    text = ""
    for name in sorted(os.listdir(folder)):
        if name.endswith(".txt"):
            text += open(f"{folder}/{name}", encoding="utf-8").read()
    return tokenizer.ids_of(text)


def chunks_of(stream, size=50):
    rows = sorted(token_chunks(stream, size).collect())
    assert [r["chunk_id"] for r in rows] == list(range(len(rows)))
    return [x for r in rows for x in r["ids"]]


@pytest.fixture
def tokenizer(spark):
    return CharTokenizer.fit(spark.createDataFrame([("ab cé\n",)], "line string"))


def test_only_changed_files_are_read(spark, tmp_path, tokenizer, monkeypatch):
    folder, root = str(tmp_path / "my [lines]"), str(tmp_path / "cache")
    for i in range(100):
        write(folder, f"{i:03}.txt", some_lines(i, 5))
    path = folder.replace("[", "\\[").replace("]", "\\]")
    read, plain_read = [], files.read_lines

    def spy(spark, paths, keyed=False):
        read.append(paths)
        return plain_read(spark, paths, keyed)

    monkeypatch.setattr(files, "read_lines", spy)
    stream, known = growing.refresh(spark, path, tokenizer, root)
    assert known["encoded_files"] == 100 and read == [path]
    assert chunks_of(stream) == plain_ids(folder, tokenizer)

    write(folder, "041.txt", ["changed", "a b"][1:] * 9)
    stream, known = growing.refresh(spark, path, tokenizer, root)
    assert known["encoded_files"] == 1 and len(read[-1]) == 1 and "041" in read[-1][0]
    assert chunks_of(stream) == plain_ids(folder, tokenizer)
    assert known["num_tokens"] == len(plain_ids(folder, tokenizer))

    os.remove(f"{folder}/007.txt")
    write(folder, "000-new.txt", ["é" * 77])
    write(folder, "050.txt", [])
    stream, known = growing.refresh(spark, path, tokenizer, root)
    assert known["encoded_files"] == 1
    assert chunks_of(stream) == plain_ids(folder, tokenizer)

    before = len(read)
    stream, known = growing.refresh(spark, path, tokenizer, root)
    assert known["encoded_files"] == 0 and len(read) == before
    wanted = chunks_of(stream)
    again, known = growing.refresh(spark, path, tokenizer, root, rebuild=True)
    assert known["encoded_files"] == 99 and chunks_of(again) == wanted == plain_ids(folder, tokenizer)


def test_a_stream_that_grew_gives_the_usual_windows(spark, tmp_path, tokenizer):
    folder = str(tmp_path / "lines")
    for i in range(6):
        write(folder, f"{i}.txt", some_lines(i + 50))
        stream, _ = growing.refresh(spark, folder, tokenizer, str(tmp_path / "cache"))
    lines = files.number_rows(files.read_lines(spark, folder, keyed=True))
    whole = corpus.stream_of_lines(lines, "row")
    assert whole.total == stream.total
    drawn = corpus.training_windows(spark, stream, (5, stream.total), 20, 4, 16, seed=2)
    text = corpus.training_windows(spark, whole, (5, stream.total), 20, 4, 16, seed=2)
    wanted = {(r["step"], r["row"]): tokenizer.ids_of(r["x"]) for r in text.collect()}
    assert {(r["step"], r["row"]): r["x"] for r in drawn.collect()} == wanted


def test_another_tokenizer_and_an_empty_folder(spark, tmp_path, tokenizer):
    folder, root = str(tmp_path / "lines"), str(tmp_path / "cache")
    os.makedirs(folder)
    stream, known = growing.refresh(spark, folder, tokenizer, root)
    assert (known["encoded_files"], stream.total, token_chunks(stream, 9).count()) == (0, 0, 0)
    write(folder, "a.txt", ["ab"])
    stream, _ = growing.refresh(spark, folder, tokenizer, root)
    assert chunks_of(stream) == tokenizer.ids_of("ab\n")
    other = CharTokenizer.fit(spark.createDataFrame([("zab\n",)], "line string"))
    stream, known = growing.refresh(spark, folder, other, root)
    assert known["encoded_files"] == 1 and chunks_of(stream) == other.ids_of("ab\n")
    write(folder, "b.txt", ["unknown: q"])
    with pytest.raises(Exception):
        growing.refresh(spark, folder, tokenizer, root)
    os.remove(f"{folder}/b.txt")
    stream, known = growing.refresh(spark, folder, tokenizer, root)
    assert known["encoded_files"] == 0 and chunks_of(stream) == tokenizer.ids_of("ab\n")


def subtree_above(plan, scan):
    """Operators between a scan and the first join above it."""
    lines = plan.split("\n")
    at = next(i for i, x in enumerate(lines) if scan in x)
    depth, out = len(lines[at]) - len(lines[at].lstrip(" :+-*(0123456789)")), []
    for line in reversed(lines[:at]):
        own = len(line) - len(line.lstrip(" :+-*(0123456789)"))
        if own < depth:
            depth = own
            out.append(line.strip(" :+-*(0123456789)"))
            if "Join" in line:
                return out
    return out


def test_gathering_leaves_a_bucketed_cache_where_it_is(spark, tmp_path):
    docs = spark.createDataFrame([(i, "some text " * (i % 9)) for i in range(90)], "doc_id long, text string")
    tokenizer = corpus.corpus_vocabulary(docs, "doc_id")
    rows, known = corpus.token_cache(spark, docs, "doc_id", tokenizer, f"{tmp_path}/c", "docs", size=40)
    path = f"{tmp_path}/buckets"
    dealt = corpus.bucketed_cache(rows, known, path, buckets=16)
    total = known["num_tokens"]
    arguments = 40, (30, total), 60, 4, 16, 3, 2
    wanted = sorted(corpus.cached_windows(spark, rows, *arguments).collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for table in (dealt, cache.read_bucketed(spark, path, "chunk_id", 16)):
            found = corpus.cached_windows(spark, table, *arguments)
            plan = found._jdf.queryExecution().executedPlan().toString()
            above = subtree_above(plan, "FileScan parquet")
            assert any("Join" in x for x in above) and not any("Exchange" in x for x in above), plan
            assert sorted(found.collect()) == wanted
        plain = corpus.cached_windows(spark, rows, *arguments)._jdf.queryExecution().executedPlan().toString()
        assert any("Exchange" in x for x in subtree_above(plain, "FileScan parquet"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.sql(f"drop table {cache._table_name(path)}")
    again = cache.read_bucketed(spark, path, "chunk_id", 16)
    assert sorted(again.collect()) == sorted(rows.collect())


def test_lines_are_placed_as_text(spark, tmp_path, tokenizer, monkeypatch):
    """With an id per character, no ids are shuffled to find the places of lines; long lines are cut."""
    folder = str(tmp_path / "lines")
    write(folder, "a.txt", ["ab c" * 700, "", "é" * 1023, "b" * 1024])
    write(folder, "b.txt", some_lines(3))
    moved = []
    monkeypatch.setattr(
        growing, "running_total",
        lambda df, *a, f=growing.running_total, **b: moved.append(dict(df.dtypes)) or f(df, *a, **b),
    )
    stream, known = growing.refresh(spark, folder, tokenizer, str(tmp_path / "cache"))
    assert chunks_of(stream) == plain_ids(folder, tokenizer)
    assert max(r["n"] for r in stream.rows.select("n").collect()) <= 1024
    assert moved and not any("array" in t for types in moved for t in types.values())
