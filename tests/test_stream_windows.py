"""The token stream, its chunks, splits, windows and pair counts against the joined text."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tokenmill.operators import ngrams, stream, tokens, windows
from tokenmill.operators.lines import corpus_lines
from catalog.queries import subword_tokenizer
from tokenmill.plans import corpus as plan
from tokenmill.session import new_path
from tokenmill.sources import files

RNG = random.Random(11)
ALPHABET = "ab é👍\n\r日"
TEXTS = {
    i: "".join(RNG.choice(ALPHABET) for _ in range(RNG.choice([1, 2, 5, 30, 200])))
    for i in RNG.sample(range(10_000), 120)
}
TEXTS[5] = "x" * 2900
TEXTS[10_001] = ""
TEXTS[10_002] = "\n"
KEPT = sorted(k for k, t in TEXTS.items() if t)
# A carriage return ends a line once the corpus is read back from its file.
LINES = {k: TEXTS[k].replace("\n", " ").strip().replace("\r", "\n") + "\n" for k in KEPT}
WHOLE = "".join(LINES[k] for k in KEPT)


@pytest.fixture(scope="module")
def documents(spark):
    rows = list(TEXTS.items())
    RNG.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(6)


@pytest.fixture(scope="module")
def text_stream(documents):
    return plan.line_stream(documents, "doc_id")


@pytest.fixture(scope="module")
def tokenizer():
    return tokens.CharTokenizer(tuple(sorted(set(WHOLE))))


@pytest.fixture(scope="module")
def id_stream(documents, tokenizer):
    lines = corpus_lines(documents, "doc_id")
    segments = tokens.encoded_segments(lines, "doc_id", tokenizer)
    return stream.token_stream(
        segments.withColumnRenamed("ids", "content"), ["doc_id", "seg"], "content"
    )


def test_positions(text_stream, id_stream, tokenizer):
    at = 0
    wanted = {}
    for k in KEPT:
        wanted[k] = (at, len(LINES[k]))
        at += len(LINES[k])
    assert text_stream.total == id_stream.total == len(WHOLE)
    assert {r["doc_id"]: (r["start"], r["n"]) for r in text_stream.rows.collect()} == wanted
    segments = id_stream.rows.orderBy("start").collect()
    assert [r["start"] for r in segments if r["seg"] == 0] == [wanted[k][0] for k in KEPT]
    assert [i for r in segments for i in r["content"]] == tokenizer.ids_of(WHOLE)
    assert all(r["n"] == len(r["content"]) <= tokens.SEGMENT for r in segments)


def test_files_give_the_same_stream(spark, documents, tokenizer):
    path = new_path(spark, "lines")
    files.write_lines(corpus_lines(documents, "doc_id"), path, key="doc_id")
    numbered = files.number_rows(files.read_lines(spark, path, keyed=True))
    assert numbered.count() == WHOLE.count("\n")
    subword = subword_tokenizer()
    for given in (tokenizer, subword):
        cached, known = plan.token_cache(
            spark, numbered, "row", given, new_path(spark, "cache"), "lines", 64, text_field=None
        )
        direct, _ = plan.token_cache(
            spark, documents, "doc_id", given, new_path(spark, "cache"), "documents", 64
        )
        rows = cached.orderBy("chunk_id").collect()
        assert rows == direct.orderBy("chunk_id").collect()
        firsts = [r["ids"][0] for r in rows]
        assert [r["next_id"] for r in rows] == [*firsts[1:], None]
        ids = [i for line in WHOLE[:-1].split("\n") for i in given.ids_of(line) + given.ids_of("\n")]
        assert [i for r in rows for i in r["ids"]] == ids and known["num_tokens"] == len(ids)
    assert plan.corpus_vocabulary(documents, "doc_id").chars == tokenizer.chars


@pytest.mark.parametrize("size, overlap", [(1, 0), (7, 0), (64, 0), (64, 1), (10, 25), (10_000, 1)])
@pytest.mark.parametrize("segment", [1024, 1])
def test_chunks(monkeypatch, text_stream, id_stream, tokenizer, size, overlap, segment):
    monkeypatch.setattr(stream, "SEGMENT", segment)
    wanted = {
        c: WHOLE[c * size : c * size + size + overlap] for c in range(-(-len(WHOLE) // size))
    }
    found = stream.token_chunks(text_stream, size, overlap).collect()
    assert len(found) == len(wanted)
    assert {r["chunk_id"]: r["content"] for r in found} == wanted
    if size == 64:
        ids = plan.id_chunks(id_stream, tokenizer, size, overlap).collect()
        assert {r["chunk_id"]: r["ids"] for r in ids} == {
            c: tokenizer.ids_of(t) for c, t in wanted.items()
        }


def test_chunks_inside_a_bucket_are_not_shuffled_again(text_stream):
    chunks = stream.token_chunks(text_stream, 64)
    chunks.collect()
    text = chunks._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in text
    final = text.split("Initial Plan")[0]
    assert final.count("Exchange hashpartitioning(_bucket") == 2  # the shuffle and its reuse
    assert final.count("Exchange hashpartitioning(chunk_id") == 1


@pytest.mark.parametrize("fraction", [0.5, 0.9, 0.123])
def test_position_split(text_stream, fraction):
    cut = int(len(WHOLE) * fraction)
    assert text_stream.split_at(fraction) == {"train": (0, cut), "val": (cut, len(WHOLE))}
    rows = stream.position_split(text_stream, fraction).collect()
    for split, text in (("train", WHOLE[:cut]), ("val", WHOLE[cut:])):
        side = sorted((r["start"], r["n"], r["content"]) for r in rows if r["split"] == split)
        assert "".join(c for _, _, c in side) == text
        assert all(len(c) == n and text[s : s + n] == c for s, n, c in side)


def test_split_too_small(spark):
    tiny = plan.line_stream(spark.createDataFrame([(1, "ab")], "doc_id long, text string"), "doc_id")
    with pytest.raises(ValueError):
        tiny.split_at(0.5)
    with pytest.raises(ValueError):
        tiny.split_at(1.0)


@pytest.mark.parametrize("size", [16, 50, 400])
def test_windows_at_the_edges(spark, text_stream, size):
    block = 50
    n = len(WHOLE)
    starts = [0, 1, size - 1, size, size + 1, n - block - 1, n // 2] + RNG.sample(range(n - block), 40)
    draws = spark.createDataFrame(list(enumerate(starts)), "draw long, start long")
    for pieces in (
        stream.stream_pieces(text_stream, size),
        windows.chunk_pieces(stream.token_chunks(text_stream, size), size, "content"),
    ):
        found = windows.gather_windows(pieces, draws, block, size, "content")
        x, y = windows.shifted_pair(found, "content", block)
        rows = {r["draw"]: (r["x"], r["y"]) for r in found.select("draw", x.alias("x"), y.alias("y")).collect()}
        assert rows == {
            d: (WHOLE[s : s + block], WHOLE[s + 1 : s + block + 1]) for d, s in enumerate(starts)
        }


def test_windows_of_ids(spark, id_stream, tokenizer):
    lo, hi = id_stream.split_at(0.8)["val"]
    rows = plan.training_windows(spark, id_stream, (lo, hi), 24, 4, 8, seed=3, accumulate=2).collect()
    ids = tokenizer.ids_of(WHOLE)[lo:hi]
    assert len(rows) == 24
    assert {(r["step"], r["micro"], r["row"]) for r in rows} == {
        (s, m, r) for s in range(3) for m in range(2) for r in range(4)
    }
    for r in rows:
        s = r["start"]
        assert r["x"] == ids[s : s + 8] and r["y"] == ids[s + 1 : s + 9]
        assert r["x"][1:] == r["y"][:-1]


def test_starts_cover_their_rank_only(spark):
    for rank in range(3):
        rows = windows.window_starts(spark, 400, 60, 10, 1, rank, 3).collect()
        assert {r["start"] for r in rows} == set(range(rank, 50, 3))
    again = windows.window_starts(spark, 400, 60, 10, 1, 2, 3).collect()
    assert sorted(again) == sorted(rows)


def test_start_errors(spark):
    with pytest.raises(ValueError):
        windows.window_starts(spark, 1, 10, 10, 1)
    with pytest.raises(ValueError):
        windows.window_starts(spark, 1, 12, 10, 1, rank=5, world=8)


def model_batches(n, span):
    """Batches a reader delivers before it starts again."""
    pos, count = 0, 0
    while True:
        count += 1
        pos += span
        if pos >= n - (span + 1):
            return count


@pytest.mark.parametrize("n", [25, 48, 49, 240, 241, 242, 263, 264, 265])
def test_epoch_length(n):
    assert windows.epoch_batches(n, 4, 6) == model_batches(n, 24)
    assert windows.epoch_batches(n, 4, 6, full=True) == (n - 1) // 24


def test_epoch_too_short():
    with pytest.raises(ValueError):
        windows.epoch_batches(24, 4, 6)


@pytest.mark.parametrize("full", [False, True])
def test_sequential_batches(text_stream, full):
    rows, block = 3, 17
    chunks = stream.token_chunks(text_stream, block, overlap=1)
    found = windows.sequential_batches(chunks, text_stream.total, rows, block, full)
    x, y = windows.shifted_pair(found, "content", block)
    got = {(r["batch"], r["row"]): (r["x"], r["y"]) for r in found.select("batch", "row", x.alias("x"), y.alias("y")).collect()}
    count = windows.epoch_batches(len(WHOLE), rows, block, full)
    wanted = {}
    for b in range(count):
        for r in range(rows):
            s = (b * rows + r) * block
            wanted[(b, r)] = (WHOLE[s : s + block], WHOLE[s + 1 : s + block + 1])
    assert got == wanted


@pytest.mark.parametrize("size, block", [(16, 10), (16, 16), (16, 50), (300, 17)])
def test_cached_ids_give_the_same_windows_and_epochs(spark, text_stream, tokenizer, size, block):
    cache = plan.id_chunks(text_stream, tokenizer, size)
    ids = tokenizer.ids_of(WHOLE)
    for lo, hi in text_stream.split_at(0.8).values():
        drawn = plan.cached_windows(spark, cache, size, (lo, hi), 30, 4, block, 3, rank=1, world=2)
        again = plan.training_windows(spark, text_stream, (lo, hi), 30, 4, block, 3, rank=1, world=2)
        rows = drawn.collect()
        assert len(rows) == 30
        for r in rows:
            at = lo + r["start"]
            assert r["x"] == ids[at : at + block] and r["y"] == ids[at + 1 : at + block + 1]
        assert {(r["step"], r["row"], r["start"], len(r["x"])) for r in rows} == {
            (r["step"], r["row"], r["start"], len(r["x"])) for r in again.collect()
        }
    epoch = plan.cached_epoch(spark, cache, size, len(ids), 3, block).collect()
    assert len(epoch) == 3 * windows.epoch_batches(len(ids), 3, block)
    for r in epoch:
        at = (r["batch"] * 3 + r["row"]) * block
        assert r["x"] == ids[at : at + block] and r["y"] == ids[at + 1 : at + block + 1]


@pytest.mark.parametrize("block", [8, 16, 64, 48])
def test_epochs_of_a_written_cache(spark, documents, tokenizer, block):
    cache, known = plan.token_cache(
        spark, documents, "doc_id", tokenizer, new_path(spark, "cache"), "documents", 64
    )
    ids = tokenizer.ids_of(WHOLE)
    found = plan.cached_epoch(spark, cache, 64, known["num_tokens"], 2, block)
    moved = "Exchange" in found._jdf.queryExecution().executedPlan().toString()
    assert moved == (64 % block != 0)
    rows = found.collect()
    assert len(rows) == 2 * windows.epoch_batches(len(ids), 2, block)
    for r in rows:
        at = (r["batch"] * 2 + r["row"]) * block
        assert r["x"] == ids[at : at + block] and r["y"] == ids[at + 1 : at + block + 1]


@pytest.mark.parametrize("size", [5, 64])
def test_pair_counts(text_stream, tokenizer, size):
    chunks = plan.id_chunks(text_stream, tokenizer, size, overlap=1)
    parts = text_stream.split_at(0.7)
    found = ngrams.pair_counts(chunks, "ids", size, parts).collect()
    ids = tokenizer.ids_of(WHOLE)
    for split, (lo, hi) in parts.items():
        wanted = Counter(zip(ids[lo:hi], ids[lo + 1 : hi]))
        got = {(r["cur"], r["next"]): r["n"] for r in found if r["split"] == split}
        assert got == wanted


def test_held_out_loss(spark, text_stream, tokenizer):
    import math

    chunks = plan.id_chunks(text_stream, tokenizer, 32, overlap=1)
    parts = text_stream.split_at(0.7)
    counts = ngrams.pair_counts(chunks, "ids", 32, parts)
    train, val = (counts.where(F.col("split") == s).drop("split") for s in ("train", "val"))
    row = ngrams.held_out_loss(train, val, len(tokenizer.chars)).first()
    ids, cut = tokenizer.ids_of(WHOLE), parts["train"][1]
    seen = Counter(zip(ids[:cut], ids[1:cut]))
    cur = Counter(ids[: cut - 1])
    pairs = list(zip(ids[cut:], ids[cut + 1 :]))
    losses = [-math.log((seen[p] + 1) / (cur[p[0]] + len(tokenizer.chars))) for p in pairs]
    assert row["pairs"] == len(pairs)
    assert row["mean_loss"] == pytest.approx(sum(losses) / len(losses), rel=1e-12)
    assert row["perplexity"] == pytest.approx(math.exp(row["mean_loss"]), rel=1e-12)
    top = ngrams.top_next(train, 2).collect()
    for c in cur:
        best = sorted(((n, -x) for (a, x), n in seen.items() if a == c), reverse=True)[:2]
        assert [(r["n"], -r["next"]) for r in sorted(top) if r["cur"] == c] == best


def test_perplexity_limit(spark):
    df = spark.createDataFrame([(19.99,), (20.0,), (None,)], "l double")
    found = [r[0] for r in df.select(ngrams.perplexity(F.col("l"))).collect()]
    assert found[0] < 5e8 and found[1] == float("inf")


def test_pairs_are_counted_without_a_copy_of_the_batch():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rows, size = 1 << 14, 1 << 10
    ids = pa.ListArray.from_arrays(
        pa.array(np.arange(rows + 1, dtype=np.int32) * size), pa.array(np.zeros(rows * size, np.int32))
    )
    ends = pa.array(np.full(rows, size, np.int32))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["train"] * rows), pa.array(np.zeros(rows, np.int32)), ends, ids],
        ["split", "first", "stop", "ids"],
    )
    tracemalloc.start()
    total = sum(sum(b.column("n").to_pylist()) for b in ngrams._count_pairs(iter([batch])))
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == rows * (size - 1)
    assert held < 8 * rows * size


def test_a_cache_deals_out_text_and_not_ids(spark, tmp_path, monkeypatch):
    from tokenmill.operators.tokens import CharTokenizer

    moved = []
    monkeypatch.setattr(
        plan, "in_key_ranges", lambda df, *a, f=plan.in_key_ranges: moved.append(dict(df.dtypes)) or f(df, *a)
    )
    df = spark.createDataFrame([(i, "abc" * i) for i in range(1, 40)], "doc_id long, text string")
    rows, known = plan.token_cache(
        spark, df, "doc_id", CharTokenizer(("\n", "a", "b", "c")), str(tmp_path), "x", size=16
    )
    found = [i for r in rows.orderBy("chunk_id").collect() for i in r["ids"]]
    assert found == [i for n in range(1, 40) for i in [1, 2, 3] * n + [0]]
    assert known["num_tokens"] == len(found)
    assert moved and not any("array" in t for types in moved for t in types.values())
