"""Line dedup, line field, language codes against plain versions."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tokenmill.llm import langid, line_crf, line_dedup

from .edge_rows import awkward, clashing, empty, prose, table
from .test_text_kernels import ascii_lower, words

STRIP = " \t\n\x0b\x0c\r"


def kept_lines(rows):
    """(id, text) -> (lines, dropped, digest), by the rule."""
    none = -(1 << 63)
    holders = collections.defaultdict(set)
    key = lambda line: ascii_lower(line.strip(STRIP))
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(none if doc is None else doc)
    out = {}
    for doc, text in rows:
        lines = (text or "").split("\n")
        own = none if doc is None else doc
        kept = [
            x for x in lines
            if len(holders.get(key(x), ())) < 5 or own == max(holders[key(x)])
        ]
        digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        out[doc, text] = (len(lines), len(lines) - len(kept), digest)
    return out


def repeated_rows():
    pick = random.Random(5)
    shared = [prose(100 + i, 12) for i in range(6)] + ["  é" * 25, "X" * 40, "y" * 39]
    rows = awkward()
    for doc in range(20, 70):
        lines = [pick.choice(shared).upper() if pick.random() < 0.3 else pick.choice(shared)
                 for _ in range(pick.randint(0, 6))]
        rows.append((doc, "\n".join([*lines, prose(doc, 9), " " + shared[0] + "\t"])))
    return rows


def test_line_dedup_equals_rule(spark):
    rows = repeated_rows()
    df = clashing(table(spark, rows), "keep_bitmap", "n_lines", "h1", "last", "_doc", "_text_hash", "_row")
    out = line_dedup.digests(line_dedup.with_bitmaps(df)).collect()
    wanted = kept_lines(rows)
    assert len(out) == len(rows)
    for r in out:
        assert (r["n_lines"], r["n_dropped"], r["kept_sha256"]) == wanted[r["doc_id"], r["text"]]
    assert sum(r["n_dropped"] for r in out) > 100
    texts = line_dedup.kept_text(line_dedup.with_bitmaps(df)).collect()
    for r, d in zip(sorted(texts, key=str), range(len(texts))):
        assert r["last"] == r["_doc"] == r["_text_hash"] == r["_row"] == "own"
    digests = {hashlib.sha256(r["text"].encode()).hexdigest() for r in texts}
    assert digests == {w[2] for w in wanted.values()}


def test_line_dedup_hot_line_spans_ranges(spark):
    """One line in every document, over more ranges than distinct lines."""
    rows = [(i, "the same long line in every document of the table\n" + prose(i, 3)) for i in range(400)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = line_dedup.digests(line_dedup.with_bitmaps(table(spark, rows))).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r["doc_id"] for r in out if r["n_dropped"] == 0} == {399}


def test_line_dedup_empty_table(spark):
    assert line_dedup.with_bitmaps(empty(spark)).count() == 0


@pytest.mark.parametrize("dropped", [[0], [3], [0, 7, 8], list(range(50))])
def test_bitmaps(dropped):
    keep = line_dedup.unpack(line_dedup.pack(dropped), 60)
    assert np.flatnonzero(~keep).tolist() == dropped
    assert line_dedup.unpack(None, 3).all()


def plain_counts(text):
    text = text or ""
    w = words(text)
    grams = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(3)}
    seen, duplicates = set(), 0
    for line in text.split("\n"):
        if words(line):
            duplicates += line in seen
            seen.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(w), sum(map(len, w)), symbols, duplicates, len(covered)


def test_quality_counts(spark):
    rows = awkward() + [(90, "a b c a b c d"), (91, "x\nx\n x\n\n\nx"), (92, "#a *b $ <|>")]
    out = line_crf.judge(clashing(table(spark, rows), "kept", "n_words"), None).collect()
    assert len(out) == len(rows)
    for r in out:
        found = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert found == plain_counts(r["text"])
        failed = found[0] < 50 or 100 * found[4] > 50 * found[0]
        assert r["base_failed"] == failed and r["kept"] == (not failed)
    assert line_crf.judge(empty(spark), None).count() == 0


def test_viterbi_equals_all_paths():
    random_numbers = np.random.default_rng(1)
    for _ in range(50):
        field = line_crf.Field(
            random_numbers.normal(size=(2, line_crf.FEATURES)), random_numbers.normal(size=(2, 2))
        )
        lines = random_numbers.normal(size=(6, line_crf.FEATURES))
        def total(path):
            score = sum(lines[i] @ field.emission[s] for i, s in enumerate(path))
            return score + sum(field.transition[a, b] for a, b in zip(path, path[1:]))
        paths = [[m >> i & 1 for i in range(6)] for m in range(64)]
        assert line_crf.viterbi(field, lines).tolist() == max(paths, key=total)


def labelled():
    rows, labels = [], []
    for i in range(120):
        good = i % 2
        text = prose(i, 90, 6) if good else "\n".join(
            " | ".join(f"{w.upper()}!!" for w in prose(i + 7 * k, 15).split()) for k in range(6)
        )
        rows.append((i, text))
        labels.append((i, good))
    return rows, labels


def test_field_learns_lines(spark):
    rows, labels = labelled()
    table_of_labels = spark.createDataFrame(labels + [(None, 1), (500, 0), (3, None)], "doc_id long, quality int")
    field = line_crf.fit(table(spark, rows + awkward()), table_of_labels)
    mixed = [(1000, prose(999, 400, 20) + "\n" + rows[0][1]), (1001, rows[0][1] + "\n" + prose(5, 10))]
    out = {r["doc_id"]: r for r in line_crf.judge(table(spark, rows + mixed), field).collect()}
    assert all(out[i]["kept"] == bool(y) for i, y in labels)
    assert out[1000]["kept"] and 0 < out[1000]["content_share"] < 1
    assert not out[1001]["kept"]


def test_field_needs_both_labels(spark):
    rows, labels = labelled()
    ones = spark.createDataFrame([x for x in labels if x[1]], "doc_id long, quality int")
    assert line_crf.fit(table(spark, rows), ones) is None
    assert line_crf.fit(table(spark, rows), ones.where("false")) is None
    assert line_crf.fit(empty(spark), ones) is None


def languages(n):
    pools = {
        "aa": "the of and to in that was his with".split(),
        "bb": "der die und den von das nicht ein ich".split(),
        "cc": "le la les des est que dans une pour".split(),
        "dd": "el los que una por con para las del".split(),
    }
    pick = random.Random(9)
    for i in range(n):
        label = pick.choice(sorted(pools))
        yield i, " ".join(pick.choice(pools[label]) for _ in range(pick.randint(5, 60))), label


def test_language_held_out(spark):
    rows = list(languages(400))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.where("doc_id % 4 != 2").unionByName(
        spark.createDataFrame([(9000, None, "zz"), (9001, "x", None)], df.schema)))
    assert model.labels == ("aa", "bb", "cc", "dd") and model.code.shape == (4, 7)
    out = langid.predict(df.where("doc_id % 4 = 2"), model).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in out) >= 0.99 * len(out)
    assert all(0 <= r["score"] <= 1 for r in out)
    odd = [(1, None), (2, ""), (3, "123 ... !!"), (4, "日本"), (5, "a"), (6, "der und " * 50_000)]
    found = {r["doc_id"]: r for r in langid.predict(
        clashing(table(spark, odd), "lang_pred", "score"), model).collect()}
    assert [found[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3
    assert found[4]["lang_pred"] in model.labels and found[5]["ambiguous"]
    assert found[6]["lang_pred"] == "bb" and not found[6]["ambiguous"]
    assert langid.predict(empty(spark), model).count() == 0


def test_language_without_training_rows(spark):
    none = langid.fit(spark.createDataFrame([], "text string, lang string"))
    out = langid.predict(table(spark), none).collect()
    assert {(r["lang_pred"], r["score"]) for r in out} == {("und", 0.0)}
    one = langid.fit(spark.createDataFrame([("abc", "aa")], "text string, lang string"))
    assert {r["lang_pred"] for r in langid.predict(table(spark, [(1, "xyz")]), one).collect()} == {"aa"}


@pytest.mark.parametrize("labels", [2, 3, 5, 6, 40])
def test_codewords_are_apart(labels):
    code = langid.codewords(labels).astype(int)
    assert (np.abs(code.sum(0)) < labels).all()
    apart = (code.shape[1] - code @ code.T) // 2
    assert apart[~np.eye(labels, dtype=bool)].min() >= (1 if labels < 4 else 4)


def test_decoding_equals_loss_of_each_codeword():
    model = langid.Model(("a", "b", "c"), langid.codewords(3), np.zeros((3, langid.BUCKETS), np.float32))
    margin = np.array([[1.0, -2.0, 0.5], [0, 0, 0]])
    best, score, ambiguous = langid.decode(model, margin)
    losses = [[np.logaddexp(0, -m * w).sum() for w in model.code] for m in margin]
    assert best.tolist() == [int(np.argmin(x)) for x in losses]
    assert score[0] == pytest.approx(np.exp(-min(losses[0])) / np.exp(-np.array(losses[0])).sum())
    assert ambiguous[1] and best[1] == 0


def test_more_labels_than_a_code_can_list(spark):
    """Any number of labels; weights by bucket equal the dense formula."""
    pick = random.Random(9)
    names = [f"l{i:03}" for i in range(620)]
    words = {n: ["".join(pick.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(6)] for n in names}
    rows = [(i, " ".join(pick.choices(words[n], k=12)), n) for i, n in enumerate(names * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    model = langid.fit(df.where("doc_id < 1240"))
    assert len(model.labels) == 620
    out = langid.predict(df.where("doc_id >= 1240"), model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.9 * len(out)
    few = df.where(F.col("lang").isin("l001", "l002", "l003") & (F.col("doc_id") < 1240))
    small = langid.fit(few)
    totals = np.full((3, langid.BUCKETS), langid.SMOOTHING)
    for _, text, name in (r for r in rows if r[2] in small.labels and r[0] < 1240):
        for _, _, grams, _ in langid._batches(pa.array([text])):
            totals[small.labels.index(name)] += np.bincount(grams, minlength=langid.BUCKETS)
    shares = totals / totals.sum(axis=1, keepdims=True)
    for bit, weights in zip(small.code.T, small.weights):
        wanted = np.log(shares[bit > 0].mean(axis=0)) - np.log(shares[bit < 0].mean(axis=0))
        assert (weights == wanted.astype(np.float32)).all()


def test_codes_for_many_labels():
    code = langid.codewords(3000)
    assert code.shape[0] == 3000 and len({bytes(x) for x in code}) == 3000


def test_field_learns_from_the_ends_of_texts(spark, monkeypatch):
    """Training lines come from anywhere in a text, the same ones on every run."""
    seen = []
    monkeypatch.setattr(line_crf, "fit_field", lambda documents, states: seen.append(documents))
    body = [f"line {i} " + "x" * i for i in range(200)]
    rows = [(i, f"{i}\n" + "\n".join(body)) for i in range(80)] + [(99, "a\nb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    for parts in (2, 5):
        line_crf.fit(docs.repartition(parts), labels)
    assert [d.tolist() for d in seen[0]] == [d.tolist() for d in seen[1]]
    whole = line_crf.measure(pa.array([rows[0][1]])).features
    last = sum(any((line == whole[-1]).all() for line in d) for d in seen[0] if len(d) == 32)
    starts = {d[0].tobytes() for d in seen[0]}
    assert len(starts) > 20 and last >= 1 and min(map(len, seen[0])) == 2
