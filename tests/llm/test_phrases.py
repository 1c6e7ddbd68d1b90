"""Phrases against counts and scores by plain loops."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tokenmill.llm import phrases

from .edge_rows import awkward, clashing, table

SCHEMA = "doc_id long, text string, lang string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def pieces(text):
    return [
        [w for w in re.split("[ \t]+", piece) if w]
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text))
    ]


def plain_counts(rows, most=4):
    counts = collections.Counter()
    for _, text, lang in rows:
        for words in pieces(text):
            for n in range(1, most + 1):
                for i in range(len(words) - n + 1):
                    counts[lang or "und", " ".join(words[i : i + n])] += 1
    return counts


def plain_collocations(rows, least=30, percent=80, top=2000):
    counts = plain_counts(rows)
    n = collections.Counter()
    for (lang, phrase), f in counts.items():
        n[lang] += f * (" " not in phrase)
    out = collections.defaultdict(list)
    candidates = {x: f for x, f in counts.items() if " " in x[1] and f >= least}
    covered = set()
    for (lang, phrase), f in candidates.items():
        words = phrase.split(" ")
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                inner = " ".join(words[i : i + k])
                if 100 * f >= percent * counts[lang, inner]:
                    covered.add((lang, inner))
    for (lang, phrase), a in candidates.items():
        words = phrase.split(" ")
        cuts = []
        for k in range(1, len(words)):
            l, r = counts[lang, " ".join(words[:k])], counts[lang, " ".join(words[k:])]
            cuts.append((2_000_000 * a // (l + r), k, l, r))
        score, _, l, r = min(cuts)
        if (lang, phrase) not in covered:
            out[lang].append((-score, -a, phrase.encode(), l, r))
    return {
        (lang, i + 1, phrase.decode(), -a, l, r, n[lang], -score)
        for lang, found in out.items()
        for i, (score, a, phrase, l, r) in enumerate(sorted(found)[:top])
    }


def corpus(seed=1, docs=700):
    pick = random.Random(seed)
    words = "alpha beta Gamma é日本 naïve \x85 nu".split(" ")
    fixed = ["new york city hall", "Of The", "a  b\tc d e", "one two.three four"]
    rows = [(*r, None) for r in awkward()]
    for doc in range(docs):
        text = []
        for _ in range(pick.randint(0, 40)):
            text.append(pick.choice(fixed) if pick.random() < 0.4 else pick.choice(words))
            text.append(pick.choice([" ", " ", "  ", "\t", ", ", "\n", ".\r"]))
        rows.append((pick.choice([doc, doc, None]), "".join(text), pick.choice(["en", "en", "de", None, "und"])))
    return rows + rows[-5:]


def frame(spark, rows):
    return clashing(spark.createDataFrame(rows, SCHEMA).repartition(5), "phrase", "words", "n", "h")


def test_collocations_equal_plain_ones(spark):
    rows = corpus()
    wanted = plain_collocations(rows)
    assert len(wanted) > 30 and len({x[0] for x in wanted}) == 3
    found = phrases.collocations(frame(spark, rows))
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {tuple(r) for r in found.collect()} == wanted
    few = phrases.collocations(frame(spark, rows), top=3)
    assert {tuple(r) for r in few.collect()} == {x for x in wanted if x[1] <= 3}


@pytest.mark.parametrize("share", [0.0, 0.3, 1.0])
def test_counts_do_not_depend_on_the_sample(spark, share):
    rows = corpus(2, 120)
    found, passes = phrases.frequent_phrases(frame(spark, rows), min_count=12, share=share)
    got = {(r["lang"], r["phrase"]): r["n"] for r in found.where("words > 0").collect()}
    assert got == {x: f for x, f in plain_counts(rows).items() if f >= 12}
    assert passes == {0.0: 2, 1.0: 1}.get(share, passes) and 1 <= passes <= 2


def test_full_bitmaps_count_everything(spark, monkeypatch):
    rows = corpus(3, 100)
    monkeypatch.setattr(phrases, "_size", lambda n: 4)
    monkeypatch.setattr(phrases, "LEAST_BITS", 4)
    found, _ = phrases.frequent_phrases(frame(spark, rows), min_count=9)
    got = {(r["lang"], r["phrase"]): r["n"] for r in found.where("words > 0").collect()}
    assert got == {x: f for x, f in plain_counts(rows).items() if f >= 9}


def test_hot_parts_are_dealt_to_blocks(spark, monkeypatch):
    monkeypatch.setattr(phrases, "HOT_ROWS", 3)
    rows = corpus()
    found = {tuple(r) for r in phrases.collocations(frame(spark, rows)).collect()}
    assert found == plain_collocations(rows)


def test_empty_tables(spark):
    for rows in ([], [(1, None, None), (2, "", "en"), (3, " \t.,", "de")]):
        assert phrases.collocations(spark.createDataFrame(rows, SCHEMA)).count() == 0


def slab_counts(texts, langs, most=4):
    """Counts by the kernels of one batch, and how often each key comes."""
    names = sorted(set(langs))
    hashes = phrases._hashes([x.encode() for x in names])
    codes = np.array([names.index(x) for x in langs])
    data, offsets = phrases.text_bytes(pa.array(texts, pa.string()))
    counts, keys, largest = collections.Counter(), collections.Counter(), 0
    every = {w: (np.full(2, 255, np.uint8), 4) for w in range(1, most + 1)}
    for raw, starts, row, carried in phrases._slabs(data, offsets, most - 1):
        largest = max(largest, len(raw))
        args = raw, starts, codes[row:], hashes
        slab = phrases._Slab(*args)
        for words, at, n in phrases._flagged(slab, every, carried):
            for place, phrase, f in zip(at, slab.phrases(at, words).to_pylist(), n):
                counts[names[slab.lang[place]], phrase] += int(f)
        for own, n in phrases._bordered(phrases._Slab(*args), range(1, most + 1), {}, None, carried):
            for k, f in zip(own, n):
                keys[int(k)] += int(f)
    return counts, keys, largest


@pytest.mark.parametrize("size", [16, 64, 1000])
def test_long_rows_are_cut_without_loss(monkeypatch, size):
    monkeypatch.setattr(phrases, "SLAB", size)
    rows = [(i, t, x) for i, (_, t, x) in enumerate(corpus(4, 60)) if len(t or "") < 5000]
    rows += [(1, "w " * 400 + " " * 300 + "tail " + "q" * 200 + " end", "en"), (2, "z" * 500, "de")]
    counts, keys, largest = slab_counts([t for _, t, _ in rows], [x or "und" for _, _, x in rows])
    assert counts == plain_counts(rows)
    assert sorted(keys.values()) == sorted(counts.values())
    assert largest <= 2 * size + 2000


def test_slabs_of_a_long_text_stay_small(monkeypatch):
    monkeypatch.setattr(phrases, "SLAB", 1000)
    data, offsets = phrases.text_bytes(pa.array(["some words " * 20_000]))
    sizes = [len(s[0]) for s in phrases._slabs(data, offsets, 3)]
    assert len(sizes) > 150 and max(sizes) < 1100


def test_sample_threshold():
    assert phrases.sample_threshold(30, 1.0) == 30
    assert phrases.sample_threshold(30, 0.0) == 1
    pick = random.Random(1)
    least = phrases.sample_threshold(30, 0.2)
    missed = sum(sum(pick.random() < 0.2 for _ in range(30)) < least for _ in range(20_000))
    assert 0.01 < missed / 20_000 < 0.06


def test_products_may_pass_64_bits(spark):
    big = 4_000_000_000_000_000_000
    rows = [("en", 1, "a", big + 2), ("en", 1, "b", big + 3), ("en", 2, "a b", big + 1)]
    frequent = spark.createDataFrame(rows, phrases.COUNTS)
    found = phrases.score_phrases(frequent).first()
    assert found["score"] == 2_000_000 * (big + 1) // (2 * big + 5) and found["l"] == big + 2
    assert phrases._product(F.lit(big), 100) is not None


@pytest.mark.parametrize("shared", ["mix", "run_hashes"])
def test_words_that_share_a_hash_are_told_apart(monkeypatch, shared):
    rows = [r for r in corpus(5, 30) if len(r[1] or "") < 5000]
    few = {
        "mix": lambda x: x & np.uint64(3),
        "run_hashes": lambda data, starts, ends: (ends - starts).astype(np.uint64) & np.uint64(1),
    }
    monkeypatch.setattr(phrases, shared, few[shared])
    counts, _, _ = slab_counts([t for _, t, _ in rows], [x or "und" for _, _, x in rows])
    assert counts == plain_counts(rows)


def test_the_expansion_is_counted_with_the_words(spark, monkeypatch):
    passes = []
    rows_of = phrases._slab_rows
    monkeypatch.setattr(phrases, "_slab_rows", lambda docs, *a: passes.append(docs) or rows_of(docs, *a))
    rows = corpus(2, 120)
    found, counted = phrases.frequent_phrases(frame(spark, rows), min_count=12, share=0.0)
    got = {(r["lang"], r["phrase"]): r["n"] for r in found.where("words > 0").collect()}
    assert got == {x: f for x, f in plain_counts(rows).items() if f >= 12} and counted == 2
    assert len(passes) == 4  # two over the sample, the border, the words


def test_a_task_counts_before_it_hands_on(monkeypatch):
    monkeypatch.setattr(phrases, "HANDED", 2)
    keys = [pa.table({"key": np.array(x, np.int64)}) for x in ([3, 1, 3], [], [1, -5])]
    got = [r for b in phrases._together(keys) for r in b.to_pylist()]
    assert [(r["key"], r["n"]) for r in got] == [(-5, 1), (1, 2), (3, 2)]
    names = pa.array(["en", "de"])
    parts = [phrases._rows(names, np.array(x), 1, pa.array(["a", "b"]), [2, 3]) for x in ([0, 0], [0, 1])]
    got = {(r["lang"], r["words"], r["phrase"]): r["n"] for b in phrases._together(parts) for r in b.to_pylist()}
    assert got == {("en", 1, "a"): 4, ("en", 1, "b"): 3, ("de", 1, "b"): 3}
