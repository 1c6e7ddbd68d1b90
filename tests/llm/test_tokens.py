"""Byte-level BPE against the rank library, unigram counts against a unigram library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer, models, pre_tokenizers

from tokenmill.llm import bpe, unigram

from .edge_rows import awkward, clashing, empty, table

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def model(ranks):
    return bpe.model_bytes(ranks)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def strings(seed, n):
    pick = random.Random(seed)
    letters = "abcdeTHE  \n\t'sñéß日語😀1239.,!  \u0085́"
    return ["".join(pick.choice(letters) for _ in range(pick.randint(0, 60))) for _ in range(n)]


def test_codec_equals_library(model, library):
    codec = bpe.Codec(model, PATTERN)
    texts = strings(1, 3000) + [t or "" for _, t in awkward()] + ["<|endoftext|>"]
    for text, ids in zip(texts, codec.encode(texts)):
        found = np.frombuffer(ids, "<u4")
        assert found.tolist() == library.encode_ordinary(text)
        assert codec.decode(found.astype(np.int64)).tobytes() == text.encode()


def test_every_token_is_reached(model, ranks):
    codec = bpe.Codec(model, PATTERN)
    found = codec.pieces.encode([bpe.mapped(t) for t in ranks])
    assert sum(ids != [rank + 1] for ids, rank in zip(found, ranks.values())) == 0


def test_model_of_a_small_vocabulary():
    ranks = {bytes([b]): b for b in range(256)}
    for token in (b"ab", b"bc", b"abc", b"aa"):
        ranks[token] = len(ranks)
    own = tiktoken.Encoding("own", pat_str=r"[^ ]+| +", mergeable_ranks=ranks, special_tokens={})
    codec = bpe.Codec(bpe.model_bytes(ranks), r"[^ ]+| +")
    for text in ("abc", "aaa", "aaaa", "babcab", "a bc  d", "bcbcabcab"):
        assert np.frombuffer(codec.encode([text])[0], "<u4").tolist() == own.encode_ordinary(text)
    with pytest.raises(ValueError):
        bpe.model_bytes({b"a": 0})
    with pytest.raises(ValueError):
        bpe.model_bytes({bytes([b]): b + 1 for b in range(256)})


def test_cache_limit_changes_nothing(monkeypatch, model, library):
    monkeypatch.setattr(bpe, "CACHED_PRE_TOKENS", 5)
    monkeypatch.setattr(bpe, "CACHED_LENGTH", 3)
    codec = bpe.Codec(model, PATTERN)
    for text in strings(2, 200):
        ids = np.frombuffer(codec.encode([text, text])[1], "<u4")
        assert ids.tolist() == library.encode_ordinary(text)


def test_columns(spark, model, library):
    df = clashing(table(spark), "n_tokens", "ids", "decoded")
    out = bpe.decode(bpe.encode(df, model, PATTERN), model, PATTERN).collect()
    assert len(out) == len(awkward())
    for row in out:
        text = row["text"] or ""
        assert row["ids"] == library.encode_ordinary(text)
        assert bytes(row["decoded"]) == text.encode()
        assert row["n_tokens"] == "own"
    digests = bpe.round_trip(df, model, PATTERN, with_ids=True).collect()
    for row in digests:
        ids = np.array(library.encode_ordinary(row["text"] or ""), "<u4")
        assert row["n_tokens"] == len(ids) and row["ids"] == ids.tolist()
        assert row["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((row["text"] or "").encode()).hexdigest()
    assert bpe.round_trip(empty(spark), model, PATTERN).count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    return unigram.read_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))


def unigram_library(vocabulary):
    least = min(s for _, s in vocabulary)
    pieces = [("<unk>", least), *vocabulary, *((f"<0x{b:02X}>", least) for b in range(256))]
    tokenizer = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(
        replacement="▁", prepend_scheme="always", split=True
    )
    return tokenizer


def test_unigram_counts_equal_library(vocabulary):
    texts = strings(3, 2000) + [t or "" for _, t in awkward()] + ["", " ", "  a", "\n", "▁a▁▁", "a\n\n b"]
    wanted = [
        len(e.ids) for e in unigram_library(vocabulary).encode_batch(texts, add_special_tokens=False)
    ]
    assert unigram.Counter(vocabulary).count(texts) == wanted


def test_unigram_ties_and_unknown_characters():
    small = (("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0), ("ba", -2.0), ("bab", -3.0))
    library = unigram_library(small)
    texts = ["ab", "aba", "abab", "babab", "c", "acb", "ab\nba", "é a"] + strings(4, 300)
    wanted = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert unigram.Counter(small).count(texts) == wanted
    assert unigram.Counter(()).count(["ab", ""]) == [len("▁ab".encode()), 0]


def test_unigram_pieces_with_line_feeds():
    pieces = (("▁", -1.0), ("a", -1.0), ("\n", -1.0), ("a\n", -1.5))
    counter = unigram.Counter(pieces)
    assert not counter.cut_lines
    texts = ["a\na", "\n\n", "a a\n a"]
    wanted = [
        len(e.ids) for e in unigram_library(pieces).encode_batch(texts, add_special_tokens=False)
    ]
    assert counter.count(texts) == wanted


def test_unigram_counts_of_runs_of_spaces(spark, vocabulary):
    code = ["    def f(x):\n        return  x\n\n\n\ta", "a      b", "  ", "   \n   ", "▁▁ a"]
    texts = strings(5, 2000) + [t or "" for _, t in awkward()] + code + ["a" + " " * 99 + "b "]
    texts += [t.replace("a", "  ") for t in strings(6, 500)]
    reaching = (("▁", -1.0), ("a", -1.0), ("b", -2.0), ("a▁b", -1.5), ("▁▁", -1.5), ("\n▁▁", -1.2), ("\n", -1.0))
    for pieces in (vocabulary, reaching, reaching[:5]):
        library = unigram_library(pieces)
        library.pre_tokenizer = pre_tokenizers.Metaspace(
            replacement="▁", prepend_scheme="always", split=False
        )
        wanted = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
        assert unigram.Counter(pieces, split=False).count(texts) == wanted
    out = unigram.count_tokens(table(spark, [(1, "a      b")]), vocabulary, split=False).collect()
    assert [r["n_tokens"] for r in out] == [3]


def test_unigram_column(spark, vocabulary):
    out = unigram.count_tokens(clashing(table(spark), "n_tokens"), vocabulary).collect()
    counter = unigram.Counter(vocabulary)
    assert len(out) == len(awkward())
    assert all(r["n_tokens"] == counter.count([r["text"] or ""])[0] for r in out)
    assert unigram.count_tokens(empty(spark), vocabulary).count() == 0
