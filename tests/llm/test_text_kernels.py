import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from tokenmill.llm import arrays

from .edge_rows import awkward, prose

TEXTS = [t for _, t in awkward()] + ["a  b", " a b ", "A a", "x\x0by\x0cz\r"]


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@pytest.mark.parametrize("piece", [64, 1 << 20])
@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_words_do_not_depend_on_pieces(monkeypatch, piece, kind):
    monkeypatch.setattr(arrays, "PIECE", piece)
    arrays._powers.cache_clear()
    found = arrays.Words(pa.array(TEXTS, kind))
    arrays._powers.cache_clear()
    wanted = [words(t) for t in TEXTS]
    assert found.counts().tolist() == [len(w) for w in wanted]
    raw = found.data.tobytes()
    flat = [raw[a:b].decode() for a, b in zip(found.starts, found.ends)]
    assert flat == [w for row in wanted for w in row]
    by_hash = {}
    for word, value in zip(flat, found.hashes.tolist()):
        assert by_hash.setdefault(value, ascii_lower(word)) == ascii_lower(word)
    assert len(set(map(ascii_lower, flat))) == len(by_hash)


def test_slices_and_empty_columns():
    column = pa.array(["drop", "a b", None, "c"]).slice(1)
    assert arrays.Words(column).counts().tolist() == [2, 0, 1]
    assert arrays.Words(pa.array([], pa.string())).counts().tolist() == []
    assert arrays.Words(pa.array([None, None], pa.string())).counts().tolist() == [0, 0]


@pytest.mark.parametrize("width", [1, 3, 5])
def test_shingles(width):
    found = arrays.Words(pa.array(TEXTS))
    values, offsets = arrays.shingles(found.hashes, found.first, width)
    values, offsets = arrays.distinct_per_row(values, offsets)
    seen = {}
    for text, a, b in zip(TEXTS, offsets, offsets[1:]):
        w = words(ascii_lower(text or ""))
        full = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
        wanted = full or ({tuple(w)} if w else set())
        assert b - a == len(wanted)
        key = values[a:b].tobytes()
        assert seen.setdefault(key, wanted) == wanted


def test_row_pieces_cover_all_rows():
    offsets = np.array([0, 5, 5, 300, 301, 302, 900])
    parts = list(arrays.row_pieces(offsets, 100))
    assert parts[0][0] == 0 and parts[-1][1] == 6
    assert all(a[1] == b[0] for a, b in zip(parts, parts[1:]))


def test_added_columns_replace_clashing_ones(spark):
    from pyspark.sql.types import LongType, StructField

    df = spark.createDataFrame([("a", "old", 1)], "text string, N string, other int")
    out = arrays.add_columns(df, [StructField("n", LongType())], lambda b: [pa.array([7] * b.num_rows)])
    assert out.columns == ["text", "other", "n"]
    assert out.collect() == [("a", 1, 7)]


def test_hashes_are_fixed_values():
    digest = hashlib.sha256(arrays.Words(pa.array([prose(1, 50)])).hashes.tobytes()).hexdigest()
    again = hashlib.sha256(arrays.Words(pa.array([prose(1, 50)])).hashes.tobytes()).hexdigest()
    assert digest == again
