"""Phrases that are common in a language, mined from a sample and counted exactly.

A sample of the documents proposes phrases that may be frequent. The full pass counts the proposals
and their negative border: all phrases of the corpus whose first and last parts (one word shorter)
are both proposed, every single word among them. All occurrences are counted, so results do not
depend on the sample. A frequent phrase of the border that was not proposed is a failure: phrases
around it were not counted. The expansion is all phrases whose parts are frequent or, not being counted
yet, may be: these parts are in turn made of such parts. So whatever is frequent is counted with it, and
the set is closed. Most phrases of a border occur once, so it is counted by 61-bit hashes and not by
strings; a last pass counts the words of all phrases whose hash is frequent, by which a shared hash costs
time but never changes a count. The expansion, a small part of a border, is counted in that pass as well.

Proposed and frequent hashes travel as bitmaps, one per phrase length, of 2 ** MOST_BITS bits (8 MB)
at most, however many phrases there are. A phrase that shares its bit with another one is counted
without need, never the other way round; a full bitmap means that everything is counted.

Text is lower-cased (A-Z), split at ``.,;:!?`` and line breaks into pieces and those at blanks and
tabs into words. A null text is an empty one, a null language is ``und``. Repeated rows count as often
as they occur and rows without an id like all others. Other columns are ignored. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenmill.llm.arrays import ODD, hash_sample, mix, row_pieces, run_hashes, text_bytes
from tokenmill.session import materialize

MIN_COUNT = 30
MAX_WORDS = 4
SAMPLE_SHARE = 0.2
MISS = 0.05  # chance that a phrase of just MIN_COUNT spread-out occurrences is not proposed
LEAST_BITS, MOST_BITS = 16, 26
BITS_PER_PHRASE = 16
HOT_ROWS = 10_000  # lookups of one part beyond which they are dealt to several tasks
COVERED_PERCENT = 80
TOP = 2000
SCALE = 2_000_000
NO_LANGUAGE = "und"

SLAB = 1 << 19
HELD = 1 << 17  # rows that a task puts together before it counts them
HANDED = 1 << 16  # rows that it hands on at a time
_BLANK, _BREAK = 32, 10
_PLAIN = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 9
)
HASH_BITS = 61  # a key is the phrase's length above so many bits of its hash
COUNTS = "lang string, words int, phrase string, n long"
Bits = dict[int, tuple[np.ndarray, int]]  # phrase length -> (bitmap, log2 of its bits)


def _single_blanks(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row starts with each run of blanks made one."""
    double = (raw[1:] == _BLANK) & (raw[:-1] == _BLANK)
    if not double.any():
        return raw, starts
    keep = np.append(~double, True)
    moved = np.concatenate([[0], np.cumsum(keep)])
    return raw[keep], moved[starts]


def _slabs(data: np.ndarray, offsets: np.ndarray, overlap: int) -> Iterator[tuple]:
    """(bytes, row starts, first row, words at the beginning that the slab before has had).

    Rows are put together with a break between them, about SLAB bytes at a time. A longer row is
    cut behind a break; where there is none, between words, and the next slab repeats ``overlap``.
    """
    for lo, hi in row_pieces(offsets, SLAB):
        raw = np.frombuffer(data[offsets[lo] : offsets[hi]].tobytes().translate(_PLAIN), np.uint8)
        inner = offsets[lo:hi] - offsets[lo]
        raw, starts = _single_blanks(np.insert(raw, inner[1:], _BREAK), inner + np.arange(hi - lo))
        at, done, carried = 0, 0, 0
        while done < len(raw):
            done = _cut(raw, done) if hi - lo == 1 else len(raw)
            yield raw[at:done], starts, lo, carried
            carried, begun = 0, _words(raw[at:done])[0]
            if raw[done - 1] == _BLANK:  # a phrase may go on
                carried = min(overlap, len(begun))
            at = at + int(begun[-carried]) if carried else done


def _cut(raw: np.ndarray, lo: int) -> int:
    """The place behind a break within SLAB bytes, else behind a blank there or the first one on."""
    hi = lo + SLAB
    if hi >= len(raw):
        return len(raw)
    for separator in (_BREAK, _BLANK):
        found = np.flatnonzero(raw[lo:hi] == separator)
        if len(found):
            return lo + int(found[-1]) + 1
    while hi < len(raw):
        ahead = raw[hi : hi + SLAB]
        found = np.flatnonzero((ahead == _BREAK) | (ahead == _BLANK))
        if len(found):
            return hi + int(found[0]) + 1
        hi += SLAB
    return len(raw)


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words in translated bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = (data != _BLANK) & (data != _BREAK)
    edges = np.flatnonzero(np.diff(inside))
    return edges[::2], edges[1::2]


def _hash_word(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hash_word, words), np.uint64, len(words))


def _extend(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases made one word longer."""
    return mix(hashes * ODD + words)


def _keys(hashes: np.ndarray, words: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - HASH_BITS)) | np.uint64(words << HASH_BITS)


def _holds(bits: tuple[np.ndarray, int], hashes: np.ndarray) -> np.ndarray:
    """Whether the bits of hashes (or of keys) are set."""
    bitmap, log = bits
    low = hashes & np.uint64((1 << HASH_BITS) - 1)
    at = low >> np.uint64(HASH_BITS - log)
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group of each key, first place and count of each group)."""
    group = pa.array(keys).dictionary_encode().indices.to_numpy()
    counts = np.bincount(group)
    first = np.zeros(len(counts), np.int64)
    first[group[::-1]] = np.arange(len(keys) - 1, -1, -1)
    return group, first, counts


def _taken(begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of all bytes of the given runs, one run after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(begin - before, lengths) + np.arange(int(lengths.sum()))


class _Slab:
    """Words of a slab: places, languages, hashes; codes within the slab when asked for."""

    def __init__(self, data, row_starts, languages: np.ndarray, language_hashes: np.ndarray):
        self.data = data
        self.starts, self.ends = _words(data)
        self.piece = np.cumsum(data == _BREAK)[self.starts] if len(data) else self.starts
        rows = np.searchsorted(row_starts, self.starts, side="right") - 1
        self.lang = languages[rows]
        self.word_hashes = run_hashes(data, self.starts, self.ends)
        self.first_hashes = mix(self.word_hashes + language_hashes[self.lang])
        self._grown = 1, self.first_hashes

    @cached_property
    def codes(self) -> np.ndarray:
        """The same number for the same word; words that share a hash are told apart by their bytes."""
        codes, first, _ = _groups(self.word_hashes)
        same = first[codes]
        lengths = self.ends - self.starts
        if (lengths == lengths[same]).all():
            letters = _taken(self.starts, lengths), _taken(self.starts[same], lengths)
            if (self.data[letters[0]] == self.data[letters[1]]).all():
                return codes
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        letters = self.data[_taken(self.starts, lengths)]
        buffers = [None, pa.py_buffer(offsets), pa.py_buffer(letters)]
        words = pa.Array.from_buffers(pa.binary(), len(lengths), buffers)
        return words.dictionary_encode().indices.to_numpy().astype(np.int64)

    def hashes(self, words: int) -> np.ndarray:
        """Hashes of all phrases of ``words`` words, over breaks as well; asked for in rising order."""
        length, hashes = self._grown
        while length < words:
            hashes = _extend(hashes[:-1], self.word_hashes[length:])
            length += 1
        self._grown = length, hashes
        return hashes

    def phrases(self, at: np.ndarray, words: int) -> pa.Array:
        """The phrases of ``words`` words that begin at the given words."""
        begin = self.starts[at]
        lengths = self.ends[at + words - 1] - begin
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        buffers = [None, pa.py_buffer(offsets), pa.py_buffer(self.data[_taken(begin, lengths)])]
        return pa.Array.from_buffers(pa.string(), len(at), buffers)


def _grown(slab: _Slab, stop: int, bits: Bits, frequent: Bits | None = None) -> Iterator:
    """(words, keys, border, expansion) of the slab's phrases of 1 to ``stop`` - 1 words.

    Which of them are in the border of ``bits`` and, given what is ``frequent`` there, in its expansion.
    """
    n = len(slab.starts)
    keys = _keys(slab.first_hashes, 1)
    border, expansion = np.ones(n, bool), np.zeros(n, bool)
    yield 1, keys, border, expansion
    for words in range(2, stop):
        last = n - words + 1
        if last <= 0 or not (border | expansion).any():
            return
        together = slab.piece[:last] == slab.piece[words - 1 :]
        proposed, may_be = _member(border, keys, bits, words - 1), expansion
        if frequent is not None:
            may_be = expansion | _member(border, keys, frequent, words - 1)
        border = proposed[:-1] & proposed[1:] & together
        expansion = may_be[:-1] & may_be[1:] & together & ~border
        keys = _keys(slab.hashes(words), words)
        yield words, keys, border, expansion


def _own(flags: np.ndarray, words: int, carried: int) -> np.ndarray:
    """Flagged places of phrases that the slab before has not had."""
    at = np.flatnonzero(flags)
    return at[at >= carried - words + 1] if carried else at


def _bordered(slab: _Slab, levels: range, bits: Bits, frequent: Bits | None, carried: int) -> Iterator:
    """(keys, counts) of the slab's phrases that are to be counted, by length.

    The border of ``bits``; given the ``frequent`` phrases of that, its expansion instead.
    """
    for words, keys, border, expansion in _grown(slab, levels.stop, bits, frequent):
        if words not in levels:
            continue
        at = _own(border if frequent is None else expansion, words, carried)
        yield keys[at], np.ones(len(at), np.int64)


def _member(flags: np.ndarray, keys: np.ndarray, bits: Bits, words: int) -> np.ndarray:
    """Flagged keys that are in ``bits``, if it knows the length."""
    if words not in bits:
        return flags
    out = np.zeros(len(flags), bool)
    at = np.flatnonzero(flags)
    out[at] = _holds(bits[words], keys[at])
    return out


def _flagged(
    slab: _Slab, frequent: Bits, carried: int, stop: int = MAX_WORDS + 1, bits: Bits = {}, expand: bool = False
) -> Iterator:
    """(words, first places, counts) of the slab's phrases to be counted by their words, by length.

    Those in the border of ``bits`` whose hash is frequent and, if wanted, the border's expansion.
    """
    known = frequent if expand else None
    for words, keys, border, expansion in _grown(slab, stop, bits, known):
        at = _own(border, words, carried) if words in frequent else np.zeros(0, np.int64)
        if len(at):
            at = at[_holds(frequent[words], keys[at])]
        if expand:
            at = np.concatenate([at, _own(expansion, words, carried)])
        if len(at):
            yield words, *_grouped(slab, at, keys[at], words)


def _grouped(slab: _Slab, at: np.ndarray, keys: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(first places, counts) of the phrases at the given places, by their words and not by their keys."""
    group, first, counts = _groups(keys)
    same = at[first[group]]
    if (slab.lang[at] == slab.lang[same]).all() and all(
        (slab.codes[at + k] == slab.codes[same + k]).all() for k in range(words)
    ):
        return at[first], counts
    distinct = int(slab.codes.max(initial=0)) + 1
    key = slab.lang[at] * distinct + slab.codes[at]
    for k in range(1, words):
        key = np.unique(key, return_inverse=True)[1] * distinct + slab.codes[at + k]
    _, first, counts = np.unique(key, return_index=True, return_counts=True)
    return at[first], counts


def _slab_rows(docs: DataFrame, text: str, lang: str, overlap: int, kernel, schema: str) -> DataFrame:
    """What ``kernel`` makes of a task's slabs, each with its words carried over and the languages.

    Its tables are put together until they have HELD rows, counted together and handed on.
    """

    def slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Slab, int, pa.Array]]:
        for batch in batches:
            if not batch.num_rows:
                continue
            langs = batch.column("lang").dictionary_encode()
            names = langs.dictionary
            language_hashes = _hashes([x.encode() for x in names.to_pylist()])
            row_lang = langs.indices.to_numpy().astype(np.int64)
            data, offsets = text_bytes(batch.column("text"))
            for raw, starts, row, carried in _slabs(data, offsets, overlap):
                slab = _Slab(raw, starts, row_lang[row:], language_hashes)
                if len(slab.starts):
                    yield slab, carried, names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for found in kernel(slabs(batches)):
            held.append(found)
            rows += found.num_rows
            if rows >= HELD:
                yield from _together(held)
                held, rows = [], 0
        if rows:
            yield from _together(held)

    rows = docs.select(
        F.col(text).alias("text"), F.coalesce(F.col(lang), F.lit(NO_LANGUAGE)).alias("lang")
    )
    return rows.mapInArrow(run, schema)


def _together(parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
    """The rows of all parts, with one row for each key."""
    whole = pa.concat_tables(parts)
    if whole.column_names == ["key"]:
        # Few keys come twice, and numbers are sorted faster than they are looked up.
        keys, counts = np.unique(whole["key"].to_numpy(), return_counts=True)
        whole = pa.table({"key": keys, "n": counts})
    else:
        keys = [c for c in whole.column_names if c != "n"]
        whole = whole.group_by(keys, use_threads=False).aggregate([("n", "sum")])
        whole = whole.rename_columns([*keys, "n"])
    yield from whole.to_batches(max_chunksize=HANDED)
    del whole
    pa.default_memory_pool().release_unused()


def count_border(docs: DataFrame, text: str, lang: str, levels: range, bits: Bits) -> DataFrame:
    """(key, n): hashed phrases with as many words as ``levels`` says.

    Only phrases whose parts are in ``bits`` are counted, for the lengths that it has.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def kernel(slabs: Iterator[tuple[_Slab, int, pa.Array]]) -> Iterator[pa.Table]:
        for slab, carried, _ in slabs:
            for keys, _ in _bordered(slab, levels, shared.value, None, carried):
                yield pa.table({"key": keys.view(np.int64)})

    rows = _slab_rows(docs, text, lang, levels.stop - 2, kernel, "key long, n long")
    return rows.groupBy("key").agg(F.sum("n").alias("n"))


def count_words(
    docs: DataFrame, text: str, lang: str, frequent: Bits, max_words: int, bits: Bits, expand: bool
) -> DataFrame:
    """(lang, words, phrase, n) of phrases in ``frequent``; 0 words for the total of a language.

    They are counted where the border of ``bits`` has them. ``expand`` counts its expansion as well:
    other phrases of parts that are or may be frequent.
    """
    shared = docs.sparkSession.sparkContext.broadcast((frequent, bits))

    def kernel(slabs: Iterator[tuple[_Slab, int, pa.Array]]) -> Iterator[pa.Table]:
        known, proposed = shared.value
        for slab, carried, names in slabs:
            totals = np.bincount(slab.lang[carried:], minlength=len(names))
            yield _rows(names, np.arange(len(names)), 0, pa.array([""] * len(names)), totals)
            for words, at, counts in _flagged(slab, known, carried, max_words + 1, proposed, expand):
                yield _rows(names, slab.lang[at], words, slab.phrases(at, words), counts)

    rows = _slab_rows(docs, text, lang, max_words - 1, kernel, COUNTS)
    return rows.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))


def _rows(names: pa.Array, lang: np.ndarray, words: int, phrases: pa.Array, counts) -> pa.Table:
    columns = [
        names.take(pa.array(lang)), pa.array(np.full(len(lang), words, np.int32)), phrases,
        pa.array(np.asarray(counts, np.int64)),
    ]
    return pa.Table.from_arrays(columns, ["lang", "words", "phrase", "n"])


def _key_words(key: str = "key") -> Column:
    return F.shiftrightunsigned(key, HASH_BITS).cast("int")


def _size(phrases: int) -> int:
    """log2 of the bits for as many phrases."""
    wanted = max(phrases * BITS_PER_PHRASE, 1)
    return int(min(max(wanted.bit_length(), LEAST_BITS), MOST_BITS))


def propose(keys: DataFrame, bits: Bits) -> tuple[Bits, int]:
    """``bits`` with the given keys added, and how many of these were not in it.

    The new bits are put together by Spark in blocks of 4 KB; the driver gets 2 ** MOST_BITS bits per
    length at most.
    """
    shared = keys.sparkSession.sparkContext.broadcast(bits)

    def fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("key").to_numpy().view(np.uint64)
            lengths = own >> np.uint64(HASH_BITS)
            new = np.ones(len(own), bool)
            for length, known in shared.value.items():
                at = np.flatnonzero(lengths == length)
                new[at] = ~_holds(known, own[at])
            yield batch.filter(pa.array(new))

    new = materialize(keys.select("key").mapInArrow(fresh, "key long"), "proposed-phrases")
    counts = {r["words"]: r["count"] for r in new.groupBy(_key_words().alias("words")).count().collect()}
    out = dict(bits)
    place = F.lit(None).cast("long")
    low = F.col("key").bitwiseAND(F.lit((1 << HASH_BITS) - 1))
    for words, n in counts.items():
        log = bits[words][1] if words in bits else _size(n)
        out[words] = (bits[words][0].copy() if words in bits else np.zeros(1 << (log - 3), np.uint8)), log
        place = F.when(_key_words() == words, F.shiftrightunsigned(low, HASH_BITS - log)).otherwise(place)
    place = place + 1  # the built-in counts places from 1
    blocks = new.groupBy(_key_words().alias("words"), F.bitmap_bucket_number(place).alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")
    )
    for block in blocks.toLocalIterator() if counts else ():
        bitmap, own = out[block["words"]][0], np.frombuffer(block["bits"], np.uint8)
        at = (block["block"] - 1) * len(own)
        bitmap[at : at + len(own)] |= own[: len(bitmap) - at]
    return out, sum(counts.values())


def sample_threshold(min_count: int, share: float, miss: float = MISS) -> int:
    """The highest count in a sample that is missed with a chance of ``miss`` at most.

    Of ``min_count`` occurrences that are sampled independently with the chance ``share``.
    """
    below = 0.0
    for threshold in range(min_count + 1):
        below += comb(min_count, threshold) * share**threshold * (1 - share) ** (min_count - threshold)
        if below > miss:
            return max(threshold, 1)
    return min_count


def frequent_phrases(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    min_count: int = MIN_COUNT,
    max_words: int = MAX_WORDS,
    share: float = SAMPLE_SHARE,
    seed: int = 11,
) -> tuple[DataFrame, int]:
    """((lang, words, phrase, n), 1, or 2 if the border had to be expanded).

    All phrases of up to ``max_words`` words with ``min_count`` occurrences in a language, and for each
    language a row of 0 words whose ``n`` counts all its words.
    """
    sample = docs.where(hash_sample(F.struct(F.col(key), F.xxhash64(text)), share, seed))
    least = sample_threshold(min_count, share)
    bits: Bits = {}
    steps = [range(1, 3), *(range(n, n + 1) for n in range(3, max_words))]
    for levels in steps:  # proposals never need the longest phrases
        likely = count_border(sample, text, lang, levels, bits).where(F.col("n") >= least)
        bits, _ = propose(likely.where(_key_words() < max_words), bits)
    bits = _all_lengths(bits, max_words)
    found = count_border(docs, text, lang, range(1, max_words + 1), bits).where(F.col("n") >= min_count)
    found = materialize(found.select("key"), "frequent-hashes")
    frequent, _ = propose(found, {})
    _, failures = propose(found.where(_key_words() < max_words), bits)
    expand = failures > 0
    if expand:
        frequent = _all_lengths(frequent, max_words)
    counts = count_words(docs, text, lang, frequent, max_words, bits, expand)
    enough = (F.col("n") >= min_count) | (F.col("words") == 0)
    return materialize(counts.where(enough), "frequent-phrases"), 1 + expand


def _all_lengths(bits: Bits, max_words: int) -> Bits:
    """``bits`` with an empty bitmap for each length that the sample has no proposal of."""
    empty = {w: (np.zeros(1 << (LEAST_BITS - 3), np.uint8), LEAST_BITS) for w in range(1, max_words)}
    return {**empty, **bits}


def _product(count: Column, factor: int) -> Column:
    return count.cast("decimal(28,0)") * F.lit(factor).cast("decimal(8,0)")


def _words_between(first: int | Column, amount: Column) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), first, amount), " ")


def _looked_up(cuts: DataFrame, frequent: DataFrame, part: str, count: str) -> DataFrame:
    """``cuts`` with the count of the phrase in column ``part``.

    Phrases that more than HOT_ROWS cuts ask for (there are at most one per HOT_ROWS cuts) are
    repeated once for each block of these, so that the cuts of one word never meet in one task.
    """
    asked = cuts.groupBy("lang", part).agg(F.count(F.lit(1)).alias("_asked"))
    blocks = F.ceil(F.col("_asked") / HOT_ROWS).cast("int")
    hot = asked.where(F.col("_asked") > HOT_ROWS).select("lang", part, blocks.alias("_blocks"))
    hot = materialize(hot, "hot-parts")
    blocks = F.coalesce("_blocks", F.lit(1))
    dealt = cuts.join(hot, ["lang", part], "left").withColumn(
        "_block", F.pmod(F.xxhash64("phrase"), blocks).cast("int")
    )
    counts = frequent.select("lang", F.col("phrase").alias(part), F.col("n").alias(count))
    counts = counts.join(hot, ["lang", part], "left").withColumn(
        "_block", F.explode(F.sequence(F.lit(0), blocks - 1))
    )
    joined = dealt.drop("_blocks").join(counts.drop("_blocks"), ["lang", part, "_block"])
    return joined.drop("_block")


def score_phrases(frequent: DataFrame, scale: int = SCALE) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of phrases of two words and more, by their weakest cut.

    Both sides of a cut occur wherever the phrase does, so they are frequent and have exact counts.
    """
    longer = frequent.where(F.col("words") >= 2)
    cuts = longer.select(
        "lang", "phrase", "words", F.col("n").alias("a"),
        F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"),
    )
    cuts = cuts.withColumns(
        {
            "_left": _words_between(1, F.col("k")),
            "_right": _words_between(F.col("k") + 1, F.col("words") - F.col("k")),
        }
    )
    cuts = _looked_up(_looked_up(cuts, frequent, "_left", "l"), frequent, "_right", "r")
    cuts = cuts.withColumn("_scaled", _product(F.col("a"), scale))
    score = F.expr("_scaled div cast(l + r as decimal(20,0))")
    weakest = F.min(F.struct(score.alias("score"), "k", "l", "r"))
    found = cuts.groupBy("lang", "phrase", "words", "a").agg(weakest.alias("cut"))
    return found.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def covered(frequent: DataFrame) -> DataFrame:
    """(lang, phrase, longest): the highest count of a longer phrase that holds the phrase."""
    inner = F.expr(
        "explode(flatten(transform(sequence(2, words - 1), n ->"
        " transform(sequence(1, words - n + 1), i -> array_join(slice(split(phrase, ' '), i, n), ' ')))))"
    )
    parts = frequent.where(F.col("words") >= 3).select("lang", "n", inner.alias("phrase"))
    return parts.groupBy("lang", "phrase").agg(F.max("n").alias("longest"))


def collocations(
    docs: DataFrame, top: int = TOP, percent: int = COVERED_PERCENT, **limits
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language.

    Left out are phrases inside a longer one that has ``percent`` of their occurrences. The rank goes
    by score and count, both descending, and then by the phrase.
    """
    frequent, _ = frequent_phrases(docs, **limits)
    totals = frequent.where(F.col("words") == 0).groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = frequent.where(F.col("words") > 0)
    scored = score_phrases(frequent).join(covered(frequent), ["lang", "phrase"], "left")
    lost = _product(F.col("longest"), 100) >= _product(F.col("a"), percent)
    kept = scored.where(~F.coalesce(lost, F.lit(False)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
