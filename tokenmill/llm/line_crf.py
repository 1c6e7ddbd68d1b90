"""Document quality: plain counts, and a linear-chain random field over lines.

Every line has a feature vector; two states, content and boilerplate, follow each other along a
document. The field's emission and transition weights are fitted to documents that carry a quality
label (see ``line_states``). Viterbi decoding marks the lines of every document, and a document
stays if content lines hold at least half of its words.

Words are runs of characters other than the six ASCII white-space ones. A null text has no words
and fails. Without labels only the plain counts decide. Repeated rows are judged alike. Other
columns are kept; ones named like the outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField

from tokenmill.llm.arrays import (
    SPACE,
    Words,
    add_columns,
    byte_class,
    hash_sample,
    mix,
    row_pieces,
    row_sums,
    shingles,
    text_bytes,
)

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
CONTENT_SHARE = 0.5
DOCS_PER_LABEL = 600  # expected size of the training sample of each label
LINES_PER_DOC = 32  # of a training document, one after the other, from a place drawn by its hash
STEPS, RATE, PENALTY = 150, 0.2, 1e-5
# Most training documents are of one state throughout; without a price on transitions the field
# would learn that a state never changes within a document.
MOVE_PENALTY = 0.05
CONTENT, BOILERPLATE = 1, 0

_SYMBOLS = byte_class(b"#*$%&|<>")
_UPPER = byte_class(bytes(range(65, 91)))
_LETTERS = byte_class(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
_DIGITS = byte_class(b"0123456789")
_CLAIMS = byte_class(b"!")
_BARS = byte_class(b"|")
_LEAD = byte_class(bytes([*range(128), *range(192, 256)]))  # first bytes of characters
FEATURES = 10
REPEATED = 9  # the feature: share of a line's words in windows that the text repeats


@dataclass(frozen=True)
class Field:
    emission: np.ndarray  # 2 x FEATURES
    transition: np.ndarray  # 2 x 2, from and to


@dataclass
class Counts:
    """Per text, and per line of all texts in order."""

    words: np.ndarray
    word_chars: np.ndarray
    symbols: np.ndarray
    repeats: np.ndarray
    line_first: np.ndarray  # number of each text's first line, and the total
    line_words: np.ndarray
    features: np.ndarray


def measure(column: pa.Array) -> Counts:
    words = Words(column, lower=False)
    data, offsets = words.data, words.offsets
    repeated = _repeated(words)
    feeds = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], feeds + 1]), kind="stable")
    line_first = np.searchsorted(feeds, offsets) + np.arange(len(offsets))
    # A feed at a text's end opens an empty line there, before the next text's first line.
    bounds = np.append(starts, len(data))
    word_bounds = np.searchsorted(words.starts, bounds)
    chars = row_sums(_LEAD[data], np.stack([words.starts, words.ends], 1).ravel())[::2]
    n = row_sums(np.ones(len(words.starts), np.int64), word_bounds)
    some = np.maximum(n, 1)

    def per(table: np.ndarray) -> np.ndarray:
        return row_sums(table[data], bounds)

    letters = np.maximum(per(_LETTERS), 1)
    last = np.full(len(n), 32, np.uint8)
    has = np.flatnonzero(n)
    last[has] = data[words.ends[word_bounds[1:][has] - 1] - 1]
    features = np.stack(
        [
            np.ones(len(n)),
            np.log1p(n) / 4,
            np.minimum(per(_SYMBOLS) / some, 2),
            per(_UPPER) / letters,
            np.minimum(per(_DIGITS) / some, 2) / 2,
            np.minimum(per(_CLAIMS) / some, 2),
            np.minimum(per(_BARS) / some, 2),
            last == ord("."),
            np.minimum(row_sums(chars, word_bounds) / some, 20) / 10,
            row_sums(repeated, word_bounds) / some,
        ],
        axis=1,
    )
    first = words.first
    return Counts(
        np.diff(first), row_sums(chars, first), row_sums(_SYMBOLS[data], offsets),
        row_sums(repeated, first), line_first, n, features,
    )


def _repeated(words: Words) -> np.ndarray:
    """Per word: is it part of a 3-word window that its text has at least twice?"""
    covered = np.zeros(len(words.hashes) + 2, bool)
    windows, offsets = shingles(words.hashes, words.first, 3)
    counts = words.counts()
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(counts)), sizes)
    at = np.repeat(words.first[:-1] - offsets[:-1], sizes) + np.arange(len(row))
    full = counts[row] >= 3
    row, at, windows = row[full], at[full], windows[full]
    _, which, times = np.unique(
        windows ^ mix(row.astype(np.uint64)), return_inverse=True, return_counts=True
    )
    at = at[times[which] > 1]
    for k in range(3):
        covered[at + k] = True
    return covered[:-2]


def _duplicates(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def viterbi(field: Field, features: np.ndarray) -> np.ndarray:
    """The best state of every line of one document."""
    scores = features @ field.emission.T
    (same0, to1), (to0, same1) = field.transition.tolist()
    back = []
    a, b = scores[0].tolist()
    for x, y in scores[1:].tolist():
        stay0, stay1 = a + same0 >= b + to0, b + same1 >= a + to1
        back.append((stay0, stay1))
        a, b = (a + same0 if stay0 else b + to0) + x, (b + same1 if stay1 else a + to1) + y
    state = CONTENT if b >= a else BOILERPLATE
    states = [state]
    for stay in reversed(back):
        state = state if stay[state] else 1 - state
        states.append(state)
    return np.array(states[::-1])


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def line_states(documents: list[np.ndarray], labels: list[int]) -> list[np.ndarray]:
    """The state of each training line: its document's label, but boilerplate where it repeats."""
    return [
        np.where(lines[:, REPEATED] >= 0.5, BOILERPLATE, label)
        for lines, label in zip(documents, labels)
    ]


def fit_field(documents: list[np.ndarray], states: list[np.ndarray]) -> Field | None:
    """Maximum likelihood with a square penalty; None unless both states occur."""
    if len({int(s) for chain in states for s in chain}) < 2:
        return None
    longest = max(map(len, documents))
    x = np.zeros((len(documents), longest, FEATURES))
    mask = np.zeros((len(documents), longest), bool)
    for i, lines in enumerate(documents):
        x[i, : len(lines)], mask[i, : len(lines)] = lines, True
    truth = np.zeros((len(documents), longest, 2))
    true_moves = np.zeros((2, 2))
    for i, chain in enumerate(states):
        truth[i, np.arange(len(chain)), chain] = 1
        np.add.at(true_moves, (chain[:-1], chain[1:]), 1)
    steps = mask[:, 1:].sum()
    weight, move = np.zeros((2, FEATURES)), np.zeros((2, 2))
    state = [np.zeros_like(v) for v in (weight, weight, move, move)]
    for step in range(1, STEPS + 1):
        score = x @ weight.T
        forward, backward = [score[:, 0]], [np.zeros((len(x), 2))]
        for t in range(1, longest):
            new = _log_sum(forward[-1][:, :, None] + move, 1) + score[:, t]
            forward.append(np.where(mask[:, t, None], new, forward[-1]))
        for t in range(longest - 1, 0, -1):
            new = _log_sum(move + (score[:, t] + backward[-1])[:, None, :], 2)
            backward.append(np.where(mask[:, t, None], new, backward[-1]))
        backward.reverse()
        total = _log_sum(forward[-1], 1)
        fwd, bwd = np.stack(forward, 1), np.stack(backward, 1)
        marginal = np.exp(fwd + bwd - total[:, None, None]) * mask[:, :, None]
        pair = (
            fwd[:, :-1, :, None] + move + (score[:, 1:] + bwd[:, 1:])[:, :, None, :]
            - total[:, None, None, None]
        )
        moves = (np.exp(np.minimum(pair, 0)) * mask[:, 1:, None, None]).sum((0, 1))
        grads = (
            np.einsum("dts,dtf->sf", truth - marginal, x) / mask.sum() - PENALTY * weight,
            (true_moves - moves) / max(steps, 1) - MOVE_PENALTY * move,
        )
        for k, (value, grad) in enumerate(zip((weight, move), grads)):
            first, second = state[2 * k], state[2 * k + 1]
            first += 0.1 * (grad - first)
            second += 0.01 * (grad * grad - second)
            value += RATE * (first / (1 - 0.9**step)) / (
                np.sqrt(second / (1 - 0.99**step)) + 1e-8
            )
    return Field(weight, move)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    docs_per_label: int = DOCS_PER_LABEL,
    lines_per_doc: int = LINES_PER_DOC,
    seed: int = 2,
) -> Field | None:
    """A field from about ``docs_per_label`` documents of each label, chosen by a hash of the key."""
    known = labels.select(F.col(key).alias("_key"), F.col(label).alias("_label")).where(
        F.col("_key").isNotNull() & F.col("_label").isin(0, 1)
    )
    sizes = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    share = {k: min(1.0, docs_per_label / n) for k, n in sizes.items()}
    chosen = F.lit(False)
    for name in sorted(share):
        few = hash_sample(F.col("_key"), share[name], seed)
        chosen = chosen | ((F.col("_label") == name) & few)
    if not share:
        return None
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(
        hash_sample(F.col("_key"), max(share.values()), seed)
    )
    sample = texts.join(known.where(chosen).distinct(), "_key").select(
        "_text", "_label", F.pmod(F.xxhash64("_text", F.lit(seed)), F.lit(1 << 40)).alias("_drawn")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measure(batch.column("_text"))
            starts = map(int, batch.column("_drawn").to_numpy())
            rows = []
            for a, b, drawn in zip(found.line_first, found.line_first[1:], starts):
                a += drawn % max(b - a - lines_per_doc + 1, 1)  # a stretch anywhere in the text
                rows.append(found.features[a : min(b, a + lines_per_doc)].ravel())
            lists = pa.array(rows, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([lists, batch.column("_label")], ["lines", "label"])

    found = sample.mapInArrow(run, "lines array<double>, label int").toArrow()
    order = sorted(zip(found["label"].to_pylist(), found["lines"].to_pylist()))
    documents = [np.array(lines).reshape(-1, FEATURES) for _, lines in order]
    return fit_field(documents, line_states(documents, [y for y, _ in order]))


def judge(df: DataFrame, field: Field | None, text: str = "text") -> DataFrame:
    """``df`` with its counts, base_failed, content_share and kept."""

    def kernel(batch: pa.RecordBatch) -> list[pa.Array]:
        column = batch.column(text)
        out: list[list] = [[] for _ in range(8)]
        for lo, hi in row_pieces(text_bytes(column)[1]):
            part = column.slice(lo, hi - lo)
            c = measure(part)
            failed = (c.words < MIN_WORDS) | (100 * c.repeats > MAX_REPEAT_PERCENT * c.words)
            share = np.ones(len(part))
            if field is not None:
                for i, (a, b) in enumerate(zip(c.line_first, c.line_first[1:])):
                    if c.words[i]:
                        content = viterbi(field, c.features[a:b]) == CONTENT
                        share[i] = c.line_words[a:b][content].sum() / c.words[i]
            share[c.words == 0] = 0
            duplicates = [_duplicates(t or "") for t in part.to_pylist()]
            kept = ~failed & (share >= CONTENT_SHARE)
            for values, new in zip(
                out,
                (c.words, c.word_chars, c.symbols, duplicates, c.repeats, failed, share, kept),
            ):
                values.append(np.asarray(new))
        return [pa.array(np.concatenate(values)) for values in out]

    longs = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    fields = [StructField(name, LongType()) for name in longs]
    fields += [
        StructField("base_failed", BooleanType()),
        StructField("content_share", DoubleType()),
        StructField("kept", BooleanType()),
    ]
    return add_columns(df, fields, kernel)
