"""Language identification by error-correcting output codes.

Every language gets a codeword of +1 and -1 bits. For each bit a binary naive-Bayes classifier over
hashed byte trigrams tells the languages with +1 from those with -1. A text's classifier margins
are compared with every codeword under the logistic loss; the codeword of the least total loss
wins, the score is the softmax of the negated losses, and a text whose two best codewords are
nearly as good as each other is flagged as ambiguous.

A null text, or one without a letter, is ``und`` with score 0. Ties go to the label that sorts
first. Training rows without text or label are left out; without any training row all is ``und``.
Repeated rows weigh as often as they occur. Other columns are kept, ones named like the outputs
are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField

from tokenmill.llm.arrays import add_columns, row_pieces, text_bytes
from tokenmill.session import materialize

DOCS_PER_LABEL = 1_000  # expected size of the training sample of a label; labels below it are whole
TRIED_LABELS = 2_000  # with more, random codes are far enough apart, and comparing them is not worth it
BUCKETS = 1 << 16
SMOOTHING = 0.5
EXHAUSTIVE_LABELS = 5
BITS_PER_DOUBLING = 10  # of random codes, for more labels than that
AMBIGUOUS = float(np.log(2.0))  # difference of the two least losses
UNKNOWN = "und"

_ASCII_LETTER = re.compile("[A-Za-z]").search
_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


@dataclass(frozen=True)
class Model:
    labels: tuple[str, ...]
    code: np.ndarray  # labels x bits, +1 and -1
    weights: np.ndarray  # bits x BUCKETS, log odds of a trigram


def codewords(labels: int) -> np.ndarray:
    """All distinct two-sided bits for few labels, else the best separated of 100 random codes.

    Beyond TRIED_LABELS labels the first random code whose bits are two-sided is taken.
    """
    if labels <= EXHAUSTIVE_LABELS:
        bits = 2 ** max(labels - 1, 0) - 1
        patterns = np.arange(1, bits + 1)
        rows = [(patterns >> k & 1) * 2 - 1 for k in range(labels)]
        return np.array(rows, np.int8).reshape(labels, bits)
    random = np.random.default_rng(labels)
    length = int(np.ceil(BITS_PER_DOUBLING * np.log2(labels)))
    best, distance = None, -1
    for _ in range(100):
        code = random.choice(np.array([-1, 1], np.int8), (labels, length))
        if labels > TRIED_LABELS:
            if (np.abs(code.sum(0, dtype=np.int64)) < labels).all():
                return code
            continue
        wide = code.astype(np.int32)
        apart = (length - wide @ wide.T) // 2
        nearest = int(apart[~np.eye(labels, dtype=bool)].min())
        if nearest > distance and (np.abs(wide.sum(0)) < labels).all():
            best, distance = code, nearest
    return best


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A bucket per byte: trigrams of each row, which begins and ends with a space, in row order."""
    sizes = np.diff(offsets)
    rows = len(sizes)
    padded = np.full(len(data) + rows + 1, 32, np.uint32)
    padded[np.arange(len(data)) + np.repeat(np.arange(1, rows + 1), sizes)] = _FOLD[data]
    grams = padded[:-2] << np.uint32(16) | padded[1:-1] << np.uint32(8) | padded[2:]
    grams = grams * np.uint32(0x9E3779B1) >> np.uint32(16)
    # Each row's grams begin at its leading space; the one that begins at its last byte is over.
    return grams[np.arange(len(data)) + np.repeat(np.arange(rows), sizes)]


def _batches(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = text_bytes(column)
    for lo, hi in row_pieces(offsets):
        at = offsets[lo : hi + 1] - offsets[lo]
        yield lo, hi, _trigrams(data[offsets[lo] : offsets[hi]], at), at


def fit(
    train: DataFrame,
    text: str = "text",
    label: str = "lang",
    docs_per_label: int = DOCS_PER_LABEL,
    seed: int = 1,
) -> Model:
    """Classifiers from about ``docs_per_label`` texts of each label, chosen by a hash of the text."""
    known = train.select(F.col(text).alias("text"), F.col(label).alias("label")).dropna()
    sizes = materialize(known.groupBy("label").agg(F.count(F.lit(1)).alias("size")), "label-sizes")
    labels = tuple(sorted(r["label"] for r in sizes.select("label").collect()))
    if not labels:
        return Model((), np.zeros((0, 0), np.int8), np.zeros((0, BUCKETS), np.float32))
    share = F.least(F.lit(1.0), docs_per_label / F.col("size")) * (1 << 30)
    drawn = F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1 << 30))
    chosen = known.join(sizes, "label").where(drawn < share.cast("long")).select("text", "label")
    counted = _gram_counts(chosen, labels)
    sums = {r["label"]: r["n"] for r in counted.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    totals = np.array([sums.get(i, 0) + SMOOTHING * BUCKETS for i in range(len(labels))])
    code = codewords(len(labels))
    weights = np.empty((code.shape[1], BUCKETS), np.float32)
    weights[:] = _bit_weights(np.zeros((len(labels), 1)), totals, code)
    found = _bucket_weights(counted, totals, code).toArrow()
    if found.num_rows:
        values = found["weights"].combine_chunks().flatten().to_numpy()
        weights[:, found["bucket"].to_numpy()] = values.reshape(found.num_rows, -1).T
    return Model(labels, code, weights)


def _gram_counts(chosen: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """(label, bucket, n) of the sample, by the labels' numbers; a task holds the counts of one label."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = {name: number for number, name in enumerate(labels)}
        for batch in batches:
            names = np.array([numbers[x] for x in batch.column("label").to_pylist()], np.int64)
            for number in np.unique(names):
                totals = np.zeros(BUCKETS, np.int64)
                rows = batch.column("text").filter(pa.array(names == number))
                for _, _, grams, _ in _batches(rows):
                    totals += np.bincount(grams, minlength=BUCKETS)
                where = np.flatnonzero(totals)
                columns = [pa.array(np.full(len(where), number)), pa.array(where), pa.array(totals[where])]
                yield pa.RecordBatch.from_arrays(columns, ["label", "bucket", "n"])

    counted = chosen.mapInArrow(count, "label long, bucket long, n long")
    return materialize(counted.groupBy("label", "bucket").agg(F.sum("n").alias("n")), "gram-counts")


def _bit_weights(counts: np.ndarray, totals: np.ndarray, code: np.ndarray) -> np.ndarray:
    """bits x buckets: log odds from counts (labels x buckets) and the labels' totals."""
    shares = (counts + SMOOTHING) / totals[:, None]
    weights = [
        np.log(shares[bit > 0].mean(axis=0)) - np.log(shares[bit < 0].mean(axis=0)) for bit in code.T
    ]
    return np.array(weights, np.float32).reshape(-1, counts.shape[1])


def _bucket_weights(counted: DataFrame, totals: np.ndarray, code: np.ndarray) -> DataFrame:
    """(bucket, weights): the classifiers' weights of every trigram bucket that occurs."""
    lists = counted.groupBy("bucket").agg(F.collect_list(F.struct("label", "n")).alias("counts"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max((4 << 20) // len(totals), 1)
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                held = part.column("counts")
                counts = np.zeros((len(totals), part.num_rows))
                column = np.repeat(np.arange(part.num_rows), held.value_lengths().to_numpy())
                flat = held.flatten()
                counts[flat.field("label").to_numpy(), column] = flat.field("n").to_numpy()
                rows = np.ascontiguousarray(_bit_weights(counts, totals, code).T)
                ends = np.arange(part.num_rows + 1, dtype=np.int32) * rows.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column("bucket"), lists], ["bucket", "weights"])

    return lists.mapInArrow(weigh, "bucket long, weights array<float>")


def margins(model: Model, column: pa.Array) -> np.ndarray:
    """rows x bits: summed log odds over the square root of their number."""
    out = np.zeros((len(column), len(model.weights)))
    for lo, hi, grams, at in _batches(column):
        full = np.flatnonzero(np.diff(at)) + lo
        if len(full):
            scale = np.sqrt(np.diff(at)[full - lo])
            for bit, weights in enumerate(model.weights):
                out[full, bit] = np.add.reduceat(weights[grams], at[full - lo]) / scale
    return out


def decode(model: Model, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(label number, score, ambiguous) of every row of margins."""
    losses = np.stack([np.logaddexp(0, -margin * word).sum(axis=1) for word in model.code], axis=1)
    best = losses.argmin(axis=1)
    least = losses.min(axis=1)
    shares = np.exp(least[:, None] - losses)
    if losses.shape[1] < 2:
        return best, np.ones(len(best)), np.zeros(len(best), bool)
    second = np.partition(losses, 1, axis=1)[:, 1]
    return best, 1 / shares.sum(axis=1), second - least < AMBIGUOUS


def _has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_ASCII_LETTER(text)) or any(map(str.isalpha, text)))


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` and ``ambiguous``; only the text is looked at."""

    def kernel(batch: pa.RecordBatch) -> list[pa.Array]:
        column = batch.column(text)
        known = np.array([_has_letter(s.as_py()) for s in column], bool) & bool(model.labels)
        names, scores = np.full(len(column), UNKNOWN, object), np.zeros(len(column))
        unsure = ~known
        if known.any():
            best, score, close = decode(model, margins(model, column.filter(pa.array(known))))
            names[known] = np.array(model.labels, object)[best]
            scores[known], unsure[known] = score, close
        return [pa.array(names, pa.string()), pa.array(scores), pa.array(unsure)]

    fields = [
        StructField("lang_pred", StringType()),
        StructField("score", DoubleType()),
        StructField("ambiguous", BooleanType()),
    ]
    return add_columns(df, fields, kernel)
