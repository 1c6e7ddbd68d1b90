"""Personal data: rules, high-recall candidates, and boosted trees that add spans.

Base spans come from fixed patterns with checks (octet range, Luhn sum, digit counts) and always
stay. Generators propose many more, overlapping spans: digit groups of any kind, dotted and colon
groups, spelled-out addresses, account numbers. Boosted trees see the format of a candidate and its
context, not its kind nor the checks that labels come from. They are fitted to all candidates with a
label, weighted so that kinds and labels count alike. The labels:

- positive: base spans; base spans in another form (a phone without its '+' or country code, an
  address spelled out); accounts whose sum is right (mod 97), IPv6 addresses of eight groups,
  spelled-out addresses that end in letters;
- negative: matches whose check fails, numbers too short or long for a phone, or after a word such as
  'version' or 'page';
- none, and not learned from: all other numbers.

Per kind, and for numbers as long as phones on their own, the lowest score with the wanted precision
on a part of them kept apart becomes the threshold. Candidates at or above it that touch no base span are added, the best score first where
they overlap. Where a check of its own holds for a candidate, EVEN is enough.

Texts are taken whole; positions count code points, ends are exclusive. A null text is an empty one
and has no spans. Without candidates of both labels nothing is added. Repeated rows are found alike
and kept apart by a row number. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.arrays import hash_sample, row_pieces, text_bytes
from tokenmill.session import materialize

BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("spelled_email", "ip6", "number", "account")
KINDS = BASE_KINDS + EXTRA_KINDS
TRAINING_CANDIDATES = 20_000  # weight of all training rows together, however many there are
CALIBRATION_SHARE = 0.3
PRECISION = 0.98
BINS = 200
TREES, DEPTH = 15, 3
CONTEXT = 24
EVEN = 0.5  # score that is enough besides a check
MOST_WEIGHT = 50.0  # of a training row of a rare kind and label
PHONE_SIZED = "phone_sized"
GROUPS = (*KINDS, PHONE_SIZED)
# Labels: confirmed ones are only learned from, open ones only judged.
CONFIRMED, CHECKED, REFUTED, OPEN = 2, 1, 0, -1

# Fixed patterns.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # looking back changes no match, only time
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_RELEVANT = re.compile(r"[0-9@]|\(at\)|\[at\]", re.I).search
_GENERATORS = {
    "spelled_email": re.compile(
        r"[A-Za-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}"
        r"(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]{1,63})+", re.I
    ),
    "ip6": re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
    "number": re.compile(r"(?<![0-9A-Za-z])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,18}(?![0-9A-Za-z])"),
    "account": re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
}
_TRIGGERS = (("mail", "contact", "@"), ("phone", "tel", "call", "mobile", "fax"),
             ("card", "visa", "payment", "credit"), ("ip", "server", "host", "address"),
             ("version", "id", "no.", "page"))


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(map(int, reversed(digits))):
        total += digit if place % 2 == 0 else 2 * digit - 9 * (digit > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local@domain, each at sign looked at once."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            yield start, free
        at = text.find("@", max(free, at + 1))


def _octets(text: str) -> bool:
    parts = (p.lstrip("0") or "0" for p in text.split(".") if p)
    return all(len(p) <= 3 and int(p) <= 255 for p in parts)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Confirmed spans, by kind and then by start."""
    return [(kind, start, end) for kind, start, end, good in _patterned(text) if good]


def _patterned(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """Matches of the fixed patterns, and whether their check holds."""
    for start, end in _emails(text):
        yield "email", start, end, True
    for m in _IP.finditer(text):
        yield "ip", m.start(), m.end(), _octets(m[0])
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        yield "card", m.start(), m.end(), 13 <= len(digits) <= 19 and luhn(digits)
    for m in _PHONE.finditer(text):
        yield "phone", m.start(), m.end(), 9 <= len(_digits(m[0])) <= 15


def _mod_97(account: str) -> bool:
    body = account.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in body[4:] + body[:4])) % 97 == 1


def _label(text: str, kind: str, start: int, end: int) -> int:
    """Weak label of a candidate that touches no base span."""
    body = text[start:end]
    n = len(_digits(body))
    if kind == "account":
        return CHECKED if _mod_97(body) else REFUTED
    if kind == "ip6":
        return CHECKED if body.count(":") == 7 else REFUTED
    if kind == "spelled_email":
        return CHECKED if re.search(r"[A-Za-z]{2,}\Z", body) else REFUTED
    if kind == "ip" or not 9 <= n <= 15 or _dotted(body):
        return REFUTED
    near = text[max(0, start - CONTEXT) : start].lower()
    return REFUTED if any(word in near for word in _TRIGGERS[-1]) else OPEN


def _dotted(body: str) -> bool:
    return bool(re.fullmatch(r"[0-9]+(\.[0-9]+){3}", body))


def _other_form(kind: str, body: str) -> tuple[str, str] | None:
    """(kind, text) of a base span as a generated candidate would have it."""
    if kind == "email":
        local, _, domain = body.partition("@")
        return "spelled_email", f"{local} (at) {domain.replace('.', ' (dot) ')}"
    if kind == "phone":
        code, space, rest = body[1:].partition(" ")
        national = space and int(body[-1]) % 2 and len(_digits(rest)) >= 7
        return "number", rest if national else body[1:]
    return None


def candidates(
    text: str, base: list[tuple[str, int, int]]
) -> list[tuple[str, int, int, int, list[float]]]:
    """(kind, start, end, label, features) of base spans, their other forms and all proposals."""
    found = {}
    for kind, start, end in base:
        found[kind, start, end] = CONFIRMED, features(text, start, end)
        other = _other_form(kind, text[start:end])
        if other:
            before = text[max(0, start - CONTEXT) : start]
            changed = before + other[1] + text[end : end + 1]
            at = len(before), len(before) + len(other[1])
            found[other[0], start, end] = CONFIRMED, features(changed, *at)
    starts = sorted((s, e) for _, s, e in base)
    reach = list(accumulate((e for _, e in starts), max))
    proposed = [(kind, s, e) for kind, s, e, good in _patterned(text) if e - s > 4 and not good]
    proposed += [
        (kind, *m.span()) for kind, pattern in _GENERATORS.items() for m in pattern.finditer(text)
    ]
    for kind, start, end in [*proposed]:  # the last word may not be the account's
        last = text.rfind(" ", start, end)
        if kind == "account" and 0 < end - last - 1 < 4:
            proposed.append((kind, start, last))
    for kind, start, end in proposed:
        before = bisect_left(starts, (end,))
        if not before or reach[before - 1] <= start:  # touches no base span
            found[kind, start, end] = _label(text, kind, start, end), features(text, start, end)
    return [(kind, s, e, label, seen) for (kind, s, e), (label, seen) in found.items()]


def features(text: str, start: int, end: int) -> list[float]:
    """Format of the span, and its context."""
    body = text[start:end]
    digits = _digits(body)
    groups = [len(g) for g in re.findall("[0-9]+", body)]
    near = text[max(0, start - CONTEXT) : start].lower()
    before, after = text[max(0, start - 1) : start], text[end : end + 1]
    format_part = [
        len(body), len(digits), len(groups), max(groups, default=0), min(groups, default=0),
        sum(c.isalpha() for c in body), sum(c.isupper() for c in body), body.count("."),
        body.count("-"), body.count(" "), body.count(":"), body.count("@"), len(set(digits)),
        body[:1] == "+", "(" in body,
    ]
    context_part = [
        before.isalnum(), after.isalnum(), before.isspace() or not before,
        after.isspace() or not after, near.count("."), sum(c.isdigit() for c in near),
        *(any(word in near for word in words) for words in _TRIGGERS),
    ]
    return [*map(float, format_part + context_part)]


SPAN = "struct<kind:string,start:int,end:int>"
CANDIDATE = "struct<kind:string,start:int,end:int,label:int,features:array<float>>"
_SPAN_TYPE = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_CANDIDATE_TYPE = pa.struct(
    [*_SPAN_TYPE, ("label", pa.int32()), ("features", pa.list_(pa.float32()))]
)


class _Nested:
    """Lists of spans, or of candidates, in flat arrays: some hundred bytes a candidate."""

    def __init__(self):
        self.kinds, self.numbers, self.features = bytearray(), array("i"), array("f")
        self.ends = array("i", [0])

    def add(self, found: Iterable[tuple]) -> None:
        for kind, *numbers in found:
            self.kinds.append(KINDS.index(kind))
            if len(numbers) > 2:  # start, end, label, features
                self.features.extend(numbers.pop())
            self.numbers.extend(numbers)

    def close(self) -> None:
        """The row's list is complete."""
        self.ends.append(len(self.kinds))

    def array(self, kind: pa.StructType) -> pa.Array:
        """A list column; ``kind`` has start and end, and label and features if it is longer."""
        n, featured = len(self.kinds), kind.num_fields > 3
        codes = pa.array(np.frombuffer(bytes(self.kinds), np.uint8).astype(np.int32))
        numbers = np.array(self.numbers, np.int32).reshape(n, kind.num_fields - 1 - featured)
        fields = [pa.array(KINDS, pa.string()).take(codes), *(pa.array(x) for x in numbers.T)]
        if featured:
            places = np.arange(n + 1, dtype=np.int32) * (len(self.features) // max(n, 1))
            values = pa.array(np.array(self.features, np.float32))
            fields.append(pa.ListArray.from_arrays(pa.array(places), values))
        structs = pa.StructArray.from_arrays(
            [f.cast(kind.field(i).type) for i, f in enumerate(fields)], fields=list(kind)
        )
        return pa.ListArray.from_arrays(pa.array(np.array(self.ends, np.int32)), structs)


def propose(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_row, key, base, candidates) per document, written out: it is read several times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text")
            for lo, hi in row_pieces(text_bytes(texts)[1]):
                bases, proposals = _Nested(), _Nested()
                for i in range(lo, hi):
                    body = texts[i].as_py()
                    if body and _RELEVANT(body):
                        base = base_spans(body)
                        bases.add(base)
                        proposals.add(candidates(body, base))
                    bases.close()
                    proposals.close()
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("_row"), part.column("_key"),
                        bases.array(_SPAN_TYPE), proposals.array(_CANDIDATE_TYPE),
                    ],
                    ["_row", "_key", "base", "candidates"],
                )

    numbered = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col(key).cast("long").alias("_key"),
        F.col(text).alias("_text"),
    )
    schema = f"_row long, _key long, base array<{SPAN}>, candidates array<{CANDIDATE}>"
    return materialize(numbered.mapInArrow(run, schema), "pii-candidates")


def _group() -> Column:
    """The group of a candidate ``c`` that has a threshold of its own."""
    digits = F.element_at("c.features", 2)
    sized = F.col("c.kind").isin("card", "number") & digits.between(9, 15)
    return F.when(sized, PHONE_SIZED).otherwise(F.col("c.kind"))


def fit(
    proposed: DataFrame, size: int = TRAINING_CANDIDATES, precision: float = PRECISION, seed: int = 3
) -> tuple[GBTClassificationModel, dict[str, float]] | None:
    """(trees, thresholds by group) from all labelled candidates; None without both labels.

    Trees are fitted to those not set apart, thresholds to all set apart; none is left out. ``size``
    is the weight of all rows together, shared evenly by kinds and labels.
    """
    every = proposed.select("_key", F.explode("candidates").alias("c")).where(
        F.col("c.label") != OPEN
    )
    good = F.col("c.label") != REFUTED
    counts = every.groupBy(F.col("c.kind").alias("kind"), good.alias("good")).count().collect()
    if len({r["good"] for r in counts}) < 2:
        return None
    room = size / len(counts)
    weight = reduce(
        lambda rest, r: F.when(
            (F.col("c.kind") == r["kind"]) & (good == r["good"]),
            min(MOST_WEIGHT, room / r["count"]),
        ).otherwise(rest),
        counts, F.lit(1.0),
    )
    place = F.struct("_key", "c.start", "c.end", "c.kind")
    labelled = every.select(
        _group().alias("group"),
        good.cast("double").alias("label"),
        array_to_vector(F.col("c.features").cast("array<double>")).alias("features"),
        weight.alias("weight"),
        hash_sample(place, CALIBRATION_SHARE, seed + 1).alias("_apart"),
    )
    labelled = materialize(labelled, "pii-training")
    train = labelled.where(~F.col("_apart"))
    if train.select("label").distinct().count() < 2:
        return None
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=seed, weightCol="weight").fit(
        train
    )
    bins = (
        scored(trees, labelled.where("_apart"))
        .groupBy("group", F.floor(F.col("p") * BINS).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("good"))
        .orderBy(F.desc("bin"))
        .collect()
    )
    pooled = _threshold(bins, precision)
    by_group = {g: [r for r in bins if r["group"] == g] for g in GROUPS}
    return trees, {g: _threshold(b, precision) if b else pooled for g, b in by_group.items()}


def _threshold(bins: list, precision: float) -> float:
    """The lowest score with the precision, from bins in descending order."""
    threshold, n, good = 2.0, 0.0, 0.0
    for i, row in enumerate(bins):
        n, good = n + row["n"], good + row["good"]
        last = i + 1 == len(bins) or bins[i + 1]["bin"] != row["bin"]
        if last and good >= precision * n:
            threshold = row["bin"] / BINS
    return max(threshold, EVEN)


def scored(trees: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    """``rows`` with ``p``, the probability of personal data."""
    return trees.transform(rows).withColumn("p", vector_to_array("probability")[1])


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 3) -> DataFrame:
    """(key, base, added): confirmed spans and added ones, as arrays of (kind, start, end)."""
    proposed = propose(docs, key, text)
    model = fit(proposed, seed=seed)
    if model is None:
        empty = F.array().cast(f"array<{SPAN}>")
        return proposed.select(F.col("_key").alias(key), "base", empty.alias("added"))
    trees, thresholds = model
    unsure = proposed.select("_row", F.explode("candidates").alias("c")).where(
        F.col("c.label") != CONFIRMED
    )
    threshold = reduce(
        lambda rest, group: F.when(_group() == group, thresholds[group]).otherwise(rest),
        GROUPS, F.lit(2.0),
    )
    threshold = F.when(F.col("c.label") == CHECKED, EVEN).otherwise(threshold)
    likely = scored(
        trees,
        unsure.withColumn("features", array_to_vector(F.col("c.features").cast("array<double>"))),
    ).where(F.col("p") >= threshold)
    wanted = likely.groupBy("_row").agg(
        F.collect_list(F.struct("p", "c.kind", "c.start", "c.end")).alias("likely")
    )
    joined = proposed.select("_row", "_key", "base").join(wanted, "_row", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            added = [
                _without_overlaps(base.as_py(), likely.as_py() or [])
                for base, likely in zip(batch.column("base"), batch.column("likely"))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), batch.column("base"), pa.array(added, pa.list_(_SPAN_TYPE))],
                [key, "base", "added"],
            )

    return joined.mapInArrow(run, f"`{key}` long, base array<{SPAN}>, added array<{SPAN}>")


def _without_overlaps(base: list[dict], likely: list[dict]) -> list[dict]:
    """Likely spans that touch no base span and no likelier one; n log n for n spans."""
    starts, ends = [], []  # of what is taken, without overlaps
    for b in sorted(base, key=lambda b: b["start"]):
        if ends and b["start"] < ends[-1]:
            ends[-1] = max(ends[-1], b["end"])
        else:
            starts.append(b["start"])
            ends.append(b["end"])
    added = []
    for c in sorted(likely, key=lambda c: (-c["p"], c["start"], c["end"], c["kind"])):
        at = bisect_left(starts, c["end"])  # the last one that begins before the end
        if not at or ends[at - 1] <= c["start"]:
            starts.insert(at, c["start"])
            ends.insert(at, c["end"])
            added.append({k: c[k] for k in ("kind", "start", "end")})
    return added


def joined(found: list[dict]) -> str:
    """kind:start:end by kind as listed, then by start, comma-joined."""
    rows = sorted((KINDS.index(f["kind"]), f["start"], f["end"]) for f in found)
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for kind, start, end in rows)


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans) from base and added spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base = [b.as_py() for b in batch.column("base")]
            added = [a.as_py() for a in batch.column("added")]
            counts = [
                pa.array([sum(b["kind"] == kind for b in row) for row in base], pa.int64())
                for kind in BASE_KINDS
            ]
            hashes = [hashlib.sha256(joined(row).encode()).hexdigest() for row in base]
            every = [joined(b + a) for b, a in zip(base, added)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), *counts, pa.array(hashes, pa.string()), pa.array(every, pa.string())],
                [key, *(f"n_{kind}" for kind in BASE_KINDS), "base_sha256", "spans"],
            )

    longs = ", ".join(f"n_{kind} long" for kind in BASE_KINDS)
    return found.mapInArrow(run, f"`{key}` long, {longs}, base_sha256 string, spans string")


def redact(text: str, found: list[dict]) -> str:
    """The text with every span replaced by its kind in brackets."""
    parts, at = [], 0
    for f in sorted(found, key=lambda f: (f["start"], -f["end"])):
        if f["start"] >= at:
            parts += [text[at : f["start"]], f"[{f['kind']}]"]
        at = max(at, f["end"])
    return "".join(parts) + text[at:]
