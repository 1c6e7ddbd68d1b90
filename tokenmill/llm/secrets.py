"""Secrets: every rule's regular expression becomes a Boolean query over an inverted trigram index.

``trigram_query`` reads off a pattern which trigrams a match must hold: literals next to each other,
small character classes and short alternatives are spelled out, alternatives are joined by "any",
what follows each other by "all". A pattern without a mandatory trigram (such as a run of hex digits)
has no query and is looked for in every text.

Texts are indexed in segments of about a megabyte, where they lie: for each trigram that a rule asks
for, a posting list of the segment's rows (a bitmap). A rule's postings are intersected and united as
its query says; the rows left are candidates and are searched with the regular expression. Neither
texts nor postings move, so no word that every document holds makes a group. ``index_segments`` gives the
same postings as a table to keep, and ``candidates`` answers rules from that table without the texts.

The index folds A-Z to lower case and works on UTF-8 bytes; patterns are compiled with ASCII classes.
Spans count code points, ends are exclusive. Base rules always stay. The other rules add their spans
unless a base span covers them. A null text is an empty one and has no spans. Rows without an id and
repeated rows are searched like all others, other columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate
from re import _constants as op
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.arrays import row_pieces, text_bytes
from tokenmill.session import new_path

MOST_STRINGS = 64  # spelled out at one place of a pattern
MOST_CLASS = 12  # characters of a class that is spelled out
MOST_REPEATS = 4  # of a part that is spelled out

Query = tuple  # ("has", trigram) | ("all", query, ...) | ("any", query, ...); ("all",) holds everywhere
EVERYWHERE: Query = ("all",)


@dataclass(frozen=True)
class Rule:
    """A kind of secret; ``least`` characters of ``group`` are needed, else a match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))

    def spans(self, text: str, compiled: re.Pattern) -> Iterator[tuple[int, int]]:
        for m in compiled.finditer(text):
            if m.end(self.group) - m.start(self.group) >= self.least:
                yield m.span()


# Fixed patterns.
BASE_RULES = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2, least=12, any_case=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=18),
    Rule("hex", r"[0-9a-f]+", least=16),
)
ADDED_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----"),
    Rule("github", r"\bgh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("gitlab", r"\bglpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"\bxox[abeprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"\bAIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])"),
    Rule("payment", r"\b[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("web_token", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"\bbearer\x20+[A-Za-z0-9._~+/-]{20,}=*", any_case=True),
    Rule("url_login", r"\b[a-z][a-z0-9+]{1,11}://[^\s:/@]{1,64}:[^\s:/@]{3,64}@"),
)
RULES = BASE_RULES + ADDED_RULES
KINDS = tuple(rule.kind for rule in RULES)
BASE_KINDS = tuple(rule.kind for rule in BASE_RULES)


def _fold(text: str) -> bytes:
    return text.encode().lower()


def _trigrams(text: bytes) -> Query:
    found = dict.fromkeys(text[i : i + 3] for i in range(len(text) - 2))
    return ("all", *(("has", int.from_bytes(t)) for t in found))


def _either(queries: Sequence[Query]) -> Query:
    different = tuple(dict.fromkeys(queries))
    if EVERYWHERE in different or not different:
        return EVERYWHERE
    needs = [frozenset(q[1:]) if q[0] == "all" else frozenset([q]) for q in different]
    different = tuple(q for q, own in zip(different, needs) if not any(n < own for n in needs))
    return different[0] if len(different) == 1 else ("any", *different)


class _Needed:
    """What a sequence of pattern parts needs: conditions so far, and the strings right behind them."""

    def __init__(self):
        self.conditions: list[Query] = []
        self.strings: set[bytes] = {b""}
        self.exact = True  # the strings are all that can match

    def then(self, more: set[bytes]) -> None:
        if len(self.strings) * len(more) > MOST_STRINGS:
            self.cut()
        self.strings = {a + b for a in self.strings for b in more}

    def cut(self, condition: Query = EVERYWHERE) -> None:
        """Something comes that cannot be spelled out."""
        for query in (_either([_trigrams(s) for s in self.strings]), condition):
            if query != EVERYWHERE:
                self.conditions.append(query)
        self.strings, self.exact = {b""}, False

    def query(self) -> Query:
        self.cut()
        different = tuple(dict.fromkeys(self.conditions))
        return different[0] if len(different) == 1 else ("all", *different)


def _class_strings(items: list) -> set[bytes] | None:
    """The characters of a class if they are few."""
    out: set[bytes] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            out.add(_fold(chr(value)))
        elif kind is op.RANGE and value[1] - value[0] < 2 * MOST_CLASS:
            out |= {_fold(chr(c)) for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= MOST_CLASS else None


def _read(items) -> _Needed:
    needed = _Needed()
    for kind, value in items:
        if kind is op.LITERAL:
            needed.then({_fold(chr(value))})
        elif kind is op.IN and (few := _class_strings(value)) is not None:
            needed.then(few)
        elif kind is op.SUBPATTERN:
            _join(needed, _read(value[-1]))
        elif kind is op.BRANCH:
            parts = [_read(x) for x in value[1]]
            strings = set().union(*(p.strings for p in parts))
            if all(p.exact for p in parts) and len(strings) <= MOST_STRINGS:
                needed.then(strings)
            else:
                needed.cut(_either([p.query() for p in parts]))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            _repeat(needed, *value)
        elif kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
            continue  # takes no characters
        else:  # any character, a negated one, a back reference
            needed.cut()
    return needed


def _join(needed: _Needed, part: _Needed) -> None:
    if part.exact and len(part.strings) <= MOST_STRINGS:
        needed.then(part.strings)
    else:
        needed.cut(part.query())


def _repeat(needed: _Needed, least: int, most: int, body) -> None:
    part = _read(body)
    if part.exact and (least, most) == (0, 1):
        needed.then(part.strings | {b""})
        return
    for _ in range(min(least, MOST_REPEATS)):
        _join(needed, part if part.exact else _read(body))
    if most > least or least > MOST_REPEATS:
        needed.cut()


def trigram_query(rule: Rule) -> Query:
    """Which trigrams of folded text a match of the rule holds; EVERYWHERE if none is mandatory."""
    flags = re.ASCII | (re.IGNORECASE if rule.any_case else 0)
    return _read(parser.parse(rule.pattern, flags)).query()


def query_trigrams(query: Query) -> set[int]:
    if query[0] == "has":
        return {query[1]}
    return set().union(*(query_trigrams(q) for q in query[1:]))


def matching_rows(query: Query, posting: Callable[[int], np.ndarray], rows: int) -> np.ndarray:
    """Rows (as flags) that the postings leave."""
    if query[0] == "has":
        return posting(query[1])
    parts = [matching_rows(q, posting, rows) for q in query[1:]]
    if query[0] == "any":
        return np.logical_or.reduce(parts)
    return np.logical_and.reduce([np.ones(rows, bool), *parts])


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Segment:
    """Posting lists of some texts for the wanted trigrams (sorted)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray):
        rows = len(offsets) - 1
        self.rows = rows
        self.wanted = wanted
        self.flags = np.zeros((len(wanted), rows), bool)
        if not len(wanted):
            return
        likely = np.zeros(1 << 16, bool)
        likely[_short(wanted >> 16, (wanted >> 8) & 255, wanted & 255)] = True
        for lo in range(0, max(len(data) - 2, 0), SEGMENT):
            folded = _LOWER[data[lo : lo + SEGMENT + 2]]
            a, b, c = folded[:-2], folded[1:-1], folded[2:]
            hits = np.flatnonzero(likely[_short(a, b, c)])
            found = (a[hits].astype(np.int64) << 16) | (b[hits].astype(np.int64) << 8) | c[hits]
            at = np.minimum(np.searchsorted(wanted, found), len(wanted) - 1)
            good = wanted[at] == found
            places, at = hits[good] + lo, at[good]
            row = np.searchsorted(offsets, places, side="right") - 1
            inside = places + 3 <= offsets[row + 1]
            self.flags[at[inside], row[inside]] = True

    def posting(self, trigram: int) -> np.ndarray:
        return self.flags[np.searchsorted(self.wanted, trigram)]


def _short(a, b, c) -> np.ndarray:
    """A 16-bit hash of three bytes."""
    return (a.astype(np.uint16) * np.uint16(2309)) ^ (b.astype(np.uint16) * np.uint16(53)) ^ c


SEGMENT = 1 << 20
SPAN = "struct<kind:string,start:int,end:int>"
_SPAN_TYPE = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def _wanted(queries: Sequence[Query]) -> np.ndarray:
    return np.array(sorted(set().union(*map(query_trigrams, queries))), np.int64)


def _segments(column: pa.Array, wanted: np.ndarray) -> Iterator[tuple[int, int, Segment]]:
    data, offsets = text_bytes(column)
    for lo, hi in row_pieces(offsets, SEGMENT):
        own = offsets[lo : hi + 1] - offsets[lo]
        yield lo, hi, Segment(data[offsets[lo] : offsets[hi]], own, wanted)


def spans(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    base: Sequence[Rule] = BASE_RULES,
    added: Sequence[Rule] = ADDED_RULES,
) -> DataFrame:
    """(key, base, added): arrays of (kind, start, end), by start and then by the rules' order."""
    rules = [*base, *added]
    queries = [trigram_query(rule) for rule in rules]
    wanted = _wanted(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [rule.compiled() for rule in rules]
        for batch in batches:
            column = batch.column("_text")
            for lo, hi, segment in _segments(column, wanted):
                candidate = np.array(
                    [matching_rows(q, segment.posting, segment.rows) for q in queries]
                ).reshape(len(rules), hi - lo)
                found_base, found_added = [], []
                for i in range(hi - lo):
                    some = np.flatnonzero(candidate[:, i])
                    body = column[lo + i].as_py() if len(some) else None
                    found = [
                        (start, int(n), end)
                        for n in some if body
                        for start, end in rules[n].spans(body, patterns[n])
                    ]
                    found.sort()
                    own = [f for f in found if f[1] < len(base)]
                    found_base.append(_structs(own, rules))
                    more = _not_covered([f for f in found if f[1] >= len(base)], own)
                    found_added.append(_structs(more, rules))
                columns = [
                    batch.column("_key").slice(lo, hi - lo),
                    pa.array(found_base, pa.list_(_SPAN_TYPE)),
                    pa.array(found_added, pa.list_(_SPAN_TYPE)),
                ]
                yield pa.RecordBatch.from_arrays(columns, [key, "base", "added"])

    rows = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, f"`{key}` long, base array<{SPAN}>, added array<{SPAN}>")


def _structs(found: list[tuple[int, int, int]], rules: Sequence[Rule]) -> list[dict]:
    return [{"kind": rules[n].kind, "start": start, "end": end} for start, n, end in found]


def _not_covered(found: list[tuple], base: list[tuple]) -> list[tuple]:
    """Spans that no base span holds whole; both lists are sorted by start."""
    starts = np.array([s for s, _, _ in base], np.int64)
    reach = [0, *accumulate((e for _, _, e in base), max)]
    return [f for f in found if reach[int(np.searchsorted(starts, f[0], side="right"))] < f[2]]


def joined(found: list[dict], kinds: Sequence[str] = KINDS) -> str:
    """kind:start:end by start and then by kind as listed, comma-joined."""
    rows = sorted((f["start"], kinds.index(f["kind"]), f["end"]) for f in found)
    return ",".join(f"{kinds[kind]}:{start}:{end}" for start, kind, end in rows)


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans) of base and added spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, added = (batch.column(c).to_pylist() for c in ("base", "added"))
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


INDEX = "keys array<long>, postings array<struct<trigram:int,rows:binary>>"


def index_segments(
    docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES
) -> DataFrame:
    """(keys, postings), written out: a row per segment, a bitmap per trigram that occurs in it."""
    wanted = _wanted([trigram_query(rule) for rule in rules])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa.struct([("trigram", pa.int32()), ("rows", pa.binary())])
        for batch in batches:
            for lo, hi, segment in _segments(batch.column("_text"), wanted):
                postings = [
                    {"trigram": int(t), "rows": np.packbits(flags).tobytes()}
                    for t, flags in zip(wanted, segment.flags) if flags.any()
                ]
                keys = pa.array([batch.column("_key").slice(lo, hi - lo).to_pylist()], pa.list_(pa.int64()))
                columns = [keys, pa.array([postings], pa.list_(types))]
                yield pa.RecordBatch.from_arrays(columns, ["keys", "postings"])

    rows = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))
    path = new_path(docs.sparkSession, "trigram-index")
    rows.mapInArrow(run, INDEX).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def candidates(index: DataFrame, rules: Sequence[Rule], key: str = "doc_id") -> DataFrame:
    """(key, kind): rows whose postings leave a rule open, from the index alone.

    The index must know the rules' trigrams; one that it was not built for has empty postings.
    """
    queries = [(rule.kind, trigram_query(rule)) for rule in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, postings in zip(batch.column("keys"), batch.column("postings")):
                own = pa.array(keys.as_py(), pa.int64())
                bitmaps = {p["trigram"]: p["rows"] for p in postings.as_py()}

                def posting(trigram: int) -> np.ndarray:
                    packed = np.frombuffer(bitmaps.get(trigram, b""), np.uint8)
                    flags = np.zeros(len(own), bool)
                    bits = np.unpackbits(packed)[: len(own)]
                    flags[: len(bits)] = bits == 1
                    return flags

                for kind, query in queries:
                    left = own.filter(pa.array(matching_rows(query, posting, len(own))))
                    kinds = pa.array([kind] * len(left), pa.string())
                    yield pa.RecordBatch.from_arrays([left, kinds], [key, "kind"])

    return index.mapInArrow(run, f"`{key}` long, kind string")
