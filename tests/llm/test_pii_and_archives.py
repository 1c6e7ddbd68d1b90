"""Personal data against the patterns themselves; archives against what was written."""

import collections
import gzip
import hashlib
import re
import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

from tokenmill.llm import pii, warc

from .edge_rows import awkward, clashing, empty, prose, table

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        sums = [int(c) * (1 + i % 2) for i, c in enumerate(digits[::-1])]
        return 13 <= len(digits) <= 19 and sum(s - 9 * (s > 9) for s in sums) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain_spans(text):
    return [
        (kind, m.start(), m.end())
        for kind, pattern in PATTERNS.items()
        for m in re.finditer(pattern, text or "")
        if valid(kind, m[0])
    ]


TEXTS = [
    "a@b.c", "a@b", "@b.c", "x@y@z.com", "a.b+c%d@e-f.gh.ij.", "é.a@b.cö", "a@@b.c", "a@b.c@d.e",
    "a@b..c", "a@b.c..d@e.f", "1.2.3.4", "256.1.1.1", "001.002.003.0004", "1.2.3.4.5.6.7.8", "1.2.3",
    "1.2.3.4567 9.9.9.9", "4539 1488 0343 6467", "4539-1488-0343-6467", "4539148803436467",
    "4539148803436468", "4539148803436467 4539148803436467", "0000 0000 0000 0", "1 2", "1--2",
    "+1 (437) 555-0689", "+1", "+1 2", "+12345678", "+123456789", "+1 () . - 5 x +44 20 7946 0958.",
    "+1+2345678901", "٣٤٥ 1.2.3.4 ٣", "call +49 89 1234567 now 10.0.0.1:80 bob@example.org",
    "9" * 300, "1." * 200, "a" * 5000 + "@" + "b." * 50, "@" * 500, "+ " * 300,
]


def test_base_spans_equal_patterns():
    for text in TEXTS + [t or "" for _, t in awkward()]:
        assert pii.base_spans(text) == plain_spans(text), text


def test_long_runs_of_zeros():
    for text in ("0" * 5000 + "1.2.3.4", "1.2.3." + "0" * 9000, "1.2.3." + "0" * 9000 + "256"):
        assert pii.base_spans(text) == [
            (k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text)
            if k == "ip" and not text.endswith("256")
        ]


def test_dense_texts_take_little_time_and_memory():
    """Spans without overlaps in n log n; candidates in flat arrays."""
    base = [{"kind": "ip", "start": 20 * i, "end": 20 * i + 8} for i in range(40_000)]
    likely = [
        {"p": i % 7 / 7, "kind": "number", "start": 10 * i, "end": 10 * i + 9} for i in range(80_000)
    ]
    begun = time.time()
    added = pii._without_overlaps(base + base[:100], likely)
    assert time.time() - begun < 5 and [a["start"] for a in added[:2]] == [130, 270]
    assert len(added) == 40_000 and all(a["start"] % 20 == 10 for a in added)
    text = "mail bob at a1.b2 (at) c (dot) org or 12 34 56 78 90, " * 4000
    tracemalloc.start()
    nested = pii._Nested()
    nested.add(pii.candidates(text, []))
    nested.close()
    column = nested.array(pii._CANDIDATE_TYPE)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(column) == 1 and len(column[0]) >= 8000
    assert held < 400 * len(column[0])


def personal_rows():
    rows = awkward() + list(enumerate(TEXTS, 100))
    for i in range(300):
        good, bad = 4539148803436460, f"{4539148803436468 + 10 * i}"
        number = next(str(good + 100 * i + k) for k in range(10) if pii.luhn(str(good + 100 * i + k)))
        rows.append((1000 + i, f"{prose(i, 10)} card {number} and mail u{i}@mail{i % 7}.org then "
                               f"version {i}.{i % 9}.300.999 page {bad[:12]} ip 10.0.{i % 250}.7 ok"))
    rows += [(2000 + i, f"card {rows[-1 - i][1].split('card ')[1][:16]} 4539148803436467 paid") for i in range(5)]
    return rows


@pytest.mark.parametrize("size", [20_000, 60])
def test_spans(spark, monkeypatch, size):
    monkeypatch.setattr(pii, "TRAINING_CANDIDATES", size)
    rows = personal_rows()
    df = clashing(table(spark, rows), "base", "added", "spans", "p", "kind")
    out = pii.spans(df).collect()
    assert len(out) == len(rows)
    wanted = collections.Counter((d, tuple(plain_spans(t))) for d, t in rows)
    plain = lambda found: tuple((b["kind"], b["start"], b["end"]) for b in found)
    assert collections.Counter((r["doc_id"], plain(r["base"])) for r in out) == wanted
    for r in out:
        every = sorted((s["start"], s["end"]) for s in r["added"])
        assert all(a[1] <= b[0] for a, b in zip(every, every[1:]))
        for s in r["added"]:
            assert all(s["end"] <= b["start"] or s["start"] >= b["end"] for b in r["base"])
    clean = [r for r in out if r["doc_id"] in (1, 2, 3, 4, 5, 6, 7, 8, 13)]
    assert not any(r["added"] for r in clean)


def iban(i):
    body = f"{10**17 + 7919 * i:018d}"
    return f"DE{98 - int(body + '131400') % 97:02d}{body}"


def test_generated_kinds_are_added(spark):
    """Spelled-out addresses, IPv6, accounts and phones without '+' are found, versions are not."""
    rows, planted, versions = personal_rows(), {}, {}
    rows += [(5000 + i, f"{prose(i, 8)} call +1 (437) 555-{1000 + i} or so") for i in range(200)]
    for i in range(40):
        groups = ":".join(f"{(i + 1) * 7919 * k % 65536:x}" for k in range(1, 9))
        account = iban(i)
        for k, (kind, body) in enumerate((
            ("spelled_email", f"bob{i} (at) mail{i % 5} (dot) example (dot) org"), ("ip6", groups),
            ("account", " ".join(account[j : j + 4] for j in range(0, 22, 4))),
            ("number", f"(437) 555-{2000 + 3 * i}"), ("number", f"1 (437) 555-{3000 + 3 * i}"),
        )):
            before = prose(100 * i + k, 6) + " so "
            rows.append((6000 + 10 * i + k, f"{before}{body} and more"))
            planted[6000 + 10 * i + k] = kind, len(before), len(before) + len(body)
        before = prose(i, 6) + " version "
        versions[8000 + i] = f"{before}{2000 + i}.{i % 7}.300.{900 + i} is out"
        versions[9000 + i] = f"{prose(i, 6)} at 12:{i}:45:10:{i} it was"
    assert all(pii._mod_97(iban(i)) for i in range(40))
    out = pii.spans(table(spark, rows + list(versions.items()))).collect()
    added = {r["doc_id"]: [(a["kind"], a["start"], a["end"]) for a in r["added"]] for r in out}
    missed = [d for d, span in planted.items() if span not in added[d]]
    assert not missed, [(planted[d], added[d]) for d in missed[:5]]
    assert not any(added[d] for d in versions)


def test_registered_query_adds_planted_kinds(spark, tmp_path):
    """Recall of planted spans of each kind, and the share of added spans that were planted."""
    from tokenmill.llm import queries

    rows, planted = personal_rows(), set()
    rows += [(5000 + i, f"{prose(i, 8)} call +1 (437) 555-{1000 + i} or so") for i in range(200)]
    for i in range(200):
        groups = ":".join(f"{(i + 3) * 104729 * k % 65536:x}" for k in range(1, 9))
        for k, (kind, body) in enumerate((
            ("spelled_email", f"ann.{i} [at] site{i % 9} [dot] net"), ("ip6", groups),
            ("account", iban(1000 + i)), ("number", f"(437) 555-{4000 + 7 * i}"),
        )):
            before = prose(1000 * i + k, 5) + " at "
            doc = 10_000 + 10 * i + k
            rows.append((doc, f"{before}{body} and so on"))
            planted.add((doc, kind, len(before), len(before) + len(body)))
    rows += [(20_000 + i, f"{prose(i, 5)} version {i}.{i % 5}.300.{i} page {10**9 + i} end") for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    out = queries.op3_pii_boosting(spark, str(tmp_path)).where("doc_id is not null").collect()
    found = set()
    for r in out:
        for span in filter(None, r["spans"].split(",")):
            kind, start, end = span.split(":")
            if kind in pii.EXTRA_KINDS:
                found.add((r["doc_id"], kind, int(start), int(end)))
    for kind in pii.EXTRA_KINDS:
        own = {p for p in planted if p[1] == kind}
        assert len(own & found) >= 0.9 * len(own), kind
    new = {f for f in found if f[0] >= 10_000}
    assert len(new & planted) >= 0.95 * len(new)


def test_digests(spark):
    rows = personal_rows()[:60]
    out = pii.digests(pii.spans(table(spark, rows))).collect()
    wanted = {d: plain_spans(t) for d, t in rows if d not in (None, 11)}
    for r in out:
        if r["doc_id"] in wanted:
            spans = wanted[r["doc_id"]]
            joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
            assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
            assert [r[f"n_{k}"] for k in PATTERNS] == [sum(s[0] == k for s in spans) for k in PATTERNS]
            assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))


def test_nothing_to_learn_from(spark):
    assert pii.spans(empty(spark)).count() == 0
    out = pii.digests(pii.spans(table(spark, [(1, None), (2, "plain")]))).collect()
    assert {(r["doc_id"], r["spans"]) for r in out} == {(1, ""), (2, "")}


def test_added_spans_do_not_overlap():
    span = lambda k, s, e, p: {"kind": k, "start": s, "end": e, "p": p}
    base = [{"kind": "ip", "start": 0, "end": 5}]
    likely = [span("number", 4, 9, 0.9), span("number", 10, 20, 0.7), span("card", 15, 25, 0.8),
              span("ip6", 25, 30, 0.6)]
    added = pii._without_overlaps(base, likely)
    assert [(a["kind"], a["start"]) for a in added] == [("card", 15), ("ip6", 25)]
    assert pii.redact("1.1.1 x", base) == "[ip] x"


# --- archives ---------------------------------------------------------------------------------


def pages():
    long_page = "<p>" + "é😀 text\r\n\r\nWARC/1.1\r\n" * 3000
    rows = [
        (1, None), (2, ""), (3, "short"), (4, "short"), (5, "x" * 99), (6, "x" * 99),
        (7, "y" * 100), (8, "y" * 100), (9, "é" * 50), (10, "é" * 50), (11, long_page), (12, long_page),
        (13, "\r\n\r\n" * 40), (14, "0\r\n\r\n"), (15, "z" * 200), (15, "z" * 200), (16, "z" * 200),
        (None, "z" * 200), (None, None), (-3, "q" * 150), (17, "q" * 150), (18, "a\u0000b" * 60),
    ]
    return rows + [(100 + i, f"page {i} " + "w" * (i * 7)) for i in range(60)]


def plain_pages(rows):
    first = {}
    for page, html in rows:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    out = collections.Counter()
    for page, html in rows:
        body = (html or "").encode()
        target = first.get(html or "")
        revisit = page is not None and len(body) >= 100 and target < page
        out[
            page, len(body), hashlib.sha256(body).hexdigest(),
            "revisit" if revisit else "response", target if revisit else None, True,
        ] += 1
    return out


@pytest.mark.parametrize("segment", [300, 16 * 1024])
def test_archives_round_trip(spark, tmp_path, segment):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, html string").repartition(4)
    df = clashing(df, "record", "refers_to", "type", "payload")
    path = str(tmp_path / "archives")
    warc.write_archives(df, path, segment=segment, records_per_file=50)
    out = warc.page_digests(spark, path).collect()
    found = collections.Counter(
        (r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["intact"])
        for r in out
    )
    assert found == plain_pages(rows)
    payloads = {r["page_id"]: bytes(r["payload"]) for r in warc.read_responses(spark, path).collect()}
    assert payloads[11] == rows[10][1].encode() and payloads[2] == b""
    kinds = {r["type"] for r in warc.read_records(spark, path).select("type").distinct().collect()}
    assert ("continuation" in kinds) and ("revisit" in kinds)


def test_no_pages(spark, tmp_path):
    path = str(tmp_path / "archives")
    warc.write_archives(spark.createDataFrame([], "page_id long, html string"), path)
    assert warc.page_digests(spark, path).count() == 0


def block_of(payload):
    return warc.HTTP_HEAD + warc.chunked(payload)


def test_broken_segments_are_told():
    payload = bytes(range(256)) * 60
    block = block_of(payload)
    parts = [{"number": i + 1, "block": block[i * 999 : i * 999 + 999]} for i in range(-(-len(block) // 999))]
    assert warc.decoded(parts[::-1], len(block)) == payload
    assert warc.decoded(parts[:-1], len(block)) is None
    assert warc.decoded(parts[1:], len(block)) is None
    assert warc.decoded(parts, len(block) + 1) is None
    assert warc.decoded(parts, None) is None
    assert warc.decoded([], 0) is None
    assert warc.decoded([{"number": 1, "block": block[:-5]}], len(block) - 5) is None
    broken = block.replace(b"1000\r\n", b"0fff\r\n", 1)
    assert warc.decoded([{"number": 1, "block": broken}], len(broken)) is None


def test_parse_reads_any_piece_size(monkeypatch):
    records = [r for i in range(40) for r in warc.page_records(i, b"p" * (i * 100), "d" * 64, None, 700)]
    content = gzip.compress(b"".join(records))
    wanted = list(warc.parse(content))
    assert len(wanted) == len(records)
    monkeypatch.setattr(warc, "READ_BYTES", 7)
    assert list(warc.parse(content)) == wanted


def record(header, block):
    lines = ["WARC/1.1", *(f"{k}:{v}" for k, v in header), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_every_member_of_an_archive_is_read():
    """A member per record, all in one, empty header values, zeros at the end."""
    records = [record([("X", ""), ("N", f" {i}")], b"b" * (i * 7000)) for i in range(30)]
    wanted = [({"X": "", "N": str(i), "Content-Length": str(i * 7000)}, b"b" * (i * 7000)) for i in range(30)]
    each = b"".join(map(gzip.compress, records))
    some = gzip.compress(b"".join(records[:9])) + gzip.compress(b"") + gzip.compress(b"".join(records[9:]))
    for content in (each, some, gzip.compress(b"".join(records)), each + b"\0" * 700):
        assert list(warc.parse(content)) == wanted
    assert list(warc.parse(b"")) == [] == list(warc.parse(gzip.compress(b"")))


def test_cut_archives_are_told():
    records = [record([("N", str(i))], bytes([65 + i]) * 50_000) for i in range(5)]
    whole = b"".join(map(gzip.compress, records))
    for size in range(10, len(whole), 97):
        if len(gzip.compress(records[0])) == size:
            continue
        with pytest.raises((EOFError, ValueError)):
            list(warc.parse(whole[:size]))
    for body in (records[0][:60], records[0][:30_000], records[0] + records[1][:20]):
        with pytest.raises(EOFError):
            list(warc.parse(gzip.compress(body)))
    with pytest.raises(ValueError):
        list(warc.parse(gzip.compress(b"WARC/1.1\r\nno colon\r\n\r\n")))
    with pytest.raises(KeyError):
        list(warc.parse(gzip.compress(b"WARC/1.1\r\nA: b\r\n\r\n")))


def test_all_labelled_candidates_are_learned_from(spark, monkeypatch):
    """A size far below the number of candidates weighs them and leaves none out."""
    seen, fit, scored = [], pii.GBTClassifier.fit, pii.scored
    monkeypatch.setattr(pii.GBTClassifier, "fit", lambda self, rows: seen.append(rows.count()) or fit(self, rows))
    monkeypatch.setattr(pii, "scored", lambda trees, rows: seen.append(rows.count()) or scored(trees, rows))
    proposed = pii.propose(table(spark, [r for r in personal_rows() if r[0] is not None]))
    labelled = proposed.select(F.explode("candidates").alias("c")).where(F.col("c.label") != pii.OPEN)
    _, thresholds = pii.fit(proposed, size=60)
    assert len(seen) == 2 and sum(seen) == labelled.count()
    assert set(thresholds) == set(pii.GROUPS)
