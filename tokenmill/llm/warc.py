"""Web archives: segmented records written with Spark, read back and put together again.

Writing: one response record per page, its HTTP body in chunked transfer framing. A block longer
than a segment is cut: the first record carries segment number 1, continuation records name it as
their origin, the last one states the total length. Pages whose payload equals that of a page with
a smaller id become revisit records without payload. Archives are gzip text files of a bounded
number of records, and records are bounded by the segment, so no file and no task grows with a page.

Reading: records are parsed file by file. Whole ones are decoded where they are; segments are
grouped by origin, ordered by number, checked against the total length and then decoded. A record
that fails a check (length, gaps, framing, digest) is returned with ``intact`` false.

A null payload is an empty one, a null page id is written as ``null`` and read as null. Repeated
rows (same id and payload) are written as often as they occur and read back as often; the first of
equal payloads is the smallest id, and all its repeats are responses. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.session import materialize

MIN_REVISIT_BYTES = 100
SEGMENT_BYTES = 16 * 1024
CHUNK_BYTES = 4 * 1024
RECORDS_PER_FILE = 2_000
WRITTEN = "2024-01-01T00:00:00Z"
READ_BYTES = 1 << 16
ROWS_PER_BATCH = 500

HTTP_HEAD = (
    b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
)
END = b"\r\n\r\n"


def revisit_plan(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(_id, _digest, refers_to): pages whose payload a page with a smaller id has.

    Only ids and digests move; equal payloads are counted before the shuffle.
    """
    named = pages.where(F.col("_bytes") >= min_bytes).select("_id", "_digest")
    first = named.groupBy("_digest").agg(
        F.min("_id").alias("refers_to"), F.count(F.lit(1)).alias("n")
    )
    shared = materialize(first.where(F.col("n") > 1).drop("n"), "shared-payloads")
    return named.join(shared, "_digest").where(F.col("_id") > F.col("refers_to")).distinct()


def _record_id(page: object, digest: str, number: int = 1) -> str:
    name = f"{'null' if page is None else page}:{digest}:{number}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def chunked(payload: bytes) -> bytes:
    parts = []
    for at in range(0, len(payload), CHUNK_BYTES):
        part = payload[at : at + CHUNK_BYTES]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; raises ValueError if the framing is broken."""
    parts, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if size == 0:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk is cut short")
        parts.append(body[at : at + size])
        at += size + 2


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    fields = [*fields, ("Content-Length", len(block))]
    head = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + END


def page_records(
    page: int | None, payload: bytes, digest: str, refers_to: int | None, segment: int
) -> Iterator[bytes]:
    """The records of one page."""
    origin = _record_id(page, digest)
    common = [
        ("WARC-Date", WRITTEN),
        ("WARC-Target-URI", f"urn:page:{'null' if page is None else page}"),
    ]
    typed = [("Content-Type", "application/http;msgtype=response")]
    digests = [("WARC-Payload-Digest", f"sha256:{digest}")]
    if refers_to is not None:
        yield _record(
            [
                ("WARC-Type", "revisit"), ("WARC-Record-ID", origin), *common, *typed, *digests,
                ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                ("WARC-Refers-To", _record_id(refers_to, digest)),
                ("WARC-Refers-To-Target-URI", f"urn:page:{refers_to}"),
            ],
            HTTP_HEAD,
        )
        return
    block = HTTP_HEAD + chunked(payload)
    count = max(1, -(-len(block) // segment))
    for number in range(1, count + 1):
        fields: list[tuple[str, object]] = [
            ("WARC-Type", "response" if number == 1 else "continuation"),
            ("WARC-Record-ID", _record_id(page, digest, number)),
            *common,
        ]
        fields += [*typed, *digests] if number == 1 else [("WARC-Segment-Origin-ID", origin)]
        if count > 1:
            fields.append(("WARC-Segment-Number", number))
            if number == count:
                fields.append(("WARC-Segment-Total-Length", len(block)))
        yield _record(fields, block[(number - 1) * segment : number * segment])


def write_archives(
    pages: DataFrame,
    path: str,
    key: str = "page_id",
    payload: str = "html",
    min_revisit_bytes: int = MIN_REVISIT_BYTES,
    segment: int = SEGMENT_BYTES,
    records_per_file: int = RECORDS_PER_FILE,
) -> None:
    """Write a record per page below ``path``, whole tasks at a time."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    prepared = pages.select(
        F.col(key).cast("long").alias("_id"),
        F.sha2(body, 256).alias("_digest"),
        F.octet_length(body).cast("long").alias("_bytes"),
        body.alias("_payload"),
    )
    plan = revisit_plan(prepared, min_revisit_bytes)
    planned = prepared.join(plan, ["_id", "_digest"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c) for c in ("_id", "_payload", "_digest", "refers_to")))
            out, held = [], 0
            for row in rows:
                for record in page_records(*(v.as_py() for v in row), segment):
                    out.append(record[:-1])  # the sink writes the last line feed
                    held += len(record)
                if held > READ_BYTES * 16:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    # A cast of binary keeps the bytes, so the text sink writes any payload as it is.
    records = planned.mapInArrow(run, "record binary").select(F.col("record").cast("string"))
    options = {"compression": "gzip", "lineSep": "\n", "maxRecordsPerFile": records_per_file}
    records.write.options(**options).text(path)


class _Inflated:
    """The bytes of a gzip file of any number of members, decompressed piece by piece."""

    def __init__(self, content: bytes):
        self.content, self.fed = content, 0
        self.inflate = zlib.decompressobj(31)
        self.buffer = bytearray()

    def more(self) -> bool:
        """Some more bytes in the buffer; False at the end of the file."""
        if self.inflate.eof:  # the next member begins
            rest = self.inflate.unused_data
            self.fed -= len(rest)
            while self.fed < len(self.content) and not self.content[self.fed]:
                self.fed += 1  # zeros may fill up a file
            if self.fed >= len(self.content):
                return False
            self.inflate = zlib.decompressobj(31)
        waiting = self.inflate.unconsumed_tail
        if not waiting:
            if self.fed >= len(self.content):
                if not self.content:
                    return False
                raise EOFError("the archive ends within a compressed member")
            waiting = self.content[self.fed : self.fed + READ_BYTES]
            self.fed += len(waiting)
        self.buffer.extend(self.inflate.decompress(waiting, 8 * READ_BYTES))
        return True


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of every record of a gzip archive, in one member or in one each.

    An archive that ends within a member, a header or a block raises an error, as does a header
    without a length.
    """
    source = _Inflated(content)
    buffer = source.buffer
    while True:
        looked = 0
        while (end := buffer.find(END, looked)) < 0:
            looked = max(len(buffer) - len(END), 0)
            if not source.more():
                if buffer.strip():
                    raise EOFError("the archive ends within a header")
                return
        lines = bytes(buffer[:end]).decode().strip("\r\n").split("\r\n")
        header = {}
        for line in lines[1:]:
            name, colon, value = line.partition(":")
            if not colon:
                raise ValueError(f"not a header line: {line[:80]!r}")
            header[name] = value.strip()
        size = int(header["Content-Length"])
        while len(buffer) < end + 4 + size + 4 and source.more():
            pass
        if len(buffer) < end + 4 + size:
            raise EOFError("the archive ends within a block")
        block = bytes(buffer[end + 4 : end + 4 + size])
        del buffer[: end + 4 + size + 4]
        yield header, block


RECORD_SCHEMA = (
    "record_id string, type string, page_id long, digest string, refers_to long, "
    "origin string, number int, total long, block binary"
)


SUMMARY_SCHEMA = RECORD_SCHEMA + ", payload_bytes long, payload_digest string, intact boolean"


def read_records(spark: SparkSession, path: str, summary: bool = False) -> DataFrame:
    """Every record of the archives below ``path``; ``number`` is null where a record is whole.

    A ``summary`` has length, digest and state of the payload in place of a whole record's block, so
    that archives are parsed once whatever is asked of them; blocks of segments stay.
    """

    def page(uri: str | None) -> int | None:
        name = (uri or "").rpartition(":")[2]
        return int(name) if name not in ("", "null") else None

    def number(header: dict[str, str], name: str) -> int | None:
        return int(header[name]) if name in header else None

    schema = SUMMARY_SCHEMA if summary else RECORD_SCHEMA
    names = [f.split()[0] for f in schema.split(", ")]
    types = [
        pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(),
        pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_(),
    ][: len(names)]

    def summed(row: tuple) -> tuple:
        """The row with its payload's length, digest and state; a whole block is left out."""
        *others, block = row
        if others[6] is not None:
            return (*row, None, None, None)
        payload = decoded([{"number": 1, "block": block}], len(block)) if others[1] == "response" else None
        if payload is None:
            return (*others, None, None, None, False)
        digest = hashlib.sha256(payload).hexdigest()
        return (*others, None, len(payload), digest, digest == others[3])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for header, block in parse(content.as_py()):
                    own = header["WARC-Record-ID"]
                    row = (
                        own, header["WARC-Type"], page(header.get("WARC-Target-URI")),
                        header.get("WARC-Payload-Digest", "").removeprefix("sha256:") or None,
                        page(header.get("WARC-Refers-To-Target-URI")),
                        header.get("WARC-Segment-Origin-ID", own),
                        number(header, "WARC-Segment-Number"),
                        number(header, "WARC-Segment-Total-Length"), block,
                    )
                    rows.append(summed(row) if summary else row)
                    if len(rows) >= ROWS_PER_BATCH:
                        yield packed(rows)
                        rows = []
                if rows:
                    yield packed(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, schema)


def decoded(parts: list[dict] | None, total: int | None) -> bytes | None:
    """The payload of an HTTP block in numbered parts of the given total length; None if broken."""
    parts = sorted(parts or [], key=lambda part: part["number"])
    if [part["number"] for part in parts] != list(range(1, len(parts) + 1)) or total is None:
        return None
    block = b"".join(part["block"] for part in parts)
    head, found, body = block.partition(END)
    if len(block) != total or not found:
        return None
    if b"transfer-encoding: chunked" not in head.lower():
        return body
    try:
        return unchunked(body)
    except ValueError:
        return None


def _decode_blocks(blocks: DataFrame) -> DataFrame:
    schema = (
        "page_id long, digest string, payload binary, payload_bytes long, payload_digest string, "
        "intact boolean, copies long"
    )
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                decoded(parts.as_py(), total.as_py())
                for parts, total in zip(batch.column("parts"), batch.column("total"))
            ]
            digests = [None if p is None else hashlib.sha256(p).hexdigest() for p in found]
            stated = batch.column("digest").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"), batch.column("digest"), pa.array(found, pa.binary()),
                    pa.array([None if p is None else len(p) for p in found], pa.int64()),
                    pa.array(digests, pa.string()),
                    pa.array([d is not None and d == s for d, s in zip(digests, stated)]),
                    batch.column("copies"),
                ],
                names,
            )

    return blocks.mapInArrow(run, schema)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Every response: page_id, digest (as stated), payload, its length and digest, intact."""
    records = read_records(spark, path)
    whole = records.where("type = 'response' and number is null").select(
        "page_id", "digest",
        F.array(F.struct(F.lit(1).alias("number"), "block")).alias("parts"),
        F.octet_length("block").cast("long").alias("total"),
        F.lit(1).cast("long").alias("copies"),
    )
    put = _decode_blocks(whole.unionByName(_segmented(records)))
    each = put.select("*", F.explode(F.expr("sequence(1L, copies)")).alias("_copy"))
    return each.drop("_copy", "copies")


def _segmented(records: DataFrame) -> DataFrame:
    """(page_id, digest, parts, total, copies) of records in segments, put together by origin.

    Equal pages write equal segments, so a number may come more than once: it is the same block.
    """
    return records.where("number is not null").groupBy("origin").agg(
        F.max(F.when(F.col("type") == "response", F.col("page_id"))).alias("page_id"),
        F.max("digest").alias("digest"),
        F.collect_set(F.struct("number", "block")).alias("parts"),
        F.max("total").alias("total"),
        F.greatest(F.count(F.when(F.col("type") == "response", 1)), F.lit(1)).alias("copies"),
    ).drop("origin")


def read_revisits(spark: SparkSession, path: str) -> DataFrame:
    """Every revisit: page_id, digest, refers_to."""
    return read_records(spark, path).where("type = 'revisit'").select(
        "page_id", "digest", "refers_to"
    )


def page_digests(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, intact) per page.

    A revisit takes the length of the payload it refers to, and is intact if that response is.
    """
    records = materialize(read_records(spark, path, summary=True), "records")
    fields = ["page_id", "digest", "payload_bytes", "payload_digest", "intact"]
    put = _decode_blocks(_segmented(records)).select(
        *fields, F.explode(F.expr("sequence(1L, copies)")).alias("_copy")
    )
    whole = records.where("type = 'response' and number is null").select(*fields)
    responses = materialize(whole.unionByName(put.drop("_copy")), "responses")
    stored = responses.where("page_id is not null").groupBy("page_id", "digest").agg(
        F.min("payload_bytes").alias("payload_bytes"), F.min("intact").alias("intact")
    )
    revisits = records.where("type = 'revisit'").select("page_id", "digest", "refers_to").join(
        stored.withColumnRenamed("page_id", "refers_to"), ["refers_to", "digest"], "left"
    )
    return responses.select(
        "page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"),
        F.lit(None).cast("long").alias("refers_to"), "intact",
    ).unionByName(
        revisits.select(
            "page_id", "payload_bytes", F.col("digest").alias("payload_digest"),
            F.lit("revisit").alias("record_type"), "refers_to",
            F.coalesce("intact", F.lit(False)).alias("intact"),
        )
    )

