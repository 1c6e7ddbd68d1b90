"""A token cache that follows a folder of text files: only new and changed files are encoded.

The stream is that of all lines in the order of file names. A file's ids are stored with positions that
count from the file's own beginning, and a table has one row per file: its length and time, where its ids
are and how many. A refresh compares that table with the folder, encodes what differs, and finds the
place of every file by a sum over the table. Files that were kept are not read, and their ids are not
moved, whatever became longer or shorter in front of them. Empty files are no files.

A refresh that dies leaves the table before it, which is named last. Ids of changed and removed files
stay on disk until ``rebuild``.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenmill.functions.text import line_ends
from tokenmill.operators.order import BUCKET, running_total
from tokenmill.operators.stream import Stream
from tokenmill.operators.tokens import SEGMENT, CharTokenizer, Tokenizer, encoded_segments
from tokenmill.session import materialize
from tokenmill.sources import files
from tokenmill.sources.cache import fingerprint, read_manifest, write_manifest

STATE = ("file", "size", "modified")


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, file, size, modified) of all files below a path or pattern; none of them is opened."""
    return spark.read.format("binaryFile").load(path).select(
        "path",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_modification_time").alias("modified"),
    )


def _encode(spark: SparkSession, paths: list[str] | str, tokenizer: Tokenizer) -> DataFrame:
    """(file, start, n, ids) of the lines of files; ``start`` counts from the file's beginning."""
    lines = files.number_rows(files.read_lines(spark, paths, keyed=True), keep=["file"])
    if isinstance(tokenizer, CharTokenizer):
        # Lengths are known before the ids are: whole lines are placed as text and encoded last.
        text = F.concat(line_ends(F.col("line")), F.lit("\n")).alias("text")
        placed = running_total(lines.select("file", "row", text), ["row"], F.length("text"), by=["file"])
        parts = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{SEGMENT}}}"), F.lit(0))
        cut = placed.select("file", "start", F.posexplode(parts).alias("seg", "text"))
        return cut.select(
            "file", (F.col("start") + F.col("seg") * SEGMENT).alias("start"),
            F.length("text").alias("n"), tokenizer.encode(F.col("text")).alias("ids"),
        )
    named = lines.select(F.struct("file", "row").alias("at"), "line")
    encoded = encoded_segments(named, "at", tokenizer).select("at.file", "at.row", "seg", "n", "ids")
    written = materialize(encoded, "encoded-lines")
    placed = running_total(written, ["row", "seg"], F.col("n"), by=["file"])
    return placed.select("file", "start", "n", "ids")


def refresh(
    spark: SparkSession, path: str, tokenizer: Tokenizer, root: str, rebuild: bool = False
) -> tuple[Stream, dict]:
    """(token stream, what was done) for the text files that ``path`` names now.

    Another tokenizer leads to another cache below ``root``. The names of new and changed files reach
    the driver; a first build reads ``path`` as it is.
    """
    home = f"{root}/files-{fingerprint({'path': path, 'tokenizer': tokenizer.identity})}"
    known = None if rebuild else read_manifest(spark, f"{home}/manifest")
    part = 0 if known is None else known["part"] + 1
    now = materialize(listed_files(spark, path), "listed-files")
    if known is None:
        home_rows, kept, stale = f"{home}/rows-{uuid.uuid4().hex}", None, now
        paths: list[str] | str = path
    else:
        home_rows, before = known["rows"], spark.read.parquet(known["table"])
        kept = now.drop("path").join(before, list(STATE))
        stale = now.join(before, list(STATE), "left_anti")
        paths = [re.sub(r"([\\{}\[\]*?])", r"\\\1", r["path"]) for r in stale.select("path").collect()]
    encoded = stale.count()
    if encoded:
        rows = _encode(spark, paths, tokenizer).withColumn("file_id", F.xxhash64("file")).drop("file")
        rows.write.mode("overwrite").parquet(f"{home_rows}/part={part}")
        counts = spark.read.parquet(f"{home_rows}/part={part}").groupBy("file_id").agg(
            F.sum("n").alias("tokens")
        )
    else:
        counts = spark.createDataFrame([], "file_id long, tokens long")
    fresh = stale.drop("path").withColumn("file_id", F.xxhash64("file")).join(counts, "file_id", "left")
    fresh = fresh.select(
        *STATE, "file_id", F.lit(part).alias("part"), F.coalesce("tokens", F.lit(0)).alias("tokens")
    )
    every = fresh if kept is None else fresh.unionByName(kept)
    table = f"{home}/table-{uuid.uuid4().hex}"
    every.write.parquet(table)
    entries = {"path": path, "part": part, "rows": home_rows, "table": table}
    write_manifest(spark, entries, f"{home}/manifest")
    stream = _stream(spark, home_rows, spark.read.parquet(table))
    return stream, {**entries, "encoded_files": encoded, "num_tokens": stream.total}


def _stream(spark: SparkSession, home_rows: str, table: DataFrame) -> Stream:
    """The stored rows at their places; the window runs over one row per file."""
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).cast("long")
    places = table.where("tokens > 0").withColumn("_base", base).select(
        "file_id", "part", "_base", F.col("tokens").alias("_total")
    )
    places = materialize(places, "file-places")
    total = places.agg(F.coalesce(F.sum("_total"), F.lit(0)).cast("long")).first()[0]
    parts = [r["part"] for r in places.select("part").distinct().collect()]
    if not parts:
        none = "start long, n int, ids array<int>, _base long, _total long, " + f"{BUCKET} long"
        return Stream(spark.createDataFrame([], none), "ids", 0)
    stored = [f"{home_rows}/part={p}" for p in parts]
    rows = spark.read.option("basePath", home_rows).parquet(*stored)
    placed = rows.join(places, ["file_id", "part"]).select(
        (F.col("_base") + F.col("start")).alias("start"), "n", "ids", "_base", "_total",
        F.col("_base").alias(BUCKET),
    )
    return Stream(placed, "ids", total)
