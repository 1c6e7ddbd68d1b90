"""Text lines and JSON lines."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from tokenmill.operators.order import KeyRanges, in_order
from tokenmill.session import materialize


def read_table(
    spark: SparkSession, path: str, form: str = "parquet", schema: StructType | None = None
) -> DataFrame:
    """One split of a dataset as a batch table."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.format(form).load(path)


def split_folder(root: str, split: str, name: str | None = None) -> str:
    """A dataset keeps one folder per split, under a folder per subset if it has subsets."""
    return f"{root}/{name}/{split}" if name else f"{root}/{split}"


def read_split(
    spark: SparkSession,
    root: str,
    split: str,
    name: str | None = None,
    form: str = "parquet",
    schema: StructType | None = None,
    streaming: bool = False,
) -> DataFrame:
    """One split of a dataset, as a table or as a stream of its files."""
    path = split_folder(root, split, name)
    if not streaming:
        return read_table(spark, path, form, schema)
    known = schema or read_table(spark, path, form).schema
    return spark.readStream.schema(known).format(form).load(path)


def available_splits(spark: SparkSession, root: str, name: str | None = None) -> list[str]:
    """Names of the split folders of a dataset."""
    return child_names(spark, f"{root}/{name}" if name else root)


def spread(table: DataFrame, key: str) -> DataFrame:
    """A freshly read table for work that is heavy per row, such as encoding.

    Files that split into fewer tasks than there are cores are shuffled once by key; anything
    larger is left as it is.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    if table.rdd.getNumPartitions() >= cores:
        return table
    return table.repartition(cores, key)


SOURCE_ORDER = ("file", "block", "seq")


def _source_order() -> list[Column]:
    """Where a row was read: its file, the part of the file, its place in the task that read it."""
    return [
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
    ]


def read_lines(spark: SparkSession, path: str | list[str], keyed: bool = False) -> DataFrame:
    """(line) of text files; line feed, carriage return and both together end a line.

    ``keyed`` adds SOURCE_ORDER, by which the rows have the order of the source.
    """
    order = _source_order() if keyed else []
    return spark.read.text(path).select(*order, F.col("value").alias("line"))


def number_rows(rows: DataFrame, out: str = "row", keep: Sequence[str] = ()) -> DataFrame:
    """Rows of a keyed read with their number from 0 in source order: a key for everything else.

    ``keep`` names columns of SOURCE_ORDER that stay. The rows are written once, which fixes
    ``seq``. Rows of one part of a file are numbered without gaps, so a number is the count of rows in earlier parts plus an offset; the window
    runs over one row per part.
    """
    written = materialize(rows, "rows")
    parts = written.groupBy("file", "block").agg(
        F.min("seq").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    earlier = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.withColumn("_base", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    joined = written.join(materialize(bases, "parts"), ["file", "block"])
    number = F.col("_base") + F.col("seq") - F.col("_first")
    others = [c for c in rows.columns if c not in SOURCE_ORDER or c in keep]
    return joined.select(number.alias(out), *others)


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """(text), one row per file."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))


def _save(df: DataFrame, write: Callable[[DataFrame], None]) -> int:
    """Write rows and return how many, counted as they pass and not by a second job.

    The counter must come last, so that no step above it runs its rows twice.
    """
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return int(seen.get["rows"])


def write_lines(
    df: DataFrame,
    path: str,
    line: str = "line",
    key: str | Sequence[str] | None = None,
    ranges: KeyRanges | None = None,
) -> int:
    """One line per row; returns the rows written.

    With a numeric key the part files, in name order, follow the key; ``ranges`` may bring its
    ranges from a table that is cheaper to read.
    """
    rows = _ordered(df, key, ranges).select(line)
    return _save(rows, lambda ready: ready.write.mode("overwrite").text(path))


def write_jsonl(
    df: DataFrame,
    path: str,
    fields: Sequence[str],
    key: str | Sequence[str] | None = None,
    ranges: KeyRanges | None = None,
) -> int:
    """One JSON object per row, UTF-8 as it is; returns the rows written. Order as above."""
    rows = _ordered(df, key, ranges).select(*fields)
    return _save(rows, lambda ready: ready.write.mode("overwrite").json(path))


def _ordered(
    df: DataFrame, key: str | Sequence[str] | None, ranges: KeyRanges | None
) -> DataFrame:
    if key is None:
        return df
    return in_order(df, [key] if isinstance(key, str) else list(key), ranges)


def read_jsonl(
    spark: SparkSession,
    path: str,
    fields: Sequence[str] = ("prompt", "response"),
    keyed: bool = False,
) -> DataFrame:
    """The named fields as text. Blank lines are skipped, a malformed line fails the job.

    ``keyed`` adds SOURCE_ORDER.
    """
    schema = StructType([StructField(f, StringType()) for f in fields])
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return rows.select(*(_source_order() if keyed else []), *fields)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none if it does not exist."""
    if not path_exists(spark, path):
        return []
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = target.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(target)
    return sorted(s.getPath().getName() for s in listed if s.isDirectory())
