"""Written results with a manifest, reused as long as their parameters are the same."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tokenmill.sources.files import path_exists


def fingerprint(parameters: dict) -> str:
    """Digest of all parameters; any change of one leads to another cache."""
    text = json.dumps(parameters, sort_keys=True, ensure_ascii=False)
    return hashlib.md5(text.encode("utf-8")).hexdigest()


# Parts of a plan that its description does not pin down: code, rows in memory, other sources.
_OPAQUE = re.compile(
    r"Python|Scala(UDF|UDAF|Aggregator)|LogicalRDD|LocalRelation|MapIn|MapPartitions|"
    r"MapElements|FlatMap|CoGroup|TypedFilter|ScriptTransformation|DataSourceV2|StreamingRelation|"
    r"Subquery$|ListQuery|^Exists$|HiveTable|^Rand|^Uuid$|^Shuffle$"
)
_EXPRESSION_ID = re.compile(r'"id":(\d+),"jvmId":"[^"]*"')


def data_identity(df: DataFrame) -> str:
    """Digest of what a table holds: its files with their lengths and times, and its plan.

    The plan counts with all its expressions and with the format and options of what it reads. A
    table that is not made of files and built-in functions alone is identified by the sum of its
    rows' hashes, which reads it once.
    """
    plan = df._jdf.queryExecution().analyzed()
    described = plan.toJSON()
    classes = {c.rsplit(".", 1)[-1] for c in re.findall(r'"class":"([^"]+)"', described)}
    files = df.inputFiles()
    if not files or any(map(_OPAQUE.search, classes)):
        return _row_identity(df)
    leaves = plan.collectLeaves()
    read = [_read_as(leaves.apply(i)) for i in range(leaves.size())]
    if None in read:
        return _row_identity(df)
    numbers: dict[str, int] = {}  # expressions by their first mention, alike in every session

    def number(found: re.Match) -> str:
        return f'"id":{numbers.setdefault(found[1], len(numbers))}'

    described = _EXPRESSION_ID.sub(number, described)
    return fingerprint({"plan": described, "read": read, "files": _file_identity(df, files)})


def _read_as(leaf) -> str | None:
    """Format and options of a relation; None if it is not made of files."""
    relation = leaf.relation() if leaf.getClass().getSimpleName() == "LogicalRelation" else None
    if relation is None or relation.getClass().getSimpleName() != "HadoopFsRelation":
        return None
    pairs, options = relation.options().iterator(), []
    while pairs.hasNext():
        options.append(pairs.next().toString())
    return f"{relation.fileFormat().getClass().getName()} {sorted(options)}"


def _file_identity(df: DataFrame, files: list[str]) -> list[str]:
    """Sums over the files' names, lengths and times; Spark lists them, in parallel if they are many."""
    literal = [re.sub(r"([\\{}\[\]*?])", r"\\\1", unquote(name)) for name in files]
    listed = df.sparkSession.read.format("binaryFile").load(literal)
    return _sums(listed.select("path", "length", "modificationTime").distinct())


def _row_identity(df: DataFrame) -> str:
    return fingerprint({"columns": df.columns, "rows": _sums(df)})


def _sums(rows: DataFrame) -> list[str]:
    hashed = F.xxhash64(*rows.columns).cast("decimal(20,0)")
    other = F.bit_xor(F.xxhash64(*rows.columns, F.lit(1)))
    return [str(x) for x in rows.agg(F.count(F.lit(1)), F.sum(hashed), other).first()]


def manifest(spark: SparkSession, entries: dict) -> DataFrame:
    """One row with a column per entry; lists stay lists, an unset entry is a null string."""
    known = [
        (F.lit(None).cast("string") if v is None else F.lit(v)).alias(k) for k, v in entries.items()
    ]
    return spark.range(1).select(*known)


def write_manifest(spark: SparkSession, entries: dict, path: str) -> None:
    rows = manifest(spark, entries).coalesce(1)
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """The manifest's entries, or None if it was never finished."""
    if not path_exists(spark, f"{path}/_SUCCESS"):
        return None
    return spark.read.json(path).first().asDict()


def reuse_or_build(
    spark: SparkSession,
    root: str,
    name: str,
    parameters: dict,
    build: Callable[[], DataFrame],
    tokens: Column,
    rebuild: bool = False,
) -> tuple[DataFrame, dict]:
    """The cached table and its manifest; built if absent or if ``rebuild``.

    Every build writes a folder of its own and the manifest, written last, names it. A build that
    dies half-way is therefore never taken for a finished one.
    """
    digest = fingerprint(parameters)
    path = f"{root}/{name}-{digest}"
    known = None if rebuild else read_manifest(spark, f"{path}/manifest")
    if known is None:
        data = f"{path}/data-{uuid.uuid4().hex}"
        seen = Observation()
        build().observe(
            seen,
            F.count(F.lit(1)).alias("rows"),
            F.coalesce(F.sum(tokens), F.lit(0)).cast("long").alias("tokens"),
        ).write.parquet(data)
        counts = seen.get
        known = {
            **parameters,
            "fingerprint": digest,
            "data": data,
            "num_rows": int(counts["rows"]),
            "num_tokens": int(counts["tokens"]),
        }
        write_manifest(spark, known, f"{path}/manifest")
    return spark.read.parquet(known["data"]), known


def stored_histogram(rows: DataFrame, known: dict, histogram: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The histogram of a cache, from beside it; the cache is read only if there is none yet.

    It belongs to one build: another build has another folder, and so another histogram.
    """
    spark, path = rows.sparkSession, f"{known['data']}-lengths"
    if not path_exists(spark, f"{path}/_SUCCESS"):
        histogram(rows).coalesce(1).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> DataFrame:
    """``df`` written in ``buckets`` files by a hash of ``key``, sorted by it, and read with that known.

    A join on the key then leaves the table where it is and moves the other side alone.
    """
    spark = df.sparkSession
    dealt = df.repartition(buckets, key)
    writer = dealt.write.bucketBy(buckets, key).sortBy(key).option("path", path)
    writer.format("parquet").saveAsTable(_table_name(path))
    return spark.table(_table_name(path))


def read_bucketed(spark: SparkSession, path: str, key: str, buckets: int) -> DataFrame:
    """A table that ``write_bucketed`` has written, in another session say."""
    name = _table_name(path)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        place = path.replace("'", "\\'")
        spark.sql(
            f"create table {name} ({columns}) using parquet clustered by (`{key}`) sorted by (`{key}`)"
            f" into {buckets} buckets location '{place}'"
        )
    return spark.table(name)


def _table_name(path: str) -> str:
    return f"bucketed_{fingerprint({'path': path})}"
