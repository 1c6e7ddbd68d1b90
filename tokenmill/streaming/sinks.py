"""Incremental exports: files that arrived since the last run are processed and appended."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tokenmill.operators.chat import chat_array_examples, prompt_response_rows
from tokenmill.operators.lines import corpus_lines
from tokenmill.operators.order import running_total
from tokenmill.operators.runlog import (
    latest,
    merged_parts,
    part_rates,
    period_parts,
    period_rates,
)
from tokenmill.operators.tokens import Tokenizer, encoded_segments
from tokenmill.session import materialize
from tokenmill.sources.files import child_names, path_exists

Merge = Callable[[DataFrame], DataFrame]


def read_new(spark: SparkSession, path: str, schema: StructType, form: str = "parquet") -> DataFrame:
    """A stream over the files of a folder (or of a glob)."""
    return spark.readStream.schema(schema).format(form).load(path)


def _run(writer, checkpoint: str) -> None:
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def append_files(
    stream: DataFrame,
    out: str,
    checkpoint: str,
    form: str = "parquet",
    partition_by: Sequence[str] = (),
) -> None:
    """Append what is available now; the sink's own log makes a repeated batch harmless."""
    writer = stream.writeStream.outputMode("append").format(form).option("path", out)
    _run(writer.partitionBy(*partition_by) if partition_by else writer, checkpoint)


def each_batch(
    stream: DataFrame, save: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> None:
    _run(stream.writeStream.outputMode(mode).foreachBatch(save), checkpoint)


def export_lines(
    stream: DataFrame,
    out: str,
    checkpoint: str,
    key: str,
    text_field: str = "text",
    form: str = "parquet",
) -> None:
    """Incremental corpus export: (key, line) rows, or the lines alone with form 'text'."""
    lines = corpus_lines(stream, key, text_field)
    append_files(lines.select("line") if form == "text" else lines, out, checkpoint, form)


def export_chat(
    stream: DataFrame,
    out: str,
    checkpoint: str,
    key: str,
    min_turns: int = 2,
    form: str = "parquet",
) -> None:
    """Incremental example export from message arrays; stateless. Form 'json' is JSON lines."""
    append_files(chat_array_examples(stream, key, min_turns=min_turns), out, checkpoint, form)


def export_prompt_response(
    stream: DataFrame, out: str, checkpoint: str, key: str, form: str = "parquet"
) -> None:
    """Incremental example export from prompt/response rows; stateless."""
    append_files(prompt_response_rows(stream, key), out, checkpoint, form)


def export_metrics(log: DataFrame, out: str, checkpoint: str) -> None:
    """Incremental append to a metric table, one folder per metric."""
    append_files(log, out, checkpoint, partition_by=["metric"])


def extend_token_cache(
    stream: DataFrame, root: str, checkpoint: str, key: str, tokenizer: Tokenizer
) -> None:
    """Incremental token cache: rows (key, seg, ids, n, start); positions go on between batches."""

    def save(batch: DataFrame, batch_id: int) -> None:
        write_token_batch(batch, batch_id, root, key, tokenizer)

    each_batch(corpus_lines(stream, key), save, checkpoint)


def write_token_batch(
    lines: DataFrame, batch_id: int, root: str, key: str, tokenizer: Tokenizer
) -> None:
    """One batch of the cache: a folder of rows and a manifest row.

    Its base is the sum over the manifests of earlier batches, so a batch that is run again
    writes the same rows to the same place.
    """
    base = _tokens_before(lines.sparkSession, root, batch_id)
    written = materialize(encoded_segments(lines, key, tokenizer), "stream-tokens")
    placed = running_total(written, [key, "seg"], F.col("n"))
    placed.withColumn("start", F.col("start") + base).write.mode("overwrite").parquet(
        f"{root}/tokens/batch_id={batch_id}"
    )
    counts = written.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("tokens"))
    counts.write.mode("overwrite").parquet(f"{root}/manifest/batch_id={batch_id}")


def _tokens_before(spark: SparkSession, root: str, batch_id: int) -> int:
    if not path_exists(spark, f"{root}/manifest"):
        return 0
    earlier = spark.read.parquet(f"{root}/manifest").where(F.col("batch_id") < batch_id)
    return earlier.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]


def read_token_cache(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/tokens").drop("batch_id")


COMPACT_EVERY = 16  # batches between two merged copies of a state table


def save_part(rows: DataFrame, batch_id: int, root: str, merge: Merge) -> None:
    """One batch's rows of a state table; every COMPACT_EVERY batches all rows so far are merged.

    A batch that is run again writes the same rows to the same place.
    """
    rows.write.mode("overwrite").parquet(f"{root}/parts/batch_id={batch_id}")
    if (batch_id + 1) % COMPACT_EVERY == 0:
        merged = merge(_parts(rows.sparkSession, root, batch_id))
        merged.write.mode("overwrite").parquet(f"{root}/merged/{batch_id}")


def _parts(spark: SparkSession, root: str, last: int | None = None) -> DataFrame:
    """The newest finished merged copy before ``last``, and the parts written after it."""
    names = child_names(spark, f"{root}/merged")
    finished = [
        int(n) for n in names
        if (last is None or int(n) < last) and path_exists(spark, f"{root}/merged/{n}/_SUCCESS")
    ]
    newest = max(finished, default=-1)
    later = spark.read.parquet(f"{root}/parts").where(F.col("batch_id") > newest).drop("batch_id")
    if newest < 0:
        return later
    return later.unionByName(spark.read.parquet(f"{root}/merged/{newest}"))


def maintain_latest(log: DataFrame, root: str, checkpoint: str) -> None:
    """Last value per (run, step, metric) of a growing log.

    A batch writes the keys it has, so the stream keeps no state of its own.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        save_part(latest(batch), batch_id, root, latest)

    each_batch(log, save, checkpoint)


def read_latest(spark: SparkSession, root: str) -> DataFrame:
    return latest(_parts(spark, root))


def export_rates(
    log: DataFrame, root: str, checkpoint: str, period: str, tokens: Column
) -> None:
    """Sums per run and period of what has arrived, however late; ``read_rates`` adds them up."""

    def save(batch: DataFrame, batch_id: int) -> None:
        save_part(period_parts(batch, period, tokens), batch_id, root, merged_parts)

    each_batch(log, save, checkpoint)


def read_rates(spark: SparkSession, root: str, seconds: float) -> DataFrame:
    """Rates of all periods so far, the open ones too."""
    return part_rates(_parts(spark, root), seconds)


def export_closed_rates(
    log: DataFrame, out: str, checkpoint: str, delay: str, period: str, seconds: float, tokens
) -> None:
    """Rates of the periods that are over, each written once and for all.

    That is the feature of a watermark: a period is written once ``delay`` has passed, later rows
    are left out and the last open period is not written. ``export_rates`` leaves nothing out.
    """
    rates = period_rates(log.withWatermark("ts", delay), period, seconds, tokens)
    append_files(rates, out, checkpoint)
