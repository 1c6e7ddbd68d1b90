"""Running sums of training runs on a stream, corrected when steps come late or again.

A run is cut into buckets of STEPS steps, and a bucket is a key of the stream, so one long run is many
keys. The state of a bucket holds its steps: the row written last for each, its tokens, and the
running sum in front of it. New rows, in whatever order, change some of them; every step whose row or
sum is now another one is emitted again, and by batch number the newest word on a step counts. A late
step corrects the rest of its bucket only: sums over earlier buckets are added on reading, from one row
per bucket.

State lives until nothing has come for a bucket for ``expiry`` milliseconds, so it is bounded by the
buckets of that time and STEPS rows each. A row for a bucket that has expired is not lost: it begins
a new state, which emits under a mark of its own, and the reader sums the few buckets with two marks
from their steps instead.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from tokenmill.operators.order import running_total
from tokenmill.operators.runlog import interval_steps
from tokenmill.session import materialize
from tokenmill.streaming.sinks import _parts, save_part

STEPS = 1_000
EXPIRY_MS = 7 * 24 * 3600 * 1000
STORE = "spark.sql.streaming.stateStore.providerClass"
KEYED_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NONE = -(1 << 63)  # stands for a missing time or event

HELD = ["step", "ts", "event_id", "known", "value", "tokens"]
OUT = (
    "run string, bucket long, step long, ts long, event_id long, known boolean, value double, "
    "tokens long, before long, since long"
)


class BucketSums(StatefulProcessor):
    """Steps of one bucket of a run with their running sums."""

    def __init__(self, expiry_ms: int):
        self.expiry_ms = expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bucket", "since long, steps binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        held = self.state.get()
        since, old = (now, None) if held is None else (held[0], _unpack(held[1]))
        new = old.drop(columns="before") if old is not None else None
        for part in rows:
            new = _newest(part[HELD] if new is None else pd.concat([new, part[HELD]]))
        new["before"] = (new["tokens"].cumsum() - new["tokens"]).astype("int64")
        self.state.update((since, _pack(new)))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        self.handle.registerTimer(now + self.expiry_ms)
        yield _changed(old, new).assign(run=key[0], bucket=key[1], since=since)[_names()]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def _names() -> list[str]:
    return [f.split()[0] for f in OUT.split(", ")]


def _newest(rows: pd.DataFrame) -> pd.DataFrame:
    """One row per step, the one written last, in the order of steps."""
    ordered = rows.sort_values(["step", "ts", "event_id", "known", "value"], kind="stable")
    return ordered.drop_duplicates("step", keep="last").reset_index(drop=True)


def _changed(old: pd.DataFrame | None, new: pd.DataFrame) -> pd.DataFrame:
    """Rows of ``new`` that ``old`` does not have as they are."""
    if old is None:
        return new
    at = np.searchsorted(old["step"].to_numpy(), new["step"].to_numpy())
    at = np.minimum(at, len(old) - 1)
    same = np.ones(len(new), bool)
    for name in new.columns:
        left, right = old[name].to_numpy()[at], new[name].to_numpy()
        same &= (left == right) | ((left != left) & (right != right))
    return new[~same]


def _pack(rows: pd.DataFrame) -> bytes:
    sink = io.BytesIO()
    table = pa.Table.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue()


def _unpack(packed: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(packed)).read_pandas()


def bucket_changes(log: DataFrame, tokens: Column, expiry_ms: int = EXPIRY_MS) -> DataFrame:
    """Stream of the steps whose last row, or the sum in front of it, has changed.

    ``log`` has (run, step, ts, event_id, value) rows of one metric. A row without a step fails the job.
    """
    step = F.coalesce(F.col("step").cast("long"), F.raise_error(F.lit("a row has no step")).cast("long"))
    rows = log.select(
        F.col("run").cast("string").alias("run"),
        F.floor(step / STEPS).cast("long").alias("bucket"),
        step.alias("step"),
        F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(NONE)).alias("ts"),
        F.coalesce(F.col("event_id").cast("long"), F.lit(NONE)).alias("event_id"),
        F.col("value").isNotNull().alias("known"),
        F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"),
        F.coalesce(tokens.cast("long"), F.lit(0).cast("long")).alias("tokens"),
    )
    return rows.groupBy("run", "bucket").transformWithStateInPandas(
        BucketSums(expiry_ms), OUT, "Update", "ProcessingTime"
    )


def maintain_runs(
    log: DataFrame, root: str, checkpoint: str, tokens: Column, expiry_ms: int = EXPIRY_MS
) -> None:
    """Take what has arrived, as one batch, into the running sums below ``root``; see ``read_runs``."""
    spark = log.sparkSession
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, KEYED_STORE)

    def save(batch: DataFrame, batch_id: int) -> None:
        rows = materialize(batch.withColumn("batch", F.lit(batch_id).cast("long")), "run-changes")
        save_part(rows, batch_id, root, newest_words)

    # A trigger for all that is available would go on for ever: time alone may change this state.
    changes = bucket_changes(log, tokens, expiry_ms).writeStream.outputMode("update")
    try:
        changes.option("checkpointLocation", checkpoint).trigger(once=True).foreachBatch(
            save
        ).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)


def newest_words(rows: DataFrame) -> DataFrame:
    """The last word on each step: by the row written last, then by batch; one mark of each bucket more.

    ``marks`` is the number of states that a bucket's rows come from, as far as it matters: 1 or 2.
    """
    last = ("ts", "event_id", "known", "value", "batch", "tokens", "before", "since")
    words = rows.groupBy("run", "bucket", "step").agg(
        F.max(F.struct(*last)).alias("w"), F.min("since").alias("_first"), F.max("since").alias("_last")
    )
    # Keeps the older mark of a step as well, so that a merged copy still shows both.
    kept = words.select(
        "run", "bucket", "step", F.explode(F.array_distinct(F.array("_first", "_last"))).alias("_since"), "w"
    )
    fields = [F.col(f"w.{c}").alias(c) for c in last if c != "since"]
    return kept.select("run", "bucket", "step", *fields, F.col("_since").alias("since")).select(rows.columns)


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """(run, step, ts, event_id, value, tokens, tokens_seen): the last row of each step, summed."""
    last = ("ts", "event_id", "known", "value", "batch", "tokens", "before")
    found = materialize(
        _parts(spark, root).groupBy("run", "bucket", "step").agg(
            F.max(F.struct(*last)).alias("w"), F.min("since").alias("_first"), F.max("since").alias("_last")
        ).select("run", "bucket", "step", "w.*", "_first", "_last"),
        "run-steps",
    )
    group = F.struct("run", "bucket").alias("_bucket_of")
    marks = found.groupBy(group).agg(F.min("_first").alias("_a"), F.max("_last").alias("_b"))
    twice = materialize(marks.where("_a < _b").select("_bucket_of"), "reopened")
    keyed = found.select("*", group)
    within = Window.partitionBy("_bucket_of").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    summed = keyed.join(twice, "_bucket_of", "left_semi").withColumn(
        "before", F.coalesce(F.sum("tokens").over(within), F.lit(0)).cast("long")
    )
    rows = keyed.join(twice, "_bucket_of", "left_anti").unionByName(summed)
    ends = rows.groupBy("run", "bucket").agg(
        F.max_by(F.col("before") + F.col("tokens"), "step").alias("_sum")
    )
    bases = running_total(materialize(ends, "bucket-sums"), ["bucket"], F.col("_sum"), by=["run"], out="earlier")
    bases = bases.select(group, "earlier")
    return rows.join(bases, "_bucket_of").select(
        "run", "step",
        F.when(F.col("ts") != NONE, F.timestamp_micros("ts")).alias("ts"),
        F.when(F.col("event_id") != NONE, F.col("event_id")).alias("event_id"),
        # Frames of the state tell no missing number from one that is none.
        F.when(F.col("known"), F.coalesce("value", F.lit(float("nan")))).alias("value"),
        "tokens",
        (F.col("earlier") + F.col("before") + F.col("tokens")).alias("tokens_seen"),
    )


def read_interval(spark: SparkSession, root: str, every: int, offset: int = 0) -> DataFrame:
    """Rows of ``read_runs`` at every so many steps, and of each run's last step so far."""
    return interval_steps(read_runs(spark, root), every, offset)
