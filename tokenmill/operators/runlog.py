"""Analytics of a training run's metric log.

A log row is (run, step, ts, event_id, value), the value of one metric. A run can hold any share of
the rows, so nothing here sorts a run in one task: sums are partial, running sums go by buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.operators.ngrams import perplexity
from tokenmill.operators.order import running_total
from tokenmill.session import materialize

MOST_COLUMNS = 1_000  # runs of a wide table


def metric_rows(
    df: DataFrame, run: str, step: str, ts: str, event_id: str, value: str, metric: Column | str
) -> DataFrame:
    """A table of events as log rows (run, step, ts, event_id, metric, value)."""
    return df.select(
        F.col(run).alias("run"),
        F.col(step).alias("step"),
        F.col(ts).alias("ts"),
        F.col(event_id).alias("event_id"),
        (F.lit(metric) if isinstance(metric, str) else metric).alias("metric"),
        F.col(value).alias("value"),
    )


def append_metrics(log: DataFrame, path: str) -> None:
    """Append log rows to a metric table, one folder per metric."""
    log.write.mode("append").partitionBy("metric").parquet(path)


def interval_steps(log: DataFrame, every: int, offset: int = 0) -> DataFrame:
    """Rows of steps with (step + offset) % every = 0 and of each run's last step.

    Offset 0 picks the reported steps, offset 1 the saved ones. The last steps, one row per run,
    are written out, so Spark broadcasts them if their size allows and joins by shuffle (split by
    adaptive execution where a run is hot) if not.
    """
    steps = log.groupBy(F.col("run").alias("_run")).agg(F.max("step").alias("_last"))
    last = materialize(steps, "last-steps")
    due = (F.col("step") + offset) % every == 0
    joined = log.join(last, F.col("run").eqNullSafe(F.col("_run")))
    return joined.where(due | (F.col("step") == F.col("_last"))).drop("_run", "_last")


def latest(log: DataFrame) -> DataFrame:
    """(run, step, metric, value, ts, event_id): the row written last for each metric of a step.

    A resumed run writes some steps again. An aggregate keeps one row per task and key, so a step
    written very often is no hot spot.
    """
    newest = F.max(F.struct("ts", "event_id", "value")).alias("m")
    return log.groupBy("run", "step", "metric").agg(newest).select(
        "run", "step", "metric", "m.value", "m.ts", "m.event_id"
    )


def tokens_seen(log: DataFrame, order: Sequence[str], tokens: Column) -> DataFrame:
    """Add ``tokens_seen``: tokens of this and all earlier rows of the run.

    A step's tokens must count once: pass the training metric's rows of ``latest``.
    """
    before = running_total(log, order, tokens, by=["run"], out="_before")
    return before.withColumn("tokens_seen", (F.col("_before") + tokens).cast("long")).drop(
        "_before"
    )


def mean_loss(log: DataFrame, keys: Sequence[str], digits: int | None = None) -> DataFrame:
    """(keys, batches, mean_loss, perplexity) over batch losses.

    ``digits`` rounds the mean, which otherwise depends on the order of summation.
    """
    mean = F.avg("value")
    grouped = log.groupBy(*keys).agg(
        F.count("value").alias("batches"),
        (F.round(mean, digits) if digits is not None else mean).alias("mean_loss"),
    )
    return grouped.withColumn("perplexity", perplexity(F.col("mean_loss")))


def split_losses(log: DataFrame, split: str, keys: Sequence[str]) -> DataFrame:
    """(keys, train, val): mean loss of the two splits side by side."""
    return log.groupBy(*keys).pivot(split, ["train", "val"]).agg(F.avg("value"))


def period_rates(
    log: DataFrame, period: str, seconds: float, tokens: Column, ts: str = "ts"
) -> DataFrame:
    """(run, period_start, batches, mean_value, tokens_per_sec) per tumbling period."""
    return (
        log.groupBy("run", F.window(ts, period).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("batches"),
            F.avg("value").alias("mean_value"),
            (F.sum(tokens) / F.lit(seconds)).alias("tokens_per_sec"),
        )
        .select("run", F.col("w.start").alias("period_start"), "batches", "mean_value",
                "tokens_per_sec")
    )


def period_parts(log: DataFrame, period: str, tokens: Column, ts: str = "ts") -> DataFrame:
    """(run, period_start, batches, values, value_sum, tokens): sums that add up over parts."""
    return (
        log.groupBy("run", F.window(ts, period).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("batches"),
            F.count("value").alias("values"),
            F.sum("value").alias("value_sum"),
            F.sum(tokens).cast("long").alias("tokens"),
        )
        .select("run", F.col("w.start").alias("period_start"), "batches", "values", "value_sum", "tokens")
    )


def merged_parts(parts: DataFrame) -> DataFrame:
    """One row per run and period from any number of parts."""
    sums = ("batches", "values", "value_sum", "tokens")
    return parts.groupBy("run", "period_start").agg(*[F.sum(c).alias(c) for c in sums])


def part_rates(parts: DataFrame, seconds: float) -> DataFrame:
    """(run, period_start, batches, mean_value, tokens_per_sec) from parts, as ``period_rates``."""
    return merged_parts(parts).select(
        "run",
        "period_start",
        "batches",
        (F.col("value_sum") / F.col("values")).alias("mean_value"),
        (F.col("tokens") / F.lit(seconds)).alias("tokens_per_sec"),
    )


def throughput(log: DataFrame, tokens: Column, seconds: Column) -> DataFrame:
    """(run, tokens, seconds, tokens_per_sec); no time at all counts as a nanosecond."""
    sums = log.groupBy("run").agg(
        F.sum(tokens).cast("long").alias("tokens"), seconds.alias("seconds")
    )
    rate = F.col("tokens") / F.greatest("seconds", F.lit(1e-9))
    return sums.withColumn("tokens_per_sec", rate)


def generation_stats(log: DataFrame) -> DataFrame:
    """(run, tokens, seconds, first_latency, tokens_per_sec) of one generated token per step.

    ``value`` holds the seconds that the token of a step took.
    """
    sums = log.groupBy("run").agg(
        F.count("value").alias("tokens"),
        F.sum("value").alias("seconds"),
        F.min_by("value", F.struct("step", "event_id")).alias("first_latency"),
    )
    rate = F.col("tokens") / F.greatest("seconds", F.lit(1e-9))
    return sums.withColumn("tokens_per_sec", rate)


def elapsed_seconds(ts: str = "ts") -> Column:
    """Aggregate: seconds from the first to the last row, to the microsecond."""
    micros = F.unix_micros(F.max(F.col(ts).cast("timestamp"))) - F.unix_micros(
        F.min(F.col(ts).cast("timestamp"))
    )
    return micros / F.lit(1e6)


def sweep_rows(log: DataFrame, baseline: str) -> DataFrame:
    """(step, run, value, delta to the baseline's mean of the step), for any number of runs."""
    means = log.groupBy("step", "run").agg(F.avg("value").alias("value"))
    base = means.where(F.col("run") == baseline).select("step", F.col("value").alias("_base"))
    joined = means.join(materialize(base, "baseline"), "step", "left")
    return joined.withColumn("delta", F.col("value") - F.col("_base")).drop("_base")


def sweep(log: DataFrame, baseline: str, runs: Sequence[str] | None = None) -> DataFrame:
    """(step, one column per run, <run>_delta to the baseline): mean value of each step.

    A wide table has a column per run, whose names the plan must hold. Without ``runs`` they are
    looked up, and more than MOST_COLUMNS of them are an error: ``sweep_rows`` takes any number.
    """
    if runs is None:
        names = log.select("run").distinct().orderBy("run").limit(MOST_COLUMNS + 1)
        runs = [r["run"] for r in names.collect()]
        if len(runs) > MOST_COLUMNS:
            raise ValueError(f"more than {MOST_COLUMNS} runs: name some, or use sweep_rows")
    wide = log.groupBy("step").pivot("run", list(runs)).agg(F.avg("value"))
    deltas = [
        (F.col(f"`{r}`") - F.col(f"`{baseline}`")).alias(f"{r}_delta")
        for r in runs
        if r != baseline
    ]
    return wide.select("*", *deltas)
