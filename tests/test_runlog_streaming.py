"""Run-log analytics in batch and as streams."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tokenmill.operators import chat, runlog, tokens
from tokenmill.operators.lines import corpus_lines
from tokenmill.session import new_path
from tokenmill.streaming import sinks

SCHEMA = "run string, step long, ts timestamp, event_id long, value double, metric string"
T0 = dt.datetime(2024, 1, 1)


def log_rows(n=600, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        run = "hot" if rng.random() < 0.6 else rng.choice("ab")
        rows.append((run, rng.randrange(40), T0 + dt.timedelta(minutes=7 * i), i, rng.randrange(3000) / 100,
                     rng.choice(["train/loss", "train/loss", "val/loss"])))
    return rows


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(log_rows(), SCHEMA).repartition(5)


def newest(rows):
    best = {}
    for run, step, ts, event, value, metric in rows:
        key = (run, step, metric)
        if key not in best or (ts, event) > best[key][:2]:
            best[key] = (ts, event, value)
    return {k: v[2] for k, v in best.items()}


def test_latest(log):
    found = runlog.latest(log).collect()
    assert {(r["run"], r["step"], r["metric"]): r["value"] for r in found} == newest(log_rows())


@pytest.mark.parametrize("every, offset", [(10, 0), (7, 1), (1000, 0)])
@pytest.mark.parametrize("limit", ["10MB", "-1"])
def test_interval_steps(spark, log, every, offset, limit):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        rows = runlog.interval_steps(log, every, offset).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    found = {(r["run"], r["step"]) for r in rows}
    last = {}
    for run, step, *_ in log_rows():
        last[run] = max(step, last.get(run, 0))
    assert found == {
        (run, step) for run, step, *_ in log_rows() if (step + offset) % every == 0 or step == last[run]
    }


def test_tokens_seen(log):
    found = {r["event_id"]: r["tokens_seen"] for r in runlog.tokens_seen(log, ["event_id"], F.col("step") + 1).collect()}
    sums, wanted = {}, {}
    for run, step, _, event, *_ in log_rows():
        sums[run] = sums.get(run, 0) + step + 1
        wanted[event] = sums[run]
    assert found == wanted


def test_mean_loss_and_perplexity(spark):
    rows = [("a", 1, T0, 1, 10.0, "train/loss"), ("a", 1, T0, 2, 20.0, "train/loss"), ("b", 1, T0, 3, 20.0, "train/loss"), ("c", 1, T0, 4, None, "train/loss")]
    found = {r["run"]: r for r in runlog.mean_loss(spark.createDataFrame(rows, SCHEMA), ["run"]).collect()}
    assert found["a"]["mean_loss"] == 15.0 and found["a"]["perplexity"] == pytest.approx(3269017.37, abs=0.01)
    assert found["b"]["perplexity"] == float("inf")
    assert found["c"]["batches"] == 0


def test_throughput_without_time(spark):
    rows = [("a", 1, T0, 1, 1.0, "train/loss"), ("b", 1, T0, 2, 1.0, "train/loss"), ("b", 2, T0 + dt.timedelta(seconds=4), 3, 1.0, "train/loss")]
    df = spark.createDataFrame(rows, SCHEMA)
    found = {r["run"]: r["tokens_per_sec"] for r in runlog.throughput(df, F.lit(10), runlog.elapsed_seconds()).collect()}
    assert found == {"a": pytest.approx(10 / 1e-9), "b": 5.0}


def test_generation_stats(spark):
    rows = [("a", 0, T0, 1, 0.5, "train/loss"), ("a", 1, T0, 2, 0.25, "train/loss"), ("a", 2, T0, 3, 0.25, "train/loss"), ("b", 0, T0, 4, 0.0, "train/loss")]
    found = {r["run"]: tuple(r)[1:] for r in runlog.generation_stats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found["a"] == (3, 1.0, 0.5, 3.0)
    assert found["b"] == (1, 0.0, 0.0, pytest.approx(1e9))


def test_sweep(spark):
    rows = [("base", 1, T0, 1, 2.0, "train/loss"), ("new", 1, T0, 2, 1.5, "train/loss"), ("base", 2, T0, 3, 1.0, "train/loss")]
    found = {r["step"]: r.asDict() for r in runlog.sweep(spark.createDataFrame(rows, SCHEMA), "base").collect()}
    assert found[1] == {"step": 1, "base": 2.0, "new": 1.5, "new_delta": -0.5}
    assert found[2]["new_delta"] is None


def test_a_wide_sweep_of_too_many_runs_points_to_rows(spark, monkeypatch):
    monkeypatch.setattr(runlog, "MOST_COLUMNS", 2)
    log = spark.createDataFrame([(r, 1, 1.0) for r in "abc"], "run string, step long, value double")
    with pytest.raises(ValueError, match="sweep_rows"):
        runlog.sweep(log, "a")
    assert runlog.sweep(log, "a", ["a", "b"]).columns == ["step", "a", "b", "b_delta"]
    assert runlog.sweep_rows(log, "a").count() == 3


def test_append(spark, log):
    path = new_path(spark, "test-metrics")
    full = log
    runlog.append_metrics(full.where("event_id < 100"), path)
    runlog.append_metrics(full.where("event_id >= 100"), path)
    assert spark.read.parquet(path).count() == 600


def arrive(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_stream_of_lines_resumes(spark):
    folder, out = new_path(spark, "in"), new_path(spark, "out")
    schema = "doc_id long, text string"
    first = [(i, f" line\n{i} ") for i in range(20)] + [(20, ""), (21, None)]
    second = [(i, f"later {i}") for i in range(30, 40)]
    read = lambda: sinks.read_new(spark, folder, spark.createDataFrame([], schema).schema)
    for rows in (first, second):
        arrive(spark, rows, schema, folder)
        sinks.export_lines(read(), out, f"{out}-state", "doc_id")
    batch = corpus_lines(spark.createDataFrame(first + second, schema), "doc_id")
    assert sorted(spark.read.parquet(out).collect()) == sorted(batch.collect())
    sinks.export_lines(read(), f"{out}-text", f"{out}-text-state", "doc_id", form="text")
    lines = [r["value"] for r in spark.read.text(f"{out}-text").collect()]
    assert sorted(lines) == sorted(r["line"] for r in batch.collect())


def test_token_cache_grows_and_survives_replay(spark):
    folder, root = new_path(spark, "in"), new_path(spark, "cache")
    schema = "doc_id long, text string"
    batches = [[(i, "ab" * (i + 1)) for i in range(5)], [(i, "b\na") for i in range(10, 14)], [(2, "a")]]
    tokenizer = tokens.CharTokenizer(("\n", " ", "a", "b"))
    empty = spark.createDataFrame([], schema).schema
    for rows in batches:
        arrive(spark, rows, schema, folder)
        sinks.extend_token_cache(sinks.read_new(spark, folder, empty), root, f"{root}-state", "doc_id", tokenizer)
    wanted, at = [], 0
    for rows in batches:
        for key, text in sorted(rows):
            ids = tokenizer.ids_of(text.replace("\n", " ") + "\n")
            wanted.append((at, key, ids))
            at += len(ids)
    found = sinks.read_token_cache(spark, root).collect()
    assert sorted((r["start"], r["doc_id"], r["ids"]) for r in found) == wanted
    # A batch that failed after writing is run again under its old number.
    lines = corpus_lines(spark.createDataFrame(batches[1], schema), "doc_id")
    sinks.write_token_batch(lines, 1, root, "doc_id", tokenizer)
    again = sinks.read_token_cache(spark, root).collect()
    assert sorted((r["start"], r["doc_id"], r["ids"]) for r in again) == wanted


def test_chat_stream_equals_batch(spark):
    folder, out = new_path(spark, "in"), new_path(spark, "out")
    schema = "conv_id long, messages array<struct<role string, content string>>"
    rows = [(i, [("user", f"q{i}"), ("assistant" if i % 3 else "user", f"a{i}")]) for i in range(12)]
    arrive(spark, rows[:6], schema, folder)
    arrive(spark, rows[6:], schema, folder)
    df = spark.createDataFrame(rows, schema)
    sinks.export_chat(sinks.read_new(spark, folder, df.schema), out, f"{out}-state", "conv_id")
    assert sorted(spark.read.parquet(out).collect()) == sorted(chat.chat_array_examples(df, "conv_id").collect())


def test_metrics_are_appended_by_metric(spark):
    folder, out = new_path(spark, "in"), new_path(spark, "metrics")
    schema = SCHEMA
    rows = [(*r[:5], ("train/loss", "val/loss")[r[3] % 2]) for r in log_rows(60)]
    empty = spark.createDataFrame([], schema).schema
    for part in (rows[:20], rows[20:]):
        arrive(spark, part, schema, folder)
        sinks.export_metrics(sinks.read_new(spark, folder, empty), out, f"{out}-state")
    found = spark.read.parquet(out)
    assert found.count() == 60 and found.where("metric = 'val/loss'").count() == 30


def test_latest_stream_equals_batch(spark):
    folder, root = new_path(spark, "in"), new_path(spark, "latest")
    rows = log_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    for part in (rows[:200], rows[200:]):
        arrive(spark, part, SCHEMA, folder)
        sinks.maintain_latest(sinks.read_new(spark, folder, df.schema), root, f"{root}-state")
    found = sinks.read_latest(spark, root).collect()
    assert {(r["run"], r["step"], r["metric"]): r["value"] for r in found} == newest(rows)


def test_two_metrics_of_a_step_are_both_kept(spark):
    rows = [("a", 1, T0, 1, 2.0, "train/loss"), ("a", 1, T0, 2, 3.0, "val/loss"),
            ("a", 1, T0, 3, 4.0, "train/loss")]
    found = runlog.latest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r["metric"], r["value"]) for r in found} == {("train/loss", 4.0), ("val/loss", 3.0)}


WAVES = [
    [("a", 1, T0, 1, 2.0, "m"), ("a", 2, T0 + dt.timedelta(hours=12), 2, 4.0, "m")],
    [("a", 3, T0 + dt.timedelta(days=3), 3, 6.0, "m")],
    [("a", 4, T0, 4, 100.0, "m"), ("a", 5, T0 + dt.timedelta(days=5), 5, None, "m")],
]


@pytest.mark.parametrize("every", [1, 2, 16])
def test_rates_keep_late_rows_and_open_periods(spark, monkeypatch, every):
    monkeypatch.setattr(sinks, "COMPACT_EVERY", every)
    folder, root = new_path(spark, "in"), new_path(spark, "rates")
    schema = spark.createDataFrame([], SCHEMA).schema
    for rows in WAVES:
        arrive(spark, rows, SCHEMA, folder)
        sinks.export_rates(
            sinks.read_new(spark, folder, schema), root, f"{root}-state", "1 day", F.lit(10)
        )
    every_row = spark.createDataFrame([r for w in WAVES for r in w], SCHEMA)
    wanted = runlog.period_rates(every_row, "1 day", 86400.0, F.lit(10)).collect()
    assert sorted(sinks.read_rates(spark, root, 86400.0).collect()) == sorted(wanted)
    # A batch that is run again leaves the result as it is.
    parts = runlog.period_parts(spark.createDataFrame(WAVES[2], SCHEMA), "1 day", F.lit(10))
    sinks.save_part(parts, 2, root, runlog.merged_parts)
    assert sorted(sinks.read_rates(spark, root, 86400.0).collect()) == sorted(wanted)


def test_closed_rates_leave_out_rows_behind_the_watermark(spark):
    folder, out = new_path(spark, "in"), new_path(spark, "rates")
    schema = spark.createDataFrame([], SCHEMA).schema
    for rows in WAVES:
        arrive(spark, rows, SCHEMA, folder)
        sinks.export_closed_rates(
            sinks.read_new(spark, folder, schema), out, f"{out}-state", "1 hour", "1 day", 86400.0, F.lit(10)
        )
    found = {r["period_start"]: (r["batches"], r["mean_value"]) for r in spark.read.parquet(out).collect()}
    assert found == {T0: (2, 3.0), T0 + dt.timedelta(days=3): (1, 6.0)}


def test_sweep_rows_of_many_runs(spark):
    rows = [(f"r{i}", s, T0, i, float(i + s), "m") for i in range(1200) for s in (1, 2)]
    found = runlog.sweep_rows(spark.createDataFrame(rows, SCHEMA), "r7").collect()
    assert len(found) == 2400 and all(r["delta"] == float(r["run"][1:]) - 7 for r in found)
