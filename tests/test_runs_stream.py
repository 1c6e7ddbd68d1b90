"""Running sums on a stream: equal to batch after every arrival."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tokenmill.operators import runlog
from tokenmill.session import new_path
from tokenmill.streaming import runs, sinks

SCHEMA = "run string, step long, ts timestamp, event_id long, value double, n long"
T0 = dt.datetime(2024, 1, 1)


def waves(seed=1, steps=90):
    """Rows out of order, steps again in later waves, old steps last, a step of its own run."""
    pick = random.Random(seed)
    rows = []
    for i in range(160):
        run = pick.choice(["hot", "hot", "hot", "b", None])
        rows.append((run, pick.randrange(-5, steps), T0 + dt.timedelta(minutes=pick.randrange(10_000)), i,
                     pick.choice([None, 1.5, float("nan"), 2.0]), pick.choice([1, 5, 100, None])))
    rows += [("b", 70, None, None, 3.0, 7), rows[3], rows[3]]
    pick.shuffle(rows)
    return [rows[:60], rows[60:61], rows[61:130], rows[130:] + rows[:5]]


def batch_view(spark, rows):
    log = spark.createDataFrame(rows, SCHEMA).withColumn("metric", F.lit("m"))
    packed = F.max(F.struct("ts", "event_id", "value", F.coalesce("n", F.lit(0)).alias("n"))).alias("m")
    last = log.groupBy("run", "step").agg(packed).select("run", "step", "m.*")
    out, seen = {}, {}
    for r in sorted(last.collect(), key=lambda r: (str(r["run"]), r["step"])):
        seen[r["run"]] = seen.get(r["run"], 0) + r["n"]
        out[r["run"], r["step"]] = (r["ts"], r["event_id"], str(r["value"]), seen[r["run"]])
    return out


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """A state store per partition takes its time."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("expiry, steps", [(10**9, 10), (1, 10), (10**9, 1000)])
def test_equal_to_batch_after_every_arrival(spark, monkeypatch, expiry, steps):
    monkeypatch.setattr(runs, "STEPS", steps)
    monkeypatch.setattr(sinks, "COMPACT_EVERY", 2)
    folder, root = new_path(spark, "in"), new_path(spark, "runs")
    schema = spark.createDataFrame([], SCHEMA).schema
    so_far = []
    for wave in waves(steps=90 if steps == 10 else 30):
        so_far += wave
        spark.createDataFrame(wave, SCHEMA).repartition(3).write.mode("append").parquet(folder)
        stream = sinks.read_new(spark, folder, schema)
        runs.maintain_runs(stream, root, f"{root}-state", F.col("n"), expiry)
        found = runs.read_runs(spark, root).collect()
        got = {(r["run"], r["step"]): (r["ts"], r["event_id"], str(r["value"]), r["tokens_seen"]) for r in found}
        assert len(got) == len(found) and got == batch_view(spark, so_far)
    every = {(r["run"], r["step"]) for r in runs.read_interval(spark, root, 7).collect()}
    last = {run: max(s for r, s in got if r == run) for run, _ in got}
    assert every == {(r, s) for r, s in got if s % 7 == 0 or s == last[r]}


def test_only_what_changed_is_emitted():
    import pandas as pd

    def frame(rows):
        new = runs._newest(pd.DataFrame(rows, columns=runs.HELD))
        new["before"] = new["tokens"].cumsum() - new["tokens"]
        return new

    old = [(s, 10, s, True, 1.0, 2) for s in range(6)]
    assert len(runs._changed(None, frame(old))) == 6
    assert runs._changed(frame(old), frame(old + old[:2])).empty
    again = frame([*old, (3, 11, 99, True, 4.0, 2)])  # the same tokens: one word
    assert list(runs._changed(frame(old), again)["step"]) == [3]
    more = frame([*old, (3, 11, 99, True, 4.0, 5)])  # other tokens: the rest of the bucket
    assert list(runs._changed(frame(old), more)["step"]) == [3, 4, 5]
    assert runs._unpack(runs._pack(more)).equals(more)


def test_a_row_without_a_step_fails(spark):
    folder, root = new_path(spark, "in"), new_path(spark, "runs")
    spark.createDataFrame([("a", None, T0, 1, 1.0, 1)], SCHEMA).write.parquet(folder)
    stream = sinks.read_new(spark, folder, spark.createDataFrame([], SCHEMA).schema)
    with pytest.raises(Exception, match="no step"):
        runs.maintain_runs(stream, root, f"{root}-state", F.col("n"))
    assert spark.conf.get(runs.STORE, "").find("RocksDB") < 0


def test_runlog_gives_the_same_sums(spark):
    rows = [("a", s, T0, s, 1.0, 3) for s in range(50)]
    log = spark.createDataFrame(rows, SCHEMA)
    wanted = {r["step"]: r["tokens_seen"] for r in runlog.tokens_seen(log, ["step"], F.col("n")).collect()}
    folder, root = new_path(spark, "in"), new_path(spark, "runs")
    log.write.parquet(folder)
    runs.maintain_runs(sinks.read_new(spark, folder, log.schema), root, f"{root}-state", F.col("n"))
    assert {r["step"]: r["tokens_seen"] for r in runs.read_runs(spark, root).collect()} == wanted
