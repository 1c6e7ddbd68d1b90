"""One key holds a third of all rows or more: results stay whole and no task gets the group."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.functions import spark_partition_id

from tokenmill.operators import chat, order, runlog
from tokenmill.operators.order import BUCKET, key_buckets
from tokenmill.plans import sft


def hot_turns(spark, n=30_000):
    hot = spark.range(n).select(
        F.lit(1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("m"), F.col("id")).alias("text"),
    )
    cold = spark.range(n).select(
        (F.col("id") / 4 + 10).cast("long").alias("conv_id"),
        (F.col("id") % 4).alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("c"), F.col("id")).alias("text"),
    )
    return hot.unionByName(cold)


def test_hot_conversation_is_whole(spark):
    turns = chat.clean_turns(hot_turns(spark))
    row = chat.chat_examples(turns).where("conv_id = 1").first()
    spoken = [("Human: ", "Assistant: ")[i % 2] + f"m{i}" for i in range(29_999)]
    assert row["prompt"] == "\n\n".join(spoken) + "\n\nAssistant:"
    assert row["response"] == "m29999"


@pytest.mark.parametrize("max_len", [256, 4096])
def test_hot_conversation_is_cut_in_its_turns(spark, max_len):
    turns = hot_turns(spark)
    vocabulary = sft.chat_vocabulary(turns)
    row = sft.chat_rows(turns, vocabulary, max_len).where("conv_id = 1").first()
    spoken = "\n\n".join(("Human: ", "Assistant: ")[i % 2] + f"m{i}" for i in range(29_999))
    ids = vocabulary.ids_of((spoken + "\n\nAssistant:m29999")[-max_len:]) + [vocabulary.eos_id]
    assert row["input_ids"] == ids[-max_len:]


def test_hot_conversation_pairs_are_spread(spark):
    pairs = chat.adjacent_turns(hot_turns(spark))
    hot = pairs.where("conv_id = 1")
    assert hot.count() == 15_000
    # Adaptive execution would put these few rows into one task; at scale it does not.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        largest = hot.groupBy(spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert largest < 15_000 / 3


def test_hot_run_is_summed_in_buckets(spark):
    log = spark.range(60_000).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise("cold").alias("run"),
        F.col("id").alias("event_id"),
    )
    seen = runlog.tokens_seen(log, ["event_id"], F.lit(2))
    top = {r["run"]: r["t"] for r in seen.groupBy("run").agg(F.max("tokens_seen").alias("t")).collect()}
    assert top == {"hot": 80_000, "cold": 40_000}
    groups = key_buckets(log, "event_id").groupBy("run", BUCKET).count().agg(F.max("count")).first()[0]
    assert groups < 40_000 / 8


def test_dense_block_of_sparse_keys_is_split(spark):
    dense = spark.range(20_000).select(F.col("id").alias("k"))
    far = spark.range(40_000).select((F.col("id") * 10**12 + 10**15).alias("k"))
    keyed = key_buckets(dense.unionByName(far), "k", rows_per_bucket=2_000)
    largest = keyed.groupBy(BUCKET).count().agg(F.max("count")).first()[0]
    assert largest < 6_000
    found = order.running_total(keyed, ["k"], F.lit(1)).agg(F.max("start"), F.countDistinct("start")).first()
    assert tuple(found) == (59_999, 60_000)
