"""Whole exports against plain statements of what they must write."""

import hashlib
import json

import pytest

from tokenmill.operators.chat import chat_array_examples, parsed_messages
from tokenmill.plans import export
from tokenmill.session import new_path
from tokenmill.sources import cache, files


def texts(spark, n, word):
    rows = [(i, f" {word}\n{i} " if i % 5 else "") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


@pytest.mark.parametrize("cap", [None, 7, 0])
def test_corpus_export(spark, cap):
    out = new_path(spark, "export") + ".txt"
    tables = {"train": texts(spark, 50, "a"), "validation": texts(spark, 10, "b"), "test": texts(spark, 3, "c")}
    summary = export.export_corpus(spark, tables, "both", out, "doc_id", max_rows=cap)
    for split, n, word, path in (("train", 50, "a", out[:-4] + "_train.txt"), ("validation", 10, "b", out[:-4] + "_val.txt")):
        wanted = [f"{word} {i}" for i in range(n) if i % 5][:cap]
        found = files.read_lines(spark, path, keyed=True).orderBy("file", "block", "seq").collect()
        assert [r["line"] for r in found] == wanted
        known = cache.read_manifest(spark, export.manifest_path(path))
        assert known["written_samples"] == len(wanted) and known["actual_split"] == split
        assert known["available_splits"] == ["test", "train", "validation"]
    totals = {r["split"]: r["rows"] for r in export.export_total(summary).collect()}
    assert totals["total"] == totals["train"] + totals["validation"]
    single = export.export_corpus(spark, tables, "test", out, "doc_id").first()
    assert (single["output"], single["rows"]) == (out, 2)


def chats(spark, n):
    rows = [(i, [("user", f"q{i}"), ("assistant", f"a{i}" if i % 4 else " ")]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, messages array<struct<role string, content string>>")


@pytest.mark.parametrize("cap", [None, 2, 5])
def test_local_split_export(spark, cap):
    out = new_path(spark, "export") + ".jsonl"
    export.export_sft(spark, {"train": chats(spark, 60)}, "both", out, "id", "chat_messages",
                      max_rows=cap, val_ratio=0.1, seed=9)
    usable = [i for i in range(60) if i % 4]
    order = sorted(usable, key=lambda i: (int(hashlib.md5(f"9:{i}".encode()).hexdigest()[:15], 16), i))
    n_val = max(1, int(len(usable) * 0.1))
    for path, ids in ((out[:-6] + "_val.jsonl", order[:n_val]), (out[:-6] + "_train.jsonl", order[n_val:])):
        lines = files.read_lines(spark, path, keyed=True).orderBy("file", "block", "seq").collect()
        found = [json.loads(r["line"]) for r in lines]
        assert found == [
            {"prompt": f"Human: q{i}\n\nAssistant:", "response": f"a{i}"} for i in ids[:cap]
        ]
        known = cache.read_manifest(spark, export.manifest_path(path))
        assert known["local_split"] and known["source_total_examples"] == len(usable)
        assert known["written_samples"] == len(found)


def test_sft_export_of_given_splits(spark):
    out = new_path(spark, "export") + ".jsonl"
    rows = spark.createDataFrame([(1, " q ", 3), (2, None, 4), (3, "x", None)], "id long, question string, answer int")
    summary = export.export_sft(
        spark, {"train": rows, "test": rows.where("id = 1")}, "both", out, "id",
        fields={"prompt": "question", "response": "answer"},
    )
    assert {r["split"]: r["rows"] for r in summary.collect()} == {"train": 1, "test": 1}
    assert [tuple(r) for r in files.read_jsonl(spark, out[:-6] + "_test.jsonl").collect()] == [("q", "3")]
    with pytest.raises(ValueError):
        export.export_sft(spark, {"train": rows}, "train", out, "id", form="other")


def test_dataset_folders(spark):
    root = new_path(spark, "dataset")
    for split in ("train", "validation"):
        texts(spark, 10, split).write.parquet(files.split_folder(root, split, "subset"))
    assert files.available_splits(spark, root, "subset") == ["train", "validation"]
    assert files.read_split(spark, root, "train", "subset").count() == 10
    stream = files.read_split(spark, root, "validation", "subset", streaming=True)
    assert stream.isStreaming and stream.columns == ["doc_id", "text"]


def test_messages_as_json_text(spark):
    rows = [
        (1, '[{"role": "user", "content": "a"}, {"role": "gpt", "content": "b"}]'),
        (2, '{"role": "user", "content": "a"}'), (3, '"text"'), (4, None), (5, "[]"),
    ]
    df = spark.createDataFrame(rows, "id long, raw string")
    parsed = df.select("id", parsed_messages(df["raw"]).alias("messages"))
    assert [tuple(r) for r in chat_array_examples(parsed, "id").collect()] == [
        (1, "Human: a\n\nAssistant:", "b")
    ]
