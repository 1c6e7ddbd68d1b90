"""Every registered query against its SQL, values and column names."""

import re

import duckdb
import pytest

import bench
from __spark_entry__ import entry, oracle_sql, queries
from catalog.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return connection


def in_column_order(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(row[i] for i in order)) for row in rows)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(oracle_sql())


def test_bench_runs_registered_queries():
    assert set(bench.HEADLINE) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    found = queries()[name](spark, SF_DIR)
    wanted = duck.execute(oracle_sql()[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(found.columns) == sorted(columns)
    rows = [tuple(r) for r in found.collect()]
    assert rows
    assert in_column_order(rows, found.columns) == in_column_order(wanted.fetchall(), columns)
    plan = found._jdf.queryExecution().executedPlan().toString()
    for slow in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert slow not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = queries()["first_n_lines"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(doc_id,99)" in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    plan = queries()["log_throughput"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    read = re.search("ReadSchema: struct<([^>]*)>", plan)[1]
    assert {column.split(":")[0] for column in read.split(",")} == {"event_type", "ts"}


def test_entry(spark):
    assert entry(spark).count() > 0
