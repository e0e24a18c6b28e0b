"""Queries against their SQL on tables beyond the limits of a scan, and streams of many keys."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from veilspark.operators import bursts
from veilspark.plans import catalog
from veilspark.streaming import live

TABLES = {
    "customer": "select range + 1 as c_custkey from range(4800)",
    "documents": "select 280 * (range // 2) + range % 2 as doc_id, 'text ' || range as text, 'en' as lang, 'web' as source, 6 as n_chars from range(3400)",
}


@pytest.mark.parametrize("name", ["q_child_limit", "q_limits", "q_tree_walk"])
def test_walks_go_on_to_the_last_element(spark, tmp_path, name):
    """Applications of over 1,501 elements: the SQL counts and numbers all of them."""
    db = duckdb.connect()
    for table, sql in TABLES.items():
        db.sql(f"create table {table} as {sql}")
        db.sql(f"copy {table} to '{tmp_path}/{table}.parquet' (format parquet)")
    got = contract.queries()[name](spark, str(tmp_path))
    want = db.sql(contract.oracle_sql()[name])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_streams_of_many_keys(spark, tmp_path):
    """State is kept in few parts and by buckets of keys, whatever the session's partitions; the runs are those of the batch form over several micro-batches,
    whether a timer or an arrival starts what waits."""
    rows = spark.range(9000).selectExpr("case when id % 700 <> 0 then id % 700 end as k", "id as n", "timestamp_seconds(id + 1000) as ts", "cast(id % 13 * 300 as double) as takes")
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    for i in range(3):
        rows.where(f"n div 3000 = {i}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        live.drain(live.coalesced_stream(source, "k", "n"), f"{tmp_path}/out", f"{tmp_path}/state")
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert len([x for x in os.listdir(f"{tmp_path}/state/state/0") if x.isdigit()]) == 8
    want = bursts.coalesced_runs(rows.withColumn("ts", F.unix_micros("ts") / 1e6), "k", "n").where("started < 9999")
    got = spark.read.parquet(f"{tmp_path}/out").where("started < 9999")
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_stream_files_come_in_order(spark, tmp_path):
    """Ranges are at most as large as asked for and are read in order, without being written twice."""
    rows = spark.range(5000).selectExpr("(id * 7919) % 5000 as n")
    catalog._in_order(rows, ["n"], 600, str(tmp_path))
    files = sorted((os.stat(f"{tmp_path}/in/{x}").st_mtime, f"{tmp_path}/in/{x}") for x in os.listdir(f"{tmp_path}/in") if x.startswith("part-"))
    got = [[r.n for r in spark.read.parquet(f).collect()] for _, f in files]
    assert [n for part in got for n in part] == list(range(5000)) and max(map(len, got)) <= 600 and os.listdir(tmp_path) == ["in"]
