"""Requests one at a time and ticks, against plain Python; streams in several micro-batches against batch."""

import math
import random

import pytest
from pyspark.sql import functions as F

from veilspark.operators import bursts, capture
from veilspark.streaming import live


def slow_runs(requests):
    """(number, started, ended) by walking from each run's end to the next."""
    left, out, free = sorted(requests), [], -math.inf
    while left:
        ready = [x for x in left if x[0] < free]  # what comes just when a run ends comes after it
        now, number, takes = ready[-1] if ready else left[0]
        start = max(now, free)
        out.append((number, start, start + takes))
        free = start + takes
        left = [x for x in left if (x[0], x[1]) > (now, number)]
    return out


def requests(n=300, seed=1):
    r = random.Random(seed)
    return [(r.choice([None, 1, 1, 1, 2, 3]), i, float(100 + i // 2 * 10), r.choice([None, -5.0, 0.0, 5.0, 20.0, 95.0])) for i in range(n)]


def by_key(rows):
    out = {}
    for k, i, ts, takes in rows:
        out.setdefault(k, []).append((ts, i, max(takes or 0.0, 0.0)))
    return out


SCHEMA = "k long, i long, ts double, takes double"


def test_runs(spark):
    rows = requests()
    want = sorted((k or 0, *x) for k, some in by_key(rows).items() for x in slow_runs(some))
    got = bursts.coalesced_runs(spark.createDataFrame(rows, SCHEMA), "k", "i").collect()
    assert sorted((r.k or 0, r.i, r.started, r.ended) for r in got) == want
    assert bursts.coalesced_runs(spark.createDataFrame([], SCHEMA), "k", "i").collect() == []


@pytest.mark.parametrize("parts", [1, 7])
def test_runs_of_a_stream(spark, tmp_path, parts):
    rows = requests(200, 3)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("at", F.timestamp_seconds("ts")).drop("ts")
    for p in range(parts):
        df.where(f"i div 2 * {parts} div 100 = {p}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    live.drain(live.coalesced_stream(stream, "k", "i", "at"), f"{tmp_path}/out", f"{tmp_path}/state")
    end = max(r[2] for r in rows)
    want = sorted((k or 0, *x) for k, some in by_key(rows).items() for x in slow_runs(some) if x[1] < end)
    assert sorted((r.k or 0, r.i, r.started, r.ended) for r in spark.read.parquet(f"{tmp_path}/out").where(f"started < {end}").collect()) == want


def test_ticks(spark, monkeypatch):
    monkeypatch.setattr(capture, "CHUNK", 4)
    r = random.Random(2)
    spans = [("a", 10.0, 21.0), ("b", 0.5, 3.0), (None, 5.0, 9.0), ("none", 4.0, 4.0), ("open", 1.0, None)]
    rows = [(r.choice(["a", "b", None, "none", "other"]), r.randint(0, 100) / 4) for _ in range(300)]
    got = capture.all_ticks(spark.createDataFrame(rows, "k string, at double"), spark.createDataFrame(spans, "k string, started double, stopped double"), "k", "at", 0.75).collect()
    want = []
    for k, a, z in spans[:3]:
        for i in range(math.ceil((z - a) / 0.75)):
            want.append((str(k), a + i * 0.75, sum(1 for x, at in rows if x == k and a <= at < z and math.floor((at - a) / 0.75) == i)))
    assert sorted((str(x.k), x.tick, x.n) for x in got) == sorted(want)


def test_silent_ticks_of_a_stream(spark, tmp_path):
    """A key that falls silent ticks on by its timer alone, as another key's rows move the time."""
    for p, some in enumerate([[("a", 100), ("b", 100), ("a", 103)], [("b", 131)], [("b", 160)]]):
        spark.createDataFrame(some, "k string, s long").select("k", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    live.drain(live.tick_stream(stream, "k", "ts", 10.0), f"{tmp_path}/out", f"{tmp_path}/state")
    got = {(r.k, r.tick): r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert {t: n for (k, t), n in got.items() if k == "a" and t < 150} == {100.0: 2, 110.0: 0, 120.0: 0, 130.0: 0, 140.0: 0}
    assert {t: n for (k, t), n in got.items() if k == "b" and t < 150} == {100.0: 1, 110.0: 0, 120.0: 0, 130.0: 1, 140.0: 0}
