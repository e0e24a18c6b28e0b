"""Streams on inputs that the batch forms have defined cases for, their sinks, and workers without the package on their path."""

import os
import subprocess
import sys

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from veilspark.operators import buffer, capture, screen
from veilspark.operators.gate import gate_timed, generations
from veilspark.streaming import live

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def stream_of(spark, df, path):
    df.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_payloads_that_no_double_holds(spark, tmp_path):
    big = 9007199254740993
    states = spark.createDataFrame([("a", 0, False, "ok"), ("a", 5, True, "no")], "k string, ts int, is_blocked boolean, reason string")
    frames = spark.createDataFrame([("a", 1, big), ("a", 2, None), ("a", 3, big + 2), ("a", 6, big + 4), ("b", 1, big)], "k string, ts int, p long")
    both = buffer.with_states(frames, states, "k", "ts", "p")
    live.drain(live.record_stream(stream_of(spark, both, f"{tmp_path}/in"), "k", "ts", "p", 10.0), f"{tmp_path}/out", f"{tmp_path}/state")
    got = sorted(map(str, spark.read.parquet(f"{tmp_path}/out").collect()))
    want = sorted(map(str, buffer.recorded(frames, states, "k", "ts", "p", F.lit(10.0)).collect()))
    assert got == want and str(big) in "".join(got)


def test_null_delay_never_ends(spark, tmp_path):
    rows = [("k", i, 1_700_000_000 + 10 * i, "clean", None, 1, False, True) for i in range(4)]
    df = spark.createDataFrame(rows, "stream_id string, seq int, s long, event string, reason string, required_checks int, requires_manual boolean, requires_delay boolean")
    df = df.withColumn("ts", F.timestamp_seconds("s")).drop("s")
    null = F.lit(None).cast("double")
    want = sorted((r.seq, r.is_blocked, r.pending_delay) for r in gate_timed(df.withColumn("ts", F.unix_seconds("ts").cast("double")), null).collect())
    live.drain(live.gate_timed_stream(stream_of(spark, df, f"{tmp_path}/in"), null), f"{tmp_path}/out", f"{tmp_path}/state")
    assert sorted((r.seq, r.is_blocked, r.pending_delay) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == want == [(i, True, True) for i in range(4)]


def test_what_is_shown_is_kept_by_key(spark, tmp_path):
    """Only the buckets of keys that changed are written; every version is whole; one that comes again is the same again."""
    path, source = f"{tmp_path}/shown", f"{tmp_path}/in"
    kind = "k long, seq int, p string"
    first = spark.createDataFrame([(i, 1, f"a{i}") for i in range(200)] + [(None, 1, "none")], kind)
    shown = capture.shown_frame(stream_of(spark, first, source), "k", "seq", "p")
    assert live.read_shown(spark, path, shown.schema).collect() == []
    live.show_to(shown, path, f"{tmp_path}/state", "k")
    before = live._version(spark, path, None)
    old = live.read_shown(spark, path, shown.schema)
    assert old.count() == 201
    second = spark.createDataFrame([(3, 2, "b3"), (7, 0, "late"), (900, 1, "new")], kind)
    live.show_to(capture.shown_frame(stream_of(spark, second, source), "k", "seq", "p"), path, f"{tmp_path}/state", "k")
    after = live._version(spark, path, None)
    assert 1 <= sum(before.get(b) != f for b, f in after.items()) <= 3
    got = {r.k: r.p for r in live.read_shown(spark, path, shown.schema).collect()}
    assert got == {i: f"a{i}" for i in range(200)} | {None: "none", 3: "b3", 900: "new"}
    assert {r.k: r.p for r in old.collect()}[3] == "a3"  # a reader of the version before still reads it
    live._publish(spark, path, max(live._versions(spark, path)), after)
    assert {r.k: r.p for r in live.read_shown(spark, path, shown.schema).collect()} == got
    for n in range(5):
        live.show_to(capture.shown_frame(stream_of(spark, spark.createDataFrame([(3, 10 + n, f"c{n}")], kind), source), "k", "seq", "p"), path, f"{tmp_path}/state", "k")
    assert len(live._versions(spark, path)) == live.VERSIONS
    assert {r.k: r.p for r in live.read_shown(spark, path, shown.schema).collect()} == got | {3: "c4"}


def test_sessions_as_of_a_frame(spark):
    sessions = spark.createDataFrame([(1, "a", 0, 10, None), (2, "a", 10, None, None), (3, "b", 5, 5, None), (4, None, 0, None, None)], "session_id int, k string, started int, stopped int, failure string")
    frames = spark.createDataFrame([("a", 0, 1, 7), ("a", 9, 2, 8), ("a", 10, 3, 9), ("a", 10, 4, 5), ("b", 5, 5, 1), ("c", 1, 6, 1), (None, 1, 7, 1)], "k string, ts int, n int, width int").withColumn("height", F.lit(1))
    out = buffer.in_sessions(frames, sessions, "k", "ts")
    assert sorted((r.n, r.session_id) for r in out.collect()) == [(1, 1), (2, 1), (3, 2), (4, 2)]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    ends = {r.session_id: (r.frames, r.width) for r in buffer.session_outcomes(sessions, out, "ts", "n").collect()}
    assert ends == {1: (2, 7), 2: (2, 9), 3: (0, None), 4: (0, None)}


def test_repeated_elements_count_once(spark):
    kind = "snapshot_id long, pid long, window_id long, elem_id long, parent_id long, child_pos long, visible boolean, value string, title string, description string, err string, elapsed_ms double"
    rows = [(1, 1, 1, i, None if i == 0 else i // 100 * 100 if i % 100 else 0, i, True, "t", None, None, None, 0.0) for i in range(801)]
    got = [tuple(screen.incomplete(screen.traversed(spark.createDataFrame(x, kind))).first()) for x in (rows, rows * 2)]
    assert got[0] == got[1] == (1, 1, False, False, True, 801)
    kids = [(1, 1, 1, i, None if i == 0 else 0, i, True, "t", None, None, None, 0.0) for i in range(302)]
    assert [screen.incomplete(screen.traversed(spark.createDataFrame(x, kind))).first().incomplete for x in (kids, kids[:301], kids[:301] * 2)] == [True, False, False]


def test_long_texts_are_counted_in_graphemes(spark):
    from veilspark.functions.text import longer_than

    texts = ["👍🏽" * 20, "👍🏽" * 21, "e\u0301" * 20, "e\u0301" * 21, "a" * 20, "a" * 21, None, "👨‍👩‍👧" * 20, "\r\n" * 20]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select(longer_than(F.col("t"), 20).alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == [False, True, False, True, False, True, False, False, False]


def test_large_files_are_not_opened(spark, tmp_path):
    from veilspark.sources.texts import guarded_files

    for name, content in (("a", b"fine"), ("b", b"x" * 50), ("c", b"\xff")):
        (tmp_path / name).write_bytes(content)
    with open(tmp_path / "huge", "wb") as f:
        f.truncate(3 << 30)  # no array holds so many bytes
    got = {r.path.rsplit("/", 1)[-1]: (r.text, r.error) for r in guarded_files(spark, str(tmp_path), 49).collect()}
    assert got == {"a": ("fine", None), "b": (None, "too large"), "c": (None, "not UTF-8"), "huge": (None, "too large")}


def test_settings_begin_a_lifecycle_only_while_a_preview_is_wanted(spark):
    controls = ["settings", "start", "settings", None, "stop", "settings", "start", "error", "settings"]
    df = spark.createDataFrame([(i, "k", "clean", c) for i, c in enumerate(controls)], "i int, k string, event string, control string")
    assert [r.lifecycle for r in generations(df, "k", ["i"]).orderBy("i").collect()] == [0, 1, 2, 2, 3, 3, 4, 5, 5]


@pytest.mark.parametrize("rows", [0, 3])
def test_workers_need_no_path(tmp_path, rows):
    """A session that begins elsewhere, with the package on the driver's own path only; a recording without frames leaves nothing."""
    code = f"""
import sys
sys.path.insert(0, {HERE!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from veilspark.session import ship_package
from veilspark.streaming import live
ship_package(spark)
df = spark.createDataFrame([("a", i, 1, i, False, "x") for i in range({rows})], "k string, ts int, side int, p int, is_blocked boolean, reason string")
df.write.parquet({str(tmp_path)!r} + "/in")
s = spark.readStream.schema(df.schema).parquet({str(tmp_path)!r} + "/in")
got = live.record_to(live.record_stream(s, "k", "ts", "p", 10.0), {str(tmp_path)!r} + "/out")
print("RESULT", got[0] is not None, got[1])
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert f"RESULT {rows > 0} None" in out.stdout, out.stderr[-3000:]


def test_state_is_kept_in_a_part_a_core(spark, tmp_path, monkeypatch):
    """A micro-batch has a store, a worker and a commit for every part, and its file is cut into row groups that several tasks read."""
    from veilspark.plans import catalog

    df = spark.range(4000).select((F.col("id") % 37).alias("user_id"), F.col("id").alias("event_id"), F.when(F.col("id") % 5 == 0, "error").otherwise("view").alias("event_type"))
    df.write.parquet(f"{tmp_path}/events.parquet")
    places = []
    monkeypatch.setattr(live, "drain", lambda s, path, state, f=live.drain: (places.append(os.path.dirname(path.removeprefix("file://"))), f(s, path, state)))
    monkeypatch.setattr(catalog, "GROUP", 4096)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        got = sorted(map(tuple, catalog.QUERIES["stream_gate"](spark, str(tmp_path)).collect()))
        assert spark.conf.get("spark.sql.shuffle.partitions") == "50"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == sorted(map(tuple, catalog.QUERIES["q_gate_manual"](spark, str(tmp_path)).collect())) and len(got) == 4000
    parts = [x for x in os.listdir(f"{places[0]}/state/state/0") if x.isdigit()]
    assert 0 < len(parts) <= spark.sparkContext.defaultParallelism
    files = [f for f in os.listdir(f"{places[0]}/in") if f.endswith(".parquet")]
    assert all(pq.ParquetFile(f"{places[0]}/in/{f}").num_row_groups > 1 for f in files)


@pytest.mark.parametrize("kind", ["string", "int", "double", "date"])
def test_payloads_of_all_kinds(spark, tmp_path, kind):
    states = spark.createDataFrame([("a", 0, False, "ok"), ("a", 5, True, "no")], "k string, ts int, is_blocked boolean, reason string")
    frames = spark.createDataFrame([("a", 1, "7"), ("a", 2, None), ("a", 2, "3"), ("a", 6, "8"), ("b", 1, "9")], "k string, ts int, p string")
    frames = frames.withColumn("p", F.expr("date_add(date'2024-01-01', cast(p as int))") if kind == "date" else F.col("p").cast(kind))
    both = buffer.with_states(frames, states, "k", "ts", "p")
    live.drain(live.record_stream(stream_of(spark, both, f"{tmp_path}/in"), "k", "ts", "p", 10.0), f"{tmp_path}/out", f"{tmp_path}/state")
    assert sorted(map(str, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(str, buffer.recorded(frames, states, "k", "ts", "p", F.lit(10.0)).collect()))
