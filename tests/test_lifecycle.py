"""Whole previews: prompts and outdated answers, starts that fail, what a stop ends; streams against batch."""

import random

import pytest
from pyspark.sql import functions as F

from veilspark.operators.lifecycle import Preview, lifecycles
from veilspark.streaming import live


def play(*events, delay=2.0, required=1, by_hand=True):
    """Rows as dicts of a preview's events (seconds, what)."""
    from veilspark.operators.lifecycle import NAMES

    preview, out = Preview(), []
    for i, (now, what) in enumerate(events):
        preview = Preview.of(preview.text())  # what a stream keeps is all there is
        out += [dict(zip(["number", *NAMES], r)) for r in preview.event(i, float(now), what, "why", True, delay, required, by_hand, True, 2, 0.0)]
    return out


def test_an_outdated_answer_is_asked_for_again():
    got = play((0, "start"), (1, "detected"), (2, "clean"), (5, "inconclusive"), (6, "clean"), (9, "frame"), (10, "approve"), (11, "approve"))
    timers = [r for r in got if r["number"] is None]
    assert [(r["at"], r["asks"], r["pending_manual"]) for r in timers] == [(4.0, True, True), (8.0, False, True)]
    first, second = (r for r in got if r["number"] in (6, 7))
    assert (first["asks"], first["is_blocked"], first["pending_manual"]) == (True, True, True)
    assert (second["asks"], second["is_blocked"], second["reason"]) == (False, False, "Protected")


def test_answers_that_nobody_asked_for_change_nothing():
    got = play((0, "start"), (1, "approve"), (2, "deny"), (3, "clean"), (4, "approve"))
    assert [r["reason"] for r in got[:3]] == ["Filling delayed stream buffer"] * 3 and got[-1]["pending_delay"]
    got = play((0, "start"), (1, "detected"), (2, "clean"), (5, "deny"), (6, "approve"))
    assert [r["reason"] for r in got[-2:]] == ["Manual clearance required"] * 2


def test_a_start_that_fails():
    got = play((0, "start"), (1, "detected"), (2, "clean"), (3, "failed"), (9, "clean"), (10, "start"), (11, "buffering"))
    assert not any(r["number"] is None for r in got)  # the timer was dropped
    failed, after, again, filling = got[3:]
    assert (failed["running"], failed["reason"], failed["lifecycle"]) == (False, "Screen Recording permission required", 1)
    assert after["reason"] == failed["reason"] and again["lifecycle"] == 2 and filling["reason"] == "Filling 2-second buffer"


def test_a_stop_ends_all():
    """The buffer is emptied, the recording over, the timer dropped; the next lifecycle begins anew."""
    got = play((0, "start"), (1, "record"), (2, "frame"), (3, "frame"), (4.5, "frame"), (5, "clean"), (6, "stop"), (6.5, "frame"), (9, "start"), (10, "frame"), (12, "frame"))
    assert [r["recorded_no"] for r in got] == [None, None, None, None, 0, None, None, None, None, None, None]
    assert [r["released_seq"] for r in got] == [None, None, None, None, 2, None, None, None, None, None, 9]
    assert [r["admitted"] for r in got if r["admitted"] is not None] == [True] * 5
    assert got[6]["reason"] == "Preview stopped" and not any(r["number"] is None for r in got)


def test_settings_restart_a_preview_that_runs():
    got = play((0, "settings"), (1, "start"), (2, "clean"), (3, "settings"), (9, "error"))
    assert [(r["reason"], r["lifecycle"]) for r in got] == [
        ("Settings changed · checking again", 0), ("Filling delayed stream buffer", 1), ("Clean checks passed · waiting for stream delay", 1), ("Filling delayed stream buffer", 2), ("Capture stopped", 3)]


WHATS = ["start", "start", "buffering", "failed", "stop", "settings", "error", "record", "detected", "inconclusive", "approve", "approve", "deny", "other"] + ["clean"] * 16 + ["frame"] * 8


def some_events(spark, n, seed=4):
    r = random.Random(seed)
    rows = [(r.choice([None, 1, 1, 2]), i, 100.0 + i, r.choice(WHATS), r.choice([None, "why"]), r.choice([None, 0.0, 4.0, 9.5]), r.choice([None, 1, 2]), r.choice([None, True, True]), r.choice([True, True, False])) for i in range(n)]
    return spark.createDataFrame(rows, "k long, i long, ts double, what string, reason string, delay double, required_checks int, requires_manual boolean, requires_delay boolean").withColumn("max_frames", F.lit(3))


@pytest.mark.parametrize("parts", [1, 6])
def test_streams_show_what_batches_show(spark, tmp_path, parts):
    df = some_events(spark, 900)
    want = {str(r) for r in lifecycles(df, "k", "i").collect()}
    timed = df.withColumn("at", F.timestamp_seconds("ts")).drop("ts")
    for p in range(parts):
        timed.where(f"i * {parts} div 900 = {p}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    live.drain(live.lifecycle_stream(stream, "k", "i", "at"), f"{tmp_path}/out", f"{tmp_path}/state")
    got = {str(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert want <= got and all("i=None" in r for r in got - want)  # timers that no event came after
    assert sum("asks=True" in r for r in want) > 2 and sum("recorded_no=0" in r for r in want) >= 1


def test_no_events(spark):
    assert lifecycles(some_events(spark, 0), "k", "i").collect() == []
