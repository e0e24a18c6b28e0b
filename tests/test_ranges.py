"""Passages against the gate event by event, and ranges against whole streams."""

import dataclasses
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilspark.operators.gate import Gate, gate_states
from veilspark.operators.ranges import Passage, gate_states_by_ranges

KINDS = ["clean"] * 5 + ["detected", "inconclusive", "reset", "delay_complete", "approve", "deny"]
EVENTS = st.lists(st.tuples(st.sampled_from(KINDS), st.sampled_from([None, "why"]), st.integers(1, 5), st.booleans(), st.booleans()), max_size=20)


@given(EVENTS, EVENTS, EVENTS)
def test_passages_say_what_a_gate_does(before, first, second):
    gate = Gate()
    for e in before:
        gate.event(*e)
    state, passages = dataclasses.replace(gate), []
    for part in (first, second):
        p = Passage()
        for e in part:
            p.event(*e)
            gate.event(*e)
        passages.append(Passage.of(p.text()))
    for p in passages:
        state = p.behind(state)
    assert state == gate


def test_a_passage_stays_small():
    """After an event that blocks two ways are left; before, no more than counts that matter."""
    p = Passage()
    for i in range(5000):
        p.event("clean", None, 1 + i % 7, i % 3 == 0, i % 2 == 0)
    assert len(p.text()) < 4000
    p.event("inconclusive", "x", 3, True, True)
    assert len(p.ways) == 2


def events(spark, n=600, seed=2, keys=(None, 1, 1, 1, 1, 1, 1, 2, 3)):
    r = random.Random(seed)
    rows = [(r.choice(keys), i // 2, r.choice(KINDS), r.choice([None, "why", "x"]), r.choice([None, 1, 2, 3, 9]), r.choice([None, True, False]), r.choice([None, True, False])) for i in range(n)]
    return spark.createDataFrame(rows, "k long, seq int, event string, reason string, required_checks int, requires_manual boolean, requires_delay boolean")


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_ranges_against_whole_streams(spark, ranges):
    """Streams within a range, over many, and with repeated places in the order."""
    df = events(spark)
    df = df.where("seq % 2 = 0").dropDuplicates(["k", "seq"])
    want = sorted(map(str, gate_states(df, "k", "seq").collect()))
    assert sorted(map(str, gate_states_by_ranges(df, ranges, "k", "seq").collect())) == want


def test_one_stream_is_spread(spark):
    df = events(spark, 4000, 5, (7,)).dropDuplicates(["seq"])
    out = gate_states_by_ranges(df, 16, "k", "seq")
    per = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sorted(map(str, out.collect())) == sorted(map(str, gate_states(df, "k", "seq").collect()))
    assert sum(per) == df.count() and max(per) < df.count() / 3


def test_no_events(spark):
    assert gate_states_by_ranges(events(spark, 0), 4, "k", "seq").collect() == []
