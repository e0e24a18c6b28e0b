"""The gate over streams that no one task can hold: ranges of events as maps from the state before to the state behind, composed in order."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.operators.gate import HARD, STATE, Gate, checking, with_defaults
from veilspark.session import stash


@dataclasses.dataclass(frozen=True)
class Case:
    """States before a range that take the same way through it: open, waiting for an answer or a delay, or counting from ``low`` up to below ``high`` (null: any)."""

    kind: str
    detected: bool | None = None
    low: int = 0
    high: int | None = None

    def holds(self, before: Gate) -> bool:
        kind = "open" if not before.blocked else "manual" if before.manual else "delay" if before.delay else "count"
        inside = kind != "count" or (self.low <= before.checks and (self.high is None or before.checks < self.high))
        return kind == self.kind and self.detected in (None, before.detected) and inside


@dataclasses.dataclass(frozen=True)
class After:
    """A gate's state as far as it is known without the state before: ``added`` checks come on top of those before while ``on_top``; the reason is the one before
    (null), a text, or what ``checks`` say out of ``required``."""

    blocked: bool
    manual: bool
    delay: bool
    detected: bool
    added: int = 0
    on_top: bool = True
    reason: str | None = None
    required: int | None = None

    def known(self, before: Gate) -> Gate:
        checks = before.checks * self.on_top + self.added
        reason = checking(checks, self.required) if self.required is not None else before.reason if self.reason is None else self.reason
        return Gate(self.blocked, reason, checks, self.manual, self.delay, self.detected)


START = [
    (Case("open"), After(False, False, False, False)), (Case("manual"), After(True, True, False, True)),
    *((Case("delay", hit), After(True, False, True, hit)) for hit in (False, True)), *((Case("count", hit), After(True, False, False, hit)) for hit in (False, True)),
]


def step(case: Case, state: After, kind: str, reason: str | None, required: int, by_hand: bool, delayed: bool) -> Iterator[tuple[Case, After]]:
    """What an event makes of a case: one, or two where it is enough checks for some counts before and not for others."""
    counting = state.blocked and not state.delay and not state.manual
    if kind == "clean" and counting:
        # counts before from which this check is enough
        enough = max(0, required - state.added - 1) if state.on_top else case.low if state.added + 1 >= required else None
        if enough is None or enough > case.low:
            yield dataclasses.replace(case, high=case.high if enough is None or (case.high is not None and case.high < enough) else enough), dataclasses.replace(state, added=state.added + 1, reason=None, required=required)
        if enough is not None and (case.high is None or enough < case.high):
            gate = Gate(True, "", required - 1, False, False, state.detected)
            gate.event(kind, reason, required, by_hand, delayed)
            yield dataclasses.replace(case, low=max(case.low, enough)), After(gate.blocked, gate.manual, gate.delay, gate.detected, state.added + 1, state.on_top, gate.reason)
        return
    gate = Gate(state.blocked, "", 0, state.manual, state.delay, state.detected)
    was = dataclasses.astuple(gate)
    gate.event(kind, reason, required, by_hand, delayed)
    cleared = kind in HARD or (kind == "approve" and was[3])
    said = cleared or gate.reason != ""
    yield case, After(
        gate.blocked, gate.manual, gate.delay, gate.detected, 0 if cleared else state.added, state.on_top and not cleared, gate.reason if said else state.reason, None if said else state.required)


class Passage:
    """A run of events as a map of states: cases, each with the state behind it. Cases that come to one state are kept together."""

    def __init__(self):
        self.ways: dict[After, list[Case]] = {}
        for case, state in START:
            self.ways.setdefault(state, []).append(case)

    def event(self, *event) -> None:
        ways: dict[After, list[Case]] = {}
        for state, cases in self.ways.items():
            # only a count before can tell cases of one state apart
            whole = not (event[0] == "clean" and state.on_top and state.blocked and not state.delay and not state.manual)
            if whole:
                for _, after in step(cases[0], state, *event):
                    ways.setdefault(after, []).extend(cases)
            else:
                for case in cases:
                    for some, after in step(case, state, *event):
                        ways.setdefault(after, []).append(some)
        self.ways = ways

    def behind(self, before: Gate) -> Gate:
        return next(state.known(before) for state, cases in self.ways.items() if any(c.holds(before) for c in cases))

    def text(self) -> str:
        return json.dumps([[dataclasses.astuple(s), [dataclasses.astuple(c) for c in cases]] for s, cases in self.ways.items()])

    @classmethod
    def of(cls, text: str) -> "Passage":
        out = cls()
        out.ways = {After(*s): [Case(*c) for c in cases] for s, cases in json.loads(text)}
        return out


EVENT = ["event", "reason", "required_checks", "requires_manual", "requires_delay"]


def _with_passages(batches: Iterator[pa.RecordBatch]):
    """The rows of a range as they are, and behind them a row with the passage of its first stream and one with that of its last, if another: only these go on in other ranges."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    first = last = passage = None
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        schema = b.schema
        for k, *event in zip(*(b.column(c).to_pylist() for c in (schema.names[0], *EVENT))):
            if passage is None or k != last:
                if n == 1:
                    first = (last, passage)
                n, last, passage = n + 1, k, Passage()
            passage.event(*event)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * len(b), pa.int32()), pa.nulls(len(b), pa.string())], [*schema.names, "part", "passage"])
    if passage is None:
        return
    rows = [first, (last, passage)] if n > 1 else [(last, passage)]
    cols = [pa.array([k for k, _ in rows], schema.types[0]), *(pa.nulls(len(rows), t) for t in schema.types[1:])]
    # the passage of a range that is one stream only says so: states go right through it
    yield pa.RecordBatch.from_arrays([*cols, pa.array([part] * len(rows), pa.int32()), pa.array([p.text() for _, p in rows])], [*schema.names, "part", "passage"])


def gate_states_by_ranges(events: DataFrame, ranges: int, key: str = "stream_id", order: str = "seq", *more: str) -> DataFrame:
    """As ``gate_states``, for streams of any size: no task sees more than about one of ``ranges`` ranges of events, though one stream may fill them all.

    Events are dealt by ranges of (key, order) and sorted. A range's passage says what it makes of any state before it: an event that blocks leaves a
    choice of two, and only counts of checks before the first such event have to be told apart. The passages of streams that go on in the next range, two a range
    at most, are composed in order, which gives every range the state that it begins with; then each is read again by itself, event by event.
    """
    by = [order, *more]
    rows = with_defaults(events, key, *by)
    sort = [key, *by, "event", "reason"]
    kinds = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes)
    ranged = stash(rows.repartitionByRange(ranges, *sort).sortWithinPartitions(*sort).mapInArrow(_with_passages, kinds + ", part int, passage string"), "ranges")
    begin: dict[int, tuple] = {}
    at: tuple | None = None
    for r in ranged.where("passage is not null").select("part", F.col(key).alias("k"), "passage").orderBy("part", F.col(key).asc_nulls_first()).collect():  # two a range at most
        goes_on = at is not None and at[0] == r.k
        if goes_on and r.part not in begin:
            begin[r.part] = at
        before = at[1] if goes_on else Gate()
        at = (r.k, Passage.of(r.passage).behind(before))
    sent = events.sparkSession.sparkContext.broadcast({part: dataclasses.astuple(gate) for part, (_, gate) in begin.items()})  # six values a range
    n = len(by) + 1

    def run(batches: Iterator[pa.RecordBatch]):
        part = k = gate = None
        for b in batches:
            out = []
            for p, k_, *event in zip(*(b.column(c).to_pylist() for c in ("part", b.schema.names[0], *EVENT))):
                if p != part:
                    gate, part, k = Gate(*sent.value[p]) if p in sent.value else Gate(), p, k_
                elif k_ != k:
                    gate, k = Gate(), k_
                gate.event(*event)
                out.append(gate.shown())
            if out:
                shown = [pa.array(c, t) for c, t in zip(zip(*out), (pa.bool_(), pa.string(), pa.int64(), pa.bool_(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*b.columns[:n], *shown], [*b.schema.names[:n], *(x.split()[0] for x in STATE.split(", "))])

    again = ranged.where("passage is null").drop("passage").repartition(ranges, "part").sortWithinPartitions("part", *sort)
    types = dict(rows.dtypes)
    return again.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in (key, *by)) + ", " + STATE)
