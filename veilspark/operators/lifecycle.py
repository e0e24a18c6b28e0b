"""One preview from start to stop: controls, checks, the clearance timer, prompts and their answers, the frame buffer and the recording, as one fold over events."""

from __future__ import annotations

import dataclasses
import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.operators.buffer import Buffer
from veilspark.operators.gate import CHECKS, CONTROL, FILLING, NOT_TRUSTED, Gate, filling

VERDICTS, ANSWERS = ("clean", "detected", "inconclusive"), ("approve", "deny")

SHOWN = (
    "at double, is_blocked boolean, reason string, clean_checks long, pending_manual boolean, pending_delay boolean, running boolean, lifecycle long, clearance long, "
    "asks boolean, admitted boolean, released_seq long, recorded_no long")
SETTINGS = ["trusted", "delay", "required_checks", "requires_manual", "requires_delay", "max_frames", "sample_interval"]
NAMES = [x.split()[0] for x in SHOWN.split(", ")]


class Preview:
    """The state of one preview."""

    def __init__(self):
        self.gate, self.buffer = Gate(), Buffer()
        self.running, self.lifecycle, self.clearance = False, 0, 0
        self.due: float | None = None  # when the clearance timer goes off
        self.by_hand = False  # the last event's setting, under which it does
        self.asked: list[int] | None = None  # the lifecycle and clearance in which the open prompt was asked
        self.recorded: int | None = None

    def text(self) -> str:
        own = {k: v for k, v in vars(self).items() if k not in ("gate", "buffer")}
        return json.dumps([dataclasses.astuple(self.gate), [self.buffer.epoch, self.buffer.last, list(self.buffer.held)], own])

    @classmethod
    def of(cls, text: str) -> "Preview":
        out = cls()
        gate, (epoch, last, held), own = json.loads(text)
        out.gate, out.buffer = Gate(*gate), Buffer(epoch, last, [tuple(x) for x in held])
        vars(out).update(own)
        return out

    def _row(self, number, at: float, asks: bool, admitted=None, released=None, recorded=None) -> tuple:
        return (number, at, *self.gate.shown(), self.running, self.lifecycle, self.clearance, asks, admitted, released, recorded)

    def _reset(self, reason: str) -> None:
        self.gate.event("reset", reason, 0, False, False)
        self.due = None

    def _end(self, reason: str) -> None:
        """No preview any more: the timer is dropped, the buffer emptied, the recording over, a prompt withdrawn."""
        self.running, self.recorded, self.asked, self.buffer = False, None, None, Buffer()
        self._reset(reason)

    def _start(self, trusted: bool) -> None:
        self.running, self.asked, self.buffer = True, None, Buffer()
        self.lifecycle += 1
        self._reset(FILLING if trusted else NOT_TRUSTED)

    def _ask(self) -> bool:
        """Ask for an approval that is waited for, unless a prompt is open."""
        if not self.gate.manual or self.asked is not None:
            return False
        self.asked = [self.lifecycle, self.clearance]
        return True

    def clear(self, now: float) -> list[tuple]:
        """The timer's row, if it has gone off by ``now``."""
        if self.due is None or self.due > now:
            return []
        at, self.due = self.due, None
        self.gate.event("delay_complete", None, 0, self.by_hand, True)
        return [self._row(None, at, self._ask())]

    def event(self, number, now: float, what: str, reason, trusted, delay, required, by_hand, delayed, most, gap) -> list[tuple]:
        """The rows of an event: the timer's, if it goes off before, and the event's own."""
        out, asks, more = self.clear(now), False, ()
        self.by_hand = by_hand
        if what == "start":
            self._start(trusted)
        elif what == "settings":
            self._reset(CONTROL["settings"])
            self.asked = None
            if self.running:
                self._start(trusted)
        elif what in ("stop", "error"):
            self.lifecycle += 1
            self._end(CONTROL[what])
        elif what in ANSWERS and self.asked is not None:
            current = self.running and self.asked == [self.lifecycle, self.clearance] and self.gate.manual
            self.asked = None
            if current:
                self.gate.event(what, None, 0, by_hand, delayed)
            else:
                asks = self._ask()  # the answer is to what isn't so any more
        elif self.running:
            if what == "failed":
                self._end(CONTROL[what])
            elif what == "buffering":
                self._reset(filling(delay))
            elif what == "record":
                self.recorded = 0
            elif what in VERDICTS:
                waited = self.gate.delay
                if what != "clean":
                    self.due = None
                    self.clearance += 1
                self.gate.event(what, reason, required, by_hand, delayed)
                if self.gate.delay and not waited and delay is not None:
                    self.due = now + delay
                asks = self._ask()
            elif what == "frame":
                admitted, released = self.buffer.arrival(number, now, self.lifecycle, delay or 0.0, most, gap)
                recorded = self.recorded if released is not None else None
                if recorded is not None:
                    self.recorded += 1
                more = (admitted, released, recorded)
        return [*out, self._row(number, now, asks, *more)]


def with_settings(events: DataFrame, key: str, order: str, ts: str, *more: str) -> DataFrame:
    """The columns of ``events`` that a preview reads; settings that are null or lacking have the defaults of gate and buffer, and are trusted."""
    def or_else(c: str, kind: str, value):
        own = F.col(c).cast(kind) if c in events.columns else F.lit(None).cast(kind)
        return F.coalesce(own, F.lit(value).cast(kind)).alias(c)

    kinds = {"trusted": ("boolean", True), "delay": ("double", None), "required_checks": ("long", CHECKS), "requires_manual": ("boolean", False), "requires_delay": ("boolean", False), "max_frames": ("long", 1), "sample_interval": ("double", 0.0)}
    return events.select(key, *more, F.col(order).cast("long").alias(order), F.col(ts).cast("double").alias("at_seconds"), "what", "reason", *[or_else(c, *kinds[c]) for c in SETTINGS])


def lifecycles(events: DataFrame, key: str, order: str, ts: str = "ts") -> DataFrame:
    """``key``, ``order`` and what a preview shows after every event, and after its clearance timer (``order`` null).

    events: ``what`` is a control (start, buffering, failed, stop, settings, error, record), a verdict, an answer (approve, deny) or a frame, numbered by
    ``order``. A start that fails, a stop and an error end everything that runs; checks, frames and recordings count only while a preview runs. An approval that
    is waited for is asked for (``asks``), in a lifecycle and a clearance that the state keeps: an answer counts if both still hold, and else is asked for
    again. Frames enter a buffer that every lifecycle begins empty; those released while recording are numbered. Controls of other names change nothing.

    A preview's events are sorted and read in order by one task, which holds one state and one buffer. A null key is a preview of its own.
    """
    kinds = dict(events.dtypes)
    rows = with_settings(events, key, order, ts).repartition(key).sortWithinPartitions(key, "at_seconds", order)

    def run(batches):
        at, preview = None, Preview()
        for b in batches:
            out = []
            for k, *event in zip(*(c.to_pylist() for c in b.columns)):
                if (k,) != at:
                    at, preview = (k,), Preview()
                out += [(k, *x) for x in preview.event(*event)]
            if out:
                types = [b.schema.types[0], pa.int64(), pa.float64(), pa.bool_(), pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], [key, order, *NAMES])

    return rows.mapInArrow(run, f"`{key}` {kinds[key]}, `{order}` long, {SHOWN}")
