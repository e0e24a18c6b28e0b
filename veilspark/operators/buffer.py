"""The delay buffer: policy, admission and release of frames, and the protected recording."""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.text import saturating_multiply
from veilspark.operators.gate import WAITING

BUDGET = 256 * 1024 * 1024
# What a recording that failed says.
FAILED_RECORDING, FAILED_FINALIZING = "Recording failed: ", "Recording failed while finalizing the video."


def buffer_policy(width: Column, height: Column, delay: Column, fps: Column, budget: Column | None = None) -> Column:
    """(bytes_per_frame, max_frames, sample_interval, max_bytes) of a buffer; inputs below their least count as that."""
    one = F.lit(1).cast("long")
    w, h, f = (F.greatest(c.cast("long"), one) for c in (width, height, fps))
    d, b = F.greatest(delay.cast("double"), F.lit(0.0)), F.greatest(F.lit(BUDGET).cast("long") if budget is None else budget.cast("long"), one)
    size = saturating_multiply(saturating_multiply(w, h), F.lit(4).cast("long"))
    within = F.when(size > b, one).otherwise(F.greatest(one, F.call_function("div", b, size)))
    frames = F.least(F.greatest(one, F.ceil(d * f)), within)
    interval = F.greatest(1.0 / f, d / frames)
    return F.struct(size.alias("bytes_per_frame"), frames.alias("max_frames"), interval.alias("sample_interval"), saturating_multiply(size, frames).alias("max_bytes"))


RELEASED = "admitted boolean, released_seq long"


class Buffer:
    """The delayed frames of one stream: numbers with the times they are ready at."""

    def __init__(self, epoch=None, last=None, held=()):
        self.epoch, self.last, self.held = epoch, last, deque(held)

    def arrival(self, number, now, epoch, delay, most, gap) -> tuple[bool, int | None]:
        """(admitted, released number) of an arrival: frames leave from the front while the first is ready, then there may be room."""
        if epoch != self.epoch:
            self.epoch, self.last = epoch, None
            self.held.clear()
        ready = None
        while self.held and self.held[0][0] <= now:
            ready = self.held.popleft()[1]
        admitted = len(self.held) < most and (self.last is None or now - self.last >= gap)
        if admitted:
            self.held.append((now + delay, number))
            self.last = now
        return admitted, ready


def arrivals(frames: DataFrame, *cols: str) -> DataFrame:
    """``cols`` and the settings of ``frames``; a buffer with null settings has no delay, room for one frame and no least interval."""
    def or_else(c: str, kind: str, value) -> Column:
        return F.coalesce(F.col(c).cast(kind), F.lit(value).cast(kind)).alias(c)

    return frames.select(*cols, F.col("epoch").cast("string").alias("epoch"), or_else("delay", "double", 0), or_else("max_frames", "long", 1), or_else("sample_interval", "double", 0))


def buffered(frames: DataFrame, key: str, order: str, ts: str = "ts") -> DataFrame:
    """``key``, ``order``, admitted, released_seq for every arrival of ``frames`` (also epoch, delay, max_frames, sample_interval).

    An arrival first releases frames from the front of the buffer while the first is ready; the newest of them is delivered (``released_seq`` is its
    number). Then it enters if there is room and enough time has passed since the last that did. A new epoch starts empty; a null key
    is a stream of its own. What enters depends on all that came before, so partitions are sorted and read in order; a task holds one buffer,
    at most max_frames numbers.
    """
    kinds = dict(frames.dtypes)
    rows = arrivals(frames, key, order, F.col(ts).cast("double").alias(ts)).repartition(key).sortWithinPartitions(key, order)

    def run(batches):
        at, buffer = None, Buffer()
        for b in batches:
            out = []
            for k, *arrival in zip(*(c.to_pylist() for c in b.columns)):
                if (k,) != at:
                    at, buffer = (k,), Buffer()
                out.append(buffer.arrival(*arrival))
            if out:
                admitted, released = zip(*out)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(admitted, pa.bool_()), pa.array(released, pa.int64())], [key, order, "admitted", "released_seq"])

    return rows.mapInArrow(run, f"{key} {kinds[key]}, {order} {kinds[order]}, {RELEASED}")


def delivered(released: DataFrame, lifecycles: DataFrame, keys: list[str]) -> DataFrame:
    """Released frames whose lifecycle is still the current one (``lifecycles``: ``keys``) when they are delivered."""
    return released.where("released_seq is not null").join(lifecycles, keys, "left_semi")


def recorded(frames: DataFrame, states: DataFrame, key: str, ts: str, payload: str, fps: Column) -> DataFrame:
    """Numbered frames with the gate's state as of their time: blocked ones keep the reason and lose the payload.

    states (key, ts, is_blocked, reason): the latest at or before a frame's time counts; before any, a stream is blocked. Times of the recording
    follow the frame numbers, so frames left out leave no gap.
    """
    rows = with_states(frames, states, key, ts, payload)
    w = Window.partitionBy(key).orderBy(ts, "side", payload)
    now = F.last(F.when(F.col("side") == 0, F.struct("is_blocked", "reason")), True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_now", now).where("side = 1")
    rows = rows.withColumn("frame_no", (F.row_number().over(w) - 1).cast("long"))
    blocked = F.coalesce(F.col("_now.is_blocked"), F.lit(True))
    return rows.select(
        key, "frame_no", (F.col("frame_no") / fps).alias("pts"), F.when(blocked, F.coalesce(F.col("_now.reason"), F.lit(WAITING))).alias("blocked_reason"),
        F.when(~blocked, F.col(payload)).alias(payload))


def with_states(frames: DataFrame, states: DataFrame, key: str, ts: str, payload: str) -> DataFrame:
    """key, ts, side, payload, is_blocked, reason: frames (side 1) among the gate's states (side 0), which come first at a time."""
    kind = dict(frames.dtypes)[payload]
    both = frames.select(key, ts, F.lit(1).alias("side"), payload, F.lit(None).cast("boolean").alias("is_blocked"), F.lit(None).cast("string").alias("reason"))
    return both.unionByName(states.select(key, ts, F.lit(0).alias("side"), F.lit(None).cast(kind).alias(payload), "is_blocked", "reason"))


def in_sessions(frames: DataFrame, sessions: DataFrame, key: str, ts: str) -> DataFrame:
    """Frames that a recorder takes, with their ``session_id``: from a session's start until it is stopped (null: it goes on), and only those
    that find the writer ready (``ready``; null: it is). Others are passed over and get no number.

    sessions (session_id, key, started, stopped) of a stream don't overlap.
    """
    rows = frames.where(F.coalesce("ready", F.lit(True))) if "ready" in frames.columns else frames
    kind, session = rows.select(F.struct(*rows.columns).alias("r")).schema["r"].dataType, sessions.select(F.struct("session_id", "stopped").alias("s")).schema["s"].dataType
    both = rows.select(key, F.col(ts).alias("_at"), F.lit(1).alias("_side"), F.struct(*rows.columns).alias("_row"), F.lit(None).cast(session).alias("_session")).unionByName(
        sessions.select(key, F.col("started").alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(kind).alias("_row"), F.struct("session_id", "stopped").alias("_session")))
    # the last session that began at or before a frame, on either side no product of frames and sessions
    w = Window.partitionBy(key).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    now = both.where(F.col(key).isNotNull()).withColumn("_session", F.last("_session", True).over(w)).where("_side = 1 and _session is not null")
    return now.where(F.col("_session.stopped").isNull() | (F.col("_at") < F.col("_session.stopped"))).select("_row.*", "_session.session_id")


def session_outcomes(sessions: DataFrame, frames: DataFrame, ts: str, *more: str) -> DataFrame:
    """session_id, frames, width, height, published, message of every session (session_id, failure): what is left when it ends.

    A recording has the size of its first frame (by ``ts`` and ``more`` columns that break its ties). One with frames is published; one that failed is deleted and leaves a message; one
    without frames leaves nothing but an earlier failure's message.
    """
    first = F.struct(ts, *more)
    own = frames.groupBy("session_id").agg(F.count("*").alias("frames"), F.min_by("width", first).alias("width"), F.min_by("height", first).alias("height"))
    out = sessions.join(own, "session_id", "left").withColumn("frames", F.coalesce("frames", F.lit(0)))
    message = F.when(F.col("failure").isNotNull(), F.concat(F.lit(FAILED_RECORDING), F.col("failure")))
    return out.select("session_id", "frames", "width", "height", ((F.col("frames") > 0) & F.col("failure").isNull()).alias("published"), message.alias("message"))


def bitrate(width: Column, height: Column) -> Column:
    return F.greatest(F.lit(2_000_000), width * height * 3)


def mask_font_size(width: Column) -> Column:
    """Points of the reason's letters on a mask of that width."""
    return F.greatest(F.lit(22.0), width / 38)
