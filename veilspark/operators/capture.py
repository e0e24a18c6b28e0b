"""Frames and ticks before the buffer: what is accepted, sized, timed and shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accepted_frames(frames: DataFrame, epochs: DataFrame, keys: list[str]) -> DataFrame:
    """Valid screen frames of the current epoch of their stream."""
    return frames.where((F.col("type") == "screen") & F.col("valid")).join(epochs, keys, "left_semi")


def capture_size(width: Column, height: Column, display_width: Column, display_height: Column) -> Column:
    """The size that is captured: as asked for, within the display."""
    return F.struct(F.least(width, display_width).alias("width"), F.least(height, display_height).alias("height"))


def ticks(rows: DataFrame, key: str, ts: str, every: str = "200 milliseconds") -> DataFrame:
    """One row per stream and tick that has rows: its start and how many rows it takes."""
    return rows.groupBy(key, F.window(ts, every).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("tick"), "n")


#: Ticks that one row makes at once.
CHUNK = 4096


def all_ticks(rows: DataFrame, spans: DataFrame, key: str, ts: str, every: float) -> DataFrame:
    """``key``, tick, n: one row per stream and tick whether it has rows or not, and how many: the first tick at the start, then ``every`` so many seconds until the stop.

    spans (``key``, started, stopped; seconds) are one of each stream; null ends and a stop before the start give no ticks. Rows before the start or from the stop
    on belong to none. Long spans are cut into chunks that are dealt out before they are ticks.
    """
    span = spans.select(key, F.col("started").cast("double").alias("started"), F.col("stopped").cast("double").alias("stopped")).where("stopped > started")
    chunks = F.sequence(F.lit(0).cast("long"), F.ceil((F.col("stopped") - F.col("started")) / every) - 1, F.lit(CHUNK).cast("long"))
    chunk = span.select(key, "started", "stopped", F.explode(chunks).alias("first")).repartition(F.xxhash64(F.col(key).cast("string"), "first"))
    last = F.least(F.col("first") + CHUNK, F.ceil((F.col("stopped") - F.col("started")) / every)) - 1
    tick = chunk.select(key, "started", F.explode(F.sequence("first", last)).alias("i"))
    at = F.floor((F.col(ts).cast("double") - F.col("started")) / every)
    counts = rows.join(span.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key"))).where((F.col(ts).cast("double") >= F.col("started")) & (F.col(ts).cast("double") < F.col("stopped")))
    counts = counts.groupBy("_key", at.alias("_i")).agg(F.count("*").alias("n"))
    both = tick.join(counts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("i") == F.col("_i")), "left")
    return both.select(key, (F.col("started") + F.col("i") * every).alias("tick"), F.coalesce("n", F.lit(0)).alias("n"))


def after_warm_up(rows: DataFrame, starts: DataFrame, key: str, ts: str, delay: Column) -> DataFrame:
    """Rows no earlier than ``delay`` after their stream's start (starts: key, started)."""
    return rows.join(starts.select(key, "started"), key).where(F.col(ts) >= F.col("started") + delay).drop("started")


def shown_frame(frames: DataFrame, key: str, order: str, payload: str) -> DataFrame:
    """The frame that a preview shows: the last delivered of each stream."""
    return frames.groupBy(key).agg(F.max(order).alias(order), F.max_by(payload, order).alias(payload))
