"""A source of frames for the buffer: a steady stream of numbered frames, sized and timed as they are asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.operators.capture import capture_size


def frame_stream(spark: SparkSession, fps: int, width: int, height: int, display_width: int, display_height: int, key: str = "display") -> DataFrame:
    """stream_id, seq, ts (seconds), width, height, type, valid: ``fps`` frames for each second, one second a micro-batch, within the display's size.

    Times follow the frames' numbers, so frames are never closer than 1/fps, and a stream that starts again gives the same frames.
    """
    rate = spark.readStream.format("rate-micro-batch").options(rowsPerBatch=max(1, fps), numPartitions=1, startTimestamp=0, advanceMillisPerBatch=1000).load()
    size = capture_size(F.lit(width), F.lit(height), F.lit(display_width), F.lit(display_height))
    return rate.select(
        F.lit(key).alias("stream_id"), F.col("value").alias("seq"), (F.col("value") / max(1, fps)).alias("ts"), size["width"].alias("width"), size["height"].alias("height"),
        F.lit("screen").alias("type"), F.lit(True).alias("valid"))
