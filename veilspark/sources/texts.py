"""Sources of text with guards that reject rather than cut, and their sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an input and characters of a text at most; what is larger is refused, never cut.
INPUT_BYTES, TEXT_CHARS = 1 << 20, 20_000


def argument_text(spark: SparkSession, *words: str) -> DataFrame:
    """A row of the words joined by spaces, of any size."""
    return spark.range(1).select(F.lit(" ".join(words)).alias("text"))


def input_error(content: Column, limit: int = INPUT_BYTES) -> Column:
    """Why bytes are refused: ``too large``, ``not UTF-8``, or null."""
    return F.when(F.octet_length(content) > limit, "too large").when(~F.is_valid_utf8(content.cast("string")), "not UTF-8")


def guarded_files(spark: SparkSession, path: str, limit: int = INPUT_BYTES) -> DataFrame:
    """path, text and error of whole files: the text is null where the file is refused. The reader goes by their lengths first, and never opens those that are
    too large."""
    files = spark.read.format("binaryFile").load(path)
    error = input_error(F.col("content"), limit)
    read = files.where(F.col("length") <= limit).select("path", F.when(error.isNull(), F.col("content").cast("string")).alias("text"), error.alias("error"))
    return read.unionByName(files.where(F.col("length") > limit).select("path", F.lit(None).cast("string").alias("text"), F.lit("too large").alias("error")))


def write_report(lines: DataFrame, path: str) -> None:
    """Report lines as text files."""
    lines.select("line").write.mode("overwrite").text(path)
