"""Kinds of sensitive text: labels, priorities and patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Kind, label shown and stored, priority where detections overlap.
KINDS = (
    ("email", "Email", 3),
    ("phone", "Phone number", 1),
    ("card", "Payment card", 5),
    ("pesel", "Polish PESEL", 4),
    ("ip", "IP address", 2),
    ("custom", "Custom phrase", 6),
)
LABEL = {k: label for k, label, _ in KINDS}
PRIORITY = {k: p for k, _, p in KINDS}

# The kinds' patterns. Word and digit classes are those of Unicode, hence the (?U).
PATTERN = {
    "email": r"(?U)(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    "phone": r"(?U)(?<!\w)(?:\+?\d[\d ()-]{7,}\d)(?!\w)",
    "card": r"(?U)(?<!\d)(?:\d[ -]?){13,19}(?!\d)",
    "pesel": r"(?U)(?<!\d)\d{11}(?!\d)",
    "ip": r"(?U)(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])",
}
#: What a match of any kind but email has in it: texts without are passed over. An email has an at sign.
NUMERIC = r"(?U)\d[\d ().-]{5,}\d"


def kind_table(spark: SparkSession) -> DataFrame:
    """kind, label, priority: a dimension of six rows."""
    return spark.createDataFrame(list(KINDS), "kind string, label string, priority int")
