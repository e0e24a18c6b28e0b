"""Settings as rows of keys and values, with defaults; modes and resolutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.kinds import KINDS

# Modes of clearing, resolutions, and defaults of all settings.
CLEAR_MODES = ("quick", "balanced", "strict", "safe")
RESOLUTIONS = (("p720", 1280, 720), ("p1080", 1920, 1080), ("p1440", 2560, 1440))
DEFAULTS = {"isEnabled": "true", "delaySeconds": "2", "clearMode": "balanced", "captureResolution": "p720", "captureFPS": "10", "showsCursor": "true", "customPhrases": "[]"}


def required_checks(mode: Column, checks_per_second: Column) -> Column:
    adaptive = F.when(checks_per_second < 10, 5).otherwise(10)
    return F.when(mode == "quick", 3).when(mode == "strict", 10).otherwise(adaptive)


def requires_manual(mode: Column) -> Column:
    return mode == "safe"


def known_or(value: Column, known, default: str) -> Column:
    return F.when(value.isin(*known), value).otherwise(F.lit(default))


def resolution(name: Column) -> Column:
    """(width, height) of a resolution; unknown names mean the first."""
    out = F.struct(F.lit(RESOLUTIONS[0][1]).alias("width"), F.lit(RESOLUTIONS[0][2]).alias("height"))
    for n, w, h in RESOLUTIONS[1:]:
        out = F.when(name == n, F.struct(F.lit(w).alias("width"), F.lit(h).alias("height"))).otherwise(out)
    return out


def settings(rows: DataFrame, owner: str, owners: DataFrame | None = None) -> DataFrame:
    """One row per ``owner`` of typed settings from rows (owner, key, value); missing and unreadable values take their defaults.

    With ``owners`` (owner), each of those has a row, and no other: owners without rows have the defaults. Custom phrases are a JSON array of texts.
    ``kinds`` and ``phrases`` are what ``with_detections`` takes as columns.
    """
    keys = [*DEFAULTS, *(f"kind.{label}" for _, label, _ in KINDS)]
    wide = rows.groupBy(owner).pivot("key", keys).agg(F.max("value"))
    if owners is not None:
        wide = owners.select(owner).distinct().join(wide, owner, "left")

    def get(key: str, kind: str) -> Column:
        default = DEFAULTS.get(key, "true")
        return F.coalesce(F.col(f"`{key}`").try_cast(kind), F.lit(default).cast(kind))

    on = F.filter(F.array(*[F.when(get(f"kind.{label}", "boolean"), F.lit(k)) for k, label, _ in KINDS]), lambda x: x.isNotNull())
    phrases = F.filter(F.coalesce(F.from_json("customPhrases", "array<string>"), F.from_json(F.lit(DEFAULTS["customPhrases"]), "array<string>")), lambda x: x.isNotNull())
    return wide.select(
        owner, get("isEnabled", "boolean").alias("is_enabled"), get("delaySeconds", "double").alias("delay_seconds"),
        known_or(F.col("clearMode"), CLEAR_MODES, "balanced").alias("clear_mode"),
        known_or(F.col("captureResolution"), [r[0] for r in RESOLUTIONS], "p720").alias("resolution"),
        get("captureFPS", "long").alias("fps"), get("showsCursor", "boolean").alias("shows_cursor"), on.alias("kinds"), phrases.alias("phrases"))


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of equal keys."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"))
