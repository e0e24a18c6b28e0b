"""Detection of sensitive text: candidates, validation, overlaps, reports and masking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.arrays import let, scan
from veilspark.functions.kinds import LABEL, NUMERIC, PATTERN, PRIORITY
from veilspark.functions.text import MARKS, ascii_digits, fold, fold_away, folded_away, ipv4_valid, luhn_valid, pesel_valid, spellings, utf16_length, widened, without_marks

SPAN = "struct<start:int,lessLength:int,lessPriority:int,end:int,kind:string,value:string>"
NONE = f"cast(array() as array<{SPAN}>)"


def _matches(df: DataFrame, text: str, name: str, pattern: Column, when: Column) -> DataFrame:
    """``df`` with the matches of a pattern and the gaps between them as arrays: each pattern runs over a text once or twice."""
    none = F.expr("cast(array() as array<string>)")
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    df = df.withColumn(f"_m_{name}", F.coalesce(F.when(when, found), none))
    return df.withColumn(f"_g_{name}", F.when(F.size(f"_m_{name}") > 0, F.split(text, pattern, -1)).otherwise(none))


def _placed(m: Column, g: Column, kind: str, original: Column | None = None) -> Column:
    """Spans of the matches ``m`` from running UTF-16 lengths of gaps ``g`` and matches.

    Values are taken from ``original``, where what was matched is a copy of it with other characters in the same places.
    """
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"), F.lit(0).alias("chars"))

    def step(a: Column, v: Column) -> tuple[Column, Column]:
        gap = F.get(g, a["i"])
        s, c, n = a["at"] + utf16_length(gap), a["chars"] + F.length(gap), utf16_length(v)
        value = v if original is None else F.substring(original, c + 1, F.length(v))
        span = F.struct(s.alias("start"), (-n).alias("lessLength"), F.lit(-PRIORITY[kind]).alias("lessPriority"), (s + n).alias("end"), F.lit(kind).alias("kind"), value.alias("value"))
        return F.struct((a["i"] + 1).alias("i"), (s + n).alias("at"), (c + F.length(v)).alias("chars")), F.array(span)

    return F.when(F.size(m) == 0, F.expr(NONE)).otherwise(scan(m, start, step, SPAN))


VALID = {
    "card": lambda x: luhn_valid(ascii_digits(x["value"])),
    "pesel": lambda x: pesel_valid(ascii_digits(x["value"])),
    "ip": lambda x: ipv4_valid(x["value"]),
}


def with_candidates(df: DataFrame, text: str, kinds: Column | tuple = tuple(PATTERN), phrases: Column | tuple = (), validate: bool = True) -> DataFrame:
    """``df`` with ``candidates``: spans of the enabled kinds and phrases, unresolved. Kinds that are off never run.

    Kinds and phrases are the same for all rows, or columns of arrays, so that each row has those of its own settings; null arrays hold nothing.
    """
    own = isinstance(kinds, Column)
    out = []
    df = df.withColumn("_may", F.col(text).rlike(NUMERIC))
    for kind in PATTERN:
        if own or kind in kinds:
            may = F.contains(F.col(text), F.lit("@")) if kind == "email" else F.col("_may")
            df = _matches(df, text, kind, F.lit(PATTERN[kind]), may & F.array_contains(kinds, kind) if own else may)
            found = _placed(F.col(f"_m_{kind}"), F.col(f"_g_{kind}"), kind)
            out.append(F.filter(found, VALID[kind]) if validate and kind in VALID else found)
    if isinstance(phrases, Column) or (any(phrases) and (own or "custom" in kinds)):
        # folding keeps positions; combining marks after a letter belong to it
        df = df.withColumn("_folded", fold(F.col(text))).withColumn("_plain", widened(without_marks(F.col("_folded"))))
        found = _phrase_spans(F.col(text), F.col("_folded"), F.col("_plain"), phrases)
        on = F.array_contains(kinds, "custom") if own else F.lit("custom" in kinds)
        out.append(F.coalesce(F.when(on, found), F.expr(NONE)))
    df = df.withColumn("candidates", F.coalesce(F.concat(*out) if out else F.expr(NONE), F.expr(NONE)))
    return df.drop("_may", "_folded", "_plain", *[f"_{x}_{kind}" for kind in PATTERN for x in "mg"])


def _phrase_spans(text: Column, folded: Column, plain: Column, phrases: Column | tuple) -> Column:
    """Spans of every phrase. One that isn't in the text without marks costs a search for a constant; the others' patterns give the places."""
    if isinstance(phrases, Column):
        known = F.transform(phrases, lambda p: let(widened(fold_away(p)), lambda f: F.struct(f.alias("plain"), _quoted(f).alias("pattern"))))
    else:
        pairs = [(f, _pattern(f)) for f in map(folded_away, phrases) if f]
        known = F.array(*[F.struct(F.lit(f).alias("plain"), F.lit(p).alias("pattern")) for f, p in pairs]) if pairs else F.expr("cast(array() as array<struct<plain:string,pattern:string>>)")
    hit = F.filter(known, lambda p: (p["plain"] != "") & F.contains(plain, p["plain"]))

    def found(p: Column) -> Column:
        both = F.struct(F.regexp_extract_all(folded, p["pattern"], F.lit(0)).alias("m"), F.split(folded, p["pattern"], -1).alias("g"))
        return let(both, lambda x: _placed(x["m"], x["g"], "custom", original=text))

    return F.flatten(F.transform(hit, found))


#: Private characters that stand for the runs of letters with several spellings while a pattern is made, and the patterns of these.
HELD = {chr(0xE100 + i): run for i, run in enumerate(spellings())}
SPELT = {run: "(?:" + "|".join("".join(f"{x}{MARKS}*" for x in way) for way in ways) + ")" for run, ways in spellings().items()}


def _pattern(plain: str) -> str:
    """A pattern of the characters of a folded phrase, each with any marks behind it, and of all spellings of runs that have several."""
    for one, run in HELD.items():
        plain = plain.replace(run, one)
    return "".join(SPELT[HELD[c]] if c in HELD else f"\\Q{c}\\E{MARKS}*" for c in plain)


def _quoted(c: Column) -> Column:
    """As ``_pattern``."""
    for one, run in HELD.items():
        c = F.replace(c, F.lit(run), F.lit(one))
    c = F.regexp_replace(c, "(?s)(.)", F.lit("\\\\Q$1\\\\E" + MARKS.replace("\\", "\\\\") + "*"))
    for one, run in HELD.items():
        c = F.replace(c, F.lit(f"\\Q{one}\\E{MARKS}*"), F.lit(SPELT[run]))
    return c


def resolved(candidates: Column) -> Column:
    """Of spans in order of start, then longest, then priority, those that touch no span kept before."""
    def step(end: Column, x: Column) -> tuple[Column, Column]:
        free = x["start"] >= end
        return F.when(free, x["end"]).otherwise(end), F.when(free, F.array(x)).otherwise(F.expr(NONE))

    return F.when(F.size(candidates) == 0, F.expr(NONE)).otherwise(scan(F.array_sort(candidates), F.lit(-1), step, SPAN))


def with_detections(df: DataFrame, text: str, kinds: Column | tuple = tuple(PRIORITY), phrases: Column | tuple = ()) -> DataFrame:
    """``df`` with ``detections``: an array of spans (start, end in UTF-16 code units, kind, value). Null text has none."""
    return with_candidates(df, text, kinds, phrases).withColumn("detections", resolved(F.col("candidates"))).drop("candidates")


def spans(df: DataFrame, key: str, array: str = "detections") -> DataFrame:
    """One row per span. The outer form keeps the optimizer from running the patterns again in a filter it would infer."""
    df = df.select(key, F.explode_outer(array).alias("x")).where("x is not null")
    return df.select(key, F.col("x.start").cast("long").alias("start"), F.col("x.end").cast("long").alias("end"), F.col("x.kind").alias("kind"), F.col("x.value").alias("value"))


def label(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in LABEL.items() for x in pair])[kind]


def report(df: DataFrame, key: str) -> DataFrame:
    """Lines of a report on ``detections``: one per detection in order, or one that says there are none."""
    lines = F.transform("detections", lambda x: F.concat(label(x["kind"]), F.lit(" at characters "), x["start"], F.lit("-"), x["end"]))
    lines = F.when(F.size("detections") == 0, F.array(F.lit("No supported PII detected"))).otherwise(lines)
    return df.select(key, F.posexplode(lines).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


def redacted(text: str) -> Column:
    """``text`` with every detection replaced by its kind in brackets, cut by UTF-16 code units as spans count them."""
    def piece(units: Column, at: Column, end: Column) -> Column:
        return F.decode(F.substring(units, 2 * at + 1, 2 * (end - at)), "UTF-16BE")

    def masked(units: Column) -> Column:
        spans = F.col("detections")
        before = F.transform(spans, lambda x, i: F.concat(piece(units, F.coalesce(F.get(spans, i - 1)["end"], F.lit(0)), x["start"]), F.lit("["), x["kind"], F.lit("]")))
        return F.concat(F.array_join(before, ""), piece(units, F.element_at(spans, -1)["end"], F.octet_length(units)))

    # bound, so that a text is encoded once
    return F.when(F.size("detections") == 0, F.col(text)).otherwise(let(F.encode(F.col(text), "UTF-16BE"), masked))
