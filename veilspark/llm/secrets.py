"""Secret scans: patterns, and sliding-window entropy over candidate strings. DataFrame functions only."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.arrays import let, scan
from veilspark.llm.common import table

# The patterns of the base kinds. Runs of at least n characters equal runs that are then checked for n.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
ASSIGN_LEAST = 6

#: Character classes of the entropy scan: name, characters, least bits per character in a window. A candidate is a run of
#: the class, at least a window long, with a digit.
CLASSES = (("entropy_hex", "0-9A-Fa-f", 2.8), ("entropy_base64", "A-Za-z0-9+/_=-", 3.8))
WINDOW = 20
#: Candidates that are known not to be secrets: UUIDs, plain numbers, placeholders, repeated rulers.
ALLOWED = (
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "^[0-9+/_=-]+$",
    "(?i)example|sample|dummy|placeholder|changeme|xxxx|0{8}|1234567",
)

ITEM = "struct<s:int,k:int,e:int,name:string>"
SPAN = f"array<{ITEM}>"
NONE = f"cast(array() as {SPAN})"
CANDIDATE = f"struct<x:{ITEM},m:string>"
NO_CANDIDATES = f"cast(array() as array<{CANDIDATE}>)"


def _spans(found: str, gaps: str, name: str, order: int) -> Column:
    """Positions of the matches ``found`` between the pieces ``gaps`` of the same text: running lengths, in one pass."""
    def step(a: Column, m: Column) -> tuple[Column, Column]:
        s = a["at"] + F.length(F.get(F.col(gaps), a["i"]))
        e = s + F.length(m)
        span = F.struct(s.alias("s"), F.lit(order).alias("k"), e.alias("e"), F.lit(name).alias("name"))
        return F.struct((a["i"] + 1).alias("i"), e.alias("at")), F.array(span)

    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"))
    return F.when(F.size(found) == 0, F.expr(NONE)).otherwise(scan(F.col(found), start, step, ITEM))


def _parts(c: Column, cuts: str, least: int) -> Column:
    """A candidate's parts between placeholders that are long enough: each pattern runs over it once, and one pass places the parts."""
    def step(gaps: Column):
        def one(a: Column, p: Column) -> tuple[Column, Column]:
            e = a["at"] + F.length(p)
            part = F.struct(F.struct(a["at"].alias("s"), c["x"]["k"].alias("k"), e.alias("e"), c["x"]["name"].alias("name")).alias("x"), p.alias("m"))
            after = F.coalesce(F.length(F.get(gaps, a["i"])), F.lit(0))
            return F.struct((a["i"] + 1).alias("i"), (e + after).alias("at")), F.when(F.length(p) >= least, F.array(part)).otherwise(F.expr(NO_CANDIDATES))
        return one

    start = F.struct(F.lit(0).alias("i"), c["x"]["s"].alias("at"))
    found = F.struct(F.split(c["m"], cuts, -1).alias("parts"), F.regexp_extract_all(c["m"], F.lit(cuts), F.lit(0)).alias("gaps"))
    return F.when(c["m"].rlike(cuts), let(found, lambda z: scan(z["parts"], start, step(z["gaps"]), CANDIDATE))).otherwise(F.array(c))


def _apart(candidates: Column, have: Column) -> Column:
    """``candidates`` that no span of ``have`` overlaps. Neither overlap among themselves, so one pass over both in order decides: a candidate waits until the next begins."""
    event = f"struct<s:int,t:int,e:int,c:{CANDIDATE}>"
    none = F.lit(None).cast(CANDIDATE)

    def at(s: Column, t: int, e: Column, c: Column) -> Column:
        return F.struct(s.alias("s"), F.lit(t).alias("t"), e.alias("e"), c.alias("c")).cast(event)

    def step(a: Column, v: Column) -> tuple[Column, Column]:
        span, reach = v["t"] == 0, F.greatest(a["reach"], F.when(v["t"] == 0, v["e"]))
        hit = F.when(span, a["hit"] | F.coalesce(v["s"] < a["c"]["x"]["e"], F.lit(False))).otherwise(a["reach"] > v["s"])
        out = F.when(span | a["hit"] | a["c"].isNull(), F.expr(NO_CANDIDATES)).otherwise(F.array(a["c"]))
        return F.struct(reach.alias("reach"), hit.alias("hit"), F.when(span, a["c"]).otherwise(v["c"]).alias("c")), out

    last = F.array(at(F.lit(2**31 - 1), 1, F.lit(2**31 - 1), none))
    events = F.array_sort(F.concat(F.transform(have, lambda x: at(x["s"], 0, x["e"], none)), F.transform(candidates, lambda c: at(c["x"]["s"], 1, c["x"]["e"], c)), last))
    start = F.struct(F.lit(-1).alias("reach"), F.lit(False).alias("hit"), none.alias("c"))
    return F.when(F.size(have) == 0, candidates).otherwise(scan(events, start, step, CANDIDATE))


def _alphabet(chars: str) -> str:
    """The characters of a class of ASCII characters and ranges."""
    return "".join(c for c in map(chr, range(128)) if re.fullmatch(f"[{chars}]", c))


def _entropy_span(c: str, chars: str, window: int, least: float) -> str:
    """SQL for the first and last end of windows of candidate ``c`` with at least ``least`` bits: a struct (lo, hi), null without any.

    The window moves one character at a time. The count of each character of the class is kept, and one goes up and one
    goes down; of entropy's sum of n log2 n only those two characters' terms change. n log2 n is looked up.
    """
    letters = _alphabet(chars)
    terms = "array(" + ", ".join(f"{n * math.log2(n) if n else 0.0!r}d" for n in range(window + 2)) + ")"

    def let(value: str, name: str, body: str) -> str:
        return f"transform(array({value}), {name} -> {body})[0]"

    def moved(counts: str, at: str, by: int) -> str:
        return f"concat(slice({counts}, 1, {at}), array({counts}[{at}] + {by}), slice({counts}, {at} + 2, {len(letters)}))"

    def place(ch: str) -> str:
        return f"instr('{letters}', {ch}) - 1"

    def state(counts: str, total: str, source: str) -> str:
        return f"named_struct('n', {counts}, 'i', {source}.i, 'sum', {total}, 'lo', {source}.lo, 'hi', {source}.hi)"

    entered = let(place("x.new"), "p", state(moved("a.n", "p", 1), f"a.sum + {terms}[a.n[p] + 1] - {terms}[a.n[p]]", "a"))
    left = f"case when x.old is null then b else {let(place('x.old'), 'q', state(moved('b.n', 'q', -1), f'b.sum + {terms}[b.n[q] - 1] - {terms}[b.n[q]]', 'b'))} end"
    high = f"d.i + 1 >= {window} and log2({window}) - d.sum / {window} >= {least}"
    noted = f"named_struct('n', d.n, 'i', d.i + 1, 'sum', d.sum, 'lo', case when {high} then coalesce(d.lo, d.i + 1 - {window}) else d.lo end, 'hi', case when {high} then d.i + 1 else d.hi end)"
    step = let(entered, "b", let(left, "d", noted))
    start = f"named_struct('n', array_repeat(0, {len(letters)}), 'i', 0, 'sum', 0d, 'lo', cast(null as int), 'hi', cast(null as int))"
    leaving = f"concat(array_repeat(cast(null as string), {window}), slice(v, 1, greatest(size(v) - {window}, 0)))"
    pairs = f"zip_with(v, {leaving}, (new, old) -> named_struct('new', new, 'old', old))"
    return let(f"split({c}, '')", "v", f"aggregate({pairs}, {start}, (a, x) -> {step}, a -> named_struct('lo', a.lo, 'hi', a.hi))")


def scan_secrets(docs: DataFrame, window: int = WINDOW, classes=CLASSES, allowed=ALLOWED) -> DataFrame:
    """doc_id, base and found (arrays of s, k, e, name) for every row of ``docs``: spans of the base kinds, and those with the entropy spans.

    Base kinds are assign, access and hex, each leftmost and not overlapping within its kind; matches that fail their
    length are dropped. The entropy scan adds, for each run of a character class that is long enough, has a digit,
    lies in no entropy span of an earlier class and isn't allow-listed, the stretch from its first to its last
    window of high entropy, also where a base span is: the two then say the same of one secret. Placeholders (allow-list entries that aren't
    anchored) excuse only themselves: a run is cut at them, and its other parts are candidates. Offsets are code points, ends exclusive. Null and
    empty texts have no spans; repeated rows each get a row; other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("t"))
    kinds = [("assign", ASSIGN), ("access", ACCESS), ("hex", HEX)]
    runs = [(name, f"(?<![{c}])[{c}]{{{window},}}") for name, c, _ in classes]
    cols, none = [], F.expr("cast(array() as array<string>)")
    for i, (_, p) in enumerate(kinds + runs):
        p = F.lit(p)
        hit = F.col("t").rlike("[0-9]") if i >= len(kinds) else F.regexp_like(F.col("t"), p)
        cols += [F.when(hit, F.regexp_extract_all("t", p, F.lit(0))).otherwise(none).alias(f"m{i}")]
    rows = rows.select("doc_id", "t", *cols)
    gaps = [F.when(F.size(f"m{i}") > 0, F.split("t", p, -1)).otherwise(none).alias(f"g{i}") for i, (_, p) in enumerate(kinds + runs)]
    rows = rows.select("doc_id", *[f"m{i}" for i in range(len(gaps))], *gaps)
    # spans carry their place in the list of matches as k until they are filtered
    rows = rows.select("doc_id", *[f"m{i}" for i in range(len(gaps))], *[_spans(f"m{i}", f"g{i}", n, i).alias(f"s{i}") for i, (n, _) in enumerate(kinds + runs)])
    good = F.expr("filter(s0, (x, i) -> length(regexp_extract(m0[i], '" + ASSIGN.replace("\\", "\\\\").replace("'", "\\'") + f"', 1)) >= {ASSIGN_LEAST})")
    rows = rows.withColumn("base", F.concat(good, "s1", "s2"))
    anchored = [a for a in allowed if a.startswith("^")]
    cuts = "|".join(f"(?:{a})" for a in allowed if not a.startswith("^"))

    def fine(c: Column) -> Column:
        """Long enough for a window, with a digit, and not allow-listed."""
        good = (F.length(c["m"]) >= window) & c["m"].rlike("[0-9]")
        for a in anchored:
            good = good & ~c["m"].rlike(a)
        return good

    rows = rows.withColumn("h", F.expr(NONE))
    for i, (_, chars, least) in enumerate(classes, len(kinds)):
        both = F.zip_with(f"s{i}", f"m{i}", lambda x, m: F.struct(x.alias("x"), m.alias("m")))
        rows = rows.withColumn("c", _apart(F.filter(both, fine), F.col("h")))
        if cuts:
            rows = rows.withColumn("c", F.filter(F.flatten(F.transform("c", lambda c: _parts(c, cuts, window))), fine))
        span = f"transform(c, c -> named_struct('x', c.x, 'w', {_entropy_span('c.m', chars, window, least)}))"
        add = f"transform(filter({span}, c -> c.w.lo is not null), c -> named_struct('s', c.x.s + c.w.lo, 'k', c.x.k, 'e', c.x.s + c.w.hi, 'name', c.x.name))"
        rows = rows.withColumn("h", F.concat("h", F.expr(f"cast({add} as {SPAN})")))
    return rows.select("doc_id", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", "h")).alias("found"))


def digest(spans: str) -> Column:
    return F.array_join(F.expr(f"transform({spans}, x -> concat(x.name, ':', x.s, ':', x.e))"), ",")


def _oracle() -> str:
    def quoted(p: str) -> str:
        return p.replace("'", "''")

    def found(name: str, pattern: str) -> str:
        p, size = quoted(pattern), "lambda x: length(x)"
        return f"""{name} as (select doc_id, pos as s, pos + length(v) as e, v from (
            select doc_id, ms[i] as v, (coalesce(list_sum(list_transform(gs[1:i], {size})), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], {size})), 0))::bigint as pos from (
                select doc_id, ms, gs, unnest(generate_series(1, len(ms))) as i from (select doc_id, regexp_extract_all(t, '{p}') as ms, regexp_split_to_array(t, '{p}') as gs from d))))"""

    def entropy(w: str) -> str:
        return f"(select log2({WINDOW}) - sum(n * log2(n)) / {WINDOW} from (select count(*)::double as n from (select unnest(string_split({w}, '')) as c) group by c))"

    def fine(v: str) -> str:
        return " or ".join(f"regexp_matches({v}, '{quoted(a)}')" for a in ALLOWED if a.startswith("^"))

    cuts = quoted("|".join(f"(?:{a})" for a in ALLOWED if not a.startswith("^")))
    parts = [found("f0", ASSIGN), found("f1", ACCESS), found("f2", HEX), f"""base as (
        select doc_id, s, 0 as k, e, 'assign' as name from f0 where length(regexp_extract(v, '{quoted(ASSIGN)}', 1)) >= {ASSIGN_LEAST}
        union all select doc_id, s, 1, e, 'access' from f1 union all select doc_id, s, 2, e, 'hex' from f2)""", "h2 as (select * from base where false)"]
    for i, (name, chars, least) in enumerate(CLASSES, 3):
        parts += [found(f"f{i}", f"[{chars}]{{{WINDOW},}}"), f"""r{i} as (select * from f{i} where regexp_matches(v, '[0-9]') and not ({fine('v')})
            and not exists (from h{i - 1} b where b.doc_id = f{i}.doc_id and b.s < f{i}.e and f{i}.s < b.e)), p{i} as (
            select doc_id, s, unnest(generate_series(1, len(gs))) as j, gs, ms from (select doc_id, s, regexp_split_to_array(v, '{cuts}') as gs, regexp_extract_all(v, '{cuts}') as ms from r{i})), c{i} as (
            select * from (select doc_id, (s + coalesce(list_sum(list_transform(gs[1:j - 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:j - 1], lambda x: length(x))), 0))::bigint as s, gs[j] as v from p{i})
            where length(v) >= {WINDOW} and regexp_matches(v, '[0-9]') and not ({fine('v')})), w{i} as (
            select doc_id, s, i, substr(v, i + 1, {WINDOW}) as w from (select *, unnest(generate_series(0, length(v) - {WINDOW})) as i from c{i})), h{i} as (
            select * from h{i - 1} union all select doc_id, s + min(i), {i}, s + max(i) + {WINDOW}, '{name}' from w{i} where {entropy('w')} >= {least} group by doc_id, s)"""]
    have = f"(select * from base union all select * from h{len(CLASSES) + 2})"
    line = "string_agg(name || ':' || s || ':' || e, ',' order by s, k, e)"
    return f"""with d as (select doc_id, coalesce(text, '') as t from documents), {", ".join(parts)},
        b as (select doc_id, {line} as x, count(*) filter (k = 0) as n_assign, count(*) filter (k = 1) as n_access, count(*) filter (k = 2) as n_hex from base group by 1),
        a as (select doc_id, {line} as x from {have} group by 1)
        select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(b.x, '')) as base_sha256, coalesce(a.x, '') as spans
        from d left join b using (doc_id) left join a using (doc_id)"""


ORACLE = _oracle()


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    rows = scan_secrets(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"size(filter(base, x -> x.name = '{n}'))").cast("long").alias(f"n_{n}") for n in ("assign", "access", "hex")]
    return rows.select("doc_id", *counts, F.sha2(digest("base"), 256).alias("base_sha256"), digest("found").alias("spans"))
