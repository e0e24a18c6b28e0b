"""DuckDB SQL for the detection queries.

DuckDB's patterns have no lookaround. Runs of the characters that a lookaround tests are wrapped in marks instead (L, R and,
for a plus after a word character, X: private-use code points), matched with the marks, and the marks are then taken out.
"""

from __future__ import annotations

from veilspark.functions.kinds import LABEL, PRIORITY

L, R, X = "\ue000", "\ue001", "\ue002"
DIGIT, WORD = r"\p{Nd}", r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}"
# The kinds' patterns as in functions/kinds.py, with marks in place of lookaround.
MARKED = {
    "email": ("t", r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"),
    "phone": (f"replace(regexp_replace(t, '([{WORD}]+)', '{L}\\1{R}', 'g'), '{R}+', '{R}{X}')", rf"\+?{L}{DIGIT}(?:[{L}{R}]*[{DIGIT} ()-]){{7,}}[{L}{R}]*{DIGIT}{R}"),
    "card": (f"regexp_replace(t, '({DIGIT}+)', '{L}\\1{R}', 'g')", rf"{L}(?:{DIGIT}(?:{R}[ -]{L})?){{12,18}}{DIGIT}{R}"),
    "pesel": (f"regexp_replace(t, '({DIGIT}+)', '{L}\\1{R}', 'g')", rf"{L}{DIGIT}{{11}}{R}"),
    "ip": (f"regexp_replace(t, '([{DIGIT}.]+)', '{L}\\1{R}', 'g')", rf"{L}(?:{DIGIT}{{1,3}}\.){{3}}{DIGIT}{{1,3}}{R}"),
}
LABELS = "case kind " + " ".join(f"when '{k}' then '{x}'" for k, x in LABEL.items()) + " end"
#: The digits of other scripts that planted texts have.
OTHER_DIGITS = "٠١٢٣٤٥٦٧٨٩０１２３４５６７８９"


def plain(x: str) -> str:
    return f"replace(translate({x}, '{L}{R}', ''), '{X}', '+')"


def units(x: str) -> str:
    """Length of ``x`` in UTF-16 code units."""
    return f"(length({x}) + length(regexp_replace({x}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


def kind_sql(kind: str, source: str) -> str:
    """(id, start, end, kind, value, c0, c1) of the raw matches of ``kind`` in ``source`` (id, t); c0 and c1 count code points."""
    marked, pattern = MARKED[kind]
    longer = "case when regexp_matches(gs[i + 1], '^[ -][^" + L + "]') or (gs[i + 1] in (' ', '-') and i = len(ms)) then gs[i + 1][1:1] else '' end" if kind == "card" else "''"
    front = plain("array_to_string(gs[1:i], '') || array_to_string(ms[1:i - 1], '')")
    return f"""select id, {units('front')}::bigint as "start", ({units('front')} + {units('v')})::bigint as "end", '{kind}' as kind, v as value, length(front) as c0, length(front) + length(v) as c1 from (
        select id, {front} as front, {plain('ms[i]')} || {longer} as v
        from (select id, ms, gs, unnest(generate_series(1, len(ms))) as i from (
            select id, regexp_extract_all(m, '{pattern}') as ms, regexp_split_to_array(m, '{pattern}') as gs from (select id, {marked} as m from {source}))))"""


def digits(v: str) -> str:
    return f"regexp_replace(translate({v}, '{OTHER_DIGITS}', '01234567890123456789'), '[^0-9]', '', 'g')"


def luhn(d: str) -> str:
    return f"list_sum(list_transform(generate_series(1, length({d})), lambda i: case when (length({d}) - i) % 2 = 0 then {d}[i:i]::int when {d}[i:i]::int * 2 > 9 then {d}[i:i]::int * 2 - 9 else {d}[i:i]::int * 2 end)) % 10 = 0"


def pesel(d: str) -> str:
    return f"(10 - list_sum(list_transform(generate_series(1, 10), lambda i: {d}[i:i]::int * [1, 3, 7, 9, 1, 3, 7, 9, 1, 3][i])) % 10) % 10 = {d}[11:11]::int"


VALID = {
    "card": lambda: f"length({digits('value')}) between 13 and 19 and {luhn(digits('value'))}",
    "pesel": lambda: pesel(digits("value")),
    "ip": lambda: "list_bool_and(list_transform(string_split(value, '.'), lambda p: coalesce(try_cast(regexp_extract(p, '^[0-9]+$') as int), 999) <= 255))",
}


def phrase_sql(phrase: str, source: str) -> str:
    p = phrase.lower()
    return f"""select id, {units('t[1:pos]')}::bigint as "start", ({units('t[1:pos]')} + {len(phrase)})::bigint as "end", 'custom' as kind, t[pos + 1:pos + {len(phrase)}] as value, pos as c0, pos + {len(phrase)} as c1 from (
        select id, t, (coalesce(list_sum(list_transform(gs[1:i], lambda x: length(x))), 0) + (i - 1) * {len(phrase)})::bigint as pos
        from (select id, t, gs, unnest(generate_series(1, len(gs) - 1)) as i from (
            select id, t, string_split(lower(strip_accents(t)), strip_accents('{p}')) as gs from {source})))"""


def candidates_sql(source: str, kinds, phrases=(), valid: bool = True) -> str:
    parts = []
    for k in kinds:
        if k in MARKED:
            where = f" where {VALID[k]()}" if valid and k in VALID else ""
            parts.append(f"select * from ({kind_sql(k, source)}) as {k}_found{where}")
    parts += [phrase_sql(p, source) for p in phrases]
    return " union all ".join(parts)


def resolved_ctes() -> str:
    """CTEs from cand to det (id, start, end, kind, value, c0, c1): overlaps resolved by a walk over each text's ordered candidates."""
    rank = "case kind " + " ".join(f"when '{k}' then {p}" for k, p in PRIORITY.items()) + " end"
    return f"""ord as (select *, row_number() over (partition by id order by "start", "end" - "start" desc, {rank} desc) as rn from cand),
    walk as (select id, rn, "end" as reach, true as kept from ord where rn = 1
        union all select o.id, o.rn, case when o."start" >= w.reach then o."end" else w.reach end, o."start" >= w.reach
        from walk w join ord o on o.id = w.id and o.rn = w.rn + 1),
    det as (select o.id, o."start", o."end", o.kind, o.value, o.c0, o.c1 from ord o join walk w using (id, rn) where w.kept)"""


def detections_ctes(source_sql: str, kinds=tuple(MARKED), phrases=()) -> str:
    """CTEs from the texts (id, t) of ``source_sql`` to det."""
    return f"src as ({source_sql}), cand as ({candidates_sql('src', kinds, phrases)}), {resolved_ctes()}"
