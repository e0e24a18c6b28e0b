"""Mixing sources to target weights: whole copies first, then Pareto order sampling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.llm.common import n_words, stash, table

SALT = "mix:"
#: Ranks are searched in two histograms of this many steps each, so that no task ever sorts a source.
STEPS = 4096
#: Copies that come into the gap that a source's ranking leaves, each of the document that leaves least of it; boosts count in steps of 1/64, up to 64.
FILLS, BOOST_STEPS, MOST = 4, 64, 64
#: The production query boosts documents of under so many words: texts of many authors rather than a few long ones.
SHORT = 200


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """One row per source of ``sizes`` (source, size, boost): source, source_size, target (words), factor: copies of a document per boost.

    Weights go to the sources by code point, null last, repeating. A source whose share passes ``max_repeats`` times its
    size stops there; with the sources in order of that ratio the water level follows from prefix sums. Within a source boosts are shares of the same
    kind: those of the highest boosts stop at ``max_repeats`` copies, and the level of the others follows. The rows here
    are one per source and boost, after a map-side sum.
    """
    w = F.array(*[F.lit(x) for x in weights])
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    level = Window.orderBy("ratio", F.col("source").isNull(), "source")
    boosts = stash(sizes.groupBy("source", "boost").agg(F.sum("size").alias("n")), "boosts")
    s = boosts.groupBy("source").agg(F.sum("n").alias("source_size"))
    s = s.withColumn("w", F.element_at(w, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * max_repeats).withColumn("ratio", F.col("cap") / F.col("w"))
    before, everything = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0)))
    s = s.withColumn("left_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    s = s.withColumn("level", (F.sum("source_size").over(everything) - F.col("full")) / F.col("left_w"))
    # the first source, in order of the ratio, that stays below its cap sets the level for all that follow it
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"])
    s = s.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(F.col("w") * F.col("level"), F.col("cap").cast("double"))))
    s = s.select("source", "source_size", "target")
    c = boosts.where("n > 0 and boost > 0").join(s.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    high = Window.partitionBy("source").orderBy(F.col("boost").desc())
    above = F.coalesce(F.sum("n").over(high.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    mass = F.sum(F.col("n") * F.col("boost")).over(high.rowsBetween(0, Window.unboundedFollowing))
    c = c.withColumn("factor", (F.col("target") - max_repeats * above) / mass)
    fits = F.col("factor") * F.col("boost") <= max_repeats
    factor = F.coalesce(F.max_by("factor", F.when(fits, F.col("boost"))), max_repeats / F.min("boost"))
    c = c.groupBy("source").agg(factor.alias("factor")).withColumnRenamed("source", "s")
    return s.join(c, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", F.coalesce("factor", F.lit(0.0)).alias("factor"))


def shares(max_repeats: int) -> tuple[Column, Column]:
    """(whole copies, probability of one more) of a document from its source's ``factor`` and its ``boost``."""
    expected = F.least(F.col("factor") * F.col("boost"), F.lit(float(max_repeats)))
    return F.floor(expected).cast("long"), expected - F.floor(expected)


def order(doc_id: Column, rest: Column) -> Column:
    """Random odds over inclusion odds, mapped from (0, inf) to (0, 1); the same for a doc_id in every run."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(SALT), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13), 16, 10)
    u = (h.cast("long") + 0.5) / F.lit(4503599627370496.0)
    q = F.try_divide(u / (1 - u), rest / (1 - rest))  # null where no part of a copy is left
    return q / (1 + q)


def _crossing(rows: DataFrame, step: Column) -> DataFrame:
    """Of each source's histogram by ``step``, the first step whose running size passes ``need``, and the size before it."""
    sums = rows.groupBy("source", step.alias("step")).agg(F.sum("size").alias("n"), F.first("need").alias("need"))
    run = Window.partitionBy("source").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("after", F.sum("n").over(run)).where("after > need")
    return sums.groupBy("source").agg(F.min(F.struct("step", "n", "after", "need")).alias("x")).select(
        F.col("source").alias("at"), F.col("x.step").alias("at_step"), (F.col("x.need") - (F.col("x.after") - F.col("x.n"))).alias("at_need"))


def _cuts(rows: DataFrame) -> DataFrame:
    """(source, cut) of ``rows`` (source, doc_id, size, q, need): the first (q, doc_id) of a source's ranking not taken; sources that never pass their need have none."""
    for scale in (STEPS, STEPS * STEPS):
        step = F.least(F.floor(F.col("q") * scale), F.lit(scale - 1))
        at = _crossing(rows, step)
        rows = rows.join(at, F.col("source").eqNullSafe(F.col("at")) & (step == F.col("at_step"))).select("source", "doc_id", "size", "q", F.col("at_need").alias("need"))
    by_rank = Window.partitionBy("source").orderBy("q", F.col("doc_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    fringe = rows.withColumn("taken", F.sum("size").over(by_rank) <= F.col("need"))
    # the first row not taken, or where its step ends
    mine = F.struct("q", F.coalesce("doc_id", F.lit(-(2**63))).alias("id"))
    end = F.struct(((F.floor(F.max("q") * scale) + 1) / scale).alias("q"), F.lit(-(2**63)).alias("id"))
    return fringe.groupBy("source").agg(F.coalesce(F.min(F.when(~F.col("taken"), mine)), end).alias("cut"))


PLAN = ["source", "source_size", "target", "factor", "cuts", "picks"]


def plan_mix(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """One row per source of ``sized`` (doc_id, source, size, boost): its target, its factor, and who is taken once more: ``cuts`` of its ranking, each with the
    size up to which it holds (null: any, or all of the ranking), and ``picks`` beside them.

    The ranking is cut where a document no longer fits. Where that is a long one much may be missing: the rest of the ranking is then cut once more, without
    documents that don't fit in the gap. Then come up to FILLS copies, each of the document that leaves least of the gap, taken already or not.
    """
    plan = stash(source_targets(sized, weights, max_repeats).withColumns({
        "cuts": F.expr("cast(array() as array<struct<at:struct<q:double,id:bigint>,most:double>>)"), "picks": F.expr("cast(array() as array<struct<q:double,id:bigint>>)")}), "targets")
    whole, rest = shares(max_repeats)
    free = (rest > 0) & (F.col("size") > 0) & (copies(max_repeats) == whole)

    def joined() -> DataFrame:
        return sized.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))

    def beside(found: DataFrame, **cols: Column) -> DataFrame:
        out = plan.join(found.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
        return stash(out.withColumns(cols).select(*PLAN, *(["gap"] if "gap" in out.columns or "gap" in cols else [])), "cuts")

    def with_gap() -> DataFrame:
        taken = joined().groupBy("source").agg(F.sum(F.col("size") * copies(max_repeats)).alias("n"))
        return beside(taken, gap=F.col("target") - F.col("n"))

    plan = with_gap()
    for most in (F.lit(None).cast("double"), F.col("gap")):
        fits = most.isNull() | (F.col("size") <= most)
        cut = _cuts(joined().where(free & fits & (F.col("gap") > 0)).select("source", "doc_id", "size", order(F.col("doc_id"), rest).alias("q"), F.col("gap").alias("need")))
        plan = beside(cut, cuts=F.when(F.col("gap") > 0, F.array_append("cuts", F.struct(F.col("cut").alias("at"), most.alias("most")))).otherwise(F.col("cuts")))
        plan = with_gap()
    for _ in range(FILLS):
        near = (rest > 0) & (F.col("size") > 0) & (copies(max_repeats) < max_repeats) & (F.col("size") < 2 * F.col("gap"))
        best = joined().where(near).groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), _place(rest).alias("at"), "size")).alias("x"))
        plan = beside(best, picks=F.when(F.col("x").isNotNull(), F.array_append("picks", F.col("x.at"))).otherwise(F.col("picks")), gap=F.col("gap") - F.coalesce("x.size", F.lit(0)))
    return plan


def _place(rest: Column) -> Column:
    """A document's place in its source's ranking."""
    return F.struct(order(F.col("doc_id"), rest).alias("q"), F.coalesce("doc_id", F.lit(-(2**63))).alias("id"))


def copies(max_repeats: int) -> Column:
    """How often the mix takes a row that is joined with its source's plan."""
    whole, rest = shares(max_repeats)
    mine = _place(rest)
    cut = F.exists("cuts", lambda c: (c["at"].isNull() | (mine < c["at"])) & (c["most"].isNull() | (F.col("size") <= c["most"])))
    return whole + F.when(rest > 0, cut.cast("long") + F.size(F.filter("picks", lambda p: p == mine))).otherwise(0)


def _boost(docs: DataFrame, boost: str | None) -> Column:
    """A column that isn't null, below zero or no number, to the nearest 1/64 and 64 at most; 1 where it is, or where none is named."""
    if boost is None:
        return F.lit(1.0)
    c = F.col(f"`{boost}`").cast("double")
    return F.when((c >= 0) & (c < float("inf")), F.least(F.floor(c * BOOST_STEPS + 0.5) / BOOST_STEPS, F.lit(float(MOST)))).otherwise(F.lit(1.0))


def sized(docs: DataFrame, boost: str | None = None) -> DataFrame:
    """doc_id, source, size (words) and boost of ``docs``, kept as a small table: the texts are read once."""
    return stash(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _boost(docs, boost).alias("boost")), "sizes")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, boost: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes, repeats counted) and source for every row of ``docs``.

    A document is expected in proportion to its ``boost`` (a column; in steps of 1/64, up to 64), and ``max_repeats`` times at
    most, so that its source meets its target. Whole copies are certain. What is left is a probability below one; Pareto order sampling ranks a source's documents by
    random odds over those inclusion odds, and the front of the ranking is taken once more, up to the source's remaining words; then what fits of the rest of it, as ``plan_mix`` says. Where the limit on repeats leaves words over, all of the
    ranking is taken. Null texts and texts without words
    have size 0 and take 0. A null source is a source of its own, the last. Repeated doc_ids are taken or left together. An
    empty table gives no rows; other columns are ignored.
    """
    rows = sized(docs, boost)
    p = plan_mix(rows, weights, max_repeats).withColumnRenamed("source", "s")
    out = rows.join(p, F.col("source").eqNullSafe(F.col("s")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies(max_repeats)).cast("long").alias("taken"), "source")


def mixed_docs(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, boost: str | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, once for each copy that the mix takes.

    Null texts and texts without words have size 0: they come along as often as their source's whole copies say. A null source is a source of its own;
    rows that share a doc_id are taken equally often; an empty table gives no rows; columns of any names and nulls in them are left alone.
    """
    p = plan_mix(sized(docs, boost), weights, max_repeats).select(F.col("source").alias("_mix_source"), "factor", "cuts", "picks")
    size = n_words(F.col("text"))
    both = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "source", size.alias("size"), _boost(docs, boost).alias("boost"))
    both = both.join(p, F.col("source").eqNullSafe(F.col("_mix_source"))).withColumn("n", copies(max_repeats).cast("int"))
    return both.where("n > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("_row.*")


def op1_pareto_mix(spark, sf_dir: str) -> DataFrame:
    """Documents of under SHORT words count twice: they are likelier than others of their source, which the ranking's odds then show."""
    docs = table(spark, sf_dir, "documents")
    return mix(docs.withColumn("boost", F.when(n_words(F.col("text")) < SHORT, 2.0).otherwise(1.0)), boost="boost")


ORACLE = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
s0 as (select source, sum(size)::bigint as source_size from d group by source),
s1 as (select *, (row_number() over (order by (source is null), source) - 1) % 3 + 1 as w from s0),
s2 as (select *, source_size * 3 as cap, (source_size * 3)::double / w as ratio from s1),
s3 as (select *, coalesce(sum(cap) over (order by ratio, (source is null), source rows between unbounded preceding and 1 preceding), 0) as full_cap,
       sum(w) over () - coalesce(sum(w) over (order by ratio, (source is null), source rows between unbounded preceding and 1 preceding), 0) as left_w,
       sum(source_size) over () as total from s2),
s4 as (select *, (total - full_cap)::double / left_w as lvl from s3),
s5 as (select *, (select lvl from s4 x where x.lvl <= x.ratio order by ratio, lvl limit 1) as level from s4),
s6 as (select source, source_size, least(cap::double, coalesce(w * level, cap::double)) as target from s5),
b0 as (select d.*, case when size < SHORT_WORDS then 2.0 else 1.0 end::double as boost from d),
b1 as (select source, boost, sum(size)::bigint as n from b0 group by 1, 2),
b2 as (select b1.source, boost, (target - 3 * coalesce(sum(n) over (partition by b1.source order by boost desc rows between unbounded preceding and 1 preceding), 0)::bigint)
       / sum(n * boost) over (partition by b1.source order by boost desc rows between current row and unbounded following) as factor from b1 join s6 on b1.source is not distinct from s6.source where n > 0),
b3 as (select source, coalesce(max_by(factor, boost) filter (factor * boost <= 3), 3 / min(boost)) as factor from b2 group by 1),
s7 as (select s6.*, coalesce(factor, 0) as factor from s6 left join b3 on b3.source is not distinct from s6.source),
r as (select b0.doc_id, b0.size, s7.*, floor(least(factor * boost, 3.0::double))::bigint as whole, least(factor * boost, 3.0::double) - floor(least(factor * boost, 3.0::double)) as rest,
      ((('0x' || substr(md5('mix:' || coalesce(b0.doc_id::varchar, '')), 1, 13))::bigint + 0.5) / 4503599627370496.0) as u
      from b0 join s7 on b0.source is not distinct from s7.source),
q0 as (select *, case when rest > 0 then (u / (1 - u)) / (rest / (1 - rest)) end as odds, sum(whole * size) over (partition by source) as certain from r),
q as (select *, odds / (1 + odds) as pos, sum(size) over (partition by source order by odds / (1 + odds), doc_id rows between unbounded preceding and current row) as run from q0),
q1 as (select *, rest > 0 and run <= target - certain as front0 from q),
q2 as (select *, any_value(target) over (partition by source) - sum(size * (whole + front0::int)) over (partition by source) as gap0 from q1),
q3 as (select *, rest > 0 and not front0 and size > 0 and size <= gap0 as late from q2),
q4 as (select *, sum(case when late then size end) over (partition by source order by pos, doc_id rows between unbounded preceding and current row) as run1 from q3),
c0 as (select * exclude (gap0), front0 or (late and gap0 > 0 and run1 <= gap0) as front from q4),
g0 as (select source, any_value(target) - sum(size * (whole + front::int)) as gap, []::bigint[] as picks from c0 group by 1),
FILL_CTES
select c0.doc_id, size, source_size, target, c0.source, (size * (whole + front::int + len(list_filter(picks, lambda p: p = doc_id))))::bigint as taken
from c0 join GAPS g on g.source is not distinct from c0.source
"""
ORACLE = ORACLE.replace("SHORT_WORDS", str(SHORT)).replace("GAPS", f"g{FILLS}").replace("FILL_CTES", ",\n".join(f"""x{i} as (select c0.source, min(row(abs(size - gap), pos, doc_id, size)) as x from c0 join g{i - 1} g on g.source is not distinct from c0.source
    where rest > 0 and whole + front::int + len(list_filter(picks, lambda p: p = doc_id)) < 3 and size > 0 and size < 2 * gap group by 1),
g{i} as (select g.source, gap - coalesce(x[4], 0) as gap, case when x is null then picks else list_append(picks, x[3]) end as picks from g{i - 1} g left join x{i} on x{i}.source is not distinct from g.source)""" for i in range(1, FILLS + 1)))
