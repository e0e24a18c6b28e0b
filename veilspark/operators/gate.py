"""The gate: blocked until enough clean checks in a row, a delay and, after a detection, an approval."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.operators.bursts import detected_reason

# The gate's reasons, and the clean checks it needs where nothing is set.
WAITING, PROTECTED, MANUAL = "Waiting for a privacy check", "Protected", "Manual clearance required"
CHECKS = 5
DELAYED, APPROVAL = "Clean checks passed · waiting for stream delay", "Clean checks passed · approval required"


def checking(checks: int, required: int) -> str:
    """What a gate says while it counts."""
    return f"Checking for PII · {checks}/{required} clean bursts"


@dataclass
class Gate:
    """The state of one stream's gate, and how an event changes it: what streams keep, where ``gate_states`` has windows."""

    blocked: bool = True
    reason: str = WAITING
    checks: int = 0
    manual: bool = False
    delay: bool = False
    detected: bool = False

    def event(self, kind: str, reason: str | None, required: int, by_hand: bool, delayed: bool) -> None:
        if kind in ("detected", "inconclusive", "reset"):
            self.blocked, self.reason, self.checks, self.manual, self.delay = True, reason or "", 0, False, False
            self.detected = kind == "detected" or (self.detected and kind != "reset")
        elif kind == "clean":
            self._clean(required, by_hand, delayed)
        elif kind == "delay_complete" and self.delay:
            self.delay = False
            self._finish(by_hand)
        elif kind == "approve" and self.manual:
            self.blocked, self.reason, self.checks, self.manual, self.delay, self.detected = False, PROTECTED, 0, False, False, False
        elif kind == "deny" and self.manual:
            self.blocked, self.reason = True, MANUAL

    def values(self) -> tuple:
        return self.blocked, self.reason, self.checks, self.manual, self.delay, self.detected

    def shown(self) -> tuple:
        return self.blocked, self.reason, self.checks, self.manual, self.delay

    def _clean(self, required: int, by_hand: bool, delayed: bool) -> None:
        if self.delay or self.manual:
            self.reason = DELAYED if self.delay else MANUAL
        elif not self.blocked:
            self.reason = PROTECTED
        else:
            self.checks += 1
            self.reason = checking(self.checks, required)
            if self.checks >= required:
                if delayed:
                    self.delay, self.reason = True, DELAYED
                else:
                    self._finish(by_hand)

    def _finish(self, by_hand: bool) -> None:
        if by_hand and self.detected:
            self.manual, self.reason = True, APPROVAL
        else:
            self.blocked, self.reason, self.detected = False, PROTECTED, False


STATE = "is_blocked boolean, reason string, clean_checks long, pending_manual boolean, pending_delay boolean"
HARD = ("detected", "inconclusive", "reset")


def with_defaults(events: DataFrame, *cols) -> DataFrame:
    """``cols`` of ``events``, event and reason, and the settings: a null number of checks is CHECKS, null flags are off."""
    return events.select(
        *cols, "event", "reason", F.coalesce(F.col("required_checks").cast("long"), F.lit(CHECKS).cast("long")).alias("required_checks"),
        F.coalesce("requires_manual", F.lit(False)).alias("requires_manual"), F.coalesce("requires_delay", F.lit(False)).alias("requires_delay"))


def gate_states(events: DataFrame, key: str = "stream_id", order: str = "seq", *more: str) -> DataFrame:
    """``key``, ``order`` and the gate's state after every event, for any configuration, by running windows.

    events has ``key``, ``order`` (and ``more`` columns that break its ties), event, reason, required_checks, requires_manual, requires_delay.
    A null key is a stream of its own. Events that block cut a stream into stretches. Within one, the first clean check that is enough, the
    end of the delay, and the first approval follow from running counts. One thing crosses the cuts: whether something was
    detected since the gate last opened; each cut sets it, clears it (a reset, or a stretch before that opened even so) or leaves it.
    """
    by = [order, *more]
    hard, clean = F.coalesce(F.col("event").isin(*HARD), F.lit(False)), F.col("event") == "clean"
    rows = with_defaults(events, key, *by)
    w = Window.partitionBy(key).orderBy(*by, "event", "reason").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_cut", F.count_if(hard).over(w))
    g = Window.partitionBy(key, "_cut").orderBy(*by, "event", "reason").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_run", F.count_if(clean).over(g))
    enough = clean & (F.col("_run") >= F.col("required_checks"))
    rows = rows.withColumns({"_top": F.min(F.when(enough, F.col("_run"))).over(g), "_wait": F.first(F.when(enough, F.col("requires_delay")), True).over(g)})
    ends = F.when(F.col("_wait"), F.col("event") == "delay_complete").otherwise(enough & (F.col("_run") == F.col("_top")))
    rows = rows.withColumns({"_ends": F.count_if(ends).over(g), "_hand": F.first(F.when(ends, F.col("requires_manual")), True).over(g), "_end": F.coalesce(ends, F.lit(False))})
    over = F.col("_ends") > 0
    rows = rows.withColumn("_yes", F.count_if(over & (F.col("event") == "approve")).over(g))
    # opened even if something was detected before the stretch
    rows = rows.withColumn("_open", over & (~F.col("_hand") | (F.col("_yes") > 0)))
    along = Window.partitionBy(key).orderBy("_cut", *by, "event", "reason")
    opened = F.coalesce(F.lag("_open").over(along), F.lit(False))
    rows = rows.withColumn("_set", F.when(F.col("event") == "detected", True).when((F.col("event") == "reset") | (hard & opened), False))
    hit = F.coalesce(F.last("_set", True).over(along.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False))
    rows = rows.withColumn("_hit", hit)
    asked = F.col("_hit") & over & F.col("_hand")
    manual, delay, open_ = asked & (F.col("_yes") == 0), F.coalesce(F.col("_wait") & ~over, F.lit(False)), over & (~F.col("_hit") | F.col("_open"))
    checks = F.when(asked & (F.col("_yes") > 0), F.lit(0).cast("long")).otherwise(F.least("_run", "_top"))
    first_end = F.col("_end") & (F.col("_ends") == 1)
    said = (
        F.when(hard, F.coalesce("reason", F.lit("")))
        .when(clean & delay, DELAYED).when(first_end, F.when(manual, APPROVAL).otherwise(PROTECTED)).when(clean & manual, MANUAL).when(clean & open_, PROTECTED)
        .when(clean, F.concat(F.lit("Checking for PII · "), F.col("_run"), F.lit("/"), F.col("required_checks"), F.lit(" clean bursts")))
        .when((F.col("event") == "approve") & asked & (F.col("_yes") == 1), PROTECTED).when((F.col("event") == "deny") & manual, MANUAL)
    )
    state = {"is_blocked": ~open_, "clean_checks": checks, "pending_manual": manual, "pending_delay": delay, "_said": said}
    rows = rows.withColumns(state).withColumn("reason", F.coalesce(F.last("_said", True).over(g), F.lit(WAITING)))
    return rows.select(key, *by, "is_blocked", "reason", "clean_checks", "pending_manual", "pending_delay")


def gate_timed(events: DataFrame, delay: Column | float, key: str = "stream_id", order: str = "seq", ts: str = "ts") -> DataFrame:
    """As ``gate_states``, with the clearance timer kept by the operator: no delay_complete events are needed.

    The timer is set when a delay begins to be waited for, to ``delay`` after that event's ``ts``; a verdict that isn't clean, or a reset, drops
    it; one that is due at an event's time goes off before it, under the settings of the event before.
    """
    hard, clean = F.coalesce(F.col("event").isin(*HARD), F.lit(False)), F.col("event") == "clean"
    rows = with_defaults(events.withColumn("_delay", delay if isinstance(delay, Column) else F.lit(delay)), key, ts, order, "_delay")
    w = Window.partitionBy(key).orderBy(ts, order, "event", "reason")
    # an event that blocks ends the stretch before it: a timer may go off right before
    rows = rows.withColumns({"_part": F.count_if(hard).over(w.rowsBetween(Window.unboundedPreceding, 0)) - hard.cast("long"), "_hand": F.lag("requires_manual").over(w)})
    g = Window.partitionBy(key, "_part").orderBy(ts, order, "event", "reason")
    now, before = g.rowsBetween(Window.unboundedPreceding, 0), g.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_enough", clean & (F.count_if(clean).over(now) >= F.col("required_checks")))
    rows = rows.withColumns({"_wait": F.first(F.when(F.col("_enough"), F.col("requires_delay")), True).over(before), "_due": F.first(F.when(F.col("_enough"), F.col(ts) + F.col("_delay")), True).over(before)})
    due = F.coalesce(F.col("_wait") & (F.col(ts) >= F.col("_due")), F.lit(False))
    rows = rows.withColumn("_fires", due & (F.count_if(due).over(now) == 1))
    own = F.struct(F.lit(1).alias("_sub"), F.col("event").alias("event"), F.col("requires_manual").alias("hand"))
    timer = F.struct(F.lit(0).alias("_sub"), F.lit("delay_complete").alias("event"), F.col("_hand").alias("hand"))
    rows = rows.select(key, ts, order, "reason", "required_checks", "requires_delay", F.explode(F.when(F.col("_fires"), F.array(timer, own)).otherwise(F.array(own))).alias("x"))
    rows = rows.select(key, ts, order, "x._sub", "x.event", "reason", "required_checks", F.col("x.hand").alias("requires_manual"), "requires_delay")
    return gate_states(rows, key, ts, order, "_sub").where("_sub = 1").drop(ts, "_sub")


# What a gate says after control events.
CONTROL = {"settings": "Settings changed · checking again", "stop": "Preview stopped", "error": "Capture stopped", "failed": "Screen Recording permission required"}
FILLING, NOT_TRUSTED = "Filling delayed stream buffer", "Accessibility permission required"
WARMING, BUFFERING = ("Filling ", "-second buffer"), ("Buffering for ", " seconds before checks begin")


def filling(seconds: float | None) -> str:
    """What a gate says while the buffer fills: the delay cut to whole seconds."""
    return str(int(seconds or 0)).join(WARMING)


def control_events(controls: DataFrame) -> DataFrame:
    """``controls`` (control, delay seconds, trusted) with the event and the reason that a gate gets for each: all reset it.

    ``start`` says that the buffer is being filled, or that permission is lacking; ``warm_up`` names the delay in whole seconds; ``failed`` is a start that the
    screen may not be captured for.
    """
    c = F.col("control")
    reason = F.when(c == "warm_up", F.concat(F.lit(WARMING[0]), whole_seconds(F.col("delay")), F.lit(WARMING[1])))
    reason = reason.when(c == "start", F.when(F.col("trusted"), FILLING).otherwise(NOT_TRUSTED))
    for name, text in CONTROL.items():
        reason = reason.when(c == name, text)
    return controls.withColumn("event", F.when(reason.isNotNull(), "reset")).withColumn("reason", reason).where("event is not null")


def whole_seconds(delay: Column) -> Column:
    """A delay as status texts show it: cut to whole seconds."""
    return delay.cast("long").cast("string")


def buffering_status(delay: Column) -> Column:
    return F.concat(F.lit(BUFFERING[0]), whole_seconds(delay), F.lit(BUFFERING[1]))


def generations(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``events`` (event; control null for verdicts) with ``lifecycle`` and ``clearance`` as of each: starts, stops and errors begin a
    new lifecycle, and so do settings while a preview is wanted (from a start to a stop or an error); verdicts that aren't clean outdate the clearance that was
    asked for."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    wanted = F.last(F.when(F.col("control") == "start", True).when(F.col("control").isin("stop", "error"), False), True).over(w)
    events = events.withColumn("_wanted", F.coalesce(wanted, F.lit(False)))
    begins = F.col("control").isin("start", "stop", "error") | ((F.col("control") == "settings") & F.col("_wanted"))
    lost = F.col("control").isNull() & F.col("event").isin("detected", "inconclusive")
    return events.withColumns({"lifecycle": F.count_if(begins).over(w), "clearance": F.count_if(lost).over(w)}).drop("_wanted")


def valid_answers(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``events`` without the answers (approve, deny) that were asked for in another lifecycle or clearance.

    Answers carry ``asked_lifecycle`` and ``asked_clearance``; whether an approval is still waited for is the gate's to say.
    """
    df = generations(events, key, order)
    same = F.col("asked_lifecycle").eqNullSafe(F.col("lifecycle")) & F.col("asked_clearance").eqNullSafe(F.col("clearance"))
    return df.where(~F.col("event").isin("approve", "deny") | same)


def gate_events(verdicts: DataFrame) -> DataFrame:
    """``verdicts`` (status, app, kinds, reason, as of snapshots) with the event and the reason that a gate gets for each."""
    event = F.when(F.col("status").isin("clean", "detected"), F.col("status")).otherwise("inconclusive")
    reason = F.when(F.col("status") == "detected", detected_reason(F.col("app"), F.col("kinds"))).when(F.col("status") != "clean", F.col("reason"))
    return verdicts.withColumn("event", event).withColumn("reason", reason)


def approval_alerts(states: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows at which an approval begins to be waited for: one alert each."""
    w = Window.partitionBy(key).orderBy(*order)
    was = F.lag("pending_manual", 1, False).over(w)
    return states.withColumn("_was", was).where(F.col("pending_manual") & ~F.col("_was")).drop("_was")


def clean_runs(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``events`` with ``run``: clean events in a row up to each, 0 at others."""
    w = Window.partitionBy(key).orderBy(*order)
    df = events.withColumn("_group", F.sum(F.when(F.col("event") != "clean", 1).otherwise(0)).over(w))
    g = Window.partitionBy(key, "_group").orderBy(*order)
    return df.withColumn("run", F.count_if(F.col("event") == "clean").over(g).cast("long"))


def gate_basic(events: DataFrame, key: str, order: list[str], required: Column) -> DataFrame:
    """Windows suffice for a gate without delay and approval: blocked where the run of clean events is short."""
    return clean_runs(events, key, order).withColumn("is_blocked", F.col("run") < required).drop("_group")


def gate_delayed(events: DataFrame, key: str, order: list[str], ts: str, required: Column, delay: Column) -> DataFrame:
    """As ``gate_basic`` with a delay from the last check that was needed; a delay that ends at an event's time ends before it."""
    df = clean_runs(events, key, order)
    g = Window.partitionBy(key, "_group").orderBy(*order)
    passed = F.max(F.when(F.col("run") == required, F.col(ts))).over(g)
    return df.withColumn("is_blocked", ~F.coalesce(F.col(ts) >= passed + delay, F.lit(False))).drop("_group")


def transitions(states: DataFrame, key: str, order: list[str], flag: str = "is_blocked") -> DataFrame:
    """Rows where ``flag`` differs from the one before; the first counts as a change from blocked."""
    w = Window.partitionBy(key).orderBy(*order)
    return states.withColumn("_was", F.lag(flag, 1, True).over(w)).where(F.col(flag) != F.col("_was")).drop("_was")


def status_line(blocked: Column, reason: Column) -> Column:
    return F.when(blocked, F.concat(F.lit("Protection: preview blocked: "), reason)).otherwise("Protection: preview safe to share")


def footer(blocked: Column, delay: Column) -> Column:
    return F.concat(F.lit("  "), F.format_string("%.1f", delay), F.lit(" s delayed · "), F.when(blocked, "blocked").otherwise("protected"), F.lit("  "))
