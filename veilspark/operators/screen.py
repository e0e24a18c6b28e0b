"""Screen snapshots: which applications are scanned, the traversal of their elements, and one verdict per snapshot."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.text import longer_than, readable
from veilspark.operators.detect import with_detections
from veilspark.session import stash

# Why a scan fails, and where.
UNSUPPORTED, UNMATCHED, TOO_MANY, SILENT = "Accessibility unsupported in ", "Unable to match ", "Accessibility window limit exceeded in ", "No readable Accessibility text in "
OFF_DISPLAY, TIMED_OUT, INCOMPLETE = " windows to the captured display", "Accessibility scan timed out in ", "Accessibility scan incomplete in "
NO_PERMISSION, NO_TARGET, NO_APP, ANY_APP, UNNAMED = "Accessibility permission required", "Capture target unavailable", "No supported app window on the captured display", "captured display", "Captured app"
# Limits beyond which a scan counts as incomplete, and the errors of an attribute that don't matter.
MAX_WINDOWS, MAX_ELEMENTS, MAX_CHILDREN, MAX_CHARS, DEADLINE_MS = 4, 1500, 300, 20_000, 150
BENIGN = ("noValue", "attributeUnsupported")


def intersects(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    """Whether two rectangles share more than an edge."""
    return (ax < bx + bw) & (bx < ax + aw) & (ay < by + bh) & (by < ay + ah)


def captured_apps(windows: DataFrame, apps: DataFrame, scans: DataFrame) -> DataFrame:
    """snapshot_id, pid, name, app_ord: applications with a visible window on the captured display, front to back.

    windows (snapshot_id, z_order, pid, x, y, w, h), apps (snapshot_id, pid, name, policy, hidden), scans (snapshot_id, own_pid,
    bx, by, bw, bh). A pid counts once, at its first window that passes all conditions.
    """
    seen = windows.where("w > 1 and h > 1").join(scans, "snapshot_id").where(F.col("pid") != F.col("own_pid"))
    seen = seen.where(intersects(*map(F.col, ("x", "y", "w", "h", "bx", "by", "bw", "bh"))))
    seen = seen.join(apps, ["snapshot_id", "pid"]).where("policy <> 'prohibited' and not hidden")
    first = seen.groupBy("snapshot_id", "pid").agg(F.min_by("name", "z_order").alias("name"), F.min("z_order").alias("z"))
    order = Window.partitionBy("snapshot_id").orderBy("z", "pid")
    return first.select("snapshot_id", "pid", "name", F.row_number().over(order).cast("long").alias("app_ord"))


def scanned_windows(ax_windows: DataFrame, scans: DataFrame) -> DataFrame:
    """Windows on the display, those whose frame can't be read included."""
    on = intersects(*map(F.col, ("x", "y", "w", "h", "bx", "by", "bw", "bh")))
    return ax_windows.join(scans.select("snapshot_id", "bx", "by", "bw", "bh"), "snapshot_id").where(F.coalesce(on, F.lit(True)))


def frame_of(position: Column, size: Column) -> Column:
    """(x, y, w, h) from typed attributes (type, a, b): null unless a point and a size, both whole, could be read."""
    read = (position["type"] == "point") & (size["type"] == "size") & position["a"].isNotNull() & position["b"].isNotNull() & size["a"].isNotNull() & size["b"].isNotNull()
    return F.when(read, F.struct(position["a"].alias("x"), position["b"].alias("y"), size["a"].alias("w"), size["b"].alias("h")))


def text_of(attribute: Column) -> Column:
    """The text of a typed attribute (type, value); values of other types are passed over."""
    return F.when(attribute["type"] == "string", attribute["value"])


APP = ["snapshot_id", "pid"]
#: Elements of an application that one task may hold (their numbers alone); larger ones are walked level by level.
WALKED = 1 << 18


def traversed(elements: DataFrame, most: int | None = MAX_ELEMENTS + 1, held: int = WALKED) -> DataFrame:
    """Elements reached from the roots (parent_id null), with ``visit``: their place in the preorder of all windows of an application.

    Nothing below an invisible element is reached, and a walk ends with element number ``most``: over MAX_ELEMENTS a scan is incomplete
    anyway. With None it goes on to the last element. Each application's elements are numbered by one task, which sees only their numbers; texts are joined afterwards. An application with
    more than ``held`` elements is walked by joins of one level at a time. Rows that repeat an element of a window are one element, at the
    first of their places; all of them come back.
    """
    key = [*APP, "window_id", "elem_id"]
    shape = elements.where("elem_id is not null").select(*key, "parent_id", "child_pos", F.coalesce("visible", F.lit(True)).alias("shown"))
    shape = stash(shape, "shape")
    large = stash(shape.groupBy(*APP).count().where(F.col("count") > held).select(*APP), "large")
    few = large.isEmpty()
    small = shape if few else shape.join(large, APP, "left_anti")
    kinds = dict(shape.dtypes)
    walked = small.groupBy(*APP).applyInArrow(_preorder(key, most), ", ".join(f"{c} {kinds[c]}" for c in key) + ", visit long")
    if not few:
        walked = walked.unionByName(_by_levels(shape.join(large, APP, "left_semi"), key, most))
    return elements.join(walked, key)


def _preorder(key: list[str], most: int | None):
    def run(t: pa.Table) -> pa.Table:
        by = [(c, "ascending") for c in ("window_id", "child_pos", "elem_id", "parent_id")]
        t = t.take(pc.sort_indices(t, sort_keys=by, null_placement="at_start"))
        window, elem, parent, shown = (t.column(c).to_pylist() for c in ("window_id", "elem_id", "parent_id", "shown"))
        below: dict = {}
        for i in {(w, e): i for i, (w, e) in reversed(list(enumerate(zip(window, elem))))}.values():
            below.setdefault((window[i], parent[i]), []).append(i)
        out = []
        for w in dict.fromkeys(window):
            stack = sorted(below.get((w, None), ()), reverse=True)
            while stack and (most is None or len(out) < most):
                i = stack.pop()
                out.append(i)
                if shown[i]:
                    stack += sorted(below.get((w, elem[i]), ()), reverse=True)
        return t.select(key).take(pa.array(out, pa.int64())).append_column("visit", pa.array(range(1, len(out) + 1), pa.int64()))

    return run


def _by_levels(shape: DataFrame, key: list[str], most: int | None) -> DataFrame:
    """``key`` and visit by a join per level; an application whose levels hold ``most`` elements already is followed no further, nor are levels
    past number ``most``."""
    one = Window.partitionBy(*key).orderBy("child_pos", "parent_id")
    shape = stash(shape.withColumn("_nth", F.row_number().over(one)).where("_nth = 1"), "shape")
    step = F.struct(F.col("child_pos").alias("pos"), F.col("elem_id").alias("id"))
    cols = [*key, "shown", "path"]
    level = stash(shape.where("parent_id is null").withColumn("path", F.array(step)).select(*cols), "level")
    out, depth = level, 1
    while (most is None or depth < most) and not level.isEmpty():
        above = level.where("shown")
        if most is not None:
            above = above.join(out.groupBy(*APP).count().where(F.col("count") >= most), APP, "left_anti")
        above = above.select(*key[:-1], F.col("elem_id").alias("parent_id"), F.col("path").alias("above"))
        level = stash(shape.join(above, [*key[:-1], "parent_id"]).withColumn("path", F.concat("above", F.array(step))).select(*cols), "level")
        out, depth = out.unionByName(level), depth + 1
    order = Window.partitionBy(*APP).orderBy("window_id", "path")
    out = out.select(*key, F.row_number().over(order).cast("long").alias("visit"))
    return out if most is None else out.where(F.col("visit") <= most)


def element_texts(elements: DataFrame) -> DataFrame:
    """Up to three texts of an element in fixed order; attributes without text give none."""
    texts = elements.select("snapshot_id", "pid", "window_id", "elem_id", F.posexplode(F.array("value", "title", "description")).alias("attr", "text"))
    return texts.where("text is not null").withColumn("attr", F.col("attr").cast("long"))


def distinct_texts(texts: DataFrame) -> DataFrame:
    return texts.select("snapshot_id", "pid", "text").distinct()


def incomplete(elements: DataFrame) -> DataFrame:
    """snapshot_id, pid, incomplete, timed_out, readable, visited of applications with traversed ``elements`` (columns as in ``traversed``).

    A scan is incomplete with over MAX_ELEMENTS elements, over MAX_CHILDREN children of one, a text of over MAX_CHARS, an error
    that matters on a visible element, or when its time is up. Rows that repeat an element count once, below the first of its places.
    """
    app = ["snapshot_id", "pid"]
    shown = F.coalesce(F.col("visible"), F.lit(True))
    texts = F.array("value", "title", "description")
    long = F.exists(texts, lambda t: longer_than(t, MAX_CHARS))
    error = F.col("err").isNotNull() & ~F.col("err").isin(*BENIGN)
    one = elements.groupBy(*app, "window_id", "elem_id").agg(
        F.min(F.struct("child_pos", "parent_id")).alias("place"),
        F.bool_or(shown & (long | error)).alias("bad"),
        F.bool_or(F.coalesce(F.col("elapsed_ms") >= DEADLINE_MS, F.lit(False))).alias("timed_out"),
        F.bool_or(shown & F.exists(texts, readable)).alias("readable"))
    flags = [F.bool_or(c).alias(c) for c in ("bad", "timed_out", "readable")]
    below = one.groupBy(*app, "window_id", "place.parent_id").agg(F.count("*").alias("n"), *flags)
    most = F.max(F.when(F.col("parent_id").isNotNull(), F.col("n"))).alias("most")
    per = below.groupBy(*app).agg(F.sum("n").alias("visited"), most, *flags)
    flag = F.col("bad") | F.col("timed_out") | (F.col("visited") > MAX_ELEMENTS) | (F.coalesce("most", F.lit(0)) > MAX_CHILDREN)
    return per.select(*app, flag.alias("incomplete"), "timed_out", "readable", F.col("visited").cast("long").alias("visited"))


def app_verdicts(apps: DataFrame, windows: DataFrame, on_display: DataFrame, elements: DataFrame, kinds=None, phrases=()) -> DataFrame:
    """One verdict per captured application: status, reason and kinds.

    Coverage failures come first (no windows, none on the display, too many), then incomplete scans, detections, and last
    applications without readable text. Each distinct text of an application is looked at once.
    """
    from veilspark.functions.kinds import PRIORITY

    app = ["snapshot_id", "pid"]
    n_all = windows.groupBy(*app).agg(F.count("*").alias("n_all"))
    n_on = on_display.groupBy(*app).agg(F.count("*").alias("n_on"))
    mine = elements.join(on_display.select(*app, "window_id").distinct(), [*app, "window_id"], "left_semi")
    reached = traversed(mine)
    texts = distinct_texts(element_texts(reached.where("coalesce(visible, true)")))
    found = with_detections(texts, "text", kinds or tuple(PRIORITY), phrases)
    hits = found.select(*app, F.explode_outer("detections").alias("x")).where("x is not null").groupBy(*app).agg(F.array_sort(F.collect_set("x.kind")).alias("kinds"))
    out = apps.join(n_all, app, "left").join(n_on, app, "left").join(incomplete(reached), app, "left").join(hits, app, "left")
    name = F.coalesce("name", F.lit(UNNAMED))
    failure = (
        F.when(F.coalesce("n_all", F.lit(0)) == 0, F.concat(F.lit(UNSUPPORTED), name))
        .when(F.coalesce("n_on", F.lit(0)) == 0, F.concat(F.lit(UNMATCHED), name, F.lit(OFF_DISPLAY)))
        .when(F.col("n_on") > MAX_WINDOWS, F.concat(F.lit(TOO_MANY), name))
    )
    silent = F.when(~F.coalesce("readable", F.lit(False)), F.concat(F.lit(SILENT), name))
    late = F.concat(F.when(F.col("timed_out"), TIMED_OUT).otherwise(INCOMPLETE), name)
    is_late, hit = F.coalesce("incomplete", F.lit(False)), F.col("kinds").isNotNull()
    status = F.when(failure.isNotNull(), "uncovered").when(is_late, "inconclusive").when(hit, "detected").when(silent.isNotNull(), "uncovered").otherwise("scanned")
    reason = F.when(failure.isNotNull(), failure).when(is_late, late).when(~hit, silent)
    return out.select(*app, name.alias("name"), "app_ord", status.alias("status"), reason.alias("reason"), F.when(status == "detected", F.col("kinds")).alias("kinds"))


def snapshot_verdicts(scans: DataFrame, verdicts: DataFrame) -> DataFrame:
    """snapshot_id, status, app, reason, kinds: the first application that is inconclusive or detected decides; else the first coverage
    failure; else the snapshot is clean. Scans that aren't trusted or have no bounds, or no application, are inconclusive first."""
    end = F.col("status").isin("inconclusive", "detected")
    row = F.struct("status", "name", "reason", "kinds")
    per = verdicts.groupBy("snapshot_id").agg(
        F.min_by(F.when(end, row), F.when(end, F.col("app_ord"))).alias("first"),
        F.min_by(F.when(F.col("status") == "uncovered", F.col("reason")), F.when(F.col("status") == "uncovered", F.col("app_ord"))).alias("failure"),
        F.min_by(F.when(F.col("status") == "scanned", F.col("name")), F.when(F.col("status") == "scanned", F.col("app_ord"))).alias("one"),
        F.count_if(F.col("status") == "scanned").alias("n_scanned"), F.count("*").alias("n"))
    out = scans.join(per, "snapshot_id", "left")
    early = (
        F.when(~F.col("trusted"), NO_PERMISSION).when(F.col("bx").isNull(), NO_TARGET)
        .when(F.coalesce("n", F.lit(0)) == 0, NO_APP)
    )
    status = F.when(early.isNotNull(), "inconclusive").when(F.col("first").isNotNull(), F.col("first.status")).when(F.col("failure").isNotNull(), "inconclusive").otherwise("clean")
    reason = F.when(early.isNotNull(), early).when(F.col("first").isNotNull(), F.col("first.reason")).otherwise(F.col("failure"))
    app = F.when(status == "detected", F.col("first.name")).when(status == "clean", F.when(F.col("n_scanned") == 1, F.col("one")).otherwise(ANY_APP))
    return out.select("snapshot_id", status.alias("status"), app.alias("app"), F.when(status == "inconclusive", reason).alias("reason"), F.when(status == "detected", F.col("first.kinds")).alias("kinds"))
