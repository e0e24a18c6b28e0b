"""Snapshot verdicts: one case of each rule."""

from pyspark.sql import functions as F

from veilspark.operators import screen

EL = "snapshot_id long, pid long, window_id long, elem_id long, parent_id long, child_pos long, visible boolean, value string, title string, description string, err string, elapsed_ms double"


def tree(s, pid, window, nodes):
    return [(s, pid, window, i, parent, i, visible, value, None, None, err, ms) for i, parent, visible, value, err, ms in nodes]


def test_verdicts(spark):
    ok = lambda v, ms=0.0: [(1, None, None, v, None, ms)]
    pii = "mail a@b.co"
    snaps = {
        1: {1: ok("hello")}, 2: {1: ok(pii)}, 3: {1: ok("  \n")}, 4: {1: [(1, None, None, "top", None, 0.0), (2, 1, False, "x", None, 0.0), (3, 2, None, pii, None, 0.0)]},
        5: {1: ok("y" * 20_001)}, 6: {1: [(1, None, None, "top", None, 0.0)] + [(k, 1, None, "z", None, 0.0) for k in range(2, 303)]},
        7: {1: [(1, None, None, "r", None, 0.0)] + [(k, (k - 2) // 200 + 1, None, "z", None, 0.0) for k in range(2, 1502)]},
        8: {1: None, 2: ok(pii)}, 9: {1: ok("late", 150.0), 2: ok(pii)}, 10: {1: [(1, None, None, pii, None, 0.0), (2, 1, None, "v", "cannotComplete", 0.0)]},
        11: {1: ok("a"), 2: ok("b")}, 12: {1: ok("a")}, 13: {1: ok("a")}, 14: {}, 15: {1: [(1, None, None, "a", "noValue", 0.0)]}, 16: {1: None, 2: ok("fine")},
    }
    scans = spark.createDataFrame([(s, s != 12, 99, None if s == 13 else 0.0, 0.0, 100.0, 100.0) for s in [*snaps, 17, 18]], "snapshot_id long, trusted boolean, own_pid long, bx double, by double, bw double, bh double")
    apps = [(s, p, f"app{p}", p) for s, a in snaps.items() for p in a] + [(17, 1, "app1", 1), (18, 1, "app1", 1)]
    elements = [x for s, a in snaps.items() for p, nodes in a.items() if nodes for x in tree(s, p, 1, nodes)]
    elements += [x for w in range(1, 6) for x in tree(17, 1, w, ok("a"))] + tree(18, 1, 1, ok("a")) + tree(18, 1, 2, ok(pii))
    el = spark.createDataFrame(elements, EL)
    win = el.select("snapshot_id", "pid", "window_id").distinct()
    # the second window of snapshot 18 is off the display; frames of the others can't be read
    off = (F.col("snapshot_id") == 18) & (F.col("window_id") == 2)
    frames = win.withColumns({c: F.when(off, 500.0) for c in "xywh"})
    on = screen.scanned_windows(frames, scans)
    captured = spark.createDataFrame(apps, "snapshot_id long, pid long, name string, app_ord long")
    out = {r.snapshot_id: (r.status, r.app, r.reason, r.kinds) for r in screen.snapshot_verdicts(scans, screen.app_verdicts(captured, frames, on, el)).collect()}
    failed = lambda why: ("inconclusive", None, why, None)
    assert out == {
        1: ("clean", "app1", None, None), 2: ("detected", "app1", None, ["email"]), 3: failed("No readable Accessibility text in app1"), 4: ("clean", "app1", None, None),
        5: failed("Accessibility scan incomplete in app1"), 6: failed("Accessibility scan incomplete in app1"), 7: failed("Accessibility scan incomplete in app1"),
        8: ("detected", "app2", None, ["email"]), 9: failed("Accessibility scan timed out in app1"), 10: failed("Accessibility scan incomplete in app1"),
        11: ("clean", "captured display", None, None), 12: failed("Accessibility permission required"), 13: failed("Capture target unavailable"),
        14: failed("No supported app window on the captured display"), 15: ("clean", "app1", None, None), 16: failed("Accessibility unsupported in app1"),
        17: failed("Accessibility window limit exceeded in app1"), 18: ("clean", "app1", None, None),
    }


def test_captured_apps(spark):
    windows = [(1, 0, 9, 0.0, 0.0, 50.0, 50.0), (1, 1, 2, 0.0, 0.0, 1.0, 50.0), (1, 2, 3, 90.0, 0.0, 20.0, 20.0), (1, 3, 2, 0.0, 0.0, 9.0, 9.0), (1, 4, 3, 0.0, 0.0, 9.0, 9.0), (1, 5, 4, 100.0, 0.0, 9.0, 9.0), (1, 6, 5, 0.0, 0.0, 9.0, 9.0), (1, 7, 6, 0.0, 0.0, 9.0, 9.0)]
    w = spark.createDataFrame(windows, "snapshot_id long, z_order long, pid long, x double, y double, w double, h double")
    a = spark.createDataFrame([(1, p, f"a{p}", "prohibited" if p == 5 else "regular", p == 6) for p in range(2, 10)], "snapshot_id long, pid long, name string, policy string, hidden boolean")
    s = spark.createDataFrame([(1, 9, 0.0, 0.0, 100.0, 100.0)], "snapshot_id long, own_pid long, bx double, by double, bw double, bh double")
    assert sorted((r.app_ord, r.pid) for r in screen.captured_apps(w, a, s).collect()) == [(1, 3), (2, 2)]


def test_preorder(spark):
    rows = tree(1, 1, 1, [(1, None, None, "a", None, 0.0), (2, 1, None, "b", None, 0.0), (4, 2, False, "c", None, 0.0), (5, 4, None, "d", None, 0.0), (3, 1, None, "e", None, 0.0)])
    assert [r.elem_id for r in screen.traversed(spark.createDataFrame(rows, EL)).orderBy("visit").collect()] == [1, 2, 4, 3]


def walk_rows(seed, n=300):
    """Random forests with repeated elements, invisible ones, elements without a parent in the window and cycles."""
    import random

    r, rows = random.Random(seed), []
    for pid in (1, 2, 3):
        for i in range(n):
            e = r.randrange(n) if r.random() < 0.1 else i
            rows.append((1, pid, r.randint(1, 2), e, None if r.random() < 0.05 else r.randrange(n), r.randint(0, 5), r.random() > 0.1, f"v{e}", None, None, None, 0.0))
    return rows


def test_walks_agree(spark):
    """One task per application, joins per level, and plain Python."""
    rows = walk_rows(7)
    df = spark.createDataFrame(rows, EL)
    want = {}
    for pid in (1, 2, 3):
        n = 0
        for w in (1, 2):
            mine, nodes = sorted((x for x in rows if x[1] == pid and x[2] == w), key=lambda x: (x[5], x[3], x[4] is not None, x[4] or 0)), {}
            for x in sorted(mine, key=lambda x: (x[5], x[4] is not None, x[4] or 0)):
                nodes.setdefault(x[3], x)

            def visit(x):
                nonlocal n
                n += 1
                want[pid, w, x[3]] = n
                if x[6]:
                    for y in sorted((y for y in nodes.values() if y[4] == x[3] and y[3] != x[3]), key=lambda y: (y[5], y[3])):
                        visit(y)

            for x in sorted((x for x in nodes.values() if x[4] is None), key=lambda x: (x[5], x[3])):
                visit(x)
    for held in (1 << 20, 10):
        got = screen.traversed(df, 1 << 20, held)
        assert {(r.pid, r.window_id, r.elem_id): r.visit for r in got.collect()} == want
    few = screen.traversed(df, 20).select("pid", "visit").distinct().groupBy("pid").count().collect()
    assert len(want) > 60 and all(r["count"] <= 20 for r in few)


def test_walk_ends_on_cycles(spark):
    rows = tree(1, 1, 1, [(1, None, None, "a", None, 0.0), (2, 1, None, "b", None, 0.0), (1, 2, None, "again", None, 0.0), (3, 4, None, "c", None, 0.0), (4, 3, None, "d", None, 0.0)])
    for held in (100, 1):
        assert sorted((r.elem_id, r.value) for r in screen.traversed(spark.createDataFrame(rows, EL), 50, held).collect()) == [(1, "a"), (1, "again"), (2, "b")]
    assert screen.traversed(spark.createDataFrame([], EL)).collect() == []


def test_typed_attributes(spark):
    df = spark.createDataFrame([(("point", 1.0, 2.0), ("size", 3.0, 4.0)), (("size", 1.0, 2.0), ("size", 3.0, 4.0)), (None, ("size", 3.0, 4.0)), (("point", 1.0, None), ("size", 3.0, 4.0))], "p struct<type:string,a:double,b:double>, s struct<type:string,a:double,b:double>")
    assert [r.f and tuple(r.f) for r in df.select(screen.frame_of(F.col("p"), F.col("s")).alias("f")).collect()] == [(1.0, 2.0, 3.0, 4.0), None, None, None]
    text = spark.createDataFrame([(("string", "x"),), (("number", "5"),), (None,)], "a struct<type:string,value:string>")
    assert [r.t for r in text.select(screen.text_of(F.col("a")).alias("t")).collect()] == ["x", None, None]
