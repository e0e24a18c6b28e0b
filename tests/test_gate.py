"""Gate, buffer, bursts and the streams."""

import random

from pyspark.sql import functions as F

from veilspark.operators import buffer, bursts, capture, gate
from veilspark.plans import catalog
from veilspark.streaming import live

EVENTS = "stream_id string, seq long, event string, reason string, required_checks int, requires_manual boolean, requires_delay boolean"

# name, required, manual, delay, events, last (blocked, reason, checks, manual pending, delay pending)
SCENES = [
    ("invalidate", 3, False, False, "c c i:late", (True, "late", 0, False, False)),
    ("recover", 3, False, False, "c c i:late c c c", (False, "Protected", 3, False, False)),
    ("count", 5, False, False, "c c", (True, "Checking for PII · 2/5 clean bursts", 2, False, False)),
    ("delay lost", 1, False, True, "c d:found t", (True, "found", 0, False, False)),
    ("stale approval", 1, True, False, "d:found c i:late a", (True, "late", 0, False, False)),
    ("reset", 1, False, True, "c r:again t a", (True, "again", 0, False, False)),
    ("deny late", 1, True, False, "d:found c i:late n a", (True, "late", 0, False, False)),
    ("deny", 1, True, False, "d:found c n", (True, "Manual clearance required", 1, True, False)),
    ("deny then clean", 1, True, False, "d:found c n c", (True, "Manual clearance required", 1, True, False)),
    ("approve", 2, True, False, "d:found c c a", (False, "Protected", 0, False, False)),
    ("no approval at start", 2, True, False, "c c", (False, "Protected", 2, False, False)),
    ("approval pending", 2, True, False, "c c d:found c c", (True, "Clean checks passed · approval required", 2, True, False)),
    ("delay pending", 2, False, True, "c c c", (True, "Clean checks passed · waiting for stream delay", 2, False, True)),
    ("delay done", 2, False, True, "i:late c c t", (False, "Protected", 2, False, False)),
    ("reset forgets", 1, True, False, "d:found r:again c", (False, "Protected", 1, False, False)),
    ("delay then manual", 1, True, True, "d:found c t", (True, "Clean checks passed · approval required", 1, True, False)),
    ("stays open", 1, False, False, "c c c", (False, "Protected", 1, False, False)),
]
WORDS = {"c": "clean", "d": "detected", "i": "inconclusive", "r": "reset", "t": "delay_complete", "a": "approve", "n": "deny"}


def scene_rows():
    for name, n, manual, delay, events, _ in SCENES:
        for k, e in enumerate(events.split()):
            kind, _, reason = e.partition(":")
            yield (name, k, WORDS[kind], reason or None, n, manual, delay)


def test_scenes(spark):
    out = gate.gate_states(spark.createDataFrame(list(scene_rows()), EVENTS)).collect()
    last = {}
    for r in sorted(out, key=lambda r: r.seq):
        last[r.stream_id] = (r.is_blocked, r.reason, r.clean_checks, r.pending_manual, r.pending_delay)
    assert last == {s[0]: s[5] for s in SCENES}


def plain_states(rows):
    """The same by one gate per stream, event by event; rows in order."""
    gates, out = {}, []
    for s, i, kind, reason, n, by_hand, delayed in rows:
        g = gates.setdefault(s, gate.Gate())
        g.event(kind, reason, gate.CHECKS if n is None else n, bool(by_hand), bool(delayed))
        out.append((s, i, *g.shown()))
    return sorted(out, key=str)


def test_windows_equal_a_gate_per_stream(spark):
    """Every kind of event, settings that change and are missing, keys that are null or beyond doubles."""
    r = random.Random(12)
    kinds = [*WORDS.values(), None, "other"]
    rows = [(r.choice([None, 7, 2**53 + 1, 2**53 + 2, 3]), i, r.choices(kinds, [9, 2, 1, 1, 3, 3, 1, 1, 1])[0], r.choice([None, f"why {i}"]), r.choice([None, 0, 1, 2, 3]), r.choice([None, True, True, False]), r.choice([None, True, False])) for i in range(4000)]
    df = spark.createDataFrame(rows, EVENTS.replace("stream_id string", "stream_id long"))
    assert sorted(map(tuple, gate.gate_states(df).collect()), key=str) == plain_states(rows)


def plain_timed(rows, delay):
    gates, timers, last, out = {}, {}, {}, []
    for s, i, now, kind, reason, n, by_hand, delayed in rows:
        g = gates.setdefault(s, gate.Gate())
        if s in timers and timers[s] <= now:
            del timers[s]
            g.event("delay_complete", None, 1, last[s], True)
        waited = g.delay
        g.event(kind, reason, n, by_hand, delayed)
        last[s] = by_hand
        if g.delay and not waited:
            timers[s] = now + delay
        elif not g.delay:
            timers.pop(s, None)
        out.append((s, i, *g.shown()))
    return sorted(out, key=str)


def timed_rows(n=2500, seed=21):
    r, t, rows = random.Random(seed), 100.0, []
    for i in range(n):
        t += r.choice([0, 0.5, 1.0, 7.0])
        rows.append((f"s{r.randrange(6)}", i, t, r.choices(list(WORDS.values()), [9, 1, 1, 1, 1, 2, 1])[0], f"why {i}", r.randint(1, 3), r.random() < 0.6, r.random() < 0.7))
    return rows


TIMED = EVENTS.replace("event string", "ts double, event string")


def test_timers_equal_a_gate_per_stream(spark):
    rows = timed_rows()
    assert sorted(map(tuple, gate.gate_timed(spark.createDataFrame(rows, TIMED), 20.0).collect()), key=str) == plain_timed(rows, 20.0)


def test_timed_stream_equals_batch(spark, tmp_path):
    rows = timed_rows(900)
    df = spark.createDataFrame(rows, TIMED).withColumn("ts", F.timestamp_micros((F.col("ts") * 1e6).cast("long")))
    for k in range(3):
        df.where((F.col("seq") >= k * 300) & (F.col("seq") < k * 300 + 300)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    live.drain(live.gate_timed_stream(stream, 20.0), f"{tmp_path}/out", f"{tmp_path}/state")
    out = spark.read.parquet(f"{tmp_path}/out")
    got = out.where("seq is not null").select("stream_id", "seq", "is_blocked", "reason", "clean_checks", "pending_manual", "pending_delay").collect()
    assert sorted(map(tuple, got), key=str) == plain_timed(rows, 20.0)
    assert out.where("seq is null and not is_blocked").count() > 0


def test_clearance_without_another_event(spark, tmp_path):
    """A timer goes off when the watermark passes it, though its stream has no more events."""
    rows = [("a", 0, 100.0, "clean", None, 1, False, True), ("b", 1, 1000.0, "clean", None, 9, False, False), ("b", 2, 2000.0, "clean", None, 9, False, False)]
    df = spark.createDataFrame(rows, TIMED).withColumn("ts", F.timestamp_micros((F.col("ts") * 1e6).cast("long")))
    for k in range(3):
        df.where(F.col("seq") == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    live.drain(live.gate_timed_stream(stream, 20.0), f"{tmp_path}/out", f"{tmp_path}/state")
    (r,) = spark.read.parquet(f"{tmp_path}/out").where("seq is null").collect()
    assert (r.stream_id, r.is_blocked, r.reason, r.ts.timestamp()) == ("a", False, "Protected", 120.0)


def test_control_events_and_answers(spark):
    rows = [("a", 0, None, "start", 2.9, True), ("a", 1, None, "warm_up", 2.9, True), ("a", 2, "clean", None, None, None), ("a", 3, None, "start", 1.0, False), ("a", 4, None, "error", 1.0, True), ("a", 5, None, "settings", None, None), ("a", 6, None, "stop", None, None)]
    df = spark.createDataFrame(rows, "k string, seq long, event string, control string, delay double, trusted boolean")
    out = gate.control_events(df).orderBy("seq").collect()
    assert [r.reason for r in out] == ["Filling delayed stream buffer", "Filling 2-second buffer", "Accessibility permission required", "Capture stopped", "Settings changed · checking again", "Preview stopped"]
    assert {r.event for r in out} == {"reset"} and gate.control_events(df.limit(0)).collect() == []
    answers = [("a", 0, "reset", "start", None, None), ("a", 1, "detected", None, None, None), ("a", 2, "approve", None, 1, 1), ("a", 3, "inconclusive", None, None, None), ("a", 4, "approve", None, 1, 1), ("a", 5, "deny", None, None, None), ("b", 6, "approve", None, 0, 0)]
    df = spark.createDataFrame(answers, "k string, seq long, event string, control string, asked_lifecycle long, asked_clearance long")
    assert sorted(r.seq for r in gate.valid_answers(df, "k", ["seq"]).collect()) == [0, 1, 2, 3, 6]


def random_events(n=3000, streams=20, seed=3):
    r = random.Random(seed)
    return [(f"s{r.randrange(streams)}", i, r.choices(list(WORDS.values()), [8, 2, 1, 1, 2, 2, 1])[0], f"why {i}", 2, True, False) for i in range(n)]


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(random_events(), EVENTS)
    for k in range(3):  # three files, three micro-batches
        df.where((F.col("seq") >= k * 1000) & (F.col("seq") < k * 1000 + 1000)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    live.drain(live.gate_stream(stream), f"{tmp_path}/out", f"{tmp_path}/state")
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    assert got == sorted(map(tuple, gate.gate_states(df).collect())) == sorted(plain_states(random_events()))


def test_stream_of_a_hot_key_is_read_in_bounded_batches(spark, tmp_path, monkeypatch):
    import os

    kinds = ["view", "view", "view", "error", "purchase", "login"]
    r = random.Random(8)
    rows = [(1 if i % 3 == 0 else r.randrange(2, 50), i, r.choice(kinds)) for i in r.sample(range(9000), 3000)]
    spark.createDataFrame(rows, "user_id long, event_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    places = []
    monkeypatch.setattr(catalog, "BATCH", 400, raising=False)
    monkeypatch.setattr(live, "drain", lambda s, path, state, f=live.drain: (places.append(os.path.dirname(path.removeprefix("file://"))), f(s, path, state)))
    got = sorted(map(tuple, catalog.QUERIES["stream_gate"](spark, str(tmp_path)).collect()))
    assert got == sorted(map(tuple, catalog.QUERIES["q_gate_manual"](spark, str(tmp_path)).collect())) and len(got) == 3000
    read = spark.read.parquet(f"{places[0]}/in").groupBy(F.col("_metadata.file_name")).agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"), F.count("*").alias("n")).orderBy("lo").collect()
    assert max(x.n for x in read) <= 400 and all(a.hi < b.lo for a, b in zip(read, read[1:]))
    assert len([f for f in os.listdir(f"{places[0]}/state/offsets") if f.isdigit()]) == len(read)


def test_windows_equal_the_fold(spark):
    rows = [(s, i, e if e in ("clean", "detected", "inconclusive") else "clean", w, 3, False, False) for s, i, e, w, *_ in random_events(seed=9)]
    df = spark.createDataFrame(rows, EVENTS)
    fold = {(r.stream_id, r.seq): r.is_blocked for r in gate.gate_states(df).collect()}
    fast = {(r.stream_id, r.seq): r.is_blocked for r in gate.gate_basic(df, "stream_id", ["seq"], F.lit(3)).collect()}
    assert fast == fold


def test_delay_window_equals_timers(spark):
    rows = [(s, i, e if e in ("clean", "detected", "inconclusive") else "clean", w, 2, False, True) for s, i, e, w, *_ in random_events(1500, seed=5)]
    df = spark.createDataFrame(rows, EVENTS)
    fast = {(r.stream_id, r.seq): r.is_blocked for r in gate.gate_delayed(df, "stream_id", ["seq"], "seq", F.lit(2), F.lit(70)).collect()}
    state, timer, slow = {}, {}, {}
    for s, i, e, w, n, manual, delay in rows:
        g = state.setdefault(s, gate.Gate())
        if s in timer and timer[s] <= i:
            del timer[s]
            g.event("delay_complete", None, n, manual, delay)
        was = g.delay
        g.event(e, w, n, manual, delay)
        if g.delay and not was:
            timer[s] = i + 70
        elif not g.delay:
            timer.pop(s, None)
        slow[s, i] = g.blocked
    assert fast == slow


def test_timed_gate_equals_delay_window(spark):
    rows = [(s, i, float(i), e if e in ("clean", "detected", "inconclusive") else "clean", w, 2, False, True) for s, i, e, w, *_ in random_events(1500, seed=7)]
    df = spark.createDataFrame(rows, EVENTS.replace("event string", "ts double, event string"))
    fast = {(r.stream_id, r.seq): r.is_blocked for r in gate.gate_delayed(df, "stream_id", ["seq"], "ts", F.lit(2), F.lit(70.0)).collect()}
    assert fast == {(r.stream_id, r.seq): r.is_blocked for r in gate.gate_timed(df, 70.0).collect()}


def test_timed_gate_waits_for_approval(spark):
    rows = [("a", i, float(t), e, "found", 1, True, True) for i, (t, e) in enumerate([(0, "detected"), (1, "clean"), (2, "clean"), (20, "clean"), (21, "approve"), (22, "clean")])]
    out = gate.gate_timed(spark.createDataFrame(rows, EVENTS.replace("event string", "ts double, event string")), 10.0).orderBy("seq").collect()
    assert [(r.is_blocked, r.pending_manual, r.pending_delay) for r in out] == [(True, False, False), (True, False, True), (True, False, True), (True, True, False), (False, False, False), (False, False, False)]
    assert [r.seq for r in gate.approval_alerts(gate.gate_states(spark.createDataFrame(random_events(), EVENTS)), "stream_id", ["seq"]).collect()]


def test_capture(spark):
    frames = spark.createDataFrame([("a", 1, 1.0, "screen", True, 0), ("a", 2, 2.0, "audio", True, 1), ("a", 3, 3.0, "screen", True, 1), ("a", 4, 4.0, "screen", False, 1)], "k string, seq long, ts double, type string, valid boolean, epoch int")
    now = spark.createDataFrame([("a", 1)], "k string, epoch int")
    assert [r.seq for r in capture.accepted_frames(frames, now, ["k", "epoch"]).collect()] == [3]
    assert capture.shown_frame(frames, "k", "seq", "type").first() == ("a", 4, "screen")
    late = capture.after_warm_up(frames, spark.createDataFrame([("a", 1.0)], "k string, started double"), "k", "ts", F.lit(2.0))
    assert sorted(r.seq for r in late.collect()) == [3, 4]


def test_buffer_policy(spark):
    big = 2**63 - 1
    rows = [(1280, 720, 2.0, 10, 268435456), (2560, 1440, 10.0, 30, 268435456), (big, big, 10.0, 30, 1024), (0, -5, -1.0, 0, 268435456)]
    df = spark.createDataFrame(rows, "w long, h long, d double, f long, b long")
    out = [tuple(r.x) for r in df.select(buffer.buffer_policy(*map(F.col, "whdfb")).alias("x")).collect()]
    assert out == [(3686400, 20, 0.1, 73728000), (14745600, 18, 10 / 18, 265420800), (big, 1, 10.0, big), (4, 1, 1.0, 4)]


FRAMES = "k long, seq long, ts double, epoch long, delay double, max_frames int, sample_interval double"


def arrival_rows(seed=2, n=800):
    r, t, rows = random.Random(seed), 0.0, []
    for i in range(n):
        t += r.random() * 3
        rows.append((r.choice([None, 2**53 + 1, 2**53 + 2]), i, t, i // 200 if i < 700 else None, r.choice([1.0, 4.0, 9.0]), r.choice([3, 3, None]), 0.9))
    return rows


def plain_queue(rows):
    state, out = {}, []
    for k, i, t, e, d, most, gap in rows:
        held, last, epoch = state.get(k, ([], None, None))
        if e != epoch:
            held, last = [], None
        ready = None
        while held and held[0][0] <= t:
            ready = held.pop(0)[1]
        admit = len(held) < (1 if most is None else most) and (last is None or t - last >= gap)
        if admit:
            held, last = [*held, (t + d, i)], t
        state[k] = held, last, e
        out.append((k, i, admit, ready))
    return sorted(out, key=str)


def test_buffered_against_a_plain_queue(spark):
    """Delays that fall within an epoch: a frame that is ready behind one that isn't has to wait."""
    rows = arrival_rows()
    assert sorted(map(tuple, buffer.buffered(spark.createDataFrame(rows, FRAMES), "k", "seq").collect()), key=str) == plain_queue(rows)
    late = [(1, i, t, 0, d, 9, 0.0) for i, (t, d) in enumerate([(0.0, 10.0), (1.0, 1.0), (3.0, 1.0), (11.0, 1.0)])]
    assert [r.released_seq for r in buffer.buffered(spark.createDataFrame(late, FRAMES), "k", "seq").orderBy("seq").collect()] == [None, None, None, 2]


def test_release_stream_equals_batch(spark, tmp_path):
    rows = arrival_rows(5, 600)
    df = spark.createDataFrame(rows, FRAMES)
    for k in range(3):
        df.where((F.col("seq") >= k * 200) & (F.col("seq") < k * 200 + 200)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    live.drain(live.release_stream(stream, "k", "seq"), f"{tmp_path}/out", f"{tmp_path}/state")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()), key=str) == plain_queue(rows)


def test_record_to_publishes_all_or_nothing(spark, tmp_path):
    frames = spark.createDataFrame([("a", 1.0, "f1"), ("a", 2.0, "f2"), ("b", 1.0, "g1")], "k string, ts double, payload string")
    states = spark.createDataFrame([("a", 1.5, False, "Protected")], "k string, ts double, is_blocked boolean, reason string")
    both, target = buffer.with_states(frames, states, "k", "ts", "payload"), f"{tmp_path}/recording"
    both.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(both.schema).parquet(f"{tmp_path}/in")
    assert live.record_to(live.record_stream(stream, "k", "ts", "payload", 10.0), target) == (target, None)
    want = [("a", 0, 0.0, "Waiting for a privacy check", None), ("a", 1, 0.1, None, "f2"), ("b", 0, 0.0, "Waiting for a privacy check", None)]
    assert sorted(map(tuple, spark.read.parquet(target).collect())) == want
    assert live.record_to(live.record_stream(stream.where("side = 0"), "k", "ts", "payload", 10.0), f"{tmp_path}/none") == (None, None)
    bad = stream.withColumn("payload", F.when(F.col("payload") == "f2", F.raise_error(F.lit("disk full"))).otherwise(F.col("payload")))
    got, message = live.record_to(live.record_stream(bad, "k", "ts", "payload", 10.0), target)
    import os

    assert got is None and message.startswith("Recording failed: ") and sorted(os.listdir(tmp_path)) == ["in"]


def test_frame_source(spark, tmp_path):
    from veilspark.sources.frames import frame_stream

    df = frame_stream(spark, 5, 4000, 700, 1920, 1080)
    query = df.writeStream.format("memory").queryName("frames_seen").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="100 milliseconds").start()
    for _ in range(100):
        if query.lastProgress and spark.table("frames_seen").count() >= 5:
            break
        query.awaitTermination(0.2)
    query.stop()
    rows = spark.table("frames_seen").orderBy("seq").limit(5).collect()
    assert [(r.seq, r.ts, r.width, r.height) for r in rows] == [(i, i / 5, 1920, 700) for i in range(5)]


def test_sessions(spark):
    frames = spark.createDataFrame([("a", float(t), 10 + t, 7, None if t == 2 else t != 3) for t in range(8)], "k string, ts double, width int, height int, ready boolean")
    sessions = spark.createDataFrame([(1, "a", 1.0, 5.0, None), (2, "a", 6.0, None, "disk full"), (3, "b", 0.0, None, None)], "session_id int, k string, started double, stopped double, failure string")
    got = buffer.in_sessions(frames, sessions, "k", "ts")
    assert sorted((r.session_id, r.ts) for r in got.collect()) == [(1, 1.0), (1, 2.0), (1, 4.0), (2, 6.0), (2, 7.0)]
    out = sorted(map(tuple, buffer.session_outcomes(sessions, got, "ts").collect()))
    assert out == [(1, 3, 11, 7, True, None), (2, 2, 16, 7, False, "Recording failed: disk full"), (3, 0, None, None, False, None)]


def test_recording(spark):
    frames = spark.createDataFrame([("a", 1.0, "f1"), ("a", 2.0, "f2"), ("a", 3.0, "f3"), ("b", 1.0, "g1")], "k string, ts double, payload string")
    states = spark.createDataFrame([("a", 2.0, False, "Protected"), ("a", 2.5, True, "PII")], "k string, ts double, is_blocked boolean, reason string")
    out = sorted(tuple(r) for r in buffer.recorded(frames, states, "k", "ts", "payload", F.lit(10.0)).collect())
    assert out == [("a", 0, 0.0, "Waiting for a privacy check", None), ("a", 1, 0.1, None, "f2"), ("a", 2, 0.2, "PII", None), ("b", 0, 0.0, "Waiting for a privacy check", None)]


def test_bursts_and_reasons(spark):
    df = spark.createDataFrame([(1, 0, "clean"), (1, 1, "detected"), (1, 2, "inconclusive"), (2, 0, "clean"), (2, 1, "clean")], "burst long, idx long, status string")
    assert sorted(map(tuple, bursts.burst_verdicts(df, ["burst"], "idx").collect())) == [(1, 1, "detected"), (2, 1, "clean")]
    assert sorted(map(tuple, bursts.burst_verdicts(df, ["burst"], "idx", count=0).collect())) == [(1, 0, "clean"), (2, 0, "clean")]
    ok = spark.createDataFrame([("a", True), ("a", None), ("a", False), ("b", True)], "k string, ok boolean")
    assert sorted(map(tuple, bursts.check_counts(ok, ["k"]).collect())) == [("a", 3, 2), ("b", 1, 0)]
    r = spark.range(1).select(bursts.detected_reason(F.lit("Mail"), F.array(F.lit("ip"), F.lit("email"), F.lit("ip")))).first()[0]
    assert r == "PII detected in Mail · Email, IP address"


def test_catalogue_names_match():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES) and len(catalog.QUERIES) >= 50
