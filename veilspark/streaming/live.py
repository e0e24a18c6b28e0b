"""Detection, gating, delayed release and recording over streams, with the batch operators' rules.

Keyed state is kept by ``transformWithState`` in RocksDB, for buckets of keys. A micro-batch's rows of a key are put in order together, so the source's rate
(``maxFilesPerTrigger`` and the size of its files) bounds what a hot key takes; micro-batches have to come in that order.
"""

from __future__ import annotations

import json
import pickle
import sys
from itertools import repeat
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from veilspark.operators import buffer as buffer_module
from veilspark.operators import bursts as bursts_module
from veilspark.operators import gate as gate_module
from veilspark.operators import lifecycle as lifecycle_module
from veilspark.operators.bursts import RUN, Runner
from veilspark.operators.buffer import FAILED_FINALIZING, FAILED_RECORDING, RELEASED, Buffer, arrivals, with_states
from veilspark.operators.detect import spans, with_detections
from veilspark.operators.gate import STATE, WAITING, Gate, with_defaults
from veilspark.operators.lifecycle import NAMES, SETTINGS, Preview, with_settings
from veilspark.operators.lifecycle import SHOWN as PREVIEW
from veilspark.session import delete

# processors go to the workers by value: the one that Spark starts beside the driver has no copy of the package
for _module in (sys.modules[__name__], buffer_module, bursts_module, gate_module, lifecycle_module):
    cloudpickle.register_pickle_by_value(_module)

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def detect_stream(texts: DataFrame, key: str, text: str, **options) -> DataFrame:
    """Detections of a stream of texts: no state."""
    return spans(with_detections(texts, text, **options), key)


def _plain(x):
    """A value of a pandas cell as Python has it: missing ones are None."""
    return None if x is None or x is pd.NaT or (isinstance(x, float) and x != x) else x.item() if isinstance(x, np.generic) else x


def _cells(column: pd.Series) -> list:
    """A column's values as Python has them: missing ones are None."""
    return column.astype(object).where(column.notna(), None).tolist() if column.hasnans else column.tolist()


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame({n: pd.Series(c, dtype=object) for n, c in zip(names, zip(*rows) if rows else [()] * len(names))})


def _millis(seconds: float) -> int:
    return int(-(-seconds * 1000 // 1))


#: Buckets that a stream's keys are dealt to.
KEYED = 256


def _keyed(rows: DataFrame, key: str, make: StatefulProcessor, out: str, mode: str = "None") -> DataFrame:
    """``rows`` grouped by buckets of ``key`` as text, so that null keys and keys of any size come through; the processor gets the text.

    Sets the session's state store to RocksDB, which these processors need, for all streams that start from then on.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kind = dict(rows.dtypes)[key]
    dealt = rows.withColumn("key_text", F.col(key).cast("string")).drop(key).withColumn("key_bucket", F.pmod(F.xxhash64("key_text"), F.lit(KEYED)).cast("int"))
    done = dealt.groupBy("key_bucket").transformWithStateInPandas(make, f"key_text string, {out}", "append", mode)
    return done.withColumn(key, F.col("key_text").cast(kind)).select(key, *[c for c in done.columns if c != "key_text"])


class Folds(StatefulProcessor):
    """A fold over the rows of each key, a bucket of keys at a time: a call for every key would cost more than its rows do.

    The states of a bucket's keys are one value, read and written once a micro-batch, and its timer is that of the key that is due first. A subclass says
    what columns a fold reads (``cols``), by what a key's rows are put in order (``by``, nulls last) and what it gives (``names``, behind the key's text).
    """

    cols: list[str] = []
    by: list[str] = []
    names: list[str] = []
    timed = False

    def init(self, handle) -> None:
        self.handle, self.kept = handle, handle.getValueState("kept", "states binary")

    def fold(self, key: str | None, state, rows: list[list], out: list[tuple]):
        """The state of a key (None: there is none) after its ``rows``; what they give is added to ``out``."""
        raise NotImplementedError

    def due(self, state) -> float | None:
        """When a key's timer goes off."""
        return None

    def fire(self, key: str | None, state, now: float, out: list[tuple]):
        """The state of a key after its timer, which has gone off by ``now``."""
        raise NotImplementedError

    def _states(self) -> dict:
        return pickle.loads(bytes(self.kept.get()[0])) if self.kept.exists() else {}

    def _next(self, states: dict) -> int | None:
        return min((_millis(x) for x in map(self.due, states.values()) if x is not None), default=None) if self.timed else None

    def _rows_by_key(self, frames) -> dict:
        cells: dict = {c: [] for c in ("key_text", *self.by, *self.cols)}
        for frame in frames:
            for c, values in cells.items():
                values += _cells(frame[c])
        places = zip(*([(x is None, x) for x in cells[c]] if None in cells[c] else cells[c] for c in self.by)) if self.by else repeat(())
        found: dict = {}
        for key, *row in zip(cells["key_text"], places, zip(*(cells[c] for c in self.cols))):
            found.setdefault(key, []).append(row)
        del cells
        for key, rows in found.items():
            if len(rows) > 1:
                rows.sort(key=itemgetter(0))
            found[key] = [row for _, row in rows]
        return found

    def handleInputRows(self, key, rows, timerValues):
        states, out = self._states(), []
        was = self._next(states)
        for k, events in self._rows_by_key(rows).items():
            states[k] = self.fold(k, states.get(k), events, out)
        first = self._next(states)
        if was != first:
            if was is not None:
                self.handle.deleteTimer(was)
            if first is not None:
                self.handle.registerTimer(first)
        self.kept.update((pickle.dumps(states),))
        yield _frame(out, ["key_text", *self.names])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        states, out = self._states(), []
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        for k, state in states.items():
            due = self.due(state)
            if due is not None and _millis(due) <= now:
                states[k] = self.fire(k, state, max(now / 1000, due), out)
        first = self._next(states)
        if first is not None:
            self.handle.registerTimer(first)
        self.kept.update((pickle.dumps(states),))
        yield _frame(out, ["key_text", *self.names])

    def close(self) -> None:
        pass


class GateProcessor(Folds):
    """The state is a gate's six values."""

    def __init__(self, order: str):
        self.by, self.cols, self.names = [order, "event", "reason"], [order, "event", "reason", "required_checks", "requires_manual", "requires_delay"], [order, *SHOWN]

    def fold(self, key, state, rows, out):
        gate = Gate(*state or ())
        for o, *event in rows:
            gate.event(*event)
            out.append((key, o, *gate.shown()))
        return gate.values()


SHOWN = [x.split()[0] for x in STATE.split(", ")]


def gate_stream(events: DataFrame, key: str = "stream_id", order: str = "seq") -> DataFrame:
    """The gate's state after every event of a stream, as ``gate_states`` has it; the state is six values per key. Outputs are appended."""
    rows = with_defaults(events, key, order)
    return _keyed(rows, key, GateProcessor(order), f"{order} {dict(events.dtypes)[order]}, {STATE}")


class TimedGateProcessor(Folds):
    """A gate with its clearance timer, as an event-time timer of the state store. The state is the gate's, when the timer goes off and under which setting."""

    timed = True

    def __init__(self, order: str, ts: str):
        self.by, self.names = [ts, order, "event", "reason"], [order, ts, *SHOWN]
        self.cols = [order, ts, "wait_seconds", "event", "reason", "required_checks", "requires_manual", "requires_delay"]

    def due(self, state):
        return state[1]

    def fire(self, key, state, now, out):
        values, due, by_hand = state
        gate = Gate(*values)
        gate.event("delay_complete", None, 0, by_hand, True)
        out.append((key, None, due, *gate.shown()))
        return gate.values(), None, False

    def fold(self, key, state, rows, out):
        values, due, by_hand = state or ((), None, False)
        gate = Gate(*values)
        for o, now, delay, *event in rows:
            if due is not None and due <= now:
                values, due, by_hand = self.fire(key, (gate.values(), due, by_hand), now, out)
                gate = Gate(*values)
            waited = gate.delay
            gate.event(*event)
            by_hand = event[3]
            due = (due if waited or delay is None else now + delay) if gate.delay else None
            out.append((key, o, now, *gate.shown()))
        return gate.values(), due, by_hand


def gate_timed_stream(events: DataFrame, delay: Column | float, key: str = "stream_id", order: str = "seq", ts: str = "ts", late: str = "1 minute") -> DataFrame:
    """The gate's state after every event, as ``gate_timed`` has it, and after every clearance that no event was needed for (its ``order`` is null).

    ``ts`` is a timestamp; ``delay`` is in seconds, and a null one never goes off. Timers are event-time timers: they go off when the watermark, ``late`` behind the newest event, passes
    them, or before the first later event of their key.
    """
    rows = with_defaults(events.withColumn("wait_seconds", (delay if isinstance(delay, Column) else F.lit(delay)).cast("double")).withWatermark(ts, late), key, order, ts, "wait_seconds")
    rows = rows.withColumn("at_seconds", F.unix_micros(F.col(ts).cast("timestamp")) / 1e6)
    out = _keyed(rows, key, TimedGateProcessor(order, "at_seconds"), f"{order} {dict(events.dtypes)[order]}, at_seconds double, {STATE}", "EventTime")
    return out.withColumn(ts, F.timestamp_micros((F.col("at_seconds") * 1e6).cast("long"))).drop("at_seconds")


class BufferProcessor(Folds):
    """The state is a buffer: epoch, the time of the last frame that entered, the frames held."""

    def __init__(self, order: str, ts: str):
        self.by, self.cols, self.names = [order], [order, ts, "epoch", "delay", "max_frames", "sample_interval"], [order, "admitted", "released_seq"]

    def fold(self, key, state, rows, out):
        buffer = Buffer(*state or ())
        for o, *arrival in rows:
            out.append((key, o, *buffer.arrival(o, *arrival)))
        return buffer.epoch, buffer.last, list(buffer.held)


def release_stream(frames: DataFrame, key: str, order: str, ts: str = "ts") -> DataFrame:
    """Admission and release of every arrival of a stream, as ``buffered`` has them; the state is one buffer per key."""
    rows = arrivals(frames, key, order, F.col(ts).cast("double").alias(ts))
    return _keyed(rows, key, BufferProcessor(order, ts), f"{order} {dict(frames.dtypes)[order]}, {RELEASED}")


class RecorderProcessor(Folds):
    """The state is a frame number and the gate's last state. Payloads that are ``boxed`` come in arrays, others with ``has_payload``."""

    def __init__(self, ts: str, payload: str, fps: float, boxed: bool):
        self.fps, self.boxed, self.names = fps, boxed, ["frame_no", "pts", "blocked_reason", payload]
        self.by, self.cols = [] if boxed else [ts, "side", "has_payload", payload], [ts, "side", "has_payload", payload, "is_blocked", "reason"]

    def _unboxed(self, rows):
        got = [(at, side, has, _plain(box[0]) if has else None, *state) for at, side, has, box, *state in rows]
        return sorted(got, key=lambda x: (x[0], x[1], x[3] is not None, x[3]))

    def fold(self, key, state, rows, out):
        n, blocked, reason = state or (0, True, WAITING)
        for _, side, has, payload, is_blocked, why in self._unboxed(rows) if self.boxed else rows:
            if side == 0:
                blocked, reason = is_blocked is not False, why or WAITING
            else:
                out.append((key, n, n / self.fps, reason if blocked else None, payload if has and not blocked else None))
                n += 1
        return n, blocked, reason


#: What stands for a payload of a kind that is null, beside ``has_payload``: without nulls, numbers stay whole.
UNBOXED = {"tinyint": 0, "smallint": 0, "int": 0, "bigint": 0, "string": ""}


def record_stream(both: DataFrame, key: str, ts: str, payload: str, fps: float) -> DataFrame:
    """The protected recording of a stream of frames among gate states (``with_states``), as ``recorded`` has it; the state is a frame
    number and the gate's last state per key. Payloads that are neither whole numbers nor texts travel in arrays; they have to have an order."""
    kind, timed = dict(both.dtypes)[payload], dict(both.dtypes)[ts].startswith("timestamp")
    box = F.coalesce(payload, F.lit(UNBOXED[kind]).cast(kind)) if kind in UNBOXED else F.array_compact(F.array(payload))
    rows = both.withColumns({"has_payload": F.col(payload).isNotNull(), payload: box, **({ts: F.unix_micros(F.col(ts).cast("timestamp"))} if timed else {})})
    return _keyed(rows, key, RecorderProcessor(ts, payload, fps, kind not in UNBOXED), f"frame_no long, pts double, blocked_reason string, {payload} {kind}")


class RunnerProcessor(Folds):
    """A runner whose waiting request starts by an event-time timer, or before the first later arrival."""

    timed = True

    def __init__(self, order: str):
        self.by, self.cols, self.names = ["at_seconds", order], [order, "at_seconds", "takes"], [order, "started", "ended"]

    def due(self, state):
        until, waiting, _ = state
        return until if waiting is not None else None

    def fire(self, key, state, now, out):
        runner = Runner(*state)
        out += [(key, *x) for x in runner.due(now)]
        return runner.until, runner.waiting, runner.takes

    def fold(self, key, state, rows, out):
        runner = Runner(*state or ())
        for row in rows:
            out += [(key, *x) for x in runner.arrival(*row)]
        return runner.until, runner.waiting, runner.takes


def coalesced_stream(requests: DataFrame, key: str, order: str, ts: str = "ts", takes: str = "takes", late: str = "0 seconds") -> DataFrame:
    """The runs of a stream of requests, as ``coalesced_runs`` has them, each when it starts; ``ts`` is a timestamp, and ``order`` isn't null. The state is a
    number and two times per key; what still waits starts when the watermark, ``late`` behind the newest request, passes the end of what runs."""
    rows = requests.withWatermark(ts, late).withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp")) / 1e6)
    rows = rows.select(key, order, ts, F.col("_at").alias("at_seconds"), F.greatest(F.coalesce(F.col(takes).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("takes"))
    kind = dict(requests.dtypes)[order]
    return _keyed(rows, key, RunnerProcessor(order), f"{order} {kind}, {RUN}", "EventTime")


class PreviewProcessor(Folds):
    """A preview with its clearance timer, as an event-time timer of the state store."""

    timed = True

    def __init__(self, order: str):
        self.by, self.cols, self.names = ["at_seconds", order], [order, "at_seconds", "what", "reason", *SETTINGS], [order, *NAMES]

    def due(self, state):
        return state[0]

    def fire(self, key, state, now, out):
        preview = Preview.of(state[1])
        out += [(key, *x) for x in preview.clear(now)]
        return preview.due, preview.text()

    def fold(self, key, state, rows, out):
        preview = Preview.of(state[1]) if state else Preview()
        for event in rows:
            out += [(key, *x) for x in preview.event(*event)]
        return preview.due, preview.text()


def lifecycle_stream(events: DataFrame, key: str, order: str, ts: str = "ts", late: str = "0 seconds") -> DataFrame:
    """What previews show after every event and every clearance of a stream, as ``lifecycles`` has it; ``ts`` is a timestamp. The state is one preview per key."""
    at = events.withWatermark(ts, late).withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp")) / 1e6)
    timed = with_settings(at, key, order, "_at", ts)
    return _keyed(timed, key, PreviewProcessor(order), f"{order} long, {PREVIEW}", "EventTime")


class TickProcessor(Folds):
    """Ticks by a timer that is set again whenever it goes off, with or without rows. The state is the tick that goes on, and its rows."""

    timed = True

    def __init__(self, every: float):
        self.every, self.by, self.cols, self.names = every, ["at_seconds"], ["at_seconds"], ["tick", "n"]

    def due(self, state):
        return state[0] + self.every

    def fire(self, key, state, now, out):
        tick, n = state
        while tick + self.every <= now:
            out.append((key, tick, n))
            tick, n = tick + self.every, 0
        return tick, n

    def fold(self, key, state, rows, out):
        for (now,) in rows:
            tick, n = self.fire(key, state or (now, 0), now, out)
            state = tick, n + 1
        return state


def tick_stream(rows: DataFrame, key: str, ts: str, every: float, late: str = "0 seconds") -> DataFrame:
    """``key``, tick (seconds), n of every tick of a stream's keys when it has ended, as ``capture.all_ticks`` has them: from a key's first row on, silent ones too.

    Timers go by event time: a silent key ticks on as the watermark does.
    """
    timed = rows.withWatermark(ts, late).select(key, ts, (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("at_seconds"))
    return _keyed(timed, key, TickProcessor(every), "tick double, n long", "EventTime")


def _start(writer, spark) -> None:
    """Run a stream over what there is. State is kept in a part a core at most: each costs a store, a worker and a commit every micro-batch. Files that
    are small are read by several tasks, by their row groups."""
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    own = {"spark.sql.shuffle.partitions": str(min(int(parts), spark.sparkContext.defaultParallelism)), "spark.sql.files.openCostInBytes": str(1 << 17)}
    were = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        query = writer.trigger(availableNow=True).start()  # the stream has its own copy of the settings from then on
    finally:
        for k, v in were.items():
            spark.conf.set(k, v)
    query.awaitTermination()


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write all that a stream has now to parquet, then end."""
    _start(stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint), stream.sparkSession)


#: Buckets of keys in a table of what is shown, and its versions that stay readable.
BUCKETS, VERSIONS = 64, 3


def show_to(shown: DataFrame, path: str, checkpoint: str, key: str, buckets: int = BUCKETS) -> None:
    """Keep the table at ``path`` at what previews show now. ``shown`` is an aggregate by ``key``: a micro-batch gives the keys that changed, and only their buckets
    are written anew.

    A bucket's files are never changed. A version is a list of each bucket's files, and is there when its list is renamed into place: ``read_shown`` finds the
    last whole version at any time. A micro-batch that comes again makes the same version again.
    """
    spark, schema = shown.sparkSession, shown.schema
    bucket = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")

    def show(changed: DataFrame, number: int) -> None:
        files = _version(spark, path, number)
        changed = changed.withColumn("bucket", bucket).persist()
        touched = [r.bucket for r in changed.select("bucket").distinct().collect()]  # ``buckets`` numbers at most
        if touched:
            new = changed
            old = [files[str(b)] for b in touched if str(b) in files]
            if old:
                kept = spark.read.schema(schema).parquet(*old).withColumn("bucket", bucket)
                same = kept[key].eqNullSafe(changed[key])
                new = kept.join(changed.select(key), same, "left_anti").unionByName(changed)
            new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/{number}")
            files |= {str(b): f"{path}/data/{number}/bucket={b}" for b in touched}
        changed.unpersist()
        _publish(spark, path, number, files)

    query = shown.writeStream.outputMode("update").foreachBatch(show).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def read_shown(spark, path: str, schema) -> DataFrame:
    """The last version of a table that ``show_to`` keeps; without any, no rows."""
    files = sorted(_version(spark, path, None).values())
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def _files(spark, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _versions(spark, path: str) -> list[int]:
    fs, where = _files(spark, f"{path}/versions")
    names = [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(int(n) for n in names if n.isdigit())


def _version(spark, path: str, before: int | None) -> dict[str, str]:
    """Files by bucket of the last version, or of the last before a number."""
    numbers = [n for n in _versions(spark, path) if before is None or n < before]
    if not numbers:
        return {}
    return json.loads(spark.read.text(f"{path}/versions/{numbers[-1]}").first().value)


def _publish(spark, path: str, number: int, files: dict[str, str]) -> None:
    """Make ``files`` version ``number``; data that only versions older than the last VERSIONS use goes."""
    fs, part = _files(spark, f"{path}/.version-{number}")
    out = fs.create(part, True)
    out.write(bytearray(json.dumps(files).encode()))
    out.close()
    to = _files(spark, f"{path}/versions/{number}")[1]
    fs.mkdirs(to.getParent())
    fs.delete(to, True)
    fs.rename(part, to)
    old = _versions(spark, path)[:-VERSIONS]
    used = set(files.values()).union(*(json.loads(spark.read.text(f"{path}/versions/{n}").first().value).values() for n in _versions(spark, path)[-VERSIONS:]))
    for n in old:
        for file in json.loads(spark.read.text(f"{path}/versions/{n}").first().value).values():
            if file not in used:
                delete(spark, file)
        delete(spark, f"{path}/versions/{n}")


def record_to(stream: DataFrame, target: str) -> tuple[str | None, str | None]:
    """Record what a stream has now as parquet at ``target``: (target, None), (None, message) or, without frames, (None, None).

    Frames go to a folder beside it that takes its place when all are written; a failure leaves no partial recording there, and no old one
    that looks like a new one.
    """
    spark = stream.sparkSession
    part = f"{target}.partial"
    delete(spark, part)

    def append(frames: DataFrame, _: int) -> None:  # once a micro-batch: a failure ends the recording
        frames.write.mode("append").parquet(f"{part}/frames")

    try:
        _start(stream.writeStream.foreachBatch(append).option("checkpointLocation", f"{part}/state"), spark)
        done = spark.read.schema(stream.schema).parquet(f"{part}/frames")
        if done.isEmpty():
            return None, None
        delete(spark, target)
        source, to = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (f"{part}/frames", target))
        if not source.getFileSystem(spark._jsc.hadoopConfiguration()).rename(source, to):
            return None, FAILED_FINALIZING
        return target, None
    except Exception as e:  # whatever ends the stream ends the recording, and is reported
        delete(spark, target)
        return None, f"{FAILED_RECORDING}{e}"
    finally:
        delete(spark, part)

