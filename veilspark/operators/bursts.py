"""Bursts of scans, requests of which the latest wins, and generations that outdate results."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.operators.detect import label


def burst_verdicts(scans: DataFrame, keys: list[str], order: str, value: str = "status", count: Column | int | None = None) -> DataFrame:
    """Per burst the first scan that isn't clean, else the last clean one: ``keys``, seq, status.

    With ``count`` only a burst's first so many scans count, at least one.
    """
    if count is not None:
        scans = scans.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
        scans = scans.where(F.col("_nth") <= F.greatest(count if isinstance(count, Column) else F.lit(count), F.lit(1)))
    bad = F.col(value) != "clean"
    first = F.min_by(F.struct(F.col(order).alias("seq"), F.col(value).alias("status")), F.when(bad, F.col(order)))
    last = F.max_by(F.struct(F.col(order).alias("seq"), F.col(value).alias("status")), F.col(order))
    any_bad = F.bool_or(bad)
    out = scans.groupBy(*keys).agg(F.when(any_bad, first).otherwise(last).alias("x"))
    return out.select(*keys, F.col("x.seq").cast("long").alias("seq"), F.col("x.status").alias("status"))


def check_counts(checks: DataFrame, keys: list[str]) -> DataFrame:
    """How many checks (``ok``; null counts as failed) were made and how many failed, by ``keys``; the failures are ``checks`` where not ``ok``."""
    return checks.groupBy(*keys).agg(F.count("*").alias("checks"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("failures"))


def coalesced(requests: DataFrame, keys: list[str], order: str, busy: Column) -> DataFrame:
    """Requests that run: one at a time; of those that arrive while one runs, the latest. ``busy`` numbers the stretch of time that
    a running request fills."""
    last = Window.partitionBy(*keys, busy).orderBy(F.col(order).desc())
    return requests.withColumn("_rank", F.row_number().over(last)).where("_rank = 1").drop("_rank")


class Runner:
    """Runs one request at a time. Of the requests that come while one runs only the latest waits; it starts when that one ends."""

    def __init__(self, until: float | None = None, waiting=None, takes: float = 0.0):
        self.until, self.waiting, self.takes = until, waiting, takes

    def _start(self, number, now: float, takes: float) -> tuple:
        self.until = now + takes
        return number, now, self.until

    def due(self, now: float) -> list[tuple]:
        """(number, started, ended) of the waiting request, if its turn has come."""
        if self.waiting is None or self.until > now:
            return []
        number, self.waiting = self.waiting, None
        return [self._start(number, self.until, self.takes)]

    def arrival(self, number, now: float, takes: float) -> list[tuple]:
        """The runs that start up to an arrival, itself included if nothing runs."""
        out = self.due(now)
        if self.until is None or self.until <= now:
            return [*out, self._start(number, now, takes)]
        self.waiting, self.takes = number, takes
        return out


RUN = "started double, ended double"


def requests_of(requests: DataFrame, key: str, order: str, ts: str, takes: str) -> DataFrame:
    """``key``, ``order``, and as seconds ``ts`` and ``takes``; a null or negative duration is none."""
    return requests.select(key, order, F.col(ts).cast("double").alias("ts"), F.greatest(F.coalesce(F.col(takes).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("takes"))


def coalesced_runs(requests: DataFrame, key: str, order: str, ts: str = "ts", takes: str = "takes") -> DataFrame:
    """``key``, ``order``, started, ended of the requests that run, each for as long as it ``takes``: one at a time; of those that arrive while one runs the
    latest, when it ends. The others never run.

    A run's start depends on the end of the one before, so partitions are sorted and read in order; a task holds one waiting request. A null key is a
    stream of its own; requests at one time come by ``order``.
    """
    kinds = dict(requests.dtypes)
    rows = requests_of(requests, key, order, ts, takes).repartition(key).sortWithinPartitions(key, "ts", order)

    def run(batches):
        at, runner, names = None, Runner(), [key, order, "started", "ended"]
        types = None

        def rows_of(found):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names)

        for b in batches:
            types, out = [b.schema.types[0], b.schema.types[1], pa.float64(), pa.float64()], []
            for k, number, now, takes in zip(*(c.to_pylist() for c in b.columns)):
                if (k,) != at:
                    out += [(*at, *x) for x in runner.due(float("inf"))]
                    at, runner = (k,), Runner()
                out += [(k, *x) for x in runner.arrival(number, now, takes)]
            if out:
                yield rows_of(out)
        last = [(*at, *x) for x in runner.due(float("inf"))] if at else []
        if last:
            yield rows_of(last)

    return rows.mapInArrow(run, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, {RUN}")


def current(rows: DataFrame, epochs: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the generation that is current."""
    return rows.join(epochs, keys, "left_semi")


def cancelled(rows: DataFrame, epochs: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose generation is no longer current."""
    return rows.join(epochs, keys, "left_anti")


def detected_reason(app: Column, kinds: Column) -> Column:
    """What a gate says on a detection: its labels once each, in order."""
    labels = F.array_join(F.array_sort(F.array_distinct(F.transform(kinds, label))), ", ")
    return F.concat(F.lit("PII detected in "), app, F.lit(" · "), labels)
