"""Keyed state of the streams: job states (O-T4) and suppression by TTL (O-T2).

Job states are columns: a micro-batch folds its events into the state of all live jobs at once
(``advance``), since a stateful processor in Python takes several exchanges with the JVM for each
of millions of jobs.  ``JobLog`` keeps the state of each batch as a table under the checkpoint folder.

Suppression is a stateful processor.  Spark drops rows older than the watermark before it sees them.
The query therefore gives Spark a watermark of ``LOOKBACK`` and the processor uses a tighter one, later
by ``LOOKBACK`` less the allowed lateness: rows between the two reach the processor, which gives them
out as ``late`` instead of losing them.  Timers are set on Spark's clock, shifted by as much.

Times are microseconds since 1970.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import Row

from pagecorpus.operators import jobs as J
from pagecorpus.session import fs_delete, fs_exists, fs_list, fs_read_text, fs_write_once

LOOKBACK = "365 days"
_LOOKBACK_MS = 365 * 86_400_000

JOB_ROWS = ("job_id long, kind string, status string, created_us long, started_us long, finished_us long, updated_us long, "
            "ignored int, event string")
#: State of a job: what events before the watermark settled (``job``), the few newer events, which may still
#: arrive out of order, and the job with them (``seen``); whether events came in the batch, and whether it left.
JOB_STATE = ("job_id long, job {0}, newer array<struct<ts long, rank int, event string>>, seen {0}, came boolean, gone boolean").format(
    "struct<status string, created_at long, started_at long, finished_at long, updated_at long, ignored int>")
SUPPRESSED_ROWS = "key string, seq long, ts_us long, kind string"

_RANK = {"created": 0, "started": 1, "cancelled": 2}
#: Legal transitions: (status, event) to status.
_MOVES = {(None, "created"): "queued", ("queued", "started"): "running", ("running", "succeeded"): "succeeded",
          ("running", "failed"): "failed", ("queued", "cancelled"): "cancelled"}
_STAMP = {"queued": "created_us", "running": "started_us", "succeeded": "finished_us", "failed": "finished_us"}


def fold(job: dict, events: list[tuple[int, str]]) -> dict:
    """The job after the events, in order of time and rank; illegal ones are counted and change nothing.
    The plain form of ``jobs.fold``, to test it by."""
    job = dict(job)
    for ts, event in sorted(events, key=lambda e: (e[0], _RANK.get(e[1], 3))):
        status = _MOVES.get((job["status"], event))
        if status is None:
            job["ignored"] += 1
            continue
        job["status"] = status
        if status in _STAMP:
            job[_STAMP[status]] = ts
        job["updated_us"] = ts
    return job


def live(state: DataFrame) -> DataFrame:
    """The jobs that are still in the state: not removed, and with more than illegal events."""
    return state.where(~F.col("gone") & (F.col("job.status").isNotNull() | (F.size("newer") > 0)))


def advance(state: DataFrame, events: DataFrame, now_us: int | None, ttl_us: int) -> DataFrame:
    """The state (``JOB_STATE``) after events (job_id, ts_us, event) that are not late.  Events before the watermark
    ``now_us`` (None: not known yet) are settled; a job that finished longer than the TTL before it is ``gone``."""
    event = F.struct(F.col("ts_us").alias("ts"), J.event_rank(F.col("event")).alias("rank"), F.col("event").alias("event"))
    came = events.groupBy(F.col("job_id").alias("id")).agg(F.collect_list(event).alias("fresh"))
    held = live(state).select("job_id", "job", "newer")
    met = held.join(came, F.col("job_id").eqNullSafe(F.col("id")), "full_outer").select(
        F.coalesce("job_id", "id").alias("job_id"), "job", F.coalesce(F.concat("newer", "fresh"), "newer", "fresh").alias("events"),
        F.col("fresh").isNotNull().alias("came"))
    now = F.lit(now_us).cast("long")

    def old(e: Column) -> Column:  # an event without a time is older than all others
        return F.coalesce(e["ts"] < now, e["ts"].isNull())

    def after(job: Column, some: Column) -> Column:  # most jobs of a large state have no event
        return F.when(F.size(some) == 0, job).otherwise(J.fold(job, some))

    settled = met.select("job_id", after(F.coalesce("job", J.new_job("long")), F.filter("events", old)).alias("job"),
                         F.filter("events", lambda e: ~old(e)).alias("newer"), "came")
    seen = settled.select("job_id", "job", "newer", after(F.col("job"), F.col("newer")).alias("seen"), "came")
    gone = F.col("seen.status").isin(J.TERMINAL) & (F.col("seen.updated_at") + F.lit(ttl_us) < now)
    return seen.withColumn("gone", F.coalesce(gone, F.lit(False)))


def job_rows(state: DataFrame) -> DataFrame:
    """The rows (``JOB_ROWS``) that a batch gives out: ``state`` of the jobs that got events, ``expired`` of those that left."""
    kinds = F.array_compact(F.array(F.when(F.col("came"), "state"), F.when(F.col("gone"), "expired")))
    return state.where("came or gone").select(
        "job_id", F.explode(kinds).alias("kind"), "seen.status", *(F.col(f"seen.{c}_at").alias(f"{c}_us") for c in ("created", "started", "finished", "updated")),
        "seen.ignored", F.lit(None).cast("string").alias("event"))


def late_rows(events: DataFrame) -> DataFrame:
    """Late events (job_id, ts_us, event) as ``JOB_ROWS``."""
    no = F.lit(None).cast("long")
    return events.select("job_id", F.lit("late").alias("kind"), F.lit(None).cast("string").alias("status"), no.alias("created_us"), no.alias("started_us"),
                         no.alias("finished_us"), F.col("ts_us").alias("updated_us"), F.lit(0).alias("ignored"), "event")


class JobLog:
    """The states of a stream's batches under ``root``, each with the newest event time so far.  A version counts once its
    small text file is there; then the state before it goes."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        done = [int(f.split(".")[0]) for f in fs_list(spark, root) if f.endswith(".newest_us")]
        self.version = max(done, default=-1)
        said = fs_read_text(spark, self._newest(self.version)) if done else ""
        self.newest_us = int(said) if said else None

    def _newest(self, version: int) -> str:
        return os.path.join(self.root, f"{version}.newest_us")

    def state(self, version: int | None = None) -> DataFrame:
        path = os.path.join(self.root, str(self.version if version is None else version))
        if not fs_exists(self.spark, path):
            return self.spark.createDataFrame([], JOB_STATE)
        return self.spark.read.schema(JOB_STATE).parquet(path)

    def write(self, version: int, state: DataFrame) -> DataFrame:
        state.write.mode("overwrite").parquet(os.path.join(self.root, str(version)))
        return self.state(version)

    def commit(self, version: int, newest_us: int | None) -> None:
        fs_write_once(self.spark, self._newest(version), "" if newest_us is None else str(newest_us))
        if self.version >= 0:
            fs_delete(self.spark, os.path.join(self.root, str(self.version)))

    def rows(self) -> int:
        """Jobs in the state and their newer events."""
        return int(live(self.state()).agg(F.coalesce(F.sum(F.size("newer") + 1), F.lit(0))).first()[0])


class _Clock(StatefulProcessor):
    """The tighter watermark, and timers set by it."""

    def __init__(self, lateness_seconds: int):
        self.shift_ms = _LOOKBACK_MS - lateness_seconds * 1000

    def now_us(self, timers) -> int | None:
        """The tighter watermark; None before the first batch has ended."""
        at = timers.getCurrentWatermarkInMs()
        return (at + self.shift_ms) * 1000 if at > 0 else None

    def wake(self, at_us: int) -> None:
        self.handle.registerTimer(max(1, at_us // 1000 + 1 - self.shift_ms))

    def close(self) -> None:
        pass


class Suppression(_Clock):
    """State of a key: until when its last kept row holds; a timer removes it then."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "until_us long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        now = self.now_us(timerValues)
        holds = self.until.exists()
        until = self.until.get()[0] if holds else None
        out = Row("key", "seq", "ts_us", "kind")
        changed = False
        for r in sorted(rows, key=lambda r: (r.ts_us, r.seq)):
            if now is not None and r.ts_us < now:
                yield out(key[0], r.seq, r.ts_us, "late")
            elif not holds or until is not None and r.ts_us > until:
                holds, until, changed = True, r.until_us, True
                yield out(key[0], r.seq, r.ts_us, "kept")
        if changed:
            self.until.update((until,))
            if until is not None:
                self.wake(until)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = self.now_us(timerValues)
        if now is not None and self.until.exists():
            until = self.until.get()[0]
            if until is not None and until < now:
                self.until.clear()
        return iter(())
