"""Job operators (O-J1..O-J10): event log folded into states, retention, reports.

A job's events are few, so the fold is a per-job ordered ``aggregate`` over its sorted event
array (bounded by the number of events of one job).  Time-series reports aggregate per hour
first and run their prefix over the small hourly table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagecorpus.operators import scan
from pagecorpus.operators.retention import keep_newest
from pagecorpus.sources.derived import seconds

TERMINAL = ["succeeded", "failed", "cancelled"]


def _step(acc: Column, e: Column) -> Column:
    """One legal transition: created -> queued; started (queued) -> running; succeeded /
    failed (running); cancelled (queued only).  Anything else leaves the state as it is."""
    status, ev, ts = acc["status"], e["event"], e["ts"]
    new_status = (F.when((ev == "created") & status.isNull(), F.lit("queued"))
                  .when((ev == "started") & (status == "queued"), F.lit("running"))
                  .when(ev.isin("succeeded", "failed") & (status == "running"), ev)
                  .when((ev == "cancelled") & (status == "queued"), F.lit("cancelled"))
                  .otherwise(status))
    moved = ~F.coalesce(new_status == status, F.lit(False)) & new_status.isNotNull()
    return F.struct(
        new_status.alias("status"),
        F.when((ev == "created") & moved, ts).otherwise(acc["created_at"]).alias("created_at"),
        F.when((ev == "started") & moved, ts).otherwise(acc["started_at"]).alias("started_at"),
        F.when(ev.isin("succeeded", "failed") & moved, ts).otherwise(acc["finished_at"]).alias("finished_at"),
        F.when(moved, ts).otherwise(acc["updated_at"]).alias("updated_at"),
        (acc["ignored"] + F.when(moved, F.lit(0)).otherwise(F.lit(1))).alias("ignored"),
    )


def event_rank(event: Column) -> Column:
    """Order of events of one instant: a same-instant start follows creation."""
    return F.when(event == "created", 0).when(event == "started", 1).when(event == "cancelled", 2).otherwise(3)


def new_job(ts_type: str = "timestamp_ntz") -> Column:
    """A job of which no event is known."""
    return F.struct(F.lit(None).cast("string").alias("status"),
                    F.lit(None).cast(ts_type).alias("created_at"),
                    F.lit(None).cast(ts_type).alias("started_at"),
                    F.lit(None).cast(ts_type).alias("finished_at"),
                    F.lit(None).cast(ts_type).alias("updated_at"),
                    F.lit(0).alias("ignored"))


def fold(job: Column, events: Column) -> Column:
    """The job after its ``(ts, rank, event)`` structs, in their order."""
    return F.aggregate(F.array_sort(events), job, _step)


def fold_events(events: DataFrame) -> DataFrame:
    """O-J1: ``(job_id, ts, event)`` -> current state per job, illegal transitions ignored
    (and counted), ties ordered by event rank so a same-instant start follows creation."""
    evs = events.select("job_id", F.struct(F.col("ts"), event_rank(F.col("event")).alias("rank"), F.col("event")).alias("e"))
    grouped = evs.groupBy("job_id").agg(F.collect_list("e").alias("evs"))
    return grouped.select("job_id", fold(new_job(), F.col("evs")).alias("s")).select("job_id", "s.*")


def cancel(jobs: DataFrame, requests: DataFrame, at: Column) -> DataFrame:
    """O-J2: cancel requests ``(job_id)``; only queued jobs change (to cancelled, with
    ``updated_at`` set and ``finished_at`` left empty)."""
    r = requests.select("job_id").distinct().withColumn("_req", F.lit(True))
    j = jobs.join(r, "job_id", "left")
    j = j.withColumn("_hit", F.coalesce(F.col("_req"), F.lit(False)) & (F.col("status") == "queued"))
    return (j.withColumn("status", F.when(F.col("_hit"), F.lit("cancelled")).otherwise(F.col("status")))
            .withColumn("updated_at", F.when(F.col("_hit"), at).otherwise(F.col("updated_at")))
            .drop("_req", "_hit"))


def retention(jobs: DataFrame, max_retained: int) -> DataFrame:
    """O-J5 / S19: when the store holds ``n >= max_retained`` jobs, remove the
    ``n - max_retained + 1`` oldest finished jobs (by finished_at, else created_at; ties by
    job id).  Queued and running jobs never go.  Adds ``evicted``."""
    n = jobs.select(F.count(F.lit(1))).scalar()
    fin = jobs.filter(F.col("status").isin(TERMINAL)).withColumn(
        "_age", F.coalesce("finished_at", "created_at"))
    n_fin = jobs.filter(F.col("status").isin(TERMINAL)).select(F.count(F.lit(1))).scalar()
    to_remove = F.when(n >= F.lit(max_retained), n - F.lit(max_retained) + 1).otherwise(F.lit(0))
    keep = F.greatest(n_fin - to_remove, F.lit(0))
    kept = keep_newest(fin, "_age", "job_id", keep, out="_keep")
    return (jobs.filter(~F.col("status").isin(TERMINAL)).withColumn("evicted", F.lit(False))
            .unionByName(kept.withColumn("evicted", ~F.col("_keep")).drop("_keep", "_age")))


def expired_results(jobs: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """O-J6: finished jobs whose result is older than the result TTL."""
    return jobs.filter(F.col("finished_at").isNotNull() & (F.col("finished_at") < now - seconds(ttl_seconds)))


def queue_series(events: DataFrame) -> DataFrame:
    """O-J7: queue size and running count at the end of every hour.

    Deltas are summed per hour first (distributed); the running total runs over the
    hourly table, which has one row per hour."""
    ev = F.col("event")
    d = events.select(F.date_trunc("hour", F.col("ts")).alias("hour"),
                      F.when(ev == "created", 1).when(ev.isin("started", "cancelled"), -1).otherwise(0).alias("dq"),
                      F.when(ev == "started", 1).when(ev.isin("succeeded", "failed"), -1).otherwise(0).alias("dr"))
    hourly = d.groupBy("hour").agg(F.sum("dq").alias("dq"), F.sum("dr").alias("dr"))
    w = Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hourly.select("hour", F.sum("dq").over(w).alias("queue_size"), F.sum("dr").over(w).alias("running"))


def durations_by_profile(jobs: DataFrame) -> DataFrame:
    """O-J8: mean wait (created -> started) and run (started -> finished) seconds."""
    wait = F.unix_micros(F.col("started_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))
    run = F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    return jobs.groupBy("profile_name").agg(
        F.count(F.lit(1)).alias("jobs"),
        (F.avg(wait) / 1e6).alias("avg_wait_seconds"),
        (F.avg(run) / 1e6).alias("avg_run_seconds"),
        F.percentile_approx(wait / 1e6, 0.95).alias("p95_wait_seconds"))


def fifo_check(jobs: DataFrame) -> DataFrame:
    """O-J9: a started job that starts before the previously created started job breaks
    FIFO order.  The previous row is looked up in parts of equal row count (no global window)."""
    s = jobs.filter(F.col("started_at").isNotNull()).withColumn(
        "_st", F.unix_micros(F.col("started_at").cast("timestamp")))
    s = scan.previous_value(s, [], "created_at", "job_id", "_st", "_prev")
    return s.withColumn("out_of_order", F.coalesce(F.col("_st") < F.col("_prev"), F.lit(False))).drop("_st", "_prev")
