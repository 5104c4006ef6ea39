"""Registered job queries (O-S4, O-J1..O-J10, O-V7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagecorpus.operators import jobs as J
from pagecorpus.plans import sqlbits as S
from pagecorpus.plans.registry import register
from pagecorpus.sources import derived as D
from pagecorpus.sources.tables import read_table

NOW = S.NOW_SQL
MAX_RETAINED = 12_000
RESULT_TTL = 3600 * 24 * 365
EXPOSED_PROFILES = ["client_0", "client_1"]


@register("job_states", S.with_views(["job_events"], """
SELECT job_id,
  CASE WHEN bool_or(event = 'succeeded') THEN 'succeeded' WHEN bool_or(event = 'failed') THEN 'failed'
       WHEN bool_or(event = 'cancelled') THEN 'cancelled' WHEN bool_or(event = 'started') THEN 'running'
       ELSE 'queued' END AS status,
  min(ts) FILTER (WHERE event = 'created') AS created_at,
  min(ts) FILTER (WHERE event = 'started') AS started_at,
  min(ts) FILTER (WHERE event IN ('succeeded', 'failed')) AS finished_at,
  max(ts) AS updated_at
FROM job_events GROUP BY job_id"""))
def q_job_states(spark, sf_dir):
    """O-J1: current job states folded from the event log."""
    return J.fold_events(D.job_events(spark, sf_dir)).select(
        "job_id", "status", "created_at", "started_at", "finished_at", "updated_at")


@register("job_cancel", S.with_views(["jobs"], f"""
SELECT job_id, CASE WHEN status = 'queued' AND job_id % 7 = 0 THEN 'cancelled' ELSE status END AS status,
       CASE WHEN status = 'queued' AND job_id % 7 = 0 THEN {NOW} END AS cancelled_at
FROM jobs"""))
def q_job_cancel(spark, sf_dir):
    """O-J2: cancel requests for every seventh job id; only queued jobs change."""
    jb = D.jobs(spark, sf_dir).withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    req = jb.filter(F.col("job_id") % 7 == 0).select("job_id")
    out = J.cancel(jb, req, D.now_col())
    return out.select("job_id", "status", F.col("updated_at").alias("cancelled_at"))


@register("job_delete", S.with_views(["jobs"], """
SELECT job_id, status FROM jobs WHERE job_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '5-LOW')"""))
def q_job_delete(spark, sf_dir):
    """O-J3: delete jobs (those of low-priority orders) -- left-anti join."""
    gone = read_table(spark, sf_dir, "orders").filter(F.col("o_orderpriority") == "5-LOW") \
        .select(F.col("o_orderkey").alias("job_id"))
    return D.jobs(spark, sf_dir).join(gone, "job_id", "left_anti").select("job_id", "status")


@register("job_get", S.with_views(["jobs"], """
SELECT j.job_id, j.status, CASE WHEN j.profile_name IN ('client_0', 'client_1') THEN j.profile_name END AS profile_name,
       j.created_at FROM jobs j
WHERE j.job_id IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1 AND l_quantity >= 45)"""))
def q_job_get(spark, sf_dir):
    """O-J4 / O-V7: get jobs by id (ids looked up from line items); response projection
    without the job's stored configuration."""
    ids = read_table(spark, sf_dir, "lineitem").filter((F.col("l_linenumber") == 1) & (F.col("l_quantity") >= 45)) \
        .select(F.col("l_orderkey").alias("job_id")).distinct()
    jb = D.jobs(spark, sf_dir).join(ids, "job_id", "left_semi")
    shown = F.when(F.col("profile_name").isin(EXPOSED_PROFILES), F.col("profile_name"))  # O-V7
    return jb.select("job_id", "status", shown.alias("profile_name"), "created_at")


@register("job_listing", S.with_views(["jobs"], """
SELECT job_id, status, created_at, CAST(row_number() OVER (ORDER BY created_at DESC, job_id DESC) AS BIGINT) AS position,
       CAST(count(*) OVER () AS BIGINT) AS total FROM jobs"""))
def q_job_listing(spark, sf_dir):
    """O-S4: job listing, newest first, with its position and the total count.

    The position is a global rank built in three levels, so no window holds the table:
    jobs in newer hours (prefix over the hour table) + jobs in newer seconds of the same
    hour (window per hour over at most 3 600 second rows) + the rank inside the second."""
    from pyspark.sql import Window
    jb = D.jobs(spark, sf_dir).select("job_id", "status", "created_at")
    total = jb.select(F.count(F.lit(1))).scalar()
    jb = (jb.withColumn("_h", F.date_trunc("hour", "created_at"))
          .withColumn("_s", F.date_trunc("second", "created_at")))
    hours = jb.groupBy("_h").agg(F.count(F.lit(1)).alias("_n"))
    hours = hours.withColumn("_newer_h", F.coalesce(F.sum("_n").over(
        Window.orderBy(F.col("_h").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    secs = jb.groupBy("_h", "_s").agg(F.count(F.lit(1)).alias("_n"))
    secs = secs.withColumn("_newer_s", F.coalesce(F.sum("_n").over(
        Window.partitionBy("_h").orderBy(F.col("_s").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = Window.partitionBy("_s").orderBy(F.col("created_at").desc(), F.col("job_id").desc())
    ranked = (jb.join(hours.select("_h", "_newer_h"), "_h").join(secs.select("_s", "_newer_s"), "_s")
              .withColumn("position", (F.col("_newer_h") + F.col("_newer_s") + F.row_number().over(inner)).cast("long")))
    return ranked.select("job_id", "status", "created_at", "position", total.cast("long").alias("total"))


@register("job_retention", S.with_views(["jobs"], f"""
SELECT job_id, status, coalesce(rn <= to_remove, false) AS evicted
FROM (SELECT j.*, CASE WHEN status IN ('succeeded', 'failed', 'cancelled')
                       THEN row_number() OVER (PARTITION BY status IN ('succeeded', 'failed', 'cancelled')
                                               ORDER BY coalesce(finished_at, created_at), job_id) END AS rn,
             CASE WHEN count(*) OVER () >= {MAX_RETAINED} THEN count(*) OVER () - {MAX_RETAINED} + 1 ELSE 0 END AS to_remove
      FROM jobs j)"""))
def q_job_retention(spark, sf_dir):
    """O-J5: retention cap -- the oldest finished jobs beyond the cap are evicted."""
    return J.retention(D.jobs(spark, sf_dir), MAX_RETAINED).select("job_id", "status", "evicted")


@register("job_result_ttl", S.with_views(["jobs"], f"""
SELECT job_id FROM jobs WHERE finished_at IS NOT NULL AND finished_at < {NOW} - INTERVAL {RESULT_TTL} SECOND"""))
def q_job_result_ttl(spark, sf_dir):
    """O-J6: finished jobs whose results have outlived the result TTL."""
    return J.expired_results(D.jobs(spark, sf_dir), D.now_col(), RESULT_TTL).select("job_id")


@register("job_queue_series", S.with_views(["job_events"], """
SELECT hour, sum(dq) OVER (ORDER BY hour ROWS UNBOUNDED PRECEDING) AS queue_size,
       sum(dr) OVER (ORDER BY hour ROWS UNBOUNDED PRECEDING) AS running
FROM (SELECT date_trunc('hour', ts) AS hour,
             sum(CASE WHEN event = 'created' THEN 1 WHEN event IN ('started', 'cancelled') THEN -1 ELSE 0 END) AS dq,
             sum(CASE WHEN event = 'started' THEN 1 WHEN event IN ('succeeded', 'failed') THEN -1 ELSE 0 END) AS dr
      FROM job_events GROUP BY 1)"""))
def q_job_queue_series(spark, sf_dir):
    """O-J7 (and O-M7 gauges): queue size and running jobs at the end of each hour."""
    return J.queue_series(D.job_events(spark, sf_dir)).select(
        "hour", F.col("queue_size").cast("long").alias("queue_size"), F.col("running").cast("long").alias("running"))


@register("job_durations", S.with_views(["jobs"], """
SELECT profile_name, count(*) AS jobs,
       avg(epoch_us(started_at) - epoch_us(created_at)) / 1e6 AS avg_wait_seconds,
       avg(epoch_us(finished_at) - epoch_us(started_at)) / 1e6 AS avg_run_seconds
FROM jobs GROUP BY profile_name"""))
def q_job_durations(spark, sf_dir):
    """O-J8: wait and run durations by profile (mean; the p95 is in the operator)."""
    return J.durations_by_profile(D.jobs(spark, sf_dir)).select(
        "profile_name", "jobs", "avg_wait_seconds", "avg_run_seconds")


@register("job_fifo_check", S.with_views(["jobs"], """
SELECT job_id, coalesce(epoch_us(started_at) < lag(epoch_us(started_at)) OVER (ORDER BY created_at, job_id), false) AS out_of_order
FROM jobs WHERE started_at IS NOT NULL"""))
def q_job_fifo_check(spark, sf_dir):
    """O-J9: FIFO order check of job starts against creation order."""
    return J.fifo_check(D.jobs(spark, sf_dir)).select("job_id", "out_of_order")


@register("job_results", S.with_views(["jobs", "page_keys"], """
SELECT j.job_id, j.status, CASE WHEN j.status = 'succeeded' THEN k.url END AS result_url,
       CASE WHEN j.status = 'failed' THEN 'http_error' END AS error_type,
       CASE WHEN j.status = 'failed' THEN 'Fetch of ' || k.url || ' failed' END AS error_message
FROM jobs j JOIN page_keys k ON k.page_id = j.job_id % (SELECT count(*) FROM pages)
WHERE j.status IN ('succeeded', 'failed')"""))
def q_job_results(spark, sf_dir):
    """O-J10: job result -- the pipeline output for succeeded jobs, a flat error struct for
    failed ones (each job scrapes page ``job_id mod pages``)."""
    jb = D.jobs(spark, sf_dir).filter(F.col("status").isin("succeeded", "failed"))
    n_pages = read_table(spark, sf_dir, "pages").select(F.count(F.lit(1))).scalar()
    k = D.page_keys(spark, sf_dir).select("page_id", "url")
    j = jb.withColumn("page_id", F.col("job_id") % n_pages).join(k, "page_id")
    ok = F.col("status") == "succeeded"
    return j.select("job_id", "status", F.when(ok, F.col("url")).alias("result_url"),
                    F.when(~ok, F.lit("http_error")).alias("error_type"),
                    F.when(~ok, F.concat(F.lit("Fetch of "), F.col("url"), F.lit(" failed"))).alias("error_message"))
