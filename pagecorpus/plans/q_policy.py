"""Registered policy / pacing / batch queries (O-D1..O-D3, O-D5..O-D9, O-V3, O-V4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagecorpus.operators import policy as pol
from pagecorpus.plans import sqlbits as S
from pagecorpus.plans.registry import ORACLES, register
from pagecorpus.sources import derived as D

NOW = S.NOW_SQL
SERVER_MAX_CONCURRENCY = 3
BATCH_SIZE = 25

LOGP_SQL = """logp AS (
  SELECT f.*, k.domain, k.url, coalesce(p.allowed, true) AS allowed,
         coalesce(CAST(p.min_delay_seconds AS DOUBLE), 5.0) AS min_delay_seconds,
         coalesce(p.max_concurrent_requests, 1) AS max_concurrent_requests,
         p.default_ttl_seconds, p.domain IS NOT NULL AS has_policy
  FROM fetch_log f JOIN page_keys k USING (page_id) LEFT JOIN policies p ON p.domain = k.domain)"""
VIEWS = ["fetch_log", "page_keys", "policies"]


def _logp(spark, sf_dir):
    f = D.fetch_log(spark, sf_dir)
    k = D.page_keys(spark, sf_dir).select("page_id", "domain", "url")
    return pol.with_policy(f.join(k, "page_id"), D.policies(spark, sf_dir))


@register("policy_lookup", S.with_views(["page_keys", "policies"], """
SELECT k.domain, coalesce(p.allowed, true) AS allowed, coalesce(CAST(p.min_delay_seconds AS DOUBLE), 5.0) AS min_delay_seconds,
       coalesce(p.max_concurrent_requests, 1) AS max_concurrent_requests, p.default_ttl_seconds
FROM (SELECT DISTINCT domain FROM page_keys) k LEFT JOIN policies p ON p.domain = k.domain"""))
def q_policy_lookup(spark, sf_dir):
    """O-D1: every crawled domain's policy with defaults filled in."""
    doms = D.page_keys(spark, sf_dir).select("domain").distinct()
    return pol.with_policy(doms, D.policies(spark, sf_dir)).select(
        "domain", "allowed", "min_delay_seconds", "max_concurrent_requests", "default_ttl_seconds")


@register("policy_admission", S.with_views(VIEWS, """
SELECT request_id, domain,
  CASE WHEN NOT has_policy THEN 'domain_not_in_allow_list' WHEN NOT allowed THEN 'domain_not_allowed' END AS reason
FROM logp""", LOGP_SQL))
def q_policy_admission(spark, sf_dir):
    """O-D2 / O-U7: requests refused by the domain policy / allow-list, with the reason."""
    return _logp(spark, sf_dir).select("request_id", "domain", pol.admission(None).alias("reason"))


@register("pacing_plan", S.with_views(VIEWS, """
SELECT request_id, domain, P + max(arr - P) OVER (PARTITION BY domain ORDER BY requested_at, request_id
                                                  ROWS UNBOUNDED PRECEDING) AS planned_start_us,
       P + max(arr - P) OVER (PARTITION BY domain ORDER BY requested_at, request_id ROWS UNBOUNDED PRECEDING) - arr AS wait_us
FROM (SELECT *, coalesce(sum(c) OVER (PARTITION BY domain ORDER BY requested_at, request_id
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS P
      FROM (SELECT request_id, domain, requested_at, epoch_us(requested_at) AS arr,
                   elapsed_ms * 1000 + CAST(min_delay_seconds * 1000000 AS BIGINT) AS c FROM logp))""", LOGP_SQL))
def q_pacing_plan(spark, sf_dir):
    """O-D3: earliest start of every logged request per domain (one at a time, delay after
    the previous finish)."""
    return pol.pacing_plan(_logp(spark, sf_dir)).select("request_id", "domain", "planned_start_us", "wait_us")


@register("delay_audit", S.with_views(VIEWS, """
SELECT request_id, domain, gap_us, coalesce(gap_us < CAST(min_delay_seconds * 1000000 AS BIGINT), false) AS violation
FROM (SELECT request_id, domain, min_delay_seconds,
             epoch_us(requested_at) - lag(epoch_us(requested_at) + elapsed_ms * 1000)
               OVER (PARTITION BY domain ORDER BY requested_at, request_id) AS gap_us FROM logp)""", LOGP_SQL))
def q_delay_audit(spark, sf_dir):
    """O-D5: min-delay audit of the fetch log."""
    return pol.delay_audit(_logp(spark, sf_dir)).select("request_id", "domain", "gap_us", "violation")


@register("concurrency_audit", S.with_views(VIEWS, """
SELECT domain, max(open_now) AS peak_open, any_value(max_concurrent_requests) AS "limit",
       max(open_now) > any_value(max_concurrent_requests) AS violated
FROM (SELECT domain, max_concurrent_requests,
             sum(delta) OVER (PARTITION BY domain ORDER BY t_us, delta, request_id ROWS UNBOUNDED PRECEDING) AS open_now
      FROM (SELECT domain, request_id, max_concurrent_requests, epoch_us(requested_at) AS t_us, 1 AS delta FROM logp
            UNION ALL
            SELECT domain, request_id, max_concurrent_requests, epoch_us(requested_at) + elapsed_ms * 1000, -1 FROM logp))
GROUP BY domain""", LOGP_SQL))
def q_concurrency_audit(spark, sf_dir):
    """O-D6: peak concurrent requests per domain against the policy limit."""
    return pol.concurrency_audit(_logp(spark, sf_dir)).select(
        "domain", F.col("peak_open").cast("long").alias("peak_open"), F.col("limit").cast("int").alias("limit"),
        "violated")


@register("can_proceed", S.with_views(VIEWS, f"""
SELECT domain, open_requests, last_finish_us,
  allowed AND open_requests < max_concurrent_requests
  AND (last_finish_us IS NULL OR epoch_us({NOW}) - last_finish_us >= CAST(min_delay_seconds * 1000000 AS BIGINT)) AS can_proceed
FROM (SELECT domain, any_value(allowed) AS allowed, any_value(min_delay_seconds) AS min_delay_seconds,
             any_value(max_concurrent_requests) AS max_concurrent_requests,
             count(*) FILTER (WHERE epoch_us(requested_at) <= epoch_us({NOW})
                              AND epoch_us({NOW}) < epoch_us(requested_at) + elapsed_ms * 1000) AS open_requests,
             max(epoch_us(requested_at) + elapsed_ms * 1000)
               FILTER (WHERE epoch_us(requested_at) + elapsed_ms * 1000 <= epoch_us({NOW})) AS last_finish_us
      FROM logp GROUP BY domain)""", LOGP_SQL))
def q_can_proceed(spark, sf_dir):
    """O-D7: can a new request start on each domain at "now"."""
    return pol.can_proceed(_logp(spark, sf_dir), D.now_col()).select(
        "domain", "open_requests", "last_finish_us", "can_proceed")


@register("batch_items", S.with_views(VIEWS, f"""
SELECT request_id // {BATCH_SIZE} AS batch_id, request_id, url, NOT failed AS success,
       CASE WHEN failed THEN 'http_error' END AS error_type,
       CASE WHEN failed THEN 'HTTP ' || CAST(status_code AS VARCHAR) END AS error_message,
       least(profile_concurrency, {SERVER_MAX_CONCURRENCY}) AS effective_concurrency
FROM (SELECT *, 1 + CAST(substr(profile, 8) AS INTEGER) * 3 AS profile_concurrency FROM logp)""", LOGP_SQL))
def q_batch_items(spark, sf_dir):
    """O-D8 / O-V4: per-item batch outcome; concurrency = min(requested, server cap)."""
    d = _logp(spark, sf_dir).withColumn("batch_id", (F.col("request_id") / BATCH_SIZE).cast("long"))
    d = d.withColumn("profile_concurrency", 1 + F.substring("profile", 8, 10).cast("int") * 3)
    return pol.batch_items(d).select(
        "batch_id", "request_id", "url", "success", "error_type", "error_message",
        F.least(F.col("profile_concurrency"), F.lit(SERVER_MAX_CONCURRENCY)).alias("effective_concurrency"))


@register("batch_summary", S.with_views(["fetch_log"], f"""
SELECT request_id // {BATCH_SIZE} AS batch_id, count(*) AS total, count(*) FILTER (WHERE NOT failed) AS succeeded,
       count(*) FILTER (WHERE failed) AS failed, max(elapsed_ms) AS elapsed_ms, count(*) BETWEEN 1 AND 50 AS size_ok,
       request_id // {BATCH_SIZE} % 13 BETWEEN 1 AND 10 AS concurrency_ok
FROM fetch_log GROUP BY 1"""))
def q_batch_summary(spark, sf_dir):
    """O-D9 / O-V3: per batch totals, the 1..50 size bound and the 1..10 concurrency bound (asked
    concurrency 0..12 by batch)."""
    d = D.fetch_log(spark, sf_dir).withColumn("batch_id", (F.col("request_id") / BATCH_SIZE).cast("long"))
    d = d.withColumn("max_concurrency", F.col("batch_id") % 13)
    return pol.batch_summary(pol.batch_items(d))


#: Requests as long as these many times their latency, so that some are open at "now".
STRETCH = 20_000
BUSY_LOGP_SQL = LOGP_SQL.replace("logp AS (", "logp0 AS (", 1) + f", logp AS (SELECT * REPLACE (elapsed_ms * {STRETCH} AS elapsed_ms) FROM logp0)"


@register("can_proceed_busy", ORACLES["can_proceed"].replace(LOGP_SQL, BUSY_LOGP_SQL))
def q_can_proceed_busy(spark, sf_dir):
    """O-D7: as ``can_proceed`` over long requests, so that open requests and the concurrency limit count."""
    log = _logp(spark, sf_dir).withColumn("elapsed_ms", F.col("elapsed_ms") * STRETCH)
    return pol.can_proceed(log, D.now_col()).select("domain", "open_requests", "last_finish_us", "can_proceed")


@register("batch_bounds", S.with_views(["fetch_log"], """
SELECT CAST(epoch(requested_at) AS BIGINT) // 14400 AS batch_id, count(*) AS total, count(*) BETWEEN 1 AND 50 AS size_ok
FROM fetch_log GROUP BY 1"""))
def q_batch_bounds(spark, sf_dir):
    """O-V3: batches of four hours, whose sizes fall on both sides of the bound."""
    d = D.fetch_log(spark, sf_dir).withColumn("batch_id", F.floor(F.unix_seconds(F.col("requested_at").cast("timestamp")) / 14400))
    return pol.batch_summary(pol.batch_items(d.withColumn("max_concurrency", F.lit(1)))).select("batch_id", "total", "size_ok")
