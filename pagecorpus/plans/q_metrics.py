"""Registered metrics queries (O-M1, O-M2, O-M4, O-M6, O-M7, O-M9 / O-S7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagecorpus.operators import jobs as J
from pagecorpus.operators import metrics as M
from pagecorpus.operators import store as st
from pagecorpus.operators.runs import RunMetrics
from pagecorpus.plans import sqlbits as S
from pagecorpus.plans import q_extract, q_profiles, q_safety  # noqa: F401  (their twins come first)
from pagecorpus.plans.q_store import GRACE_SECONDS, REQ_SQL, _requests
from pagecorpus.plans.registry import ORACLES, register
from pagecorpus.sources import derived as D

NOW = S.NOW_SQL

REQUEST_COUNTERS_SQL = """
SELECT metric, 'counter' AS kind, value FROM (
  SELECT 'scrape_requests_total' AS metric, CAST(count(*) AS DOUBLE) AS value FROM fetch_log
  UNION ALL SELECT 'scrape_success_total', CAST(count(*) FILTER (WHERE NOT failed) AS DOUBLE) FROM fetch_log
  UNION ALL SELECT 'scrape_error_total', CAST(count(*) FILTER (WHERE failed) AS DOUBLE) FROM fetch_log
  UNION ALL SELECT 'scrape_duration_ms_sum', CAST(sum(elapsed_ms) AS DOUBLE) FROM fetch_log
  UNION ALL SELECT 'scrape_duration_ms_avg', avg(elapsed_ms) FROM fetch_log)"""


def _request_long(spark, sf_dir):
    return M.to_long(M.request_counters(D.fetch_log(spark, sf_dir)), {"scrape_duration_ms_avg": "counter"})


@register("metrics_requests", S.with_views(["fetch_log"], REQUEST_COUNTERS_SQL))
def q_metrics_requests(spark, sf_dir):
    """O-M1 / O-M6: request counters and latency sum / mean, long form."""
    return _request_long(spark, sf_dir)


CACHE_COUNTERS_SQL = S.with_views(["snapshots", "page_keys", "fetch_log"], f"""
SELECT metric, 'counter' AS kind, CAST(sum(value) AS DOUBLE) AS value FROM (
  SELECT CASE result WHEN 'cached' THEN 'cache_hits_total' WHEN 'stale' THEN 'cache_stale_hits_total'
                     ELSE 'cache_misses_total' END AS metric, 1 AS value
  FROM (SELECT CASE WHEN outcome = 'hit' THEN 'cached' WHEN NOT failed THEN 'fetched'
                    WHEN outcome = 'expired' THEN 'stale' ELSE 'error' END AS result
        FROM (SELECT r.failed, CASE WHEN r.force_refresh THEN 'bypass' WHEN s.cache_key IS NULL THEN 'miss'
                     WHEN s.expires_at IS NOT NULL AND {NOW} > s.expires_at THEN 'expired' ELSE 'hit' END AS outcome
              FROM requests r LEFT JOIN snapshots s USING (cache_key)))
  UNION ALL SELECT 'cache_hits_total', 0 UNION ALL SELECT 'cache_stale_hits_total', 0
  UNION ALL SELECT 'cache_misses_total', 0)
GROUP BY metric""", REQ_SQL)


def _cache_long(spark, sf_dir):
    r = _requests(spark, sf_dir).select("request_id", "cache_key", "force_refresh", "failed")
    res = st.stale_if_error(st.lookup(r, D.snapshots(spark, sf_dir), D.now_col()))
    return M.to_long(M.cache_counters(res))


@register("metrics_cache", CACHE_COUNTERS_SQL)
def q_metrics_cache(spark, sf_dir):
    """O-M2: cache hit / miss / stale counters from the lookup and fallback outcomes."""
    return _cache_long(spark, sf_dir)


JOB_COUNTERS_SQL = S.with_views(["job_events"], """
SELECT 'jobs_' || e || '_total' AS metric, 'counter' AS kind,
       CAST((SELECT count(*) FROM job_events WHERE event = e) AS DOUBLE) AS value
FROM (SELECT unnest(['created', 'succeeded', 'failed', 'cancelled']) AS e)""")


def _job_long(spark, sf_dir):
    return M.to_long(M.job_counters(D.job_events(spark, sf_dir)))


@register("metrics_jobs", JOB_COUNTERS_SQL)
def q_metrics_jobs(spark, sf_dir):
    """O-M4: job lifecycle counters."""
    return _job_long(spark, sf_dir)


GAUGES_SQL = S.with_views(["job_events"], """
SELECT metric, 'gauge' AS kind, value FROM (
  SELECT 'jobs_queue_size' AS metric, CAST(arg_max(queue_size, hour) AS DOUBLE) AS value FROM series
  UNION ALL SELECT 'jobs_running', CAST(arg_max(running, hour) AS DOUBLE) FROM series)""",
"""series AS (SELECT hour, sum(dq) OVER (ORDER BY hour ROWS UNBOUNDED PRECEDING) AS queue_size,
       sum(dr) OVER (ORDER BY hour ROWS UNBOUNDED PRECEDING) AS running
FROM (SELECT date_trunc('hour', ts) AS hour,
             sum(CASE WHEN event = 'created' THEN 1 WHEN event IN ('started', 'cancelled') THEN -1 ELSE 0 END) AS dq,
             sum(CASE WHEN event = 'started' THEN 1 WHEN event IN ('succeeded', 'failed') THEN -1 ELSE 0 END) AS dr
      FROM job_events GROUP BY 1))""")


def _gauge_long(spark, sf_dir):
    s = J.queue_series(D.job_events(spark, sf_dir)).select(
        "hour", F.col("queue_size").alias("jobs_queue_size"), F.col("running").alias("jobs_running"))
    return M.to_long(M.last_gauges(s, "hour", ["jobs_queue_size", "jobs_running"]))


@register("metrics_gauges", GAUGES_SQL)
def q_metrics_gauges(spark, sf_dir):
    """O-M7: gauges = last value of the queue-size and running series."""
    return _gauge_long(spark, sf_dir)


#: Cleanup runs: days before "now", entries and size to keep; the last one has a limit that fails.
CLEANUP_RUNS = [(3, 240, 3_000_000, True), (0, 200, 600_000, True), (0, -1, 600_000, False)]


def _cleaned_sql(src: str, now: str, entries: int, size: int) -> str:
    return f"""SELECT * EXCLUDE (rn, run) FROM (
  SELECT *, sum(content_length) OVER (ORDER BY fetched_at DESC, cache_key DESC ROWS UNBOUNDED PRECEDING) AS run
  FROM (SELECT *, row_number() OVER (ORDER BY fetched_at DESC, cache_key DESC) AS rn FROM {src}
        WHERE NOT coalesce(expires_at < {now} - INTERVAL {GRACE_SECONDS} SECOND, false)) WHERE rn <= {entries}) WHERE run <= {size}"""


def _runs_sql() -> str:
    done = [r for r in CLEANUP_RUNS if r[1] >= 0]
    nows = [f"({NOW} - INTERVAL {d} DAY)" for d, *_ in done]
    ctes = ",\n".join(f"s{i + 1} AS ({_cleaned_sql('snapshots' if i == 0 else f's{i}', nows[i], e, z)})" for i, (_, e, z, _v) in enumerate(done))
    last = f"s{len(done)}"
    counters = [("cache_cleanup_runs_total", str(len(done))), ("cache_cleanup_deleted_entries_total", f"(SELECT count(*) FROM snapshots) - (SELECT count(*) FROM {last})"),
                ("cache_cleanup_errors_total", str(len(CLEANUP_RUNS) - len(done))), ("cache_vacuum_runs_total", str(sum(r[3] for r in done))), ("cache_vacuum_errors_total", "0")]
    gauges = [("cache_size_bytes", f"(SELECT coalesce(sum(content_length), 0) FROM {last})"), ("cache_entries_total", f"(SELECT count(*) FROM {last})"),
              ("cache_expired_entries_total", f"(SELECT count(*) FROM {last} WHERE expires_at < {nows[-1]})"),
              ("scraper_up", "(SELECT CAST(bool_or(NOT failed) AS INTEGER) FROM fetch_log WHERE date_trunc('hour', requested_at) = (SELECT date_trunc('hour', max(requested_at)) FROM fetch_log))")]
    rows = " UNION ALL ".join(f"SELECT '{m}' AS metric, '{k}' AS kind, CAST({v} AS DOUBLE) AS value" for k, ms in (("counter", counters), ("gauge", gauges)) for m, v in ms)
    others = " UNION ALL ".join(f"SELECT metric, 'counter', value FROM ({q})" for q in (
        f"SELECT * FROM ({ORACLES['extract_rates']}) WHERE metric LIKE 'extraction%'", ORACLES["auth_counters"], ORACLES["proxy_counters"]))
    return S.with_views(["snapshots", "fetch_log"], f"{rows} UNION ALL {others}", ctes)


def _runs_long(spark, sf_dir):
    """All runs, each counted by its own pass."""
    from datetime import datetime, timedelta

    from pagecorpus.plans.q_extract import REQUIRED_SPEC, _run
    from pagecorpus.plans.q_profiles import _attribution
    from pagecorpus.plans.q_safety import _fetched_choices
    m = RunMetrics()
    table, now = D.store_table(spark, sf_dir), datetime.fromisoformat(D.NOW)
    for days, entries, size, vacuum in CLEANUP_RUNS:
        table = m.cleanup(table, now - timedelta(days=days), GRACE_SECONDS, entries, size, vacuum)
    m.extraction(_run(spark, sf_dir, REQUIRED_SPEC))
    m.auth(_attribution(spark, sf_dir))
    m.proxy(_fetched_choices(spark, sf_dir))
    m.health(D.fetch_log(spark, sf_dir))
    return m.frame(spark)


@register("metrics_runs", _runs_sql())
def q_metrics_runs(spark, sf_dir):
    """O-M8 / O-M3 / O-M5: counters and gauges of cleanup, extraction, auth and proxy runs, taken from the runs."""
    return _runs_long(spark, sf_dir)


def _exposition_sql() -> str:
    """Twin of the exposition: the per-family counter queries as subqueries, then the
    HELP / TYPE / value lines (all exposed values are integral)."""
    fams = [S.with_views(["fetch_log"], REQUEST_COUNTERS_SQL).replace(
                "\n  UNION ALL SELECT 'scrape_duration_ms_avg', avg(elapsed_ms) FROM fetch_log)", ")"),
            CACHE_COUNTERS_SQL, JOB_COUNTERS_SQL, GAUGES_SQL, _runs_sql()]
    helps = ", ".join(f"('{m}', '{h}')" for m, (_k, h) in M.METRIC_HELP.items())
    union = " UNION ALL ".join(f"SELECT metric, kind, value FROM ({q})" for q in fams)
    return f"""WITH m AS ({union}),
help(metric, text) AS (VALUES {helps}),
mh AS (SELECT m.metric, m.kind, m.value, coalesce(h.text, replace(m.metric, '_', ' ')) AS text
       FROM m LEFT JOIN help h USING (metric))
SELECT metric, 0 AS line_no, '# HELP ' || metric || ' ' || text AS line FROM mh
UNION ALL SELECT metric, 1, '# TYPE ' || metric || ' ' || kind FROM mh
UNION ALL SELECT metric, 2, metric || ' ' || CAST(CAST(value AS BIGINT) AS VARCHAR) FROM mh"""


def _exposed_long(spark, sf_dir):
    # the text format prints the latency sum; the mean is derived by the reader
    req = _request_long(spark, sf_dir).filter(F.col("metric") != "scrape_duration_ms_avg")
    return (req.unionByName(_cache_long(spark, sf_dir)).unionByName(_job_long(spark, sf_dir))
            .unionByName(_gauge_long(spark, sf_dir)).unionByName(_runs_long(spark, sf_dir)))


@register("metrics_exposition", _exposition_sql())
def q_metrics_exposition(spark, sf_dir):
    """O-M9 / O-S7: the text exposition of all rolled-up metrics (HELP, TYPE, value lines)."""
    return M.exposition(_exposed_long(spark, sf_dir))


@register("metrics_text_sink", f"SELECT line AS value FROM ({ORACLES['metrics_exposition']})")
def q_metrics_text_sink(spark, sf_dir):
    """O-S7: the exposition written as a text file and read back."""
    from pagecorpus.sources import sinks
    from pagecorpus.streaming.streams import scratch
    out = scratch(spark, "metrics_text")
    sinks.write_metrics_text(q_metrics_exposition(spark, sf_dir), out)
    return spark.read.text(out)
