"""Metrics roll-ups (O-M1..O-M9, O-S7): conditional counts in one aggregate, long form
``(metric, kind, value)`` via ``stack``, and the text exposition as sorted lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Metric name -> (kind, help text), as the exposition prints them.
METRIC_HELP = {
    "scrape_requests_total": ("counter", "Total scrape requests received"),
    "scrape_success_total": ("counter", "Successful scrape responses"),
    "scrape_error_total": ("counter", "Failed scrape responses"),
    "cache_hits_total": ("counter", "Cache hits"),
    "cache_misses_total": ("counter", "Cache misses"),
    "cache_stale_hits_total": ("counter", "Stale cache served on error"),
    "extraction_requests_total": ("counter", "Total extraction requests"),
    "extraction_success_total": ("counter", "Successful extraction responses"),
    "extraction_error_total": ("counter", "Failed extraction responses"),
    "jobs_created_total": ("counter", "Total async jobs created"),
    "jobs_succeeded_total": ("counter", "Total async jobs succeeded"),
    "jobs_failed_total": ("counter", "Total async jobs failed"),
    "jobs_cancelled_total": ("counter", "Total async jobs cancelled"),
    "jobs_running": ("gauge", "Currently running async jobs"),
    "jobs_queue_size": ("gauge", "Number of jobs waiting in queue"),
    "scrape_duration_ms_sum": ("counter", "Total scrape duration in ms (for avg)"),
    "auth_requests_total": ("counter", "Total authenticated requests"),
    "auth_failures_total": ("counter", "Total authentication failures"),
    "proxy_requests_total": ("counter", "Total scrape requests routed through a proxy"),
    "proxy_errors_total": ("counter", "Total proxy-related errors"),
    "scraper_up": ("gauge", "Service health (1 = up, 0 = down)"),
    "cache_cleanup_runs_total": ("counter", "Total cache cleanup runs"),
    "cache_cleanup_deleted_entries_total": ("counter", "Total cache entries deleted by cleanup"),
    "cache_cleanup_errors_total": ("counter", "Total cache cleanup errors"),
    "cache_vacuum_runs_total": ("counter", "Total cache VACUUM runs"),
    "cache_vacuum_errors_total": ("counter", "Total cache VACUUM errors"),
    "cache_size_bytes": ("gauge", "cache size bytes"),
    "cache_entries_total": ("gauge", "cache entries total"),
    "cache_expired_entries_total": ("gauge", "cache expired entries total"),
}


def to_long(wide: DataFrame, kinds: dict[str, str] | None = None) -> DataFrame:
    """One-row wide aggregate -> ``(metric, kind, value double)`` rows."""
    cols = wide.columns
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
    long = wide.selectExpr(f"stack({len(cols)}, {pairs}) AS (metric, value)")
    kinds = kinds or {}
    kind = F.lit("counter")
    for name, k in {**{m: v[0] for m, v in METRIC_HELP.items()}, **kinds}.items():
        kind = F.when(F.col("metric") == name, F.lit(k)).otherwise(kind)
    return long.select("metric", kind.alias("kind"), "value")


def request_counters(log: DataFrame) -> DataFrame:
    """O-M1 / O-M6: requests, successes, errors and the latency sum, plus the mean."""
    return log.agg(
        F.count(F.lit(1)).alias("scrape_requests_total"),
        F.count(F.when(~F.col("failed"), 1)).alias("scrape_success_total"),
        F.count(F.when(F.col("failed"), 1)).alias("scrape_error_total"),
        F.coalesce(F.sum("elapsed_ms"), F.lit(0)).alias("scrape_duration_ms_sum"),
        F.avg("elapsed_ms").alias("scrape_duration_ms_avg"))


def cache_counters(results: DataFrame) -> DataFrame:
    """O-M2: fresh hits, misses (anything fetched) and stale hits, one per request."""
    r = F.col("result")
    return results.agg(
        F.count(F.when(r == "cached", 1)).alias("cache_hits_total"),
        F.count(F.when(r.isin("fetched", "error"), 1)).alias("cache_misses_total"),
        F.count(F.when(r == "stale", 1)).alias("cache_stale_hits_total"))


def job_counters(events: DataFrame) -> DataFrame:
    """O-M4: job lifecycle counters from the event log."""
    ev = F.col("event")
    return events.agg(*[F.count(F.when(ev == e, 1)).alias(f"jobs_{e}_total")
                        for e in ("created", "succeeded", "failed", "cancelled")])


def last_gauges(series: DataFrame, ts: str, names: list[str]) -> DataFrame:
    """O-M7: a gauge is its last value (``max_by`` over time)."""
    return series.agg(*[F.max_by(n, ts).alias(n) for n in names])


def exposition(long: DataFrame) -> DataFrame:
    """O-M9 / O-S7: ``# HELP``, ``# TYPE`` and value lines per metric, one line per row."""
    help_map = F.create_map(*[x for m, (k, h) in METRIC_HELP.items() for x in (F.lit(m), F.lit(h))])
    helptext = F.coalesce(F.try_element_at(help_map, F.col("metric")), F.regexp_replace("metric", "_", " "))
    value = F.when(F.col("value") == F.floor("value"), F.col("value").cast("long").cast("string")) \
        .otherwise(F.col("value").cast("string"))
    lines = F.array(
        F.struct(F.lit(0).alias("o"), F.concat(F.lit("# HELP "), F.col("metric"), F.lit(" "), helptext).alias("line")),
        F.struct(F.lit(1).alias("o"), F.concat(F.lit("# TYPE "), F.col("metric"), F.lit(" "), F.col("kind")).alias("line")),
        F.struct(F.lit(2).alias("o"), F.concat(F.col("metric"), F.lit(" "), value).alias("line")))
    return long.select("metric", F.inline(lines)).select("metric", F.col("o").alias("line_no"), "line")
