"""Domain policy, pacing and batch operators (O-D1..O-D3, O-D5..O-D9).

Times are integer microseconds so that prefix sums are exact.  The pacing plan uses the
closed form of ``start_i = max(arrival_i, start_{i-1} + dur_{i-1} + delay)``:
with ``P_i`` the exclusive prefix sum of ``dur + delay``,
``start_i = P_i + max_{j <= i}(arrival_j - P_j)`` -- a running sum and a running max, both
computed with the chunked scans of :mod:`pagecorpus.operators.scan`, so a dominant domain
is not one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagecorpus.operators import scan

# The policy a domain gets when it has no row (or a partial one).
DEFAULT_POLICY = {"allowed": True, "min_delay_seconds": 5.0, "max_concurrent_requests": 1}


def with_policy(df: DataFrame, policies: DataFrame, domain_col: str = "domain") -> DataFrame:
    """O-D1: attach the domain's policy, defaults filled in (exact domain match).

    The policy table has one row per configured domain -- a dimension whose size is the
    number of configured domains."""
    p = policies.select(
        F.col("domain").alias("_pd"), F.col("allowed").alias("_pa"),
        F.col("min_delay_seconds").alias("_pm"), F.col("max_concurrent_requests").alias("_pc"),
        F.col("default_ttl_seconds").alias("_pt"), F.lit(True).alias("_pf"))
    # policy rows grow with the number of domains, so no forced broadcast: the size-based
    # choice (and AQE at run time) broadcasts it only while it is small
    j = df.join(p, F.col(domain_col) == F.col("_pd"), "left")
    return (j.withColumn("allowed", F.coalesce("_pa", F.lit(DEFAULT_POLICY["allowed"])))
            .withColumn("min_delay_seconds", F.coalesce(F.col("_pm").cast("double"),
                                                        F.lit(DEFAULT_POLICY["min_delay_seconds"])))
            .withColumn("max_concurrent_requests", F.coalesce("_pc", F.lit(DEFAULT_POLICY["max_concurrent_requests"])))
            .withColumn("default_ttl_seconds", F.col("_pt"))
            .withColumn("has_policy", F.coalesce("_pf", F.lit(False)))
            .drop("_pd", "_pa", "_pm", "_pc", "_pt", "_pf"))


def admission(df: DataFrame) -> Column:
    """O-D2 / S15: reason a request is refused (null = admitted).  Without an explicit
    allow-list the policy table's domains are the allow-list."""
    return (F.when(~F.col("has_policy"), F.lit("domain_not_in_allow_list"))
            .when(~F.col("allowed"), F.lit("domain_not_allowed")))


def pacing_plan(requests: DataFrame, domain: str = "domain", ts: str = "requested_at",
                tie: str = "request_id", dur_ms: str = "elapsed_ms") -> DataFrame:
    """O-D3: earliest start per request with one request at a time per domain and
    ``min_delay_seconds`` after the previous finish.  Adds ``planned_start_us`` and
    ``wait_us`` (needs ``min_delay_seconds``)."""
    d = (requests
         .withColumn("_arr", F.unix_micros(F.col(ts).cast("timestamp")))
         .withColumn("_c", F.col(dur_ms) * 1000 + (F.col("min_delay_seconds") * 1_000_000).cast("long")))
    d = scan.queue_starts(d, [domain], ts, tie, "_arr", "_c", "planned_start_us")
    return d.withColumn("wait_us", F.col("planned_start_us") - F.col("_arr")).drop("_arr", "_c")


def delay_audit(log: DataFrame, domain: str = "domain", ts: str = "requested_at",
                tie: str = "request_id", dur_ms: str = "elapsed_ms") -> DataFrame:
    """O-D5: gap between a request and the previous request's finish on the same domain;
    ``violation`` when the gap is shorter than ``min_delay_seconds``."""
    d = (log.withColumn("_arr", F.unix_micros(F.col(ts).cast("timestamp")))
         .withColumn("_fin", F.col("_arr") + F.col(dur_ms) * 1000))
    d = scan.previous_value(d, [domain], ts, tie, "_fin", "_prev_fin")
    d = d.withColumn("gap_us", F.col("_arr") - F.col("_prev_fin"))
    d = d.withColumn("violation", F.coalesce(F.col("gap_us") < (F.col("min_delay_seconds") * 1_000_000).cast("long"),
                                             F.lit(False)))
    return d.drop("_arr", "_fin", "_prev_fin")


def concurrency_audit(log: DataFrame, domain: str = "domain", ts: str = "requested_at",
                      tie: str = "request_id", dur_ms: str = "elapsed_ms") -> DataFrame:
    """O-D6: +1 at start, -1 at finish, running sum per domain (a finish frees its slot for
    a start at the same instant); per domain the peak and whether it broke the limit."""
    base = log.select(domain, tie, "max_concurrent_requests",
                      F.unix_micros(F.col(ts).cast("timestamp")).alias("_arr"), F.col(dur_ms).alias("_dur"))
    ev = base.select(domain, tie, "max_concurrent_requests", F.explode(F.array(
        F.struct(F.col("_arr").alias("t_us"), F.lit(1).alias("delta")),
        F.struct((F.col("_arr") + F.col("_dur") * 1000).alias("t_us"), F.lit(-1).alias("delta")))).alias("e"))
    ev = ev.select(domain, "max_concurrent_requests", F.col("e.t_us").alias("t_us"), F.col("e.delta").alias("delta"),
                   F.timestamp_micros(F.col("e.t_us")).alias("_ts"),
                   (F.col("e.delta") * F.lit(10**15) + F.col(tie)).alias("_tie"))
    run = scan.running_sum(ev, [domain], "_ts", "_tie", "delta", "open_now")
    return (run.groupBy(domain).agg(F.max("open_now").alias("peak_open"),
                                    F.first("max_concurrent_requests").alias("limit"))
            .withColumn("violated", F.col("peak_open") > F.col("limit")))


def can_proceed(log: DataFrame, at: Column, domain: str = "domain", ts: str = "requested_at",
                dur_ms: str = "elapsed_ms") -> DataFrame:
    """O-D7: per domain at time ``at``: open requests, last finish, and whether a new
    request may start (allowed, below the concurrency limit, delay since last finish met)."""
    at_us = F.unix_micros(at.cast("timestamp"))
    d = log.select(domain, "allowed", "min_delay_seconds", "max_concurrent_requests",
                   F.unix_micros(F.col(ts).cast("timestamp")).alias("_arr"),
                   (F.unix_micros(F.col(ts).cast("timestamp")) + F.col(dur_ms) * 1000).alias("_fin"))
    agg = d.groupBy(domain).agg(
        F.count(F.when((F.col("_arr") <= at_us) & (at_us < F.col("_fin")), 1)).alias("open_requests"),
        F.max(F.when(F.col("_fin") <= at_us, F.col("_fin"))).alias("last_finish_us"),
        F.first("allowed").alias("allowed"), F.first("min_delay_seconds").alias("min_delay_seconds"),
        F.first("max_concurrent_requests").alias("max_concurrent_requests"))
    ok = (F.col("allowed") & (F.col("open_requests") < F.col("max_concurrent_requests"))
          & (F.col("last_finish_us").isNull()
             | ((at_us - F.col("last_finish_us")) >= (F.col("min_delay_seconds") * 1_000_000).cast("long"))))
    return agg.withColumn("can_proceed", ok)


def batch_items(items: DataFrame) -> DataFrame:
    """O-D8: per item ``success`` and, for failures, a flat error struct."""
    return items.withColumn("success", ~F.col("failed")).withColumn(
        "error_type", F.when(F.col("failed"), F.lit("http_error"))).withColumn(
        "error_message", F.when(F.col("failed"), F.concat(F.lit("HTTP "), F.col("status_code").cast("string"))))


def batch_summary(items: DataFrame, max_items: int = 50, max_concurrency: int = 10) -> DataFrame:
    """O-D9 (+ O-V3): per batch totals and the size / concurrency bounds check."""
    return items.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(F.col("success"), 1)).alias("succeeded"),
        F.count(F.when(~F.col("success"), 1)).alias("failed"),
        F.max("elapsed_ms").alias("elapsed_ms"), F.max("max_concurrency").alias("_asked"),
    ).withColumn("size_ok", (F.col("total") >= 1) & (F.col("total") <= max_items)) \
        .withColumn("concurrency_ok", F.col("_asked").between(1, max_concurrency)).drop("_asked")
