"""Request validation and response shaping (O-V1, O-V2, O-V5, O-V6, O-V8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Request modes.
MODES = ["http", "browser", "auto"]


def request_rules(df: DataFrame, cross_field: bool = True) -> Column:
    """O-V1 / O-V2: codes of the broken request rules (empty = accepted).  The cross-field
    browser-timeout rule is a parameter (batch items skip it)."""
    url, mode = F.col("url"), F.col("mode")
    ttl, timeout = F.col("cache_ttl_seconds"), F.col("timeout_seconds")
    codes = F.array(
        F.when(url.isNull() | (F.length(url) < 1) | (F.length(url) > 8192), F.lit("url_length")),
        F.when(~mode.isin(MODES), F.lit("mode")),
        F.when(ttl.isNotNull() & ((ttl < 60) | (ttl > 2592000)), F.lit("cache_ttl_range")),
        F.when((timeout < 5) | (timeout > 180), F.lit("timeout_range")),
        F.when(F.lit(cross_field) & (mode == "browser") & (timeout > 60), F.lit("browser_timeout_over_60")))
    return F.filter(codes, lambda c: c.isNotNull())


def truncate(df: DataFrame, html: str, max_chars: int) -> DataFrame:
    """O-V5 / S3: cut to ``max_chars`` characters, recompute the length, flag the cut."""
    return (df.withColumn("truncated", F.length(html) > max_chars)
            .withColumn(html, F.substring(html, 1, max_chars))
            .withColumn("content_length", F.length(html).cast("long")))


def response_v1(df: DataFrame, from_cache: Column, stale: Column, expose_profile: Column, *more: str) -> DataFrame:
    """O-V6 / O-V8: the v1 record -- snapshot columns, flags and a metadata struct with the request's elapsed
    time, with the caller's profile name attached only when profiles are exposed.  ``more`` names further
    columns for the metadata."""
    meta = F.struct(F.col("mode").alias("mode"), F.col("elapsed_ms").alias("elapsed_ms"),
                    F.col("content_length").alias("content_length"), F.col("cache_key").alias("cache_key"),
                    F.when(expose_profile, F.col("profile")).alias("profile_name"), *more)
    return df.select("request_id", "url", "final_url", "status_code", from_cache.alias("from_cache"),
                     stale.alias("stale"), "fetched_at", "expires_at", meta.alias("metadata"))
