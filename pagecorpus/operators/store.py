"""Snapshot-table (store) operators O-C1..O-C17.

The store is a table ``(cache_key, url, final_url, status_code, fetched_at, expires_at, mode,
content_length, ...)``.  Every operator is a join, a filter or one aggregate; key joins never
carry ``html`` (column pruning keeps it out of the shuffles).  Deletions return the kept
table and a one-row count, so callers can rewrite only the touched date partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagecorpus.operators.retention import cut_offs, keep_newest, newer_than
from pagecorpus.sources.derived import seconds


def is_expired_at(expires_at: Column, now: Column) -> Column:
    """S1: expired iff ``now > expires_at``; a null expiry never expires."""
    return F.coalesce(now > expires_at, F.lit(False))


def lookup(requests: DataFrame, store: DataFrame, now: Column, force_col: str = "force_refresh") -> DataFrame:
    """O-C1: requests ``(request_id, cache_key, force_refresh)`` x store -> outcome
    ``hit`` / ``expired`` / ``miss`` / ``bypass`` (force refresh skips the lookup)."""
    s = store.select("cache_key", F.col("expires_at").alias("_exp"), F.lit(True).alias("_found"))
    j = requests.join(s, "cache_key", "left")
    outcome = (F.when(F.col(force_col), F.lit("bypass"))
               .when(F.col("_found").isNull(), F.lit("miss"))
               .when(is_expired_at(F.col("_exp"), now), F.lit("expired"))
               .otherwise(F.lit("hit")))
    return j.withColumn("outcome", outcome).drop("_exp", "_found")


def resolve_ttl(request_ttl: Column, domain_ttl: Column, global_ttl: Column) -> Column:
    """O-C2 / S2: first non-zero of request, domain, global TTL (seconds)."""
    nz = lambda c: F.when(c != 0, c)
    return F.coalesce(nz(request_ttl), nz(domain_ttl), global_ttl)


def expires_at(fetched_at: Column, ttl: Column) -> Column:
    """``ttl <= 0`` (or null) stores a null expiry."""
    return F.when(ttl > 0, fetched_at + seconds(ttl))


def stale_if_error(outcomes: DataFrame, stale_enabled: bool = True) -> DataFrame:
    """O-C4 / S4: a failed fetch returns the expired candidate as stale when one exists
    (not after a forced refresh), otherwise the error."""
    has_candidate = F.col("outcome") == "expired"
    res = (F.when(~F.col("failed"), F.lit("fetched"))
           .when(F.lit(stale_enabled) & has_candidate, F.lit("stale"))
           .otherwise(F.lit("error")))
    return outcomes.withColumn("result", F.when(F.col("outcome") == "hit", F.lit("cached")).otherwise(res))


def delete_keys(store: DataFrame, keys: DataFrame, on: str = "cache_key") -> DataFrame:
    """O-C5 (by key) / O-C6 (by exact raw URL, ``on='url'``): left-anti join."""
    return store.join(keys.select(on).distinct(), on, "left_anti")


def purge_domain(store: DataFrame, needle: str) -> DataFrame:
    """O-C8 / S16: drop rows whose URL is LIKE ``%needle%``, without regard to case; ``%`` and
    ``_`` in the needle are wildcards."""
    return store.filter(~purged("url", needle))


def purged(url: str, needle: str):
    return F.like(F.lower(url), F.lit(f"%{needle.lower()}%"))


def stats(store: DataFrame, now: Column) -> DataFrame:
    """O-C9: entries, total size and expired rows in one aggregate."""
    return store.agg(
        F.count(F.lit(1)).alias("total_entries"),
        F.coalesce(F.sum("content_length"), F.lit(0)).cast("long").alias("total_size_bytes"),
        F.count(F.when(F.col("expires_at").isNotNull() & (F.col("expires_at") < now), 1)).alias("expired_entries"))


def exists(keys: DataFrame, store: DataFrame) -> DataFrame:
    """O-C10: keys present in the store (left-semi; no content is read)."""
    return keys.join(store.select("cache_key"), "cache_key", "left_semi")


def expiry_check(keys: DataFrame, store: DataFrame, now: Column) -> DataFrame:
    """O-C11: per key, expired flag; a missing key counts as expired."""
    s = store.select("cache_key", F.col("expires_at").alias("_exp"), F.lit(True).alias("_found"))
    j = keys.join(s, "cache_key", "left")
    return j.withColumn("is_expired", F.when(F.col("_found").isNull(), F.lit(True))
                        .otherwise(is_expired_at(F.col("_exp"), now))).drop("_exp", "_found")


def expired_beyond_grace(store: DataFrame, now: Column, grace_seconds: int) -> Column:
    """O-C12 predicate: expired more than ``grace_seconds`` ago."""
    return F.col("expires_at").isNotNull() & (F.col("expires_at") < now - seconds(grace_seconds))


def cleanup(store: DataFrame, now: Column, grace_seconds: int, max_entries: int,
            max_size: int) -> DataFrame:
    """O-C15: phases in order -- expired beyond grace, then keep newest ``max_entries``, then
    keep newest within ``max_size`` -- each row tagged with the first phase that deletes it.
    Returns the store with a ``phase`` column (null = kept)."""
    expired = F.coalesce(expired_beyond_grace(store, now, grace_seconds), F.lit(False))
    # both limits keep a newest-first prefix of the same order, so their cut-offs come from one pass
    entries, size = cut_offs(store.filter(~expired), "fetched_at", "cache_key", [(max_entries, None), (max_size, "content_length")])
    return store.withColumn("phase", F.when(expired, F.lit("expired"))
                            .when(~newer_than("fetched_at", "cache_key", entries), F.lit("max_entries"))
                            .when(~newer_than("fetched_at", "cache_key", size), F.lit("max_size")))


def cleanup_report(tagged: DataFrame) -> DataFrame:
    """O-C15 / O-M8: one row of per-phase counts and sizes before and after."""
    ph = F.col("phase")
    return tagged.agg(
        F.count(F.when(ph == "expired", 1)).alias("deleted_expired"),
        F.count(F.when(ph == "max_entries", 1)).alias("deleted_by_max_entries"),
        F.count(F.when(ph == "max_size", 1)).alias("deleted_by_max_size"),
        F.count(ph).alias("total_deleted"),
        F.count(F.lit(1)).alias("entries_before"),
        F.count(F.when(ph.isNull(), 1)).alias("entries_after"),
        F.coalesce(F.sum("content_length"), F.lit(0)).cast("long").alias("size_before_bytes"),
        F.coalesce(F.sum(F.when(ph.isNull(), F.col("content_length"))), F.lit(0)).cast("long").alias("size_after_bytes"))


def evict_on_write(store: DataFrame, now: Column, max_size: int) -> DataFrame:
    """O-C16: when the total size exceeds ``max_size``: every expired row goes, then the
    oldest live rows until the rest fits (exact newest-first cut).  Adds ``evicted``."""
    total = store.select(F.coalesce(F.sum("content_length"), F.lit(0))).scalar()
    expired = F.coalesce(F.col("expires_at") < now, F.lit(False))
    live = keep_newest(store.filter(~expired), "fetched_at", "cache_key", max_size,
                       weight="content_length", out="_keep")
    over = total > F.lit(max_size)
    return (store.filter(expired).withColumn("evicted", over)
            .unionByName(live.withColumn("evicted", over & ~F.col("_keep")).drop("_keep")))


def cleanup_params(overrides: DataFrame, defaults: dict) -> DataFrame:
    """O-C17: per-request override else configured value."""
    return overrides.select("*", *[F.coalesce(F.col(k), F.lit(v)).alias(f"effective_{k}")
                                   for k, v in defaults.items()])
