"""Registered store queries (O-S1, O-S2, O-C1..O-C17) over the derived snapshot table."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagecorpus.operators import store as st
from pagecorpus.plans import sqlbits as S
from pagecorpus.plans.registry import register
from pagecorpus.sources import derived as D

# Fixed parameters of the cleanup queries.
GRACE_SECONDS = 86400
MAX_ENTRIES = 200
MAX_SIZE = 600_000
GLOBAL_TTL = 86400
NOW = S.NOW_SQL


def _requests(spark, sf_dir):
    """Requests derived from the fetch log: key of the requested page, forced refresh on
    every seventh request id, request TTL override 0 / none / minutes by request id."""
    f = D.fetch_log(spark, sf_dir)
    k = D.page_keys(spark, sf_dir).select("page_id", "cache_key", "domain", "url")
    rid = F.col("request_id")
    return f.join(k, "page_id").select(
        "request_id", "requested_at", "page_id", "url", "cache_key", "domain", "failed", "status_code", "profile", "mode", "elapsed_ms",
        (rid % 7 == 0).alias("force_refresh"),
        F.when(rid % 3 == 0, F.lit(0)).when(rid % 3 == 1, F.lit(None).cast("int"))
        .otherwise((60 * (rid % 50 + 1)).cast("int")).alias("request_ttl"))


REQ_SQL = """requests AS (
  SELECT f.request_id, f.requested_at, f.page_id, k.url, k.cache_key, k.domain, f.failed, f.status_code,
         f.request_id % 7 = 0 AS force_refresh,
         CASE WHEN f.request_id % 3 = 0 THEN 0 WHEN f.request_id % 3 = 1 THEN NULL
              ELSE CAST(60 * (f.request_id % 50 + 1) AS INTEGER) END AS request_ttl
  FROM fetch_log f JOIN page_keys k USING (page_id))"""


def _with(names, body, extra=None):
    return S.with_views(names, body, extra)


@register("store_upsert", S.with_views(["snapshots"], """
SELECT cache_key, url, final_url, status_code, fetched_at, expires_at, mode, content_length, seq FROM snapshots"""))
def q_store_upsert(spark, sf_dir):
    """O-C3 / O-S1: the store after upserting every successful fetch (last write wins)."""
    return D.snapshots(spark, sf_dir).select("cache_key", "url", "final_url", "status_code", "fetched_at",
                                             "expires_at", "mode", "content_length", "seq")


@register("store_lookup", _with(["snapshots", "page_keys", "fetch_log"], f"""
SELECT r.request_id, r.cache_key,
  CASE WHEN r.force_refresh THEN 'bypass' WHEN s.cache_key IS NULL THEN 'miss'
       WHEN s.expires_at IS NOT NULL AND {NOW} > s.expires_at THEN 'expired' ELSE 'hit' END AS outcome
FROM requests r LEFT JOIN snapshots s USING (cache_key)""", REQ_SQL))
def q_store_lookup(spark, sf_dir):
    """O-C1 / O-S2: every request looked up in the store at "now"."""
    r = _requests(spark, sf_dir).select("request_id", "cache_key", "force_refresh")
    return st.lookup(r, D.snapshots(spark, sf_dir), D.now_col()).select("request_id", "cache_key", "outcome")


@register("store_ttl", _with(["page_keys", "fetch_log", "policies"], f"""
SELECT request_id, ttl_seconds,
  CASE WHEN ttl_seconds > 0 THEN requested_at + to_seconds(ttl_seconds) END AS expires_at
FROM (SELECT r.request_id, r.requested_at,
        coalesce(CASE WHEN r.request_ttl <> 0 THEN r.request_ttl END,
                 CASE WHEN p.default_ttl_seconds <> 0 THEN p.default_ttl_seconds END, {GLOBAL_TTL}) AS ttl_seconds
      FROM requests r LEFT JOIN policies p ON p.domain = regexp_extract(r.url, '^https?://(?:www\\.)?([^/:?#]+)', 1)
      WHERE NOT r.failed)""", REQ_SQL))
def q_store_ttl(spark, sf_dir):
    """O-C2: TTL = first non-zero of request, domain policy, global; expiry from it."""
    r = _requests(spark, sf_dir).filter(~F.col("failed"))
    r = r.withColumn("pdomain", F.regexp_extract("url", r"^https?://(?:www\.)?([^/:?#]+)", 1))
    pol = D.policies(spark, sf_dir).select(F.col("domain").alias("pdomain"), "default_ttl_seconds")
    j = r.join(pol, "pdomain", "left")  # policy rows grow with domains: AQE picks the join
    ttl = st.resolve_ttl(F.col("request_ttl"), F.col("default_ttl_seconds"), F.lit(GLOBAL_TTL))
    return (j.withColumn("ttl_seconds", ttl.cast("int"))
            .select("request_id", "ttl_seconds", st.expires_at(F.col("requested_at"), F.col("ttl_seconds")).alias("expires_at")))


@register("store_stale_if_error", _with(["snapshots", "page_keys", "fetch_log"], f"""
SELECT request_id, outcome,
  CASE WHEN outcome = 'hit' THEN 'cached' WHEN NOT failed THEN 'fetched'
       WHEN outcome = 'expired' THEN 'stale' ELSE 'error' END AS result
FROM (SELECT r.request_id, r.failed,
        CASE WHEN r.force_refresh THEN 'bypass' WHEN s.cache_key IS NULL THEN 'miss'
             WHEN s.expires_at IS NOT NULL AND {NOW} > s.expires_at THEN 'expired' ELSE 'hit' END AS outcome
      FROM requests r LEFT JOIN snapshots s USING (cache_key))""", REQ_SQL))
def q_store_stale(spark, sf_dir):
    """O-C4: failed fetches fall back to the expired candidate (stale) when there is one."""
    r = _requests(spark, sf_dir).select("request_id", "cache_key", "force_refresh", "failed")
    out = st.stale_if_error(st.lookup(r, D.snapshots(spark, sf_dir), D.now_col()))
    return out.select("request_id", "outcome", "result")


@register("store_delete_key", S.with_views(["snapshots"], """
SELECT cache_key, url FROM snapshots WHERE cache_key NOT IN (SELECT cache_key FROM snapshots WHERE status_code = 404)"""))
def q_store_delete_key(spark, sf_dir):
    """O-C5: delete by key (the keys whose newest fetch was a 404), then read the table back."""
    gone = D.snapshots(spark, sf_dir).filter(F.col("status_code") == 404).select("cache_key")
    return D.store_table(spark, sf_dir).delete_keys(gone).read().select("cache_key", "url")


@register("store_delete_url", S.with_views(["snapshots"], """
SELECT cache_key, url FROM snapshots WHERE url NOT IN (SELECT url FROM pages WHERE url LIKE '%utm_source=%')"""))
def q_store_delete_url(spark, sf_dir):
    """O-C6: delete by exact raw URL (the tracking-parameter URLs of the page table), then read the table back."""
    from pagecorpus.sources.tables import read_table
    urls_ = read_table(spark, sf_dir, "pages").filter(F.col("url").contains("utm_source=")).select("url")
    return D.store_table(spark, sf_dir).delete_urls(urls_).read().select("cache_key", "url")


@register("store_purge_all", S.with_views(["snapshots"], """
SELECT CAST(count(*) AS BIGINT) AS deleted, CAST(0 AS BIGINT) AS remaining FROM snapshots"""))
def q_store_purge_all(spark, sf_dir):
    """O-C7: purge everything; the deleted rows as the table reports them, the remaining ones as read back."""
    after = D.store_table(spark, sf_dir).purge()
    return after.read().agg(F.lit(after.report["deleted"]).cast("long").alias("deleted"), F.count(F.lit(1)).alias("remaining"))


@register("store_purge_domain", S.with_views(["snapshots", "page_keys"], """
SELECT s.cache_key, s.url,
       lower(s.url) NOT LIKE '%example.n_t%' AS kept_substring,
       coalesce(k.domain <> 'blog.ththan.example.net', true) AS kept_exact
FROM snapshots s LEFT JOIN (SELECT DISTINCT cache_key, domain FROM page_keys) k USING (cache_key)"""))
def q_store_purge_domain(spark, sf_dir):
    """O-C8: purge by domain -- the reference's substring rule and an exact-domain variant."""
    s = D.snapshots(spark, sf_dir)
    k = D.page_keys(spark, sf_dir).select("cache_key", "domain").distinct()
    j = s.join(k, "cache_key", "left")
    return j.select("cache_key", "url",
                    (~st.purged("url", "EXAMPLE.n_t")).alias("kept_substring"),
                    F.coalesce(F.col("domain") != "blog.ththan.example.net", F.lit(True)).alias("kept_exact"))


@register("store_purge_like", S.with_views(["snapshots"], """
SELECT count(*) FILTER (WHERE gone) AS deleted, count(*) FILTER (WHERE NOT gone) AS remaining,
       CAST(coalesce(sum(content_length) FILTER (WHERE NOT gone), 0) AS BIGINT) AS size_bytes
FROM (SELECT *, lower(url) LIKE '%example.n_t%' AS gone FROM snapshots)"""))
def q_store_purge_like(spark, sf_dir):
    """O-C8: the substring purge on the written table: deleted rows from the pass that removes them, the
    rest as read back."""
    after = D.store_table(spark, sf_dir).delete_where(st.purged("url", "EXAMPLE.n_t"))
    return after.read().agg(F.lit(after.report["deleted"]).cast("long").alias("deleted"), F.count(F.lit(1)).alias("remaining"),
                            F.coalesce(F.sum("content_length"), F.lit(0)).cast("long").alias("size_bytes"))


@register("store_stats", S.with_views(["snapshots"], f"""
SELECT CAST(count(*) AS BIGINT) AS total_entries, CAST(coalesce(sum(content_length), 0) AS BIGINT) AS total_size_bytes,
       CAST(count(*) FILTER (WHERE expires_at IS NOT NULL AND expires_at < {NOW}) AS BIGINT) AS expired_entries
FROM snapshots"""))
def q_store_stats(spark, sf_dir):
    """O-C9: entries, size and expired rows."""
    return st.stats(D.snapshots(spark, sf_dir), D.now_col())


_CANDIDATES_SQL = """candidates AS (
  SELECT cache_key FROM page_keys
  UNION ALL SELECT sha256(canonical_url || '/missing') FROM page_keys)"""


def _candidates(spark, sf_dir):
    k = D.page_keys(spark, sf_dir)
    return k.select("cache_key").unionByName(
        k.select(F.sha2(F.concat("canonical_url", F.lit("/missing")), 256).alias("cache_key")))


@register("store_exists", _with(["snapshots", "page_keys"], """
SELECT c.cache_key FROM candidates c WHERE c.cache_key IN (SELECT cache_key FROM snapshots)""", _CANDIDATES_SQL))
def q_store_exists(spark, sf_dir):
    """O-C10: which candidate keys exist (half of them are made-up misses)."""
    return st.exists(_candidates(spark, sf_dir), D.snapshots(spark, sf_dir))


@register("store_expiry_check", _with(["snapshots", "page_keys"], f"""
SELECT c.cache_key, CASE WHEN s.cache_key IS NULL THEN true
                         ELSE coalesce({NOW} > s.expires_at, false) END AS is_expired
FROM candidates c LEFT JOIN snapshots s USING (cache_key)""", _CANDIDATES_SQL))
def q_store_expiry_check(spark, sf_dir):
    """O-C11: per key, expired (a missing key counts as expired)."""
    return st.expiry_check(_candidates(spark, sf_dir), D.snapshots(spark, sf_dir), D.now_col()) \
        .select("cache_key", "is_expired")


@register("store_cleanup_expired", S.with_views(["snapshots"], f"""
SELECT cache_key FROM snapshots
WHERE expires_at IS NOT NULL AND expires_at < {NOW} - INTERVAL {GRACE_SECONDS} SECOND"""))
def q_store_cleanup_expired(spark, sf_dir):
    """O-C12: rows expired beyond the grace period (the ones phase 1 deletes)."""
    s = D.snapshots(spark, sf_dir)
    return s.filter(st.expired_beyond_grace(s, D.now_col(), GRACE_SECONDS)).select("cache_key")


@register("store_keep_entries", S.with_views(["snapshots"], f"""
SELECT cache_key, row_number() OVER (ORDER BY fetched_at DESC, cache_key DESC) <= {MAX_ENTRIES} AS keep FROM snapshots"""))
def q_store_keep_entries(spark, sf_dir):
    """O-C13: keep the newest ``MAX_ENTRIES`` rows (bucketed cut-off, no global window)."""
    from pagecorpus.operators.retention import keep_newest
    return keep_newest(D.snapshots(spark, sf_dir), "fetched_at", "cache_key", MAX_ENTRIES).select("cache_key", "keep")


@register("store_keep_size", S.with_views(["snapshots"], f"""
SELECT cache_key, sum(content_length) OVER (ORDER BY fetched_at DESC, cache_key DESC
                                            ROWS UNBOUNDED PRECEDING) <= {MAX_SIZE} AS keep FROM snapshots"""))
def q_store_keep_size(spark, sf_dir):
    """O-C14: keep the newest rows whose total size fits ``MAX_SIZE`` characters."""
    from pagecorpus.operators.retention import keep_newest
    return keep_newest(D.snapshots(spark, sf_dir), "fetched_at", "cache_key", MAX_SIZE,
                       weight="content_length").select("cache_key", "keep")


CLEANUP_SQL = S.with_views(["snapshots"], f"""
SELECT CAST(count(*) FILTER (WHERE phase = 'expired') AS BIGINT) AS deleted_expired,
       CAST(count(*) FILTER (WHERE phase = 'max_entries') AS BIGINT) AS deleted_by_max_entries,
       CAST(count(*) FILTER (WHERE phase = 'max_size') AS BIGINT) AS deleted_by_max_size,
       CAST(count(phase) AS BIGINT) AS total_deleted,
       CAST(count(*) AS BIGINT) AS entries_before,
       CAST(count(*) FILTER (WHERE phase IS NULL) AS BIGINT) AS entries_after,
       CAST(coalesce(sum(content_length), 0) AS BIGINT) AS size_before_bytes,
       CAST(coalesce(sum(content_length) FILTER (WHERE phase IS NULL), 0) AS BIGINT) AS size_after_bytes
FROM (
  SELECT cache_key, content_length, 'expired' AS phase FROM snapshots
  WHERE expires_at IS NOT NULL AND expires_at < {NOW} - INTERVAL {GRACE_SECONDS} SECOND
  UNION ALL
  SELECT cache_key, content_length,
         CASE WHEN rn > {MAX_ENTRIES} THEN 'max_entries'
              WHEN sum(CASE WHEN rn <= {MAX_ENTRIES} THEN content_length ELSE 0 END)
                   OVER (ORDER BY fetched_at DESC, cache_key DESC ROWS UNBOUNDED PRECEDING) > {MAX_SIZE}
              THEN 'max_size' END AS phase
  FROM (SELECT *, row_number() OVER (ORDER BY fetched_at DESC, cache_key DESC) AS rn FROM snapshots
        WHERE NOT (expires_at IS NOT NULL AND expires_at < {NOW} - INTERVAL {GRACE_SECONDS} SECOND)))""")


@register("store_cleanup", CLEANUP_SQL)
def q_store_cleanup(spark, sf_dir):
    """O-C15 (and O-M8 counters): full cleanup, phases in order, one report row."""
    tagged = st.cleanup(D.snapshots(spark, sf_dir), D.now_col(), GRACE_SECONDS, MAX_ENTRIES, MAX_SIZE)
    return st.cleanup_report(tagged)


CLEANED_SQL = S.with_views(["snapshots"], f"""
SELECT cache_key, fetched_at, content_length FROM (
  SELECT *, sum(content_length) OVER (ORDER BY fetched_at DESC, cache_key DESC ROWS UNBOUNDED PRECEDING) AS run
  FROM (SELECT *, row_number() OVER (ORDER BY fetched_at DESC, cache_key DESC) AS rn FROM snapshots
        WHERE NOT coalesce(expires_at < {NOW} - INTERVAL {GRACE_SECONDS} SECOND, false))
  WHERE rn <= {MAX_ENTRIES})
WHERE run <= {MAX_SIZE}""")


@register("store_cleanup_apply", CLEANED_SQL)
def q_store_cleanup_apply(spark, sf_dir):
    """O-C15 on the written table: the phases' rows are deleted in one version; what is left, read back."""
    table = D.store_table(spark, sf_dir)
    tagged = st.cleanup(table.read(), D.now_col(), GRACE_SECONDS, MAX_ENTRIES, MAX_SIZE)
    after = table.delete_keys(tagged.where("phase is not null").select("cache_key"))
    return after.read().select("cache_key", "fetched_at", "content_length")


@register("store_evict_on_write", S.with_views(["snapshots"], f"""
SELECT cache_key, (SELECT sum(content_length) FROM snapshots) > {MAX_SIZE} AND (expired OR run > {MAX_SIZE}) AS evicted
FROM (SELECT cache_key, coalesce(expires_at < {NOW}, false) AS expired,
             sum(CASE WHEN coalesce(expires_at < {NOW}, false) THEN 0 ELSE content_length END)
               OVER (PARTITION BY coalesce(expires_at < {NOW}, false) ORDER BY fetched_at DESC, cache_key DESC
                     ROWS UNBOUNDED PRECEDING) AS run
      FROM snapshots)"""))
def q_store_evict(spark, sf_dir):
    """O-C16: evict on write -- all expired rows, then the oldest until the size fits."""
    return st.evict_on_write(D.snapshots(spark, sf_dir), D.now_col(), MAX_SIZE).select("cache_key", "evicted")


@register("store_cleanup_params", S.with_views(["fetch_log"], f"""
SELECT profile,
  coalesce(CASE profile WHEN 'client_1' THEN 3600 END, {GRACE_SECONDS}) AS effective_delete_expired_after_seconds,
  coalesce(CASE profile WHEN 'client_2' THEN 50 END, {MAX_ENTRIES}) AS effective_max_entries,
  coalesce(CASE profile WHEN 'client_3' THEN 100000 END, {MAX_SIZE}) AS effective_max_size_bytes
FROM (SELECT DISTINCT profile FROM fetch_log)"""))
def q_store_cleanup_params(spark, sf_dir):
    """O-C17: cleanup parameters per caller, override else configured value."""
    prof = D.fetch_log(spark, sf_dir).select("profile").distinct()
    p = F.col("profile")
    ov = prof.select("profile",
                     F.when(p == "client_1", F.lit(3600)).alias("delete_expired_after_seconds"),
                     F.when(p == "client_2", F.lit(50)).alias("max_entries"),
                     F.when(p == "client_3", F.lit(100000)).alias("max_size_bytes"))
    out = st.cleanup_params(ov, {"delete_expired_after_seconds": GRACE_SECONDS, "max_entries": MAX_ENTRIES,
                                 "max_size_bytes": MAX_SIZE})
    return out.select("profile", "effective_delete_expired_after_seconds", "effective_max_entries",
                      "effective_max_size_bytes")


@register("store_lookup_mixed", _with(["snapshots", "page_keys", "fetch_log"], f"""
SELECT q.request_id, q.cache_key,
  CASE WHEN q.force_refresh THEN 'bypass' WHEN s.cache_key IS NULL THEN 'miss'
       WHEN s.expires_at IS NOT NULL AND {NOW} > s.expires_at THEN 'expired' ELSE 'hit' END AS outcome
FROM (SELECT request_id, force_refresh, CASE WHEN request_id % 5 = 0 THEN sha256(cache_key) ELSE cache_key END AS cache_key FROM requests) q
LEFT JOIN snapshots s USING (cache_key)""", REQ_SQL))
def q_store_lookup_mixed(spark, sf_dir):
    """O-C1 / O-S2: lookups of which every fifth asks for a key that the store lacks; the rows come from
    the written table, bucket by bucket."""
    r = _requests(spark, sf_dir).select("request_id", "force_refresh", F.when(
        F.col("request_id") % 5 == 0, F.sha2("cache_key", 256)).otherwise(F.col("cache_key")).alias("cache_key"))
    found = D.store_table(spark, sf_dir).lookup(r.select("cache_key"))
    return st.lookup(r, found, D.now_col()).select("request_id", "cache_key", "outcome")
