"""Registered request / response queries: validation (O-V1, O-V2, O-V5, O-V6, O-V8) and
the request / response / dump sources and sinks (O-S3, O-S5, O-S6, O-S8), compaction
(O-C18)."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from pagecorpus.operators import policy as pol
from pagecorpus.operators import validate as V
from pagecorpus.plans import sqlbits as S
from pagecorpus.plans.q_store import REQ_SQL, _requests
from pagecorpus.plans.registry import register
from pagecorpus.sources import derived as D
from pagecorpus.sources import sinks
from pagecorpus.streaming.streams import scratch

MAX_HTML_CHARS = 4000
EXPOSED_PROFILES = ["client_0", "client_1"]


def _request_rows(spark, sf_dir):
    return _requests(spark, sf_dir).select(
        "request_id", "url", "mode", F.col("request_ttl").alias("cache_ttl_seconds"),
        (F.lit(5) + F.col("elapsed_ms") % 200).cast("int").alias("timeout_seconds"))


VALIDATION_SQL = S.with_views(["fetch_log", "page_keys"], """
SELECT request_id, concat_ws(',',
    CASE WHEN url IS NULL OR length(url) < 1 OR length(url) > 8192 THEN 'url_length' END,
    CASE WHEN mode NOT IN ('http', 'browser', 'auto') THEN 'mode' END,
    CASE WHEN cache_ttl_seconds IS NOT NULL AND (cache_ttl_seconds < 60 OR cache_ttl_seconds > 2592000) THEN 'cache_ttl_range' END,
    CASE WHEN timeout_seconds < 5 OR timeout_seconds > 180 THEN 'timeout_range' END,
    CASE WHEN mode = 'browser' AND timeout_seconds > 60 THEN 'browser_timeout_over_60' END) AS rules
FROM (SELECT r.request_id, r.url, f.mode, r.request_ttl AS cache_ttl_seconds,
             CAST(5 + f.elapsed_ms % 200 AS INTEGER) AS timeout_seconds
      FROM requests r JOIN fetch_log f USING (request_id))""", REQ_SQL)


@register("request_validation", VALIDATION_SQL)
def q_request_validation(spark, sf_dir):
    """O-V1 / O-V2: request field rules and the browser-timeout cross-field rule, as the
    list of broken rule codes per request ('' = accepted)."""
    r = _request_rows(spark, sf_dir)
    return r.select("request_id", F.array_join(V.request_rules(r, cross_field=True), ",").alias("rules"))


TRUNC_SQL = f"""
SELECT page_id, CAST(least(length(html), {MAX_HTML_CHARS}) AS BIGINT) AS content_length,
       length(html) > {MAX_HTML_CHARS} AS truncated, substr(html, 1, {MAX_HTML_CHARS}) AS html FROM pages"""


@register("html_truncation", TRUNC_SQL)
def q_html_truncation(spark, sf_dir):
    """O-V5 / S3: HTML cut to the size limit in characters, length recomputed, flagged."""
    from pagecorpus.sources.tables import read_table
    p = read_table(spark, sf_dir, "pages")
    return V.truncate(p, "html", MAX_HTML_CHARS).select("page_id", "content_length", "truncated", "html")


RESPONSE_SQL = S.with_views(["snapshots", "page_keys", "fetch_log"], f"""
SELECT r.request_id, s.url, s.final_url, s.status_code, coalesce(o.outcome = 'hit', false) AS from_cache,
       false AS stale, s.mode, s.content_length, s.cache_key,
       CASE WHEN f.profile IN ({', '.join(repr(p) for p in EXPOSED_PROFILES)}) THEN f.profile END AS profile_name
FROM requests r JOIN fetch_log f USING (request_id) JOIN snapshots s USING (cache_key)
LEFT JOIN (SELECT r2.request_id, CASE WHEN r2.force_refresh THEN 'bypass'
                  WHEN s2.expires_at IS NOT NULL AND {S.NOW_SQL} > s2.expires_at THEN 'expired' ELSE 'hit' END AS outcome
           FROM requests r2 JOIN snapshots s2 USING (cache_key)) o USING (request_id)
WHERE NOT f.failed""", REQ_SQL)


def _responses(spark, sf_dir):
    from pagecorpus.operators import store as st
    r = _requests(spark, sf_dir).filter(~F.col("failed")).select("request_id", "cache_key", "force_refresh", "profile", "elapsed_ms")
    snaps = D.snapshots(spark, sf_dir)
    look = st.lookup(r, snaps, D.now_col())
    j = look.join(snaps.drop("seq"), "cache_key")
    return V.response_v1(j, F.col("outcome") == "hit", F.lit(False),
                         F.col("profile").isin(EXPOSED_PROFILES))


@register("response_records", RESPONSE_SQL)
def q_response_records(spark, sf_dir):
    """O-V6 / O-V8 / O-S6: v1 response records (store hit or fresh fetch), with the caller's
    profile name attached only where profiles are exposed; flattened for the check."""
    r = _responses(spark, sf_dir)
    return r.select("request_id", "url", "final_url", "status_code", "from_cache", "stale",
                    F.col("metadata.mode").alias("mode"), F.col("metadata.content_length").alias("content_length"),
                    F.col("metadata.cache_key").alias("cache_key"), F.col("metadata.profile_name").alias("profile_name"))


@register("response_json_sink", "SELECT request_id, url, CAST(status_code AS INTEGER) AS status_code, from_cache FROM ("
          + RESPONSE_SQL + ")")
def q_response_json_sink(spark, sf_dir):
    """O-S6: response records written as JSON lines (partitioned by mode) and read back."""
    out = scratch(spark, "responses")
    sinks.write_responses(_responses(spark, sf_dir), out)
    back = spark.read.schema("request_id long, url string, status_code int, from_cache boolean").json(out)
    return back.select("request_id", "url", "status_code", "from_cache")


DUMP_SQL = """
SELECT page_id, left(replace(replace(replace(url, '://', '_'), '/', '_'), '?', '_'), 100) || '.html' AS file_name,
       regexp_extract(url, '^https?://(?:www\\.)?([^/:?#]+)', 1) AS domain FROM pages"""


def _all_responses(spark, sf_dir):
    """The answer to every request that has one: from the store, fetched, or stale after a failed fetch."""
    from pagecorpus.operators import store as st
    from pagecorpus.plans.q_store import GLOBAL_TTL
    from pagecorpus.sources.tables import read_table
    r = _requests(spark, sf_dir).withColumn("pdomain", F.regexp_extract("url", r"^https?://(?:www\.)?([^/:?#]+)", 1))
    pol = D.policies(spark, sf_dir).select(F.col("domain").alias("pdomain"), "default_ttl_seconds")
    r = r.withColumnRenamed("url", "asked_url").withColumnRenamed("status_code", "got_status").withColumnRenamed("mode", "got_mode")
    snaps = D.snapshots(spark, sf_dir).drop("seq")
    r = st.stale_if_error(st.lookup(r, snaps, D.now_col())).where("result <> 'error'").join(pol, "pdomain", "left")
    # digests, so that contents do not travel once for each request
    pages = read_table(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("content_sha256"), F.length("html").cast("long").alias("page_length"))
    j = r.join(pages, "page_id").join(snaps, "cache_key", "left")
    fresh = F.col("result") == "fetched"
    pick = lambda new, old: F.when(fresh, new).otherwise(F.col(old)).alias(old)
    ttl = st.resolve_ttl(F.col("request_ttl"), F.col("default_ttl_seconds"), F.lit(GLOBAL_TTL)).cast("int")
    rows = j.select("request_id", "profile", "elapsed_ms", "cache_key", "content_sha256", ~fresh, F.col("result") == "stale",
                    pick(F.col("asked_url"), "url"), pick(F.col("asked_url"), "final_url"), pick(F.col("got_status"), "status_code"),
                    pick(F.col("requested_at"), "fetched_at"), pick(st.expires_at(F.col("requested_at"), ttl), "expires_at"),
                    pick(F.col("got_mode"), "mode"), pick(F.col("page_length"), "content_length"))
    rows = rows.toDF("request_id", "profile", "elapsed_ms", "cache_key", "content_sha256", "from_cache", "stale", *rows.columns[7:])
    return V.response_v1(rows, F.col("from_cache"), F.col("stale"), F.col("profile").isin(EXPOSED_PROFILES), "content_sha256")


FULL_SQL = S.with_views(["snapshots", "page_keys", "fetch_log", "policies"], f"""
SELECT request_id, result <> 'fetched' AS from_cache, result = 'stale' AS stale, elapsed_ms, cache_key, sha256(html) AS content_sha256,
       CASE WHEN result = 'fetched' THEN url ELSE s_url END AS url, CASE WHEN result = 'fetched' THEN got_status ELSE s_status END AS status_code,
       CASE WHEN result = 'fetched' THEN requested_at ELSE s_fetched END AS fetched_at,
       CASE WHEN result <> 'fetched' THEN s_expires WHEN ttl > 0 THEN requested_at + to_seconds(ttl) END AS expires_at,
       CASE WHEN result = 'fetched' THEN got_mode ELSE s_mode END AS mode,
       CASE WHEN result = 'fetched' THEN length(html) ELSE s_length END AS content_length,
       CASE WHEN profile IN ({', '.join(repr(p) for p in EXPOSED_PROFILES)}) THEN profile END AS profile_name
FROM (SELECT *, CASE WHEN outcome = 'hit' THEN 'cached' WHEN NOT failed THEN 'fetched' WHEN outcome = 'expired' THEN 'stale' ELSE 'error' END AS result
      FROM (SELECT r.request_id, r.requested_at, r.url, r.cache_key, r.failed, r.status_code AS got_status, f.mode AS got_mode, f.elapsed_ms, f.profile, p.html,
                   s.url AS s_url, s.status_code AS s_status, s.fetched_at AS s_fetched, s.expires_at AS s_expires, s.mode AS s_mode, s.content_length AS s_length,
                   coalesce(CASE WHEN r.request_ttl <> 0 THEN r.request_ttl END, CASE WHEN po.default_ttl_seconds <> 0 THEN po.default_ttl_seconds END, 86400) AS ttl,
                   CASE WHEN r.force_refresh THEN 'bypass' WHEN s.cache_key IS NULL THEN 'miss'
                        WHEN s.expires_at IS NOT NULL AND {S.NOW_SQL} > s.expires_at THEN 'expired' ELSE 'hit' END AS outcome
            FROM requests r JOIN fetch_log f USING (request_id) JOIN pages p ON p.page_id = r.page_id LEFT JOIN snapshots s USING (cache_key)
            LEFT JOIN policies po ON po.domain = regexp_extract(r.url, '^https?://(?:www\\.)?([^/:?#]+)', 1)))
WHERE result <> 'error'""", REQ_SQL)


@register("response_full", FULL_SQL)
def q_response_full(spark, sf_dir):
    """O-V6 / O-V8 / O-S6: whole response records -- fresh, cached and stale ones with real elapsed times and
    content digests -- written as JSON lines and read back with the full nested schema."""
    out = scratch(spark, "responses_full")
    rows = _all_responses(spark, sf_dir)
    sinks.write_responses(rows, out)
    back = spark.read.schema(rows.schema).options(**sinks.JSON_TIMES).json(out)
    return back.select("request_id", "url", "status_code", "from_cache", "stale", "fetched_at", "expires_at",
                       *(F.col(f"metadata.{c}").alias(c) for c in ("mode", "elapsed_ms", "content_length", "cache_key", "profile_name", "content_sha256")))


@register("html_dump_names", DUMP_SQL)
def q_html_dump_names(spark, sf_dir):
    """O-S5: the dump sink's file name per page (``://``, ``/``, ``?`` -> ``_``, 100 chars)."""
    from pagecorpus.sources.tables import read_table
    p = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return p.select("page_id", sinks.dump_name(F.col("url")).alias("file_name"),
                    F.regexp_extract("url", r"^https?://(?:www\.)?([^/:?#]+)", 1).alias("domain"))


@register("html_dump_sink", """
SELECT regexp_extract(url, '^https?://(?:www\\.)?([^/:?#]+)', 1) AS domain,
       left(replace(replace(replace(url, '://', '_'), '/', '_'), '?', '_'), 100) || '.html' AS file_name,
       CAST(length(html) AS INTEGER) AS n_chars FROM pages""")
def q_html_dump_sink(spark, sf_dir):
    """O-S5: pages written by the dump sink (parquet partitioned by domain, named rows)."""
    from pagecorpus.sources.tables import read_table
    out = scratch(spark, "dump")
    sinks.write_html_dump(read_table(spark, sf_dir, "pages"), out)
    back = spark.read.option("basePath", out).schema("file_name string, html string, domain string").parquet(out)
    return back.select("domain", "file_name", F.length("html").cast("int").alias("n_chars"))


REQUEST_SOURCE_SQL = S.with_views(["fetch_log", "page_keys"], """
SELECT request_id // 25 AS batch_id, request_id, url, mode FROM fetch_log JOIN page_keys USING (page_id)""")


@register("request_source", REQUEST_SOURCE_SQL)
def q_request_source(spark, sf_dir):
    """O-S3: batch requests written as nested JSON (``items`` arrays) and read back with a
    fixed schema, ``explode`` to one row per item."""
    out = scratch(spark, "requests")
    f = D.fetch_log(spark, sf_dir).join(D.page_keys(spark, sf_dir).select("page_id", "url"), "page_id")
    sinks.write_batch_requests(f, out, batch_size=25)
    return sinks.read_batch_requests(spark, out)


@register("store_compaction", None)
def q_store_compaction(spark, sf_dir):
    """O-C18: rewrite the store by fetch date and report files and bytes before / after."""
    out = scratch(spark, "compaction")
    return sinks.compact(spark, D.snapshots(spark, sf_dir), out, "fetched_at")
