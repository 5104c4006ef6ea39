"""Registered queries of the full request schema (O-S3, O-V1, O-V2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagecorpus.operators import requests as R
from pagecorpus.plans import sqlbits as S
from pagecorpus.plans.registry import register
from pagecorpus.sources import derived as D
from pagecorpus.sources.tables import read_table
from pagecorpus.streaming.streams import scratch

#: Values of the derived requests; the same text is valid in Spark and in the twin.
_VALUES = {
    "url": "CASE WHEN request_id % 97 = 5 THEN NULL WHEN request_id % 89 = 0 THEN '' WHEN request_id % 211 = 0 THEN repeat('a', 8193) ELSE url END",
    "mode": "CASE WHEN request_id % 17 = 0 THEN NULL WHEN request_id % 53 = 0 THEN 'ftp' ELSE mode END",
    "cache_ttl_seconds": "CASE WHEN request_id % 4 = 0 THEN 30 WHEN request_id % 4 = 1 THEN NULL ELSE 60 * (request_id % 50 + 1) END",
    "wait_until": "CASE WHEN request_id % 41 = 0 THEN 'idle' WHEN request_id % 3 = 0 THEN NULL WHEN request_id % 3 = 1 THEN 'load' ELSE 'networkidle0' END",
    "wait_selector": "CASE WHEN request_id % 61 = 0 THEN repeat('x', 501) WHEN request_id % 2 = 0 THEN '#main' END",
    "timeout_seconds": "CASE WHEN request_id % 19 = 0 THEN NULL ELSE 5 + elapsed_ms % 200 END",
    "max_scrolls": "CASE WHEN request_id % 13 = 0 THEN NULL ELSE request_id % 120 END",
    "delay_ms": "CASE WHEN request_id % 13 = 0 THEN NULL ELSE 50 * (request_id % 700) END",
    "preset": "CASE request_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'light' WHEN 2 THEN 'content' WHEN 3 THEN 'aggressive' ELSE 'heavy' END",
    "x_selector": "CASE WHEN request_id % 31 = 0 THEN NULL ELSE 'a' END",
    "x_type": "CASE WHEN request_id % 29 = 0 THEN 'link' ELSE 'attr' END",
    "n_type": "CASE WHEN request_id % 37 = 0 THEN 'json' WHEN request_id % 2 = 0 THEN 'text' END",
    "damage": "CASE WHEN request_id % 101 = 0 THEN 'cut' WHEN request_id % 103 = 0 THEN 'type' ELSE '' END",
}
_ROWS_SQL = "rq AS (SELECT request_id, " + ", ".join(f"{v} AS {n}" for n, v in _VALUES.items()) + \
    " FROM (SELECT f.request_id, f.mode, f.elapsed_ms, p.url FROM fetch_log f JOIN pages p USING (page_id)))"


def _landed(spark, sf_dir) -> str:
    """The fetch log's requests as JSON lines, some of them damaged."""
    rows = D.fetch_log(spark, sf_dir).select("request_id", "page_id", "mode", "elapsed_ms").join(
        read_table(spark, sf_dir, "pages").select("page_id", "url"), "page_id")
    v = rows.select("request_id", *(F.expr(sql).alias(n) for n, sql in _VALUES.items()))
    c = F.col
    field = lambda **kw: F.struct(*(x.alias(n) for n, x in kw.items()))
    fields = field(title=field(selector=F.lit("title")), x=field(selector=c("x_selector"), type=c("x_type"), attribute=F.lit("href")),
                   o=field(selector=F.lit("nav"), type=F.lit("object"), fields=field(n=field(selector=F.lit("li"), type=c("n_type"), multiple=F.lit(True)))))
    scroll = F.when(c("max_scrolls").isNotNull(), F.struct(F.lit(True).alias("enabled"), "max_scrolls", "delay_ms"))
    line = F.to_json(F.struct("request_id", "url", "mode", "cache_ttl_seconds", "wait_until", "wait_selector", "timeout_seconds", scroll.alias("scroll"),
                              F.struct("preset").alias("normalize"), F.struct(F.lit(True).alias("enabled"), fields.alias("fields")).alias("extract")))
    damaged = F.when(c("damage") == "cut", F.substring(line, 1, 30)).when(
        c("damage") == "type", F.concat(F.regexp_replace(line, r"\}$", ""), F.lit(',"force_refresh":"soon"}'))).otherwise(line)
    out = scratch(spark, "request_lines")
    v.select(damaged.alias("value")).write.text(out)
    return out


_BROKEN_SQL = """
SELECT request_id, '$' AS path, 'malformed' AS code FROM rq WHERE damage <> ''
UNION ALL SELECT request_id, unnest(list_filter([
    CASE WHEN url IS NULL THEN {'p': 'url', 'c': 'missing'} END,
    CASE WHEN length(url) NOT BETWEEN 1 AND 8192 THEN {'p': 'url', 'c': 'length'} END,
    CASE WHEN mode NOT IN ('http', 'browser', 'auto') THEN {'p': 'mode', 'c': 'enum'} END,
    CASE WHEN wait_until NOT IN ('load', 'domcontentloaded', 'networkidle', 'networkidle0') THEN {'p': 'wait_until', 'c': 'enum'} END,
    CASE WHEN preset NOT IN ('light', 'content', 'aggressive') THEN {'p': 'normalize.preset', 'c': 'enum'} END,
    CASE WHEN cache_ttl_seconds NOT BETWEEN 60 AND 2592000 THEN {'p': 'cache_ttl_seconds', 'c': 'range'} END,
    CASE WHEN timeout_seconds NOT BETWEEN 5 AND 180 THEN {'p': 'timeout_seconds', 'c': 'range'} END,
    CASE WHEN max_scrolls NOT BETWEEN 1 AND 100 THEN {'p': 'scroll.max_scrolls', 'c': 'range'} END,
    CASE WHEN delay_ms NOT BETWEEN 100 AND 30000 THEN {'p': 'scroll.delay_ms', 'c': 'range'} END,
    CASE WHEN length(wait_selector) > 500 THEN {'p': 'wait_selector', 'c': 'length'} END,
    CASE WHEN mode = 'browser' AND coalesce(timeout_seconds, 90) > 60 THEN {'p': 'timeout_seconds', 'c': 'browser_over_60'} END,
    CASE WHEN x_selector IS NULL THEN {'p': 'extract.fields.x.selector', 'c': 'missing'} END,
    CASE WHEN x_type = 'link' THEN {'p': 'extract.fields.x.type', 'c': 'enum'} END,
    CASE WHEN n_type = 'json' THEN {'p': 'extract.fields.o.fields.n.type', 'c': 'enum'} END], lambda r: r IS NOT NULL)) AS r FROM rq WHERE damage = ''"""
_BROKEN_SQL = _BROKEN_SQL.replace("UNION ALL SELECT request_id, unnest(", "UNION ALL SELECT request_id, r.p, r.c FROM (SELECT request_id, unnest(") + ")"


@register("request_rejections", S.with_views(["fetch_log"], _BROKEN_SQL, _ROWS_SQL))
def q_request_rejections(spark, sf_dir):
    """O-V1 / O-V2 / O-S3: every broken rule of every request read with the full schema, by path."""
    return R.rejected(R.read_requests(spark, _landed(spark, sf_dir))).select("request_id", "path", "code")


ACCEPTED_SQL = S.with_views(["fetch_log"], """
SELECT request_id, url, coalesce(mode, 'auto') AS mode, CAST(cache_ttl_seconds AS INTEGER) AS cache_ttl_seconds, false AS force_refresh,
       coalesce(wait_until, 'networkidle') AS wait_until, CAST(coalesce(timeout_seconds, 90) AS INTEGER) AS timeout_seconds,
       max_scrolls IS NOT NULL AS scroll_enabled, CAST(coalesce(max_scrolls, 5) AS INTEGER) AS max_scrolls,
       CAST(coalesce(delay_ms, 1000) AS INTEGER) AS delay_ms, true AS stop_when_no_growth, preset, false AS minify,
       'o,title,x' AS fields, coalesce(n_type, 'none') AS nested_type
FROM rq WHERE damage = '' AND request_id NOT IN (SELECT request_id FROM broken)""", _ROWS_SQL + f", broken AS ({_BROKEN_SQL})")


@register("request_accepted", ACCEPTED_SQL)
def q_request_accepted(spark, sf_dir):
    """O-S3: the requests that break no rule, with every default filled in."""
    ok = R.accepted(R.read_requests(spark, _landed(spark, sf_dir)))
    nested = F.try_element_at(F.try_element_at("extract.fields", F.lit("o"))["fields"], F.lit("n"))["type"]
    return ok.select("request_id", "url", "mode", "cache_ttl_seconds", "force_refresh", "wait_until", "timeout_seconds",
                     F.col("scroll.enabled").alias("scroll_enabled"), "scroll.max_scrolls", "scroll.delay_ms", "scroll.stop_when_no_growth",
                     "normalize.preset", "normalize.minify", F.array_join(F.array_sort(F.map_keys("extract.fields")), ",").alias("fields"),
                     F.coalesce(nested, F.lit("none")).alias("nested_type"))
