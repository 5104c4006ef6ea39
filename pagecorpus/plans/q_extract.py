"""Registered extraction queries (O-X1..O-X15, O-M3) over the shredded page corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagecorpus.operators.extract import extract
from pagecorpus.plans import sqlbits as S
from pagecorpus.plans.q_clean import ABS_LINKS_SQL
from pagecorpus.plans.registry import register
from pagecorpus.sources.corpus import nodes_table
from pagecorpus.sources.tables import read_table

NAV_SPEC = {"links": {"selector": "nav a", "type": "attr", "attribute": "href", "multiple": True,
                      "absolute_url": True}}
HEAD_SPEC = {
    "title": {"selector": "title"},
    "heading": {"selector": "article h1", "type": "text"},
    "footer": {"selector": "footer", "type": "text"},
    "missing": {"selector": "div.sponsor", "default": "n/a"},
    "ad_attr": {"selector": "div.ad", "type": "attr", "attribute": "data-slot", "default": "none"},
}
ITEMS_SPEC = {"items": {"selector": "nav li", "type": "object", "multiple": True,
                        "fields": {"label": {"selector": "a", "type": "text"},
                                   "href": {"selector": "a", "type": "attr"}}}}
NAV_OBJECT_SPEC = {"nav": {"selector": "nav", "type": "object",
                           "fields": {"first": {"selector": "li:first-child a"},
                                      "last": {"selector": "li:last-child a", "type": "attr"},
                                      "count_hint": {"selector": "li:nth-child(n+4) a", "multiple": True}}}}
REQUIRED_SPEC = {"title": {"selector": "title"},
                 "sixth": {"selector": "nav li:nth-child(6) a", "required": True},
                 "seventh": {"selector": "nav li:nth-child(7) a", "required": True}}
MENU_SPEC = {"menu": {"selector": "nav > ul", "type": "html"}}


def _bases(spark, sf_dir):
    # O-U14: spec base, else final URL, else URL (the page table has only the URL)
    return read_table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("base_url"))


def _run(spark, sf_dir, spec):
    return extract(nodes_table(spark, sf_dir), spec, _bases(spark, sf_dir))


@register("extract_nav_links", ABS_LINKS_SQL)
def q_extract_nav_links(spark, sf_dir):
    """O-X1 / O-X4 / O-X7 / O-X12: every nav link's href, absolute, in document order."""
    r = _run(spark, sf_dir, NAV_SPEC)
    return r.filter(F.col("extracted.links").isNotNull()).select(
        "page_id", F.array_join("extracted.links", " ").alias("links"))


_TXT = lambda e: S.py_strip(S.unescape(e))

HEAD_SQL = f"""
SELECT page_id,
  CASE WHEN regexp_matches(_h, '(?si)<title\\b') THEN {_TXT("regexp_extract(_h, '(?si)<title\\b[^>]*>(.*?)</title', 1)")} END AS title,
  CASE WHEN regexp_matches(_h, '(?si)<article\\b.*?<h1\\b') THEN
    {_TXT("regexp_replace(regexp_extract(_h, '(?si)<article\\b.*?<h1\\b[^>]*>(.*?)</h1', 1), '<[^>]*>', '', 'g')")} END AS heading,
  CASE WHEN regexp_matches(_h, '(?si)<footer\\b') THEN
    {_TXT("regexp_replace(regexp_extract(_h, '(?si)<footer\\b[^>]*>(.*?)</footer', 1), '<[^>]*>', '', 'g')")} END AS footer,
  'n/a' AS missing,
  CASE WHEN regexp_matches(_h, '<div class="ad"') THEN NULL ELSE 'none' END AS ad_attr
FROM (SELECT page_id, regexp_replace(html, '(?si)<(script|style)\\b[^>]*>.*?</(script|style)\\s*>', ' ', 'g') AS _h FROM pages)"""


@register("extract_fields", HEAD_SQL)
def q_extract_fields(spark, sf_dir):
    """O-X2 / O-X6 / O-X10 / S9: first-match text fields, a default for no match, and a
    matched element lacking the attribute (null, not the default)."""
    r = _run(spark, sf_dir, HEAD_SPEC)
    return r.select("page_id", "extracted.title", "extracted.heading", "extracted.footer", "extracted.missing",
                    "extracted.ad_attr")


_ITEMS = "regexp_extract_all(_nav, '<li><a href=\"([^\"]*)\">([^<]*)</a></li>', {g})"
ITEMS_SQL = f"""
SELECT page_id, CAST(i - 1 AS INTEGER) AS position, {_TXT('labels[i]')} AS label, hrefs[i] AS href
FROM (SELECT page_id, labels, hrefs, unnest(range(1, len(hrefs) + 1)) AS i
      FROM (SELECT page_id, {_ITEMS.format(g=2)} AS labels, {_ITEMS.format(g=1)} AS hrefs
            FROM (SELECT page_id, regexp_extract(html, '(?si)<nav\\b.*?</nav', 0) AS _nav FROM pages)))"""


@register("extract_items", ITEMS_SQL)
def q_extract_items(spark, sf_dir):
    """O-X8 / O-X9: an object list (label + href per nav item) in long form, one row per item."""
    r = _run(spark, sf_dir, ITEMS_SPEC)
    return r.select("page_id", F.posexplode("extracted.items").alias("position", "item")).select(
        "page_id", "position", "item.label", "item.href")


NAV_OBJ_SQL = f"""
SELECT page_id, {_TXT('labels[1]')} AS first, hrefs[len(hrefs)] AS last,
       CASE WHEN len(hrefs) >= 4 THEN array_to_string(list_transform(labels[4:], lambda x: {_TXT('x')}), '|') END AS count_hint
FROM (SELECT page_id, {_ITEMS.format(g=2)} AS labels, {_ITEMS.format(g=1)} AS hrefs
      FROM (SELECT page_id, regexp_extract(html, '(?si)<nav\\b.*?</nav', 0) AS _nav FROM pages))"""


@register("extract_object", NAV_OBJ_SQL)
def q_extract_object(spark, sf_dir):
    """O-X8: a single nested object (first match) with scalar, attribute and list fields."""
    r = _run(spark, sf_dir, NAV_OBJECT_SPEC)
    return r.select("page_id", "extracted.nav.first", "extracted.nav.last",
                    F.array_join("extracted.nav.count_hint", "|").alias("count_hint"))


REQ_SQL = f"""
SELECT page_id, CASE WHEN n >= 7 THEN {_TXT("regexp_extract(html, '(?si)<title\\b[^>]*>(.*?)</title', 1)")} END AS title,
       CASE WHEN n < 6 THEN 'sixth' WHEN n < 7 THEN 'seventh' END AS error_field,
       CASE WHEN n < 6 THEN 'No element matched CSS selector ''nav li:nth-child(6) a'''
            WHEN n < 7 THEN 'No element matched CSS selector ''nav li:nth-child(7) a''' END AS error_message
FROM (SELECT page_id, html, len(regexp_extract_all(regexp_extract(html, '(?si)<nav\\b.*?</nav', 0), '<li\\b')) AS n FROM pages)"""


@register("extract_required", REQ_SQL)
def q_extract_required(spark, sf_dir):
    """O-X11 / S12: required fields -- the first failing one (spec order) nulls the page's
    result and becomes its extraction error."""
    r = _run(spark, sf_dir, REQUIRED_SPEC)
    return r.select("page_id", "extracted.title", F.col("extraction_error.field").alias("error_field"),
                    F.col("extraction_error.message").alias("error_message"))


RATES_SQL = f"""
SELECT metric, CAST(value AS DOUBLE) AS value FROM (
  SELECT 'extraction_requests_total' AS metric, count(*) AS value FROM r
  UNION ALL SELECT 'extraction_success_total', count(*) FILTER (WHERE n >= 7) FROM r
  UNION ALL SELECT 'extraction_error_total', count(*) FILTER (WHERE n < 7) FROM r
  UNION ALL SELECT 'fill_rate_title', avg(CASE WHEN n >= 7 THEN 1.0 ELSE 0.0 END) FROM r)"""
RATES_SQL = S.with_views([], "WITH r AS (SELECT page_id, len(regexp_extract_all(regexp_extract(html, '(?si)<nav\\b.*?</nav', 0), '<li\\b')) AS n FROM pages)\n" + RATES_SQL)


@register("extract_rates", RATES_SQL)
def q_extract_rates(spark, sf_dir):
    """O-X15 / O-M3: extraction request / success / error counters and a field fill rate."""
    r = _run(spark, sf_dir, REQUIRED_SPEC)
    ok = F.col("extraction_error").isNull()
    wide = r.agg(F.count(F.lit(1)).cast("double").alias("extraction_requests_total"),
                 F.count(F.when(ok, 1)).cast("double").alias("extraction_success_total"),
                 F.count(F.when(~ok, 1)).cast("double").alias("extraction_error_total"),
                 F.avg(F.when(F.col("extracted.title").isNotNull(), 1.0).otherwise(0.0)).alias("fill_rate_title"))
    return wide.selectExpr("stack(4, 'extraction_requests_total', extraction_requests_total, "
                           "'extraction_success_total', extraction_success_total, 'extraction_error_total', "
                           "extraction_error_total, 'fill_rate_title', fill_rate_title) AS (metric, value)")


MENU_SQL = """
SELECT page_id, regexp_extract(html, '(?si)<nav\\b[^>]*>\\s*<ul>(.*?)</ul>', 1) AS menu FROM pages"""


@register("extract_inner_html", MENU_SQL)
def q_extract_inner_html(spark, sf_dir):
    """O-X3 / O-H16: inner HTML of the first ``nav > ul`` rebuilt from the node table."""
    r = _run(spark, sf_dir, MENU_SPEC)
    return r.select("page_id", "extracted.menu")
