"""Registered page queries: flagship summary (minimum slice) and visible text."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagecorpus.operators.nodes import visible_text
from pagecorpus.plans import sqlbits as S
from pagecorpus.plans.pages import page_summary
from pagecorpus.plans.registry import register
from pagecorpus.sources.corpus import nodes_table

_NO_CODE = "(?si)<(script|style)\\b[^>]*>.*?</(script|style)\\s*>"

PAGE_SUMMARY_SQL = f"""
SELECT page_id, domain, cache_key,
  CASE WHEN regexp_matches(_h, '(?si)<title\\b') THEN
    {S.py_strip(S.unescape("regexp_extract(_h, '(?si)<title\\b[^>]*>(.*?)</title', 1)"))} END AS title,
  CAST(coalesce(list_sum(list_transform(regexp_extract_all(_h, '(?si)<nav\\b.*?</nav\\s*>'),
       lambda b: len(regexp_extract_all(b, '(?i)<a[\\s/>]')))), 0) AS BIGINT) AS n_links,
  CAST(length({S.page_text_sql('html')}) AS BIGINT) AS n_chars
FROM ({S.url_sql("SELECT page_id, url, html, regexp_replace(html, '" + _NO_CODE + "', ' ', 'g') AS _h FROM pages", 'url')})
"""


@register("page_summary", PAGE_SUMMARY_SQL)
def q_page_summary(spark, sf_dir):
    return page_summary(spark, sf_dir)


PAGE_TEXT_SQL = f"""
SELECT page_id, {S.page_text_sql('html')} AS text FROM pages
"""


@register("page_text", PAGE_TEXT_SQL)
def q_page_text(spark, sf_dir):
    """O-H17 on every page."""
    return visible_text(nodes_table(spark, sf_dir))


NODE_TAG_COUNTS_SQL = f"""
SELECT tag, CAST(count(*) AS BIGINT) AS n
FROM (SELECT lower(unnest(regexp_extract_all(
        regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?si)<(script|style)\\b([^>]*)>.*?</(script|style)\\s*>', '<\\1\\2>', 'g'),
        '<([a-zA-Z][^\\s/>]*)', 1))) AS tag FROM pages)
GROUP BY tag
"""


@register("node_tag_counts", NODE_TAG_COUNTS_SQL)
def q_node_tag_counts(spark, sf_dir):
    """O-H1 check: element counts by tag over the whole shredded corpus."""
    nodes = nodes_table(spark, sf_dir)
    return (nodes.filter(F.col("kind") == "element").groupBy("tag")
            .agg(F.count(F.lit(1)).alias("n")))
