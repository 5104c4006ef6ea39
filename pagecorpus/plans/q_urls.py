"""Registered URL queries over the page table (O-U1..O-U5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagecorpus.functions import urls
from pagecorpus.plans import sqlbits as S
from pagecorpus.plans.registry import register
from pagecorpus.sources.tables import read_table

URL_PARTS_SQL = f"""
SELECT page_id, scheme, netloc, userinfo, hostname, port, path, params, query, fragment
FROM ({S.url_sql('SELECT page_id, url FROM pages', 'url', keys=False)})
"""


@register("url_parts", URL_PARTS_SQL)
def q_url_parts(spark, sf_dir):
    """O-U1: URL split into its parts."""
    df = urls.add_url_parts(read_table(spark, sf_dir, "pages").select("page_id", "url"), "url")
    return df.select("page_id", "scheme", "netloc", "userinfo", "hostname", "port", "path", "params",
                     "query", "fragment")


URL_KEYS_SQL = f"""
SELECT page_id, canonical_url, cache_key, domain
FROM ({S.url_sql('SELECT page_id, url FROM pages', 'url')})
"""


@register("url_keys", URL_KEYS_SQL)
def q_url_keys(spark, sf_dir):
    """O-U2, O-U3, O-U4: canonical URL, cache key and domain per page."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.add_url_keys(pages, "url").select("page_id", "canonical_url", "cache_key", "domain")


FRONTIER_SQL = f"""
SELECT cache_key, arg_min(canonical_url, page_id) AS canonical_url, min(page_id) AS page_id,
       arg_min(url, page_id) AS url, CAST(count(*) AS BIGINT) AS n_urls
FROM ({S.url_sql('SELECT page_id, url FROM pages', 'url')})
GROUP BY cache_key
"""


@register("frontier_dedup", FRONTIER_SQL)
def q_frontier_dedup(spark, sf_dir):
    """O-U5: de-duplicate a crawl frontier by cache key; the first page per key is kept.

    One aggregation on the key with partial (map-side) aggregation, so a key that holds a
    third of all rows is combined before the shuffle."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    keyed = urls.add_url_keys(pages, "url", dom=None)
    return (keyed.groupBy("cache_key")
            .agg(F.min_by("canonical_url", "page_id").alias("canonical_url"),
                 F.min("page_id").alias("page_id"),
                 F.min_by("url", "page_id").alias("url"),
                 F.count(F.lit(1)).alias("n_urls")))
