"""Page-level plans: the flagship summary and the page-text report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagecorpus.functions import urls
from pagecorpus.operators.extract import extract
from pagecorpus.operators.nodes import visible_text
from pagecorpus.sources.corpus import nodes_table
from pagecorpus.sources.tables import read_table


SUMMARY_SPEC = {"title": {"selector": "title"}, "links": {"selector": "nav a", "type": "attr", "multiple": True}}


def page_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: one row per page ``(page_id, domain, cache_key, title, n_links, n_chars)``.

    URL columns are pure expressions on the page scan (html pruned away); text, title and
    nav links come from the node table; all per-page results meet in joins on page_id.
    """
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    nodes = nodes_table(spark, sf_dir)
    keyed = urls.add_url_keys(pages, "url", canonical=None).select("page_id", "domain", "cache_key")
    text = visible_text(nodes).select("page_id", F.length("text").cast("long").alias("n_chars"))
    found = extract(nodes, SUMMARY_SPEC).select("page_id", "extracted.title", F.size("extracted.links").alias("n_links"))
    return (keyed.join(text, "page_id", "left")
            .join(found, "page_id", "left")
            .select("page_id", "domain", "cache_key", "title",
                    F.greatest("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("n_chars", F.lit(0)).cast("long").alias("n_chars")))
