"""The whole pipeline over pages: clean, then extract from what is left, then format (O-H18, O-H19).

The node table is shredded once.  Cleaning works on it, and extraction sees the cleaned nodes as a
parser would see the cleaned markup: strings that a removal made neighbours are one string, and
positions among siblings are those of the elements that are left.  Removed nodes leave gaps in the ids,
which the intervals and the extraction allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagecorpus.operators.clean import FEATURES, clean_nodes, rebuild_html
from pagecorpus.operators.extract import extract
from pagecorpus.operators.nodes import visible_text
from pagecorpus.session import materialize

FORMATS = ("html", "text")


def as_parsed(nodes: DataFrame) -> DataFrame:
    """Cleaned nodes as parsing their markup gives them.  All windows lie within a page."""
    page = Window.partitionBy("page_id").orderBy("node_id")
    string = F.col("kind").isin("text", "ctext")
    follows = (string & (F.lag("kind").over(page) == F.col("kind")) & (F.lag("parent_id").over(page) == F.col("parent_id")))
    runs = nodes.filter(~(string & (F.col("text") == ""))).withColumn("_new", ~F.coalesce(follows, F.lit(False)))
    runs = runs.withColumn("_run", F.sum(F.col("_new").cast("int")).over(page))
    run = Window.partitionBy("page_id", "_run").orderBy("node_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    merged = runs.withColumn("text", F.when(string, F.array_join(F.collect_list("text").over(run), "")).otherwise(F.col("text")))
    merged = merged.filter("_new").drop("_new", "_run")
    element = F.col("kind") == "element"
    one = F.when(element, 1).otherwise(0)
    family = Window.partitionBy("page_id", "parent_id")
    place = F.sum(one).over(family.orderBy("node_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")
    whole = Window.partitionBy("page_id")
    return merged.withColumns({
        "esib": F.when(element, place),
        "esib_rev": F.when(element, F.sum(one).over(family).cast("int") - place + 1),
        "last_desc": F.when(F.col("node_id") == 0, F.max("node_id").over(whole)).otherwise(F.col("last_desc"))})


def base_url(spec_base: str | None, final_url: Column, url: Column) -> Column:
    """O-U14: the spec's base URL, else the final URL, else the URL; empty ones do not count."""
    given = F.lit(spec_base)
    return F.coalesce(*(F.when(c != "", c) for c in (given, final_url, url)))


def process(pages: DataFrame, nodes: DataFrame, features: dict[str, bool] | None = None, spec: dict | None = None,
            response_format: str = "html", spec_base: str | None = None) -> DataFrame:
    """One row for each page ``(page_id, url, html[, final_url])``: page_id, content, content_length,
    normalized, applied, extracted, extraction_error.

    ``features`` as from ``clean.resolve_features``; an empty page is neither cleaned nor extracted from.
    Cleaning resolves URLs against the final URL, extraction against the spec's base before it."""
    if response_format not in FORMATS:
        raise ValueError(f"response_format must be one of {FORMATS}")
    features = {f: True for f in FEATURES if (features or {}).get(f)}
    final = F.col("final_url") if "final_url" in pages.columns else F.lit(None).cast("string")
    bases = pages.select("page_id", base_url(None, final, F.col("url")).alias("base_url"))
    if features:
        nodes = materialize(as_parsed(clean_nodes(nodes, features, bases)), "cleaned")
    if response_format == "text":
        content = visible_text(nodes).select("page_id", F.col("text").alias("content"))
    elif features:
        content = rebuild_html(nodes).select("page_id", F.col("html").alias("content"))
    else:
        content = pages.select("page_id", F.col("html").alias("content"))
    done = extract(nodes, spec or {}, pages.select("page_id", base_url(spec_base, final, F.col("url")).alias("base_url")))
    applied = F.when(F.length("html") > 0, F.lit(",".join(sorted(features)))).otherwise("")
    return (pages.select("page_id", applied.alias("applied")).join(content, "page_id", "left").join(done, "page_id", "left")
            .select("page_id", F.coalesce("content", F.lit("")).alias("content"),
                    F.length(F.coalesce("content", F.lit(""))).cast("long").alias("content_length"),
                    (F.col("applied") != "").alias("normalized"), "applied", "extracted", "extraction_error"))
