"""Registered cleaning queries (O-H2..O-H16, O-H18) on the shredded page corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagecorpus.operators import clean as C
from pagecorpus.operators.nodes import visible_text
from pagecorpus.plans import sqlbits as S
from pagecorpus.plans.registry import register
from pagecorpus.sources import derived as D
from pagecorpus.sources.corpus import nodes_table
from pagecorpus.sources.tables import read_table

AGGRESSIVE = C.resolve_features("aggressive")
CONTENT = C.resolve_features("content")
_DROP = ["script", "style", "noscript", "template", "meta"] + C.MEDIA_TAGS

# Profile configurations (a dimension joined to the profiles seen in the fetch log).
PROFILE_CONFIGS = {
    "client_0": dict(enabled=False, preset=None),
    "client_1": dict(enabled=False, preset="light", minify=False),
    "client_2": dict(enabled=False, preset="content", absolute_urls=True),
    "client_3": dict(enabled=True, preset=None, remove_media=True),
}

ELEMENT_COUNTS_SQL = f"""
SELECT page_id, CAST(count(t) FILTER (WHERE t IS NOT NULL AND lower(t) NOT IN ({', '.join(repr(t) for t in _DROP)})) AS BIGINT) AS n_elements
FROM (SELECT page_id, unnest(CASE WHEN len(ts) = 0 THEN [NULL] ELSE ts END) AS t FROM (
  SELECT page_id, regexp_extract_all(
    regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
      '(?si)<(script|style|noscript|template)\\b[^>]*>.*?</(script|style|noscript|template)\\s*>', '', 'g'),
      '(?s)<!--.*?-->', '', 'g'),
    '<([a-zA-Z][^\\s/>]*)', 1) AS ts FROM pages))
GROUP BY page_id"""


@register("clean_element_counts", ELEMENT_COUNTS_SQL)
def q_clean_element_counts(spark, sf_dir):
    """O-H2..O-H10: elements left per page after the aggressive preset's subtree removals
    (scripts, styles, comments, meta, noscript, hidden, media) -- one flag, one pass."""
    nodes = nodes_table(spark, sf_dir)
    kept = C.clean_nodes(nodes, AGGRESSIVE)
    pages = nodes.filter(F.col("node_id") == 0).select("page_id")
    counts = kept.filter(F.col("kind") == "element").groupBy("page_id").agg(F.count(F.lit(1)).alias("n_elements"))
    return pages.join(counts, "page_id", "left").select("page_id", F.coalesce("n_elements", F.lit(0)).alias("n_elements"))


ABS_LINKS_SQL = S.with_views(["page_keys"], """
SELECT page_id, array_to_string(list_transform(hrefs, lambda h:
         CASE WHEN starts_with(h, '//') THEN scheme || ':' || h
              WHEN starts_with(h, '/') THEN scheme || '://' || netloc || h ELSE h END), ' ') AS links
FROM (SELECT page_id, scheme, netloc, regexp_extract_all(
        regexp_replace(html, '(?si)<(script|style)\\b[^>]*>.*?</(script|style)\\s*>', '', 'g'),
        '<a\\s[^>]*href="([^"]*)"', 1) AS hrefs
      FROM (""" + S.url_sql("SELECT page_id, url, html FROM pages", "url", keys=False) + """))
WHERE len(hrefs) > 0""")


@register("clean_absolute_links", ABS_LINKS_SQL)
def q_clean_absolute_links(spark, sf_dir):
    """O-H11 / O-U12 / O-U14: link targets after the absolute-URL rewrite, in document order,
    resolved against each page's URL."""
    nodes = nodes_table(spark, sf_dir)
    bases = read_table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("base_url"))
    feats = {f: False for f in C.FEATURES}
    feats["absolute_urls"] = True
    links = (C.clean_nodes(nodes.filter((F.col("tag") == "a") | (F.col("node_id") == 0)), feats, bases)
             .filter((F.col("tag") == "a") & F.map_contains_key("attrs", "href"))
             .select("page_id", "node_id", F.try_element_at("attrs", F.lit("href")).alias("href")))
    return links.groupBy("page_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("node_id", "href"))), lambda x: x["href"]), " ").alias("links"))


def _profile_features(spark):
    rows = []
    for prof, cfg in PROFILE_CONFIGS.items():
        cfg = dict(cfg)
        feats = C.resolve_features(cfg.pop("preset"), cfg.pop("enabled"), **cfg)
        rows += [(prof, f) for f, on in feats.items() if on]
    return spark.createDataFrame(rows, "profile string, feature string")


#: The twin's own statement of each configuration's features.
PROFILE_FEATURES_SQL = """pf(profile, feature) AS (
  SELECT 'client_1', unnest(['remove_comments', 'remove_noscript', 'collapse_whitespace', 'minify'])
  UNION ALL SELECT 'client_2', unnest(['remove_hidden', 'remove_scripts', 'remove_styles', 'remove_comments', 'remove_meta',
    'remove_noscript', 'remove_data_attrs', 'absolute_urls', 'collapse_whitespace', 'minify'])
  UNION ALL SELECT 'client_3', 'remove_media')"""


PRESET_SQL = S.with_views(["fetch_log"], """
SELECT p.profile, pf.feature, CAST(count(*) AS BIGINT) AS n_requests
FROM fetch_log p JOIN pf USING (profile) GROUP BY 1, 2""", PROFILE_FEATURES_SQL)


@register("preset_features", PRESET_SQL)
def q_preset_features(spark, sf_dir):
    """O-H14: features each caller's configuration resolves to (presets are additive), with
    the number of logged requests they applied to."""
    pf = F.broadcast(_profile_features(spark))  # one row per configured (profile, feature)
    f = D.fetch_log(spark, sf_dir).select("profile")
    return f.join(pf, "profile").groupBy("profile", "feature").agg(F.count(F.lit(1)).alias("n_requests"))


APPLIED_SQL = S.with_views(["fetch_log"], """
SELECT profile, CAST(count(*) AS BIGINT) AS n_requests, applied <> '' AS normalized, applied
FROM (SELECT f.profile, coalesce((SELECT string_agg(feature, ',' ORDER BY feature) FROM pf WHERE pf.profile = f.profile), '') AS applied
      FROM fetch_log f WHERE NOT f.failed)
GROUP BY profile, applied""", PROFILE_FEATURES_SQL)


@register("applied_features", APPLIED_SQL)
def q_applied_features(spark, sf_dir):
    """O-H15: the applied-feature list and ``normalized`` flag per successful request."""
    pf = _profile_features(spark).groupBy("profile").agg(
        F.array_join(F.array_sort(F.collect_list("feature")), ",").alias("applied"))
    f = D.fetch_log(spark, sf_dir).filter(~F.col("failed")).select("profile")
    j = f.join(F.broadcast(pf), "profile", "left").withColumn("applied", F.coalesce("applied", F.lit("")))
    return j.groupBy("profile", "applied").agg(F.count(F.lit(1)).alias("n_requests")) \
        .withColumn("normalized", F.col("applied") != "").select("profile", "n_requests", "normalized", "applied")


FORMAT_SQL = S.with_views(["jobs"], f"""
SELECT j.job_id, CASE WHEN j.job_id % 2 = 0 THEN 'text' ELSE 'html' END AS response_format,
       CAST(CASE WHEN j.job_id % 2 = 0 THEN length({S.page_text_sql('p.html')}) ELSE length(p.html) END AS BIGINT) AS content_length
FROM jobs j JOIN pages p ON p.page_id = j.job_id % (SELECT count(*) FROM pages)
WHERE j.status = 'succeeded'""")


@register("format_switch", FORMAT_SQL)
def q_format_switch(spark, sf_dir):
    """O-H18 / O-V6: v2 response content per succeeded job -- visible text for even job ids,
    raw html otherwise -- with the content length recomputed."""
    jb = D.jobs(spark, sf_dir).filter(F.col("status") == "succeeded").select("job_id")
    pages = read_table(spark, sf_dir, "pages")
    n = pages.select(F.count(F.lit(1))).scalar()
    text = visible_text(nodes_table(spark, sf_dir))
    per_page = pages.select("page_id", F.length("html").alias("html_len")).join(
        text.select("page_id", F.length("text").alias("text_len")), "page_id")
    j = jb.withColumn("page_id", F.col("job_id") % n).join(per_page, "page_id")
    even = F.col("job_id") % 2 == 0
    return j.select("job_id", F.when(even, F.lit("text")).otherwise(F.lit("html")).alias("response_format"),
                    F.when(even, F.col("text_len")).otherwise(F.col("html_len")).cast("long").alias("content_length"))


@register("clean_content", None)
def q_clean_content(spark, sf_dir):
    """O-H19 / O-H16 / O-H12 / O-H13: content preset applied to every page and the markup
    rebuilt from the cleaned nodes (length recomputed); rows-only check."""
    nodes = nodes_table(spark, sf_dir)
    html = C.rebuild_html(C.clean_nodes(nodes, CONTENT))
    return html.select("page_id", F.length("html").alias("content_length"), "html")


LIGHT = C.resolve_features("light")

MINIFIED_SQL = f"""
SELECT page_id, CAST(len(list_filter(regexp_split_to_array(h, '<[^>]*>'),
                                     lambda pc: regexp_matches(pc, '[^{S.WS[1:-1]}]'))) AS BIGINT) AS n_text_nodes
FROM (SELECT page_id,
        regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '<c>', 'g'),
                       '(?si)<(script|style)\\b([^>]*)>(.+?)</(script|style)\\s*>', '<\\1\\2>x</\\4>', 'g') AS h
      FROM pages)"""


@register("clean_minified_text_nodes", MINIFIED_SQL)
def q_clean_minified_text_nodes(spark, sf_dir):
    """O-H12 / O-H13: text nodes left per page after the light preset -- comments removed,
    whitespace collapsed, blank strings dropped by minify (script / style text preserved)."""
    nodes = nodes_table(spark, sf_dir)
    kept = C.clean_nodes(nodes, LIGHT).filter(F.col("kind").isin("text", "ctext"))
    pages = nodes.filter(F.col("node_id") == 0).select("page_id")
    counts = kept.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_text_nodes"))
    return pages.join(counts, "page_id", "left").select(
        "page_id", F.coalesce("n_text_nodes", F.lit(0)).cast("long").alias("n_text_nodes"))
