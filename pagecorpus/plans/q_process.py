"""Registered queries of the whole pipeline (O-H18, O-H19, O-J10): clean, extract, format."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagecorpus.operators.clean import resolve_features
from pagecorpus.operators.process import process
from pagecorpus.plans import sqlbits as S
from pagecorpus.plans.q_clean import PROFILE_CONFIGS
from pagecorpus.plans.registry import register
from pagecorpus.sources import derived as D
from pagecorpus.sources.corpus import nodes_table
from pagecorpus.sources.tables import read_table

#: What each job asks for: a required link, a list with a default, two texts.
JOB_SPEC = {
    "title": {"selector": "title"},
    "fifth": {"selector": "nav li:nth-child(5) a", "type": "attr", "attribute": "href", "absolute_url": True, "required": True},
    "scripts": {"selector": "script", "multiple": True, "default": ["none"]},
    "lead": {"selector": "article h1"},
}


def _page_results(spark, sf_dir, profile: str, response_format: str) -> DataFrame:
    """What a job of ``profile`` gets from each page; contents as lengths and digests, so that they do
    not travel once for each job."""
    cfg = dict(PROFILE_CONFIGS[profile])
    features = resolve_features(cfg.pop("preset"), cfg.pop("enabled"), **cfg)
    r = process(read_table(spark, sf_dir, "pages"), nodes_table(spark, sf_dir), features, JOB_SPEC, response_format)
    return r.select(
        "page_id", F.lit(profile).alias("profile_name"), F.lit(response_format).alias("response_format"), "normalized", "content_length",
        F.sha2("content", 256).alias("content_sha256"), "extracted.title", "extracted.fifth",
        F.array_join("extracted.scripts", "|").alias("scripts"), "extracted.lead",
        F.col("extraction_error.field").alias("error_field"), F.col("extraction_error.message").alias("error_message"))


_TXT = lambda e: S.py_strip(S.unescape(e))
_H = "regexp_replace(html, '(?si)<(script|style)\\b[^>]*>.*?</(script|style)\\s*>', ' ', 'g')"
_LINK = "regexp_extract_all(regexp_extract(html, '(?si)<nav\\b.*?</nav', 0), '<li><a href=\"([^\"]*)\">', 1)[5]"
_SCRIPTS = ("array_to_string(list_transform(regexp_extract_all(html, '(?si)<script\\b[^>]*>(.*?)</script', 1), "
            f"lambda x: {S.py_strip('x')}), '|')")
# two configurations collapse white space, so a line break inside a string is a space to them
_COLLAPSED = f"regexp_replace(html, '{S.WS}+', ' ', 'g')"
JOB_CONTENT_SQL = S.with_views(["jobs"], f"""
SELECT job_id, response_format, normalized, CAST(length(content) AS BIGINT) AS content_length, sha256(content) AS content_sha256,
       CASE WHEN link IS NOT NULL THEN title END AS title,
       CASE WHEN starts_with(link, '//') THEN scheme || ':' || link WHEN starts_with(link, '/') THEN scheme || '://' || netloc || link ELSE link END AS fifth,
       CASE WHEN link IS NULL THEN NULL WHEN profile_name = 'client_2' THEN 'none' ELSE scripts END AS scripts,
       CASE WHEN link IS NOT NULL THEN lead END AS lead,
       CASE WHEN status = 'failed' THEN 'http_error' WHEN link IS NULL THEN 'extraction_error' END AS error_type,
       CASE WHEN status = 'succeeded' AND link IS NULL THEN 'fifth' END AS error_field,
       CASE WHEN status = 'failed' THEN 'Fetch of ' || url || ' failed'
            WHEN link IS NULL THEN 'No element matched CSS selector ''nav li:nth-child(5) a''' END AS error_message
FROM (SELECT j.job_id, j.status, j.profile_name, p.url,
             CASE WHEN j.status = 'succeeded' THEN CASE WHEN j.profile_name = 'client_0' THEN 'html' ELSE 'text' END END AS response_format,
             CASE WHEN j.status = 'succeeded' THEN j.profile_name <> 'client_0' END AS normalized,
             CASE WHEN j.status = 'succeeded' THEN CASE WHEN j.profile_name = 'client_0' THEN p.html WHEN j.profile_name = 'client_3' THEN p.text ELSE p.collapsed END END AS content,
             CASE WHEN j.status = 'succeeded' THEN p.link END AS link, p.title, p.scripts, p.lead, p.scheme, p.netloc
      FROM jobs j JOIN (
        SELECT page_id, url, html, scheme, netloc, {S.page_text_sql('html')} AS text, {S.page_text_sql(_COLLAPSED)} AS collapsed,
               {_TXT("regexp_extract(" + _H + ", '(?si)<title\\b[^>]*>(.*?)</title', 1)")} AS title,
               {_TXT("regexp_replace(regexp_extract(" + _H + ", '(?si)<article\\b.*?<h1\\b[^>]*>(.*?)</h1', 1), '<[^>]*>', '', 'g')")} AS lead,
               {_LINK} AS link, {_SCRIPTS} AS scripts
        FROM ({S.url_sql("SELECT page_id, url, html FROM pages", "url", keys=False)})) p
      ON p.page_id = j.job_id % (SELECT count(*) FROM pages)
      WHERE j.status IN ('succeeded', 'failed'))""")


@register("job_contents", JOB_CONTENT_SQL)
def q_job_contents(spark, sf_dir):
    """O-J10 / O-H19 / O-H18: what each finished job returns -- its page cleaned by its profile's
    configuration, fields extracted from the cleaned page, content in its format -- or its error."""
    pages = read_table(spark, sf_dir, "pages")
    n = pages.select(F.count(F.lit(1))).scalar()
    jb = (D.jobs(spark, sf_dir).filter(F.col("status").isin("succeeded", "failed"))
          .select("job_id", "status", "profile_name", (F.col("job_id") % n).alias("page_id")))
    results = reduce(DataFrame.unionByName, (_page_results(spark, sf_dir, p, "html" if p == "client_0" else "text") for p in PROFILE_CONFIGS))
    ok = F.col("status") == "succeeded"
    j = jb.join(results, ["page_id", "profile_name"], "left").join(pages.select("page_id", "url"), "page_id")
    shown = ["response_format", "normalized", "content_length", "content_sha256", "title", "fifth", "scripts", "lead", "error_field"]
    return j.select(
        "job_id", *(F.when(ok, F.col(c)).alias(c) for c in shown),
        F.when(~ok, F.lit("http_error")).when(F.col("error_field").isNotNull(), F.lit("extraction_error")).alias("error_type"),
        F.when(~ok, F.concat(F.lit("Fetch of "), F.col("url"), F.lit(" failed"))).otherwise(F.col("error_message")).alias("error_message"))
