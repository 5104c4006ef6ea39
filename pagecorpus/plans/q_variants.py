"""Registered queries over page variants: the pages with markup that the crawl lacks (hidden elements, media,
``data-*`` and style attributes, ``srcset``, markers of block and challenge pages, short bodies, more links),
so that every cleaning, labelling and extraction rule meets rows that it changes.

A variant is its page with one fixed piece put in by the page's number; the twin puts in the same piece.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from pagecorpus.operators import clean as C
from pagecorpus.operators import label as L
from pagecorpus.operators.extract import extract
from pagecorpus.operators.process import base_url
from pagecorpus.plans import sqlbits as S
from pagecorpus.plans.q_safety import _marker_sql
from pagecorpus.plans.registry import register
from pagecorpus.sources import derived as D
from pagecorpus.sources.corpus import nodes_table
from pagecorpus.sources.tables import read_table

#: Pieces by page number modulo their count, put in after the body tag: markup, the elements of it that the
#: aggressive preset keeps, and those of them that carry an attribute.
PIECES = [
    ('<div hidden><p>h</p></div><u>keep</u>', 1),
    ('<div aria-hidden="TRUE"><i>h</i></div><section><u>a</u><u>b</u></section>', 3),
    ('<p style="color:red; Display : none">h</p><p style="color:red" data-x="1" data-y="2">keep</p>', 1),
    ('<p style="visibility:hidden"><b>h</b></p><input type="HIDDEN" value="1"><input type="text" value="2">', 1),
    ('<template><u>t</u></template><noscript><u>n</u></noscript>', 0),
    ('<picture><source srcset="p.png 2x"><img src="a.png"></picture><video poster="v.png"><source src="v.mp4"></video><u>keep</u>', 1),
    ('<svg><u>s</u></svg><canvas></canvas><iframe src="f.html"></iframe><object><embed src="e"></object><audio></audio>', 0),
    ('<meta name="x" content="y"><pre>  two   spaces  </pre><code> c </code><em> a   b </em>', 3),
]
#: Sources, and what they are for a page whose URL has the root {r} and the folder {d}.
SRCSET = '<img srcset="a.png 1x, /b.png 2x,,   //c.example/c.png, ?q=1 640w" src="d.png"><a href="?n=2">n</a>'


def _pieces_column():
    n = F.col("page_id") % len(PIECES)
    return reduce(lambda acc, i: acc.when(n == i, F.lit(PIECES[i][0])), range(1, len(PIECES)), F.when(n == 0, F.lit(PIECES[0][0])))


def _with_piece(pages, piece):
    return pages.select("page_id", "url", F.replace(F.col("html"), F.lit("<body>"), F.concat(F.lit("<body>"), piece)).alias("html"))


def _variant_nodes(spark, sf_dir, key, piece):
    return nodes_table(spark, sf_dir, _with_piece(read_table(spark, sf_dir, "pages"), piece), key)


_DROP = "'" + "', '".join(["script", "style", "noscript", "template", "meta"] + C.MEDIA_TAGS) + "'"
_BARE = """regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
      '(?si)<(script|style|noscript|template)\\b[^>]*>.*?</(script|style|noscript|template)\\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g')"""
VARIANT_COUNTS_SQL = f"""
SELECT page_id, CAST(len(list_filter(regexp_extract_all({_BARE}, '<([a-zA-Z][^\\s/>]*)', 1), lambda t: lower(t) NOT IN ({_DROP}))) + kept AS BIGINT) AS n_elements,
       CAST(0 AS BIGINT) AS n_data_attrs, CAST(0 AS BIGINT) AS n_style_attrs, CAST(0 AS BIGINT) AS n_comments,
       CAST(CASE WHEN page_id % {len(PIECES)} = 7 THEN 1 ELSE 0 END AS BIGINT) AS n_pre,
       CASE WHEN page_id % {len(PIECES)} = 7 THEN '  two   spaces  | c |a b' END AS spaced
FROM (SELECT *, [{', '.join(str(k) for _, k in PIECES)}][page_id % {len(PIECES)} + 1] AS kept FROM pages)"""


@register("variant_clean_counts", VARIANT_COUNTS_SQL)
def q_variant_clean_counts(spark, sf_dir):
    """O-H4..O-H10, O-H12: what the aggressive preset leaves of pages with hidden elements, media, style and
    ``data-*`` attributes, comments and preserved white space."""
    kept = C.clean_nodes(_variant_nodes(spark, sf_dir, "pieces", _pieces_column()), C.resolve_features("aggressive"))
    el = F.col("kind") == "element"
    own = F.map_keys("attrs")
    texts = C.with_parent_tag(kept)
    spaced = texts.filter(F.col("parent_tag").isin("pre", "code", "em")).groupBy("page_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "text"))), lambda x: x["text"]), "|").alias("spaced"))
    counts = kept.groupBy("page_id").agg(
        F.count(F.when(el, 1)).alias("n_elements"),
        F.count(F.when(el & F.exists(own, lambda k: F.startswith(k, F.lit("data-"))), 1)).alias("n_data_attrs"),
        F.count(F.when(el & F.array_contains(own, "style"), 1)).alias("n_style_attrs"),
        F.count(F.when(F.col("kind") == "comment", 1)).alias("n_comments"), F.count(F.when(F.col("tag") == "pre", 1)).alias("n_pre"))
    return counts.join(spaced, "page_id", "left").select("page_id", "n_elements", "n_data_attrs", "n_style_attrs", "n_comments", "n_pre", "spaced")


SRCSET_SQL = """
SELECT page_id, d || 'a.png 1x, ' || r || '/b.png 2x, ' || scheme || '://c.example/c.png, ' || f || '?q=1 640w' AS srcset,
       d || 'd.png' AS src, f || '?n=2' AS href
FROM (SELECT page_id, scheme, scheme || '://' || netloc AS r,
             scheme || '://' || netloc || CASE WHEN path = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END AS d,
             scheme || '://' || netloc || path || CASE WHEN params <> '' THEN ';' || params ELSE '' END AS f
      FROM (""" + S.url_sql("SELECT page_id, url FROM pages", "url", keys=False) + "))"


@register("variant_srcset", SRCSET_SQL)
def q_variant_srcset(spark, sf_dir):
    """O-U12 / O-U13 / O-U14 / O-H11: ``srcset`` entries, sources and links of several relative forms, made
    absolute against each page's base URL."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    bases = pages.select("page_id", base_url(None, F.lit(""), F.col("url")).alias("base_url"))
    nodes = _variant_nodes(spark, sf_dir, "srcset", F.lit(SRCSET))
    out = C.edit_attributes(nodes, {"absolute_urls": True}, bases)
    first = lambda tag, attr: F.min_by(F.try_element_at("attrs", F.lit(attr)), F.when(
        (F.col("tag") == tag) & F.map_contains_key("attrs", attr), F.col("node_id")))
    return out.groupBy("page_id").agg(first("img", "srcset").alias("srcset"), first("img", "src").alias("src"), first("a", "href").alias("href"))


#: Markers by page number: pieces and titles, and every seventeenth page is cut to a short body.
MARKS = ["captcha", "Unusual  Traffic", "unusual traffic", "cf-browser-verification", "CHALLENGE-platform", "please complete the security check",
         "just a moment", "Checking your browser", "attention required", "nothing"]
SHORT = 17


def _marked(pages):
    n = F.col("page_id") % len(MARKS)
    mark = F.try_element_at(F.array(*(F.lit(m) for m in MARKS)), (n + 1).cast("int"))
    long = F.when(F.col("page_id") % 3 == 0, F.replace(F.col("html"), F.lit("<title>"), F.concat(F.lit("<title>"), mark, F.lit(" ")))) \
        .otherwise(F.replace(F.col("html"), F.lit("<body>"), F.concat(F.lit("<body><p>"), mark, F.lit("</p>"))))
    return pages.select("page_id", F.when(F.col("page_id") % SHORT == 0, F.concat(F.lit("  <p>"), mark, F.lit("</p>  "))).otherwise(long).alias("html"))


_MARKED_SQL = f"""marked AS (
  SELECT page_id, CASE WHEN page_id % {SHORT} = 0 THEN '  <p>' || mark || '</p>  '
                       WHEN page_id % 3 = 0 THEN replace(html, '<title>', '<title>' || mark || ' ')
                       ELSE replace(html, '<body>', '<body><p>' || mark || '</p>') END AS html
  FROM (SELECT *, [{', '.join(f"'{m}'" for m in MARKS)}][page_id % {len(MARKS)} + 1] AS mark FROM pages))"""
VARIANT_LABEL_SQL = S.with_views(["fetch_log"], f"""
SELECT f.request_id, CASE WHEN f.status_code IN (403, 429, 503, 444) THEN 'status' WHEN length({S.py_strip('p.html')}) < 500 THEN 'too_short'
       WHEN {_marker_sql('lower(p.html)', L.BLOCK_MARKERS)} IS NOT NULL THEN 'marker:' || {_marker_sql('lower(p.html)', L.BLOCK_MARKERS)} END AS rule
FROM fetch_log f JOIN marked p USING (page_id)""", _MARKED_SQL)


@register("variant_block_labels", VARIANT_LABEL_SQL)
def q_variant_block_labels(spark, sf_dir):
    """O-L1: block rules over pages with markers and short bodies."""
    rules = _marked(read_table(spark, sf_dir, "pages")).select("page_id", L.page_block_rule(F.col("html")).alias("page_rule"))
    j = D.fetch_log(spark, sf_dir).join(rules, "page_id")
    return j.select("request_id", L.block_rule(F.col("status_code"), F.col("page_rule")).alias("rule"))


VARIANT_CHALLENGE_SQL = f"""WITH {_MARKED_SQL}
SELECT page_id, coalesce({_marker_sql("lower(coalesce(t, ''))", L.CHALLENGE_MARKERS)}, {_marker_sql('lower(html)', L.CHALLENGE_MARKERS)}) AS challenge_marker
FROM (SELECT page_id, html, regexp_extract(html, '(?si)<title\\b[^>]*>(.*?)</title', 1) AS t FROM marked)"""


@register("variant_challenge_labels", VARIANT_CHALLENGE_SQL)
def q_variant_challenge_labels(spark, sf_dir):
    """O-L2: challenge markers in titles and bodies."""
    pages = _marked(read_table(spark, sf_dir, "pages"))
    title = extract(nodes_table(spark, sf_dir, pages, "marked"), {"title": {"selector": "title"}}).select("page_id", "extracted.title")
    return pages.join(title, "page_id", "left").select("page_id", L.challenge_label(F.col("title"), F.col("html")).alias("challenge_marker"))


REQUIRED = {"title": {"selector": "title"}, "seventh": {"selector": "nav li:nth-child(7) a", "required": True}, "note": {"selector": "p.note", "default": "-"}}
MORE = '<li><a href="/more">more</a></li><li><a href="/most">most</a></li><li><a href="/all">all</a></li>'
_SEVENTH = "(page_id % 4 <> 0 AND n + 3 >= 7)"
VARIANT_REQUIRED_SQL = f"""
SELECT page_id, CASE WHEN {_SEVENTH} THEN labels[7 - 3] END AS seventh, CASE WHEN {_SEVENTH} THEN '-' END AS note,
       CASE WHEN NOT {_SEVENTH} THEN 'seventh' END AS error_field
FROM (SELECT page_id, labels, len(labels) AS n FROM (
  SELECT page_id, list_transform(regexp_extract_all(regexp_extract(html, '(?si)<nav\\b.*?</nav', 0), '<li><a href="[^"]*">([^<]*)</a></li>', 1),
                                 lambda x: {S.py_strip(S.unescape('x'))}) AS labels FROM pages))"""


def _required(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages")
    more = pages.select("page_id", "url", F.when(F.col("page_id") % 4 != 0, F.replace(F.col("html"), F.lit("<nav><ul>"), F.lit("<nav><ul>" + MORE)))
                        .otherwise(F.col("html")).alias("html"))
    return extract(nodes_table(spark, sf_dir, more, "more"), REQUIRED)


@register("variant_required", VARIANT_REQUIRED_SQL)
def q_variant_required(spark, sf_dir):
    """O-X11: a required field that most pages fill and some lack."""
    return _required(spark, sf_dir).select("page_id", "extracted.seventh", "extracted.note", F.col("extraction_error.field").alias("error_field"))


@register("variant_rates", f"""SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(seventh) AS BIGINT) AS n_filled, CAST(count(error_field) AS BIGINT) AS n_failed,
       avg(CASE WHEN seventh IS NOT NULL THEN 1.0 ELSE 0.0 END) AS fill_rate FROM ({VARIANT_REQUIRED_SQL})""")
def q_variant_rates(spark, sf_dir):
    """O-X15: fill and error rates where both occur."""
    r = _required(spark, sf_dir).select("extracted.seventh", "extraction_error")
    filled = F.col("seventh").isNotNull()
    return r.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(filled, 1)).alias("n_filled"),
                 F.count(F.when(F.col("extraction_error").isNotNull(), 1)).alias("n_failed"), F.avg(filled.cast("double")).alias("fill_rate"))
