"""Corpus cleaning on the node table (O-H2..O-H16, O-H18).

Removals are unions of subtrees, so the reference's fixed sequence of tree walks collapses
into one combined flag and one removal pass (:func:`remove_subtrees`).  Attribute edits
are map functions on the surviving elements; the two whitespace steps are expressions on
string nodes that look at the *direct* parent's tag only.  :func:`rebuild_html` serialises
the node table back to markup with one ordered aggregate per page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagecorpus.functions import urls
from pagecorpus.functions.text import WS, collapse_ws, py_strip
from pagecorpus.operators.nodes import remove_subtrees
from pagecorpus.sources.shred import VOID_ELEMENTS

# Features a preset switches on (presets are additive to explicit flags).
PRESETS = {
    "light": ["remove_comments", "remove_noscript", "collapse_whitespace", "minify"],
    "content": ["remove_scripts", "remove_styles", "remove_comments", "remove_meta", "remove_noscript",
                "remove_hidden", "remove_data_attrs", "collapse_whitespace", "minify"],
    "aggressive": ["remove_scripts", "remove_styles", "remove_comments", "remove_meta", "remove_noscript",
                   "remove_hidden", "remove_media", "remove_data_attrs", "collapse_whitespace", "minify"],
}
# The features in the order they are reported.
FEATURES = ["remove_hidden", "remove_scripts", "remove_styles", "remove_comments", "remove_meta",
            "remove_noscript", "remove_media", "remove_data_attrs", "absolute_urls",
            "collapse_whitespace", "minify"]
# Media and embedded-content tags.
MEDIA_TAGS = ["audio", "canvas", "embed", "iframe", "img", "object", "picture", "source", "svg", "video"]
# Tags whose direct text is left alone by the whitespace steps.
PRESERVE_TAGS = ["pre", "code", "textarea", "script", "style"]
# Attributes that carry URLs.
URL_ATTRS = ["href", "src", "action", "poster"]
# Fixed value: styles that hide an element.
HIDDEN_STYLE = f"(?i)(display{WS}*:{WS}*none|visibility{WS}*:{WS}*hidden)"
STRING_KINDS = ["text", "ctext", "doctype", "cdata", "pi", "decl"]


def resolve_features(preset: str | None = None, enabled: bool = False, **flags: bool) -> dict[str, bool]:
    """O-H14 for one configuration: presets add features, explicit ``False`` cannot remove
    a preset feature; nothing applies unless enabled or a known preset is given."""
    preset_set = set(PRESETS.get(preset or "", []))
    if not enabled and not preset_set:
        return {}
    return {f: bool(flags.get(f, False)) or f in preset_set for f in FEATURES}


def _attr(name: str) -> Column:
    return F.try_element_at(F.col("attrs"), F.lit(name))


def removal_flag(features: dict[str, bool]) -> Column:
    """The combined subtree-removal predicate (hidden is read on the original attributes)."""
    el = F.col("kind") == "element"
    tag = F.col("tag")
    terms = []
    if features.get("remove_hidden"):
        aria = _attr("aria-hidden")
        hidden = ((tag == "template")
                  | F.map_contains_key(F.col("attrs"), "hidden")
                  | F.coalesce(F.lower(aria) == "true", F.lit(False))
                  | F.coalesce(_attr("style").rlike(HIDDEN_STYLE), F.lit(False))
                  | ((tag == "input") & F.coalesce(F.lower(_attr("type")) == "hidden", F.lit(False))))
        terms.append(el & hidden)
    for feat, tags in (("remove_scripts", ["script"]), ("remove_styles", ["style"]),
                       ("remove_meta", ["meta"]), ("remove_noscript", ["noscript"]),
                       ("remove_media", MEDIA_TAGS)):
        if features.get(feat):
            terms.append(el & tag.isin(tags))
    if features.get("remove_comments"):
        terms.append(F.col("kind") == "comment")
    flag = F.lit(False)
    for t in terms:
        flag = flag | t
    return flag


def _absolutize(out: DataFrame) -> DataFrame:
    """O-H11 / O-U13: ``href src action poster`` and every ``srcset`` entry resolved against
    ``_base`` (non-empty values only).  Each URL attribute is lifted to a column, joined with
    the staged URL expressions, and written back with ``transform_values``; ``srcset``
    entries are exploded, resolved and re-joined in entry order per element."""
    el = F.col("kind") == "element"
    # one row per non-empty URL attribute, one staged URL join over just those rows
    kv = (out.filter(el).select("page_id", "node_id", "_base", F.explode(F.map_filter(
        "attrs", lambda k, v: k.isin(URL_ATTRS) & (v != ""))).alias("_k", "_v")))
    kv = urls.add_joined_url(kv, "_base", "_v", "_abs")
    resolved = kv.groupBy("page_id", "node_id").agg(
        F.map_from_entries(F.collect_list(F.struct("_k", "_abs"))).alias("_absmap"))
    out = out.join(resolved, ["page_id", "node_id"], "left")
    out = out.withColumn("attrs", F.when(F.col("_absmap").isNotNull(), F.transform_values(
        "attrs", lambda k, v: F.coalesce(F.try_element_at(F.col("_absmap"), k), v))).otherwise(F.col("attrs"))) \
        .drop("_absmap")
    srcset = F.try_element_at(F.col("attrs"), F.lit("srcset"))
    has = out.filter(el & F.coalesce(srcset != "", F.lit(False)))
    ws_free = f"[^{WS[1:-1]}]"
    entries = (has.select("page_id", "node_id", "_base", F.posexplode(F.split(srcset, ",")).alias("i", "e"))
               .withColumn("e", py_strip(F.col("e"))).filter(F.col("e") != "")
               .withColumn("_u", F.regexp_extract("e", f"^({ws_free}+)", 1))
               .withColumn("_d", F.regexp_extract("e", f"^{ws_free}+{WS}+(.*)$", 1)))
    entries = urls.add_joined_url(entries, "_base", "_u", "_abs")
    entries = entries.withColumn("_piece", F.concat(
        "_abs", F.when(F.col("_d") != "", F.concat(F.lit(" "), F.col("_d"))).otherwise(F.lit(""))))
    rebuilt = entries.groupBy("page_id", "node_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("i", "_piece"))), lambda x: x["_piece"]), ", ").alias("_srcset"))
    out = out.join(rebuilt, ["page_id", "node_id"], "left")
    return out.withColumn("attrs", F.when(F.col("_srcset").isNotNull(), F.transform_values(
        "attrs", lambda k, v: F.when(k == "srcset", F.col("_srcset")).otherwise(v))).otherwise(F.col("attrs"))) \
        .drop("_srcset")


def edit_attributes(nodes: DataFrame, features: dict[str, bool], bases: DataFrame | None = None) -> DataFrame:
    """O-H4 (style attribute), O-H8 (data-*), O-H11 (absolute URLs incl. srcset)."""
    out = nodes
    if features.get("remove_styles"):
        out = out.withColumn("attrs", F.when(F.col("kind") == "element",
                                             F.map_filter("attrs", lambda k, v: k != "style")))
    if features.get("remove_data_attrs"):
        out = out.withColumn("attrs", F.when(F.col("kind") == "element",
                                             F.map_filter("attrs", lambda k, v: ~F.startswith(k, F.lit("data-")))))
    if features.get("absolute_urls"):
        if bases is None:
            raise ValueError("absolute_urls needs a (page_id, base_url) table")
        out = out.join(bases.select("page_id", F.col("base_url").alias("_base")), "page_id", "left")
        out = _absolutize(out).drop("_base")
    return out


def with_parent_tag(nodes: DataFrame) -> DataFrame:
    """Adds ``parent_tag`` (equi-join of each node to its parent row)."""
    parents = nodes.select("page_id", F.col("node_id").alias("parent_id"), F.col("tag").alias("parent_tag"))
    return nodes.join(parents, ["page_id", "parent_id"], "left")


def edit_text(nodes: DataFrame, features: dict[str, bool]) -> DataFrame:
    """O-H12 collapse and O-H13 minify (drop blank strings, strip the rest); comments and
    strings directly under pre / code / textarea / script / style are left alone."""
    if not (features.get("collapse_whitespace") or features.get("minify")):
        return nodes
    n = with_parent_tag(nodes)
    editable = F.col("kind").isin(STRING_KINDS) & ~F.coalesce(F.col("parent_tag").isin(PRESERVE_TAGS), F.lit(False))
    if features.get("collapse_whitespace"):
        n = n.withColumn("text", F.when(editable, collapse_ws(F.col("text"))).otherwise(F.col("text")))
    if features.get("minify"):
        n = n.withColumn("text", F.when(editable, py_strip(F.col("text"))).otherwise(F.col("text")))
        n = n.filter(~(editable & (F.col("text") == "")))
    return n.drop("parent_tag")


def clean_nodes(nodes: DataFrame, features: dict[str, bool], bases: DataFrame | None = None) -> DataFrame:
    """O-H19 (cleaning part): removals, attribute edits, text edits -- in that order."""
    if not features:
        return nodes
    removes = any(features.get(f) for f in ("remove_hidden", "remove_scripts", "remove_styles", "remove_meta",
                                             "remove_noscript", "remove_media", "remove_comments"))
    out = remove_subtrees(nodes, removal_flag(features)) if removes else nodes
    out = edit_attributes(out, features, bases)
    return edit_text(out, features)


def _escape_text(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


def _attr_text(k: Column, v: Column) -> Column:
    esc = _escape_text(v)
    has_dq = F.contains(v, F.lit('"'))
    has_sq = F.contains(v, F.lit("'"))
    quoted = (F.when(has_dq & has_sq, F.concat(F.lit('"'), F.replace(esc, F.lit('"'), F.lit("&quot;")), F.lit('"')))
              .when(has_dq, F.concat(F.lit("'"), esc, F.lit("'")))
              .otherwise(F.concat(F.lit('"'), esc, F.lit('"'))))
    return F.concat(F.lit(" "), k, F.lit("="), quoted)


def rebuild_html(nodes: DataFrame, root_col: str | None = None) -> DataFrame:
    """O-H16: serialise nodes back to markup per page (``page_id, html``).

    Every node yields an opening piece at ``(node_id, 0)`` and elements a closing piece at
    ``(last_desc, 1, -depth)``, so closings follow the subtree inner-first; one sorted
    ``collect_list`` per page joins them.  Rows of several subtrees (``root_col``) bring their
    ``parent_tag`` along.  Void elements print as ``<br/>``; text is
    escaped except directly inside script / style."""
    n = (nodes if "parent_tag" in nodes.columns else with_parent_tag(nodes)).filter(F.col("kind") != "document")
    attrs_txt = F.array_join(F.transform(F.map_entries("attrs"), lambda e: _attr_text(e["key"], e["value"])), "")
    is_void = F.col("tag").isin(list(VOID_ELEMENTS))
    raw_parent = F.coalesce(F.col("parent_tag").isin("script", "style"), F.lit(False))
    kind = F.col("kind")
    open_piece = (F.when(kind == "element", F.concat(F.lit("<"), F.col("tag"), attrs_txt,
                                                    F.when(is_void, F.lit("/>")).otherwise(F.lit(">"))))
                  .when(kind.isin("text", "ctext"), F.when(raw_parent, F.col("text")).otherwise(_escape_text(F.col("text"))))
                  .when(kind == "comment", F.concat(F.lit("<!--"), F.col("text"), F.lit("-->")))
                  .when(kind == "doctype", F.concat(F.lit("<!DOCTYPE "), F.col("text"), F.lit(">")))
                  .when(kind == "cdata", F.concat(F.lit("<![CDATA["), F.col("text"), F.lit("]]>")))
                  .when(kind == "pi", F.concat(F.lit("<?"), F.col("text"), F.lit(">")))
                  .otherwise(F.concat(F.lit("<!"), F.col("text"), F.lit(">"))))
    close_piece = F.when((kind == "element") & ~is_void, F.concat(F.lit("</"), F.col("tag"), F.lit(">")))
    pieces = F.array(
        F.struct(F.col("node_id").alias("p"), F.lit(0).alias("ph"), F.lit(0).alias("d"), open_piece.alias("s")),
        F.struct(F.col("last_desc").alias("p"), F.lit(1).alias("ph"), (-F.col("depth")).alias("d"), close_piece.alias("s")))
    keys = ["page_id"] + ([root_col] if root_col else [])
    exploded = n.select(*keys, F.inline(pieces)).filter(F.col("s").isNotNull())
    return exploded.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "ph", "d", "s"))), lambda x: x["s"]), "")
        .alias("html"))
