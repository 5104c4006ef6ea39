"""Structured extraction (O-X1..O-X15): a declarative field spec compiled to a DataFrame plan.

A spec is ``{name: field}`` with ``field`` keys ``selector, type (text|html|attr|object),
attribute, multiple, default, required, absolute_url, fields`` (``fields`` recursive for
objects).  Spark has no recursive types, so the spec is compiled on the driver into one
plan whose result type follows the spec: string, ``array<string>``, ``struct`` or
``array<struct>``.

All selectors become boolean columns of the node table (:mod:`select`), and the nodes of a page one
array indexed by node id, all behind one exchange by page.  Every field is evaluated per *scope*: the
document at the top, a matched element of an object field below it.  A scope is a slice of the array,
since a subtree is an interval of ids; so is the text of an element.  Of the matches inside the scope
the first one or the document-ordered list is kept.  Then:

* no match -> ``default`` (null for multiple too), or a failure when ``required``;
* a matched element lacking the attribute -> null, not the default;
* one failed required field (in spec order, document order for object lists) nulls the
  page's whole ``extracted`` and fills ``extraction_error{field, message}``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagecorpus.functions.text import py_strip
from pagecorpus.operators.clean import rebuild_html, with_parent_tag
from pagecorpus.operators.select import match_columns, parse_selector
from pagecorpus.operators.values import absolutize, attr_value
from pagecorpus.sources.shred import STRING_CONTAINERS

FIELD_TYPES = ("text", "html", "attr", "object")


class SpecError(ValueError):
    pass


@dataclass
class Field:
    name: str
    selector: str
    type: str = "text"
    attribute: str | None = None
    multiple: bool = False
    default: object = None
    required: bool = False
    absolute_url: bool = False
    fields: list["Field"] = field(default_factory=list)
    no: int = -1

    def spark_type(self) -> T.DataType:
        if self.type == "object":
            base: T.DataType = T.StructType([T.StructField(f.name, f.spark_type(), True) for f in self.fields])
        else:
            base = T.StringType()
        return T.ArrayType(base, True) if self.multiple else base


def compile_spec(spec: dict) -> list[Field]:
    """Validate a spec (selector grammar, types, defaults castable to the field type)."""
    out = []
    for name, cfg in spec.items():
        ftype = cfg.get("type", "text")
        if ftype not in FIELD_TYPES:
            # an unknown type yields the element's outer HTML (kept as 'outer')
            ftype = "outer"
        parse_selector(cfg["selector"])
        f = Field(name=name, selector=cfg["selector"], type=ftype, attribute=cfg.get("attribute"),
                  multiple=bool(cfg.get("multiple", False)), default=cfg.get("default"),
                  required=bool(cfg.get("required", False)), absolute_url=bool(cfg.get("absolute_url", False)),
                  fields=compile_spec(cfg.get("fields") or {}) if ftype == "object" else [])
        if f.default is not None:
            if f.type == "object":
                raise SpecError(f"field {name}: object defaults are not supported")
            if f.multiple and not (isinstance(f.default, list) and all(isinstance(x, str) for x in f.default)):
                raise SpecError(f"field {name}: default must be a list of strings")
            if not f.multiple and not isinstance(f.default, str):
                raise SpecError(f"field {name}: default must be a string")
        out.append(f)
    return out


def _default_col(f: Field) -> Column:
    if f.default is None:
        return F.lit(None).cast(f.spark_type())
    if f.multiple:
        return F.array(*[F.lit(x) for x in f.default]).cast(f.spark_type())
    return F.lit(f.default)


def subtree_html(nodes: DataFrame, matches: DataFrame, inner: bool = True) -> DataFrame:
    """O-X3 (inner) / O-X14 (outer) markup of each match ``(page_id, node_id, last_desc)``:
    ``(page_id, node_id, html)``; an element without content has no row in the inner form.

    A match is spread to the ids of its interval, so as many rows are made as are printed."""
    first = F.col("node_id") + (1 if inner else 0)
    ids = (matches.filter(first <= F.col("last_desc"))
           .select("page_id", F.col("node_id").alias("_root"), F.explode(F.sequence(first, "last_desc")).alias("node_id")))
    rows = ids.join(with_parent_tag(nodes), ["page_id", "node_id"])
    return rebuild_html(rows, root_col="_root").withColumnRenamed("_root", "node_id")


_FAIL = "struct<field:string,message:string>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _numbered(fields: list[Field]) -> list[Field]:
    """All fields of a spec, parents before children; ``Field.no`` is the place in this list."""
    out: list[Field] = []

    def walk(level):
        for f in level:
            f.no = len(out)
            out.append(f)
            walk(f.fields)
    walk(fields)
    return out


def _inside(page: Column, m: Column) -> Column:
    """The part of the page's array below node ``m`` (element i of the array is node i - 1)."""
    return F.slice(page, m["id"] + 2, m["last"] - m["id"])


def _value(f: Field, page: Column, m: Column) -> Column:
    """``struct(value, fail)`` of one match."""
    if f.type == "object":
        return _record(f.fields, page, _inside(page, m))
    if f.type == "text":
        strings = F.filter(_inside(page, m), lambda n: n["container"] == m["container"])
        value = F.array_join(F.transform(strings, lambda n: n["piece"]), "")
    else:
        value = m[f"v{f.no}"]
    return F.struct(value.alias("value"), F.lit(None).cast(_FAIL).alias("fail"))


def _field(f: Field, page: Column, scope: Column) -> Column:
    """``struct(value, fail)`` of a field among the nodes of ``scope``."""
    own = F.struct(F.lit(f.name).alias("field"), F.lit(f"No element matched CSS selector '{f.selector}'").alias("message"))
    none = F.struct(_default_col(f).cast(f.spark_type()).alias("value"),
                    F.when(F.lit(f.required), own).cast(_FAIL).alias("fail"))

    def of(matches: Column) -> Column:
        if f.multiple:
            found = _let(F.transform(matches, lambda m: _value(f, page, m)), lambda each: F.struct(
                F.transform(each, lambda x: x["value"]).alias("value"),
                F.get(F.filter(F.transform(each, lambda x: x["fail"]), lambda x: x.isNotNull()), F.lit(0)).alias("fail")))
        else:
            found = _let(F.get(matches, F.lit(0)), lambda m: _value(f, page, m))
        return F.when(F.size(matches) == 0, none).otherwise(found)
    return _let(F.filter(scope, lambda n: n[f"m{f.no}"]), of)


def _record(fields: list[Field], page: Column, scope: Column) -> Column:
    """``struct(value, fail)`` of all fields among the nodes of ``scope``; the first failing field counts."""
    each = F.struct(*[_field(f, page, scope).alias(f"f{f.no}") for f in fields])
    return _let(each, lambda r: F.struct(
        F.struct(*[r[f"f{f.no}"]["value"].alias(f.name) for f in fields]).alias("value"),
        F.coalesce(*[r[f"f{f.no}"]["fail"] for f in fields]).alias("fail")))


def page_arrays(nodes: DataFrame, fields: list[Field], bases: DataFrame | None) -> DataFrame:
    """``(page_id, has_html, page)``: one row for each page, ``page[i]`` for node i with its interval, its
    stripped string, and for field k whether it matches (``mk``) and its attribute or markup (``vk``).

    Nodes that no field needs are null.  One exchange by page; a page's array is bounded by the size
    cap of pages."""
    every = _numbered(fields)
    string = F.col("kind").isin("text", "cdata", "ctext")
    keep = [F.when(string, py_strip(F.col("text"))).alias("piece"),
            F.when(string, F.col("kind") == "ctext").otherwise(F.coalesce(F.col("tag").isin(list(STRING_CONTAINERS)), F.lit(False)))
            .alias("container")]
    keep += [attr_value(f.attribute).alias(f"v{f.no}") for f in every if f.type == "attr"]
    df = match_columns(nodes, {f"m{f.no}": f.selector for f in every}, keep)
    absolute = [f for f in every if f.type == "attr" and f.absolute_url]
    df = df.withColumns({f"v{f.no}": F.when(F.col(f"m{f.no}"), F.col(f"v{f.no}")) for f in every if f.type == "attr"})
    if absolute:
        if bases is None:
            raise SpecError("absolute_url needs page base URLs")
        df = df.join(bases.select("page_id", "base_url"), "page_id", "left")
        for f in absolute:
            df = absolutize(df, f"v{f.no}", "base_url", f"v{f.no}")
    for f in every:
        if f.type in ("html", "outer"):
            html = subtree_html(nodes, df.filter(f"m{f.no}").select("page_id", "node_id", "last_desc"), f.type == "html")
            df = df.join(html.withColumnRenamed("html", f"v{f.no}"), ["page_id", "node_id"], "left")
            df = df.withColumn(f"v{f.no}", F.when(F.col(f"m{f.no}"), F.coalesce(f"v{f.no}", F.lit(""))))
    marks = [f"m{f.no}" for f in every]
    texts = F.col("piece") != "" if any(f.type == "text" for f in every) else F.lit(False)
    needed = reduce(or_, [F.col(m) for m in marks], (F.col("node_id") == 0) | F.coalesce(texts, F.lit(False)))
    gap = F.lead("node_id").over(Window.partitionBy("page_id").orderBy("node_id")) - F.col("node_id") - 1
    values = [f"v{f.no}" for f in every if f.type in ("attr", "html", "outer")]
    df = df.filter(needed).select("page_id", F.coalesce(gap, F.lit(0)).alias("gap"), F.struct(
        F.col("node_id").alias("id"), F.col("last_desc").alias("last"), "container", "piece", *marks, *values).alias("n"))
    rows = F.array_sort(F.collect_list(F.struct(F.col("n.id").alias("id"), "n", "gap")))
    filled = F.flatten(F.transform(rows, lambda r: F.concat(F.array(r["n"]), F.array_repeat(F.when(F.lit(False), r["n"]), r["gap"]))))
    return (df.groupBy("page_id").agg(filled.alias("page"))
            .filter(F.col("page")[0]["id"] == 0)
            .select("page_id", (F.col("page")[0]["last"] > 0).alias("has_html"), "page"))


def extract(nodes: DataFrame, spec: dict, bases: DataFrame | None = None,
            enabled: bool = True) -> DataFrame:
    """Run ``spec`` over every page: ``(page_id, extracted, extraction_error)``.

    O-X13 gating: disabled or empty specs and pages with empty HTML get neither column
    filled."""
    fields = compile_spec(spec)
    if not fields or not enabled:
        kind = T.StructType([T.StructField(f.name, f.spark_type(), True) for f in fields]) if fields else T.NullType()
        return nodes.filter(F.col("node_id") == 0).select(
            "page_id", F.lit(None).cast(kind).alias("extracted"), F.lit(None).cast(_FAIL).alias("extraction_error"))
    pages = page_arrays(nodes, fields, bases)
    done = pages.select("page_id", F.when(F.col("has_html"), _record(fields, F.col("page"), F.col("page"))).alias("r"))
    return done.select("page_id", F.when(F.col("r.fail").isNull(), F.col("r.value")).alias("extracted"),
                       F.col("r.fail").alias("extraction_error"))
