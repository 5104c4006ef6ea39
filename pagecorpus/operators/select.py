"""O-X1: CSS selectors compiled to windows over the node table.

Supported subset: type, ``*``, ``.class``, ``#id``, ``[a]``, ``[a=v]``, ``~= |= ^= $= *=``,
``:first-child``, ``:last-child``, ``:nth-child(an+b)``, ``:not(compound)``, the four
combinators (descendant, ``>``, ``+``, ``~``) and comma lists.  Anything else is rejected
when the selector is compiled, never silently ignored.

A compound is a predicate on one node row.  ``A B`` compares a running maximum of the ends of ``A``'s
intervals with the node's id; ``A > B`` looks at the group of a parent and its children; ``A + B`` and
``A ~ B`` look at the siblings before.  All windows lie within a page, so rows are dealt once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagecorpus.functions.text import WS


class SelectorError(ValueError):
    pass


@dataclass
class AttrTest:
    name: str
    op: str | None = None
    value: str | None = None


@dataclass
class Compound:
    tag: str | None = None
    classes: list[str] = field(default_factory=list)
    ids: list[str] = field(default_factory=list)
    attrs: list[AttrTest] = field(default_factory=list)
    nth: list[tuple[int, int, bool]] = field(default_factory=list)  # (a, b, from_end)
    negations: list["Compound"] = field(default_factory=list)


_IDENT = r"-?(?:[_a-zA-Z\u00a0-\uffff]|\\.)(?:[-_a-zA-Z0-9\u00a0-\uffff]|\\.)*"
_TOKEN = re.compile(
    r"(?P<ws>\s+)|(?P<comb>[>+~])|(?P<comma>,)|(?P<star>\*)|(?P<type>" + _IDENT + r")"
    r"|\.(?P<cls>" + _IDENT + r")|#(?P<id>" + _IDENT + r"|[-_a-zA-Z0-9]+)"
    r"|\[\s*(?P<an>" + _IDENT + r")\s*(?:(?P<aop>[~|^$*]?=)\s*(?:\"(?P<dq>[^\"]*)\"|'(?P<sq>[^']*)'|(?P<bare>"
    + _IDENT + r"|[-_a-zA-Z0-9]+))\s*(?P<flag>[iIsS])?\s*)?\]"
    r"|:(?P<pseudo>[-a-zA-Z]+)(?:\((?P<arg>[^()]*(?:\([^()]*\)[^()]*)*)\))?"
)


def _unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s)


def _parse_nth(arg: str) -> tuple[int, int]:
    a = arg.strip().lower().replace(" ", "")
    if a == "odd":
        return 2, 1
    if a == "even":
        return 2, 0
    m = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?", a)
    if m:
        coef = m.group(1)
        av = 1 if coef in ("", "+") else (-1 if coef == "-" else int(coef))
        return av, int(m.group(2) or 0)
    if re.fullmatch(r"[+-]?\d+", a):
        return 0, int(a)
    raise SelectorError(f"unsupported nth argument: {arg!r}")


def _parse_compound_tokens(tokens: list[tuple[str, re.Match]]) -> Compound:
    c = Compound()
    for kind, m in tokens:
        if kind == "star":
            c.tag = c.tag or "*"
        elif kind == "type":
            c.tag = _unescape(m.group("type")).lower()
        elif kind == "cls":
            c.classes.append(_unescape(m.group("cls")))
        elif kind == "id":
            c.ids.append(_unescape(m.group("id")))
        elif kind == "attr":
            if m.group("flag"):
                raise SelectorError("attribute case flags are not supported")
            val = m.group("dq")
            if val is None:
                val = m.group("sq")
            if val is None and m.group("bare") is not None:
                val = _unescape(m.group("bare"))
            c.attrs.append(AttrTest(_unescape(m.group("an")).lower(), m.group("aop"), val))
        elif kind == "pseudo":
            name = m.group("pseudo").lower()
            arg = m.group("arg")
            if name == "first-child" and arg is None:
                c.nth.append((0, 1, False))
            elif name == "last-child" and arg is None:
                c.nth.append((0, 1, True))
            elif name == "nth-child" and arg is not None:
                a, b = _parse_nth(arg)
                c.nth.append((a, b, False))
            elif name == "nth-last-child" and arg is not None:
                a, b = _parse_nth(arg)
                c.nth.append((a, b, True))
            elif name == "not" and arg is not None:
                inner = parse_selector(arg)
                for complex_sel in inner:
                    if len(complex_sel) != 1:
                        raise SelectorError(":not() takes compound selectors only here")
                    c.negations.append(complex_sel[0][1])
            else:
                raise SelectorError(f"unsupported pseudo-class :{name}")
    return c


def parse_selector(text: str) -> list[list[tuple[str, Compound]]]:
    """Selector text to a list (comma alternatives) of [(combinator, compound), ...];
    the first combinator is ''."""
    pos = 0
    text = text.strip()
    if not text:
        raise SelectorError("empty selector")
    alternatives: list[list[tuple[str, Compound]]] = []
    current: list[tuple[str, Compound]] = []
    compound_tokens: list[tuple[str, re.Match]] = []
    pending_comb = ""

    def close_compound():
        nonlocal compound_tokens, pending_comb
        if compound_tokens:
            if current and not pending_comb:
                raise SelectorError("missing combinator")
            current.append((pending_comb if current else "", _parse_compound_tokens(compound_tokens)))
            compound_tokens = []
            pending_comb = ""

    while pos < len(text):
        m = _TOKEN.match(text, pos)
        if not m or m.end() == pos:
            raise SelectorError(f"cannot parse selector {text!r} at {pos}")
        pos = m.end()
        kind = next(k for k in ("ws", "comb", "comma", "star", "type", "cls", "id", "an", "pseudo")
                    if m.group(k) is not None)
        kind = {"an": "attr"}.get(kind, kind)
        if kind == "ws":
            if compound_tokens:
                close_compound()
                pending_comb = " "
            continue
        if kind == "comb":
            close_compound()
            if not current:
                raise SelectorError("selector starts with a combinator")
            pending_comb = m.group("comb")
            continue
        if kind == "comma":
            close_compound()
            if not current or pending_comb.strip():
                raise SelectorError("dangling combinator or empty alternative")
            alternatives.append(current)
            current = []
            pending_comb = ""
            continue
        if kind in ("type", "star") and compound_tokens:
            raise SelectorError("type selector must come first in a compound")
        compound_tokens.append((kind, m))
    close_compound()
    if not current or pending_comb.strip():
        raise SelectorError("dangling combinator")
    alternatives.append(current)
    return alternatives


def _attr_value(name: str) -> Column:
    return F.try_element_at(F.col("attrs"), F.lit(name))


def compound_predicate(c: Compound) -> Column:
    pred = F.col("kind") == "element"
    if c.tag and c.tag != "*":
        pred = pred & (F.col("tag") == c.tag)
    for cls in c.classes:
        pred = pred & F.coalesce(F.array_contains(F.split(_attr_value("class"), " "), cls), F.lit(False))
    for i in c.ids:
        pred = pred & F.coalesce(_attr_value("id") == i, F.lit(False))
    for t in c.attrs:
        v = _attr_value(t.name)
        if t.op is None:
            test = F.map_contains_key(F.col("attrs"), t.name)
        elif t.op == "=":
            test = v == t.value
        elif t.op == "~=":
            test = (F.array_contains(F.split(v, f"{WS}+"), t.value)
                    if t.value and not re.search(r"\s", t.value) else F.lit(False))
        elif t.op == "|=":
            test = (v == t.value) | F.startswith(v, F.lit(t.value + "-"))
        elif t.op == "^=":
            test = F.startswith(v, F.lit(t.value)) if t.value else F.lit(False)
        elif t.op == "$=":
            test = F.endswith(v, F.lit(t.value)) if t.value else F.lit(False)
        elif t.op == "*=":
            test = F.contains(v, F.lit(t.value)) if t.value else F.lit(False)
        else:
            raise SelectorError(f"unsupported attribute operator {t.op}")
        pred = pred & F.coalesce(test, F.lit(False))
    for a, b, from_end in c.nth:
        idx = F.col("esib_rev") if from_end else F.col("esib")
        if a == 0:
            test = idx == b
        else:
            diff = idx - F.lit(b)
            test = ((diff % abs(a)) == 0) & ((diff / F.lit(a)) >= 0)
        pred = pred & F.coalesce(test, F.lit(False))
    for neg in c.negations:
        pred = pred & ~compound_predicate(neg)
    return pred


def _strictly_before(w):
    return w.rowsBetween(Window.unboundedPreceding, -1)


def _descendants(df: DataFrame, steps: list[tuple[str, str, str]]) -> DataFrame:
    """Nodes below a flagged one: some flagged node before it has an interval that reaches it."""
    order = _strictly_before(Window.partitionBy("page_id").orderBy("node_id"))
    return df.select("*", *[
        (F.col(own) & F.coalesce(F.max(F.when(F.col(prev), F.col("last_desc"))).over(order) >= F.col("node_id"), F.lit(False)))
        .alias(out) for out, prev, own in steps])


def _children(df: DataFrame, steps: list[tuple[str, str, str]]) -> DataFrame:
    """Children of a flagged node: flagged rows get a second copy in the group of their children."""
    parent = reduce(or_, [F.col(prev) for _, prev, _ in steps])
    own = F.struct(F.col("parent_id").alias("group"), F.lit(True).alias("row"))
    copy = F.struct(F.col("node_id").alias("group"), F.lit(False).alias("row"))
    both = df.select("*", F.explode(F.when(parent, F.array(own, copy)).otherwise(F.array(own))).alias("_g"))
    family = Window.partitionBy("page_id", "_g.group")
    return both.select(*df.columns, "_g", *[
        (F.col(own_) & F.max(~F.col("_g.row") & F.col(prev)).over(family)).alias(out)
        for out, prev, own_ in steps]).filter("_g.row").drop("_g")


def _siblings(df: DataFrame, steps: list[tuple[str, str, str]], adjacent: bool) -> DataFrame:
    """Elements right after (``+``) or anywhere after (``~``) a flagged sibling; other nodes have no
    ``esib`` and sort first."""
    order = Window.partitionBy("page_id", "parent_id").orderBy("esib")
    seen = (lambda c: F.lag(c).over(order)) if adjacent else (lambda c: F.max(c).over(_strictly_before(order)))
    return df.select("*", *[(F.col(own) & F.coalesce(seen(F.col(prev)), F.lit(False))).alias(out) for out, prev, own in steps])


_STEPS = {" ": _descendants, ">": _children, "+": lambda df, s: _siblings(df, s, True), "~": lambda df, s: _siblings(df, s, False)}


def match_columns(nodes: DataFrame, selectors: dict[str, str], keep: list) -> DataFrame:
    """``page_id, node_id, parent_id, last_desc, esib``, the ``keep`` columns and one boolean column
    for each of ``selectors`` (name -> selector), for every node.

    Compounds are tested where the rows lie, so attribute maps need not travel.  Then the rows are
    dealt by ``page_id`` once, and every combinator is a window within the page: no join, and no
    second exchange, however many selectors and steps there are.  Steps that selectors have in
    common (the same beginning) are computed once."""
    parsed = {name: parse_selector(text) for name, text in selectors.items()}
    tests: dict[str, str] = {}
    paths: dict[str, list[tuple]] = {}
    predicates = []
    for name, alternatives in parsed.items():
        for steps in alternatives:
            for _, compound in steps:
                if repr(compound) not in tests:
                    tests[repr(compound)] = f"_t{len(tests)}"
                    predicates.append(F.coalesce(compound_predicate(compound), F.lit(False)).alias(tests[repr(compound)]))
        paths[name] = [tuple((comb, repr(compound)) for comb, compound in steps) for steps in alternatives]
    df = nodes.select("page_id", "node_id", "parent_id", "last_desc", "esib", *keep, *predicates)
    done = {path[:1]: tests[path[0][1]] for found in paths.values() for path in found}
    longest = max((len(path) for found in paths.values() for path in found), default=1)
    if longest > 1:
        df = df.repartition("page_id")
    for size in range(2, longest + 1):
        todo = dict.fromkeys(path[:size] for found in paths.values() for path in found if len(path) >= size)
        for comb, step in _STEPS.items():
            now = [p for p in todo if p[-1][0] == comb]
            for p in now:
                done[p] = f"_s{len(done)}"
            if now:
                df = step(df, [(done[p], done[p[:-1]], tests[p[-1][1]]) for p in now])
    marks = [reduce(or_, [F.col(done[path]) for path in paths[name]]).alias(name) for name in selectors]
    return df.select("page_id", "node_id", "parent_id", "last_desc", "esib",
                     *[c for c in df.columns[5:5 + len(keep)]], *marks)


def select_nodes(nodes: DataFrame, selector: str) -> DataFrame:
    """Matches of ``selector`` as ``(page_id, node_id, parent_id, last_desc, esib, tag)``, one row for each
    matched element (order by ``node_id`` for document order)."""
    return (match_columns(nodes, {"_match": selector}, ["tag"]).filter("_match")
            .select("page_id", "node_id", "parent_id", "last_desc", "esib", "tag"))
