"""O-H1: shred a page table into the node table, once per corpus.

One ``mapInPandas`` pass: each task tokenises its pages with the standard library's
``html.parser`` and builds the tree with the stack rules of the reference's tree builder
(no implied end tags; an end tag closes the nearest open element of that name and is
ignored when none is open; void elements close at once; ``<x/>`` closes at once; adjacent
data and character references form one text node; a comment ends the text run; the last
duplicate attribute wins; list attributes such as ``class`` are whitespace-normalised;
an all-ASCII-whitespace text node outside ``pre``/``textarea`` becomes one newline or
one space).  Everything downstream (cleaning, text, selectors, rebuilding) is plain
DataFrame work on the node table.

Node table schema::

    page_id long, node_id int (pre-order, 0 = document), parent_id int, depth int,
    last_desc int (end of the subtree interval),
    esib int (1-based index among element siblings), esib_rev int (same from the end),
    kind string, tag string, attrs map<string,string>, text string

``kind``: document, element, text, ctext (a string inside a script / style / template /
rt / rp container -- serialised, but not part of the page's text), comment, doctype,
cdata, pi, decl.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

NODE_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType(), False),
    T.StructField("node_id", T.IntegerType(), False),
    T.StructField("parent_id", T.IntegerType(), True),
    T.StructField("depth", T.IntegerType(), False),
    T.StructField("last_desc", T.IntegerType(), False),
    T.StructField("esib", T.IntegerType(), True),
    T.StructField("esib_rev", T.IntegerType(), True),
    T.StructField("kind", T.StringType(), False),
    T.StructField("tag", T.StringType(), True),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType(), True), True),
    T.StructField("text", T.StringType(), True),
])

# Elements that close as soon as they open.
VOID_ELEMENTS = frozenset([
    "area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link", "menuitem",
    "meta", "param", "source", "track", "wbr", "basefont", "bgsound", "command", "frame",
    "image", "isindex", "nextid", "spacer",
])
# Elements whose whitespace-only text is kept verbatim.
PRESERVE_WHITESPACE = frozenset(["pre", "textarea"])
# Elements whose strings are not page text.
STRING_CONTAINERS = frozenset(["rt", "rp", "style", "script", "template"])
# Attributes holding a whitespace-separated list, per tag ('*' = any tag).
LIST_ATTRIBUTES = {
    "*": ("class", "accesskey", "dropzone"),
    "a": ("rel", "rev"),
    "link": ("rel", "rev"),
    "td": ("headers",),
    "th": ("headers",),
    "form": ("accept-charset",),
    "object": ("archive",),
    "area": ("rel",),
    "icon": ("sizes",),
    "iframe": ("sandbox",),
    "output": ("for",),
}
_ASCII_SPACES = " \n\t\x0c\r"


def _charref_text(name: str) -> str:
    """Numeric character reference; 128..159 read as windows-1252, as browsers do."""
    try:
        if name[:1] in ("x", "X"):
            code = int(name.lstrip("xX"), 16)
        else:
            code = int(name)
    except ValueError:
        return "&#" + name + ";"
    if code < 256:
        try:
            return bytes([code]).decode("windows-1252")
        except UnicodeDecodeError:
            pass
    try:
        return chr(code)
    except (ValueError, OverflowError):
        return "\N{REPLACEMENT CHARACTER}"


def _entity_text(name: str) -> str:
    from html.entities import name2codepoint
    if name in name2codepoint:
        return chr(name2codepoint[name])
    from html.entities import html5
    key = name + ";"
    if key in html5:
        return html5[key]
    return "&" + name


class _TreeBuilder(HTMLParser):
    """Stack-based tree builder on top of the stdlib tokenizer."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        # columns, appended per node
        self.parent, self.depth, self.kind, self.tag, self.attrs, self.text = [], [], [], [], [], []
        self.last_desc = []
        self._new(None, 0, "document", None, None, None)
        self.stack = [0]            # open element ids (0 = document)
        self.stack_tags = [None]
        self.open_count: dict[str, int] = {}
        self.container_depth = 0    # open string containers
        self.preserve_depth = 0     # open pre / textarea
        self.pending: list[str] = []
        self.closed_void: dict[str, int] = {}

    def _new(self, parent, depth, kind, tag, attrs, text) -> int:
        nid = len(self.kind)
        self.parent.append(parent)
        self.depth.append(depth)
        self.kind.append(kind)
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.text.append(text)
        self.last_desc.append(nid)
        return nid

    def _flush(self, kind: str | None = None) -> None:
        if not self.pending:
            return
        data = "".join(self.pending)
        self.pending = []
        if self.preserve_depth == 0 and all(c in _ASCII_SPACES for c in data):
            data = "\n" if "\n" in data else " "
        if kind is None:
            kind = "ctext" if self.container_depth > 0 else "text"
        top = self.stack[-1]
        self._new(top, len(self.stack), kind, None, None, data)

    # -- tokenizer callbacks
    def handle_starttag(self, tag, attrs, _close_void=True):
        self._flush()
        amap = {}
        for k, v in attrs:
            amap[k] = "" if v is None else v
        for key in LIST_ATTRIBUTES["*"] + LIST_ATTRIBUTES.get(tag, ()):
            if key in amap:
                amap[key] = " ".join(amap[key].split())
        nid = self._new(self.stack[-1], len(self.stack), "element", tag, amap, None)
        self.stack.append(nid)
        self.stack_tags.append(tag)
        self.open_count[tag] = self.open_count.get(tag, 0) + 1
        if tag in STRING_CONTAINERS:
            self.container_depth += 1
        if tag in PRESERVE_WHITESPACE:
            self.preserve_depth += 1
        if _close_void and tag in VOID_ELEMENTS:
            self._pop_to(tag)
            self.closed_void[tag] = self.closed_void.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs, _close_void=False)
        self.handle_endtag(tag)

    def handle_endtag(self, tag, _check_void=True):
        if _check_void and self.closed_void.get(tag):
            self.closed_void[tag] -= 1
            return
        self._flush()
        self._pop_to(tag)

    def _pop_to(self, tag) -> None:
        if not self.open_count.get(tag):
            return
        while len(self.stack) > 1:
            popped_tag = self._pop()
            if popped_tag == tag:
                break

    def _pop(self) -> str:
        nid = self.stack.pop()
        tag = self.stack_tags.pop()
        self.open_count[tag] -= 1
        if tag in STRING_CONTAINERS:
            self.container_depth -= 1
        if tag in PRESERVE_WHITESPACE:
            self.preserve_depth -= 1
        self.last_desc[nid] = len(self.kind) - 1
        return tag

    def handle_data(self, data):
        self.pending.append(data)

    def handle_charref(self, name):
        self.pending.append(_charref_text(name))

    def handle_entityref(self, name):
        self.pending.append(_entity_text(name))

    def handle_comment(self, data):
        self._flush()
        self.pending.append(data)
        self._flush("comment")

    def handle_decl(self, data):
        self._flush()
        if data.startswith("DOCTYPE "):
            data = data[len("DOCTYPE "):]
        elif data == "DOCTYPE":
            data = ""
        self.pending.append(data)
        self._flush("doctype")

    def unknown_decl(self, data):
        self._flush()
        kind = "decl"
        if data.upper().startswith("CDATA["):
            data = data[len("CDATA["):]
            kind = "cdata"
        self.pending.append(data)
        self._flush(kind)

    def handle_pi(self, data):
        self._flush()
        self.pending.append(data)
        self._flush("pi")

    def finish(self) -> None:
        self.close()
        self._flush()
        while len(self.stack) > 1:
            self._pop()
        self.last_desc[0] = len(self.kind) - 1


def shred_page(page_id: int, html: str | None) -> dict:
    """Build the node columns for one page (a plain-Python helper, used per row)."""
    b = _TreeBuilder()
    if html:
        b.feed(html)
    b.finish()
    n = len(b.kind)
    esib = [None] * n
    esib_rev = [None] * n
    children: dict[int, list[int]] = {}
    for nid in range(1, n):
        par = b.parent[nid]
        if b.kind[nid] == "element":
            children.setdefault(par, []).append(nid)
    for kids in children.values():
        m = len(kids)
        for i, k in enumerate(kids):
            esib[k] = i + 1
            esib_rev[k] = m - i
    return {
        "page_id": [page_id] * n, "node_id": list(range(n)), "parent_id": b.parent,
        "depth": b.depth, "last_desc": b.last_desc, "esib": esib,
        "esib_rev": esib_rev, "kind": b.kind, "tag": b.tag,
        "attrs": b.attrs, "text": b.text,
    }


def _shred_batches(batches):
    for pdf in batches:
        cols: dict[str, list] = {f.name: [] for f in NODE_SCHEMA.fields}
        for pid, html in zip(pdf["page_id"], pdf["html"]):
            one = shred_page(int(pid), html)
            for k, v in one.items():
                cols[k].extend(v)
        yield pd.DataFrame(cols)


def shred(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Pages ``(page_id, html)`` to the node table (lazy; persist it once per corpus)."""
    src = pages.select(pages[id_col].cast("long").alias("page_id"), pages[html_col].alias("html"))
    return src.mapInPandas(_shred_batches, schema=NODE_SCHEMA)
