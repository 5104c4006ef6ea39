"""Operator 6, HTML extraction by line-block distribution.

Markup is stripped into lines, one for each block element.  Lines inside structural boilerplate
(menus, headers, footers, sidebars, notices, adverts, forms, comments of readers) and lines that
are all links outside an article have length 0.  The lengths are summed over sliding windows of
``WINDOW`` lines.  A surge point is where the sums rise from 0, a dive point is where they fall
back to 0, which takes ``WINDOW`` lines of length 0, so an advert or a link inside a text does not end
it; the text between a surge and its dive is one candidate region, with its lines of links.  A page
with an article (or main) element keeps the regions of the one with the most text; any other page keeps
the region with the most text, the regions next to it, and those near it in weight.

Each page is a row of its own (no shuffle), html is read whole, nothing is cut.

Defined results: null or empty html gives an empty text; markup that never ends swallows what
follows it, as a browser does for scripts and comments; equal rows give equal rows; text
without any markup is one block.
"""

from __future__ import annotations

import html as _html
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

WINDOW = 3
#: Share of the heaviest region's text that a region not next to it needs on pages without an article.
NEAR = 0.3

_ATTRS = r"""(?:"[^"]*"|'[^']*'|[^'">])*"""
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>script|style|title|textarea|noscript|template|svg|select|iframe|object|canvas|video|audio|math)\b(?:{_ATTRS}|[^>]*)>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:\s{_ATTRS}|/)?)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs2>[^>]*)>"
    r"|<[!?/][^>]*>", re.S | re.I)
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot "
    "th thead tr ul option caption".split())
#: Elements that an end tag of an inner element does not reach across.
_SCOPE = frozenset("article aside blockquote body div footer form header html li main nav section table td th ul ol".split())
_DEAD_TAGS = frozenset("nav header footer aside form head button dialog menu fieldset label".split())
_DEAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words in class and id names that mark boilerplate.
_DEAD_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner "
    "sidebar sidenav menu menus nav navbar navigation topbar header masthead footer breadcrumb breadcrumbs cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login form search share "
    "sharing social related recommended recommendations widget widgets comment comments disqus respond reply replies "
    "pagination pager toolbar copyright disclaimer skiplink".split())
_OPEN_WORDS = frozenset("has no with without is".split())
_COMMENT_WORDS = frozenset("comment comments reply replies respond disqus ad ads advert advertisement sponsored promo related recommended".split())
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_KEEP_TAGS = frozenset("html body main".split())


def _names(value: str) -> set[str]:
    out: set[str] = set()
    for name in value.split():
        parts = [p.lower() for p in _NAME.findall(name)]
        if parts and parts[0] in _OPEN_WORDS:
            continue
        out.update(parts)
    return out


def _is_dead(tag: str, attrs: str) -> bool:
    if tag in _DEAD_TAGS:
        return True
    if not attrs or attrs.isspace() or tag in _KEEP_TAGS:
        return False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            if _names(value) & (_COMMENT_WORDS if tag == "article" else _DEAD_WORDS):
                return True
        elif name == "role" and value.lower() in _DEAD_ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def lines_of(page: str) -> list[tuple[str, int, float]]:
    """(text, container, share of link text) of each block in page order.  A line of dead
    markup is ("", -1, 0).  Container 0 is the page, others count article and main elements."""
    out: list[tuple[str, int, float]] = []
    parts: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, int]] = []  # tag, dead, container
    dead, container, containers, links, breaks = 0, 0, 0, 0, 0

    def end_line():
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((text, container, linked / max(1, len(text))))
            parts = []
        linked = 0

    def pop():
        nonlocal dead, container, links
        tag, was_dead, _ = stack.pop()
        dead -= was_dead
        if tag == "a":
            links -= 1
        container = stack[-1][2] if stack else 0

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at and not dead:
            piece = _html.unescape(page[at:m.start()])
            parts.append(piece)
            if not piece.isspace():
                breaks = 0
                if links:
                    linked += len(piece.strip())
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        closing = m["end"] or m["end2"]
        attrs = m["attrs"] or m["attrs2"] or ""
        if tag == "br":
            breaks += 1
            if breaks > 1:
                end_line()
            else:
                parts.append(" ")
            continue
        if tag in _BLOCK:
            end_line()
            breaks = 0
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    while len(stack) > i:
                        pop()
                    break
                if stack[i][0] in _SCOPE and tag not in _SCOPE:
                    break
            continue
        if tag in _VOID:
            continue
        if tag == "body":
            while stack and stack[-1][0] == "head":
                pop()
        if tag in _BLOCK and stack:  # a block ends an open paragraph, an item ends the item before it
            for i in range(len(stack) - 1, -1, -1):
                name = stack[i][0]
                if name == "p" or name == tag and tag in ("li", "dd", "dt", "td", "th", "tr", "option"):
                    while len(stack) > i:
                        pop()
                    break
                if name in _SCOPE:
                    break
        if attrs.rstrip().endswith("/") and tag not in _BLOCK and tag != "a":
            continue
        is_dead = _is_dead(tag, attrs)
        if is_dead and not dead:
            end_line()
            out.append(("", -1, 0.0))
        if tag in ("article", "main") and not dead and not is_dead:
            containers += 1
            container = containers if tag == "article" or container == 0 else container
        dead += is_dead
        links += tag == "a"
        stack.append((tag, is_dead, container))
    if at < len(page) and not dead:
        parts.append(_html.unescape(page[at:]))
    end_line()
    return out


def regions(lengths: np.ndarray, window: int = 1) -> list[tuple[int, int]]:
    """(surge, dive) pairs: maximal stretches of lines over which the sum of the window that ends at a
    line stays above 0, without the lines of length 0 at their end."""
    sums = np.convolve(lengths, np.ones(window, np.int64))[:len(lengths)]
    above = np.concatenate([[0], sums > 0, [0]])
    surges, dives = np.flatnonzero(np.diff(above) > 0), np.flatnonzero(np.diff(above) < 0)
    text = np.flatnonzero(lengths)
    return [(int(i), int(text[np.searchsorted(text, j) - 1]) + 1) for i, j in zip(surges, dives, strict=True)]


def main_text(page) -> str:
    """The main text of one page."""
    if not isinstance(page, str) or not page:
        return ""
    lines = lines_of(page)
    if not lines:
        return ""
    inside: dict[int, int] = {}
    for text, c, _ in lines:
        if c > 0:
            inside[c] = inside.get(c, 0) + len(text)
    best = min(inside, key=lambda c: (-inside[c], c)) if inside else 0
    lengths = np.array([len(t) if (c == best if best else c >= 0 and share < 0.8) else 0 for t, c, share in lines], np.int64)
    found = regions(lengths, WINDOW)
    if not found:
        return ""
    weight = [int(lengths[i:j].sum()) for i, j in found]
    main = weight.index(max(weight))
    keep = [r for k, (r, w) in enumerate(zip(found, weight, strict=True)) if best or abs(k - main) <= 1 or w >= NEAR * weight[main]]
    return "\n".join(lines[i][0] for a, b in keep for i in range(a, b) if lines[i][0] and (not best or lines[i][1] == best))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html)."""
    def run(batches):
        for pdf in batches:
            texts = [main_text(h) for h in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"].astype("Int64"), "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})
    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")
