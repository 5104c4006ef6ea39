"""Operator 9, benchmark decontamination by greedy string tiling.

Rolling (Karp-Rabin) hashes of ``MIN_MATCH`` words are computed once for every benchmark item
and rolled over every text; equal ones are seeds.  Seeds that follow each other on a diagonal
make maximal matches.  For each text and item with seeds, the longest match whose words are all
unmarked is marked in both, matches that overlap are trimmed and tried again, until none of
``MIN_MATCH`` words is left.  The marked share of the item is its coverage: it does not depend on
the order in which the passages stand, so reordered passages count in full.  A text that covers
an item by ``COVERAGE`` or more is contaminated.

The benchmark's seeds go to the tasks in chunks of at most ``CHUNK_SEEDS`` seeds; a larger
benchmark takes several passes over the texts, so that memory stays bounded.  Texts are read
whole, where they lie; no shuffle of texts.

Defined results: null texts have no words; an item with fewer than ``MIN_MATCH`` words matches
as a whole; items without words match nothing; repeated items and repeated texts are judged
each by itself; an empty benchmark leaves every text clean.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagecorpus.llm import common as C
from pagecorpus.llm.licenses import license_words

MIN_MATCH = 4
COVERAGE = 0.5
CHUNK_SEEDS = 2_000_000


def grams(h: np.ndarray, width: int) -> np.ndarray:
    return C.shingle_hashes(h, width) if len(h) >= width else np.empty(0, np.uint64)


def tile(p: np.ndarray, q: np.ndarray, width: int, n_item: int) -> tuple[int, int, int]:
    """Greedy string tiling of the seeds (p in the text, q in the item): words of the item that
    are marked, number of tiles, and the longest tile."""
    order = np.lexsort((p, p - q))
    p, q = p[order], q[order]
    cut = np.flatnonzero((np.diff(p - q) != 0) | (np.diff(p) != 1)) + 1
    starts = np.concatenate([[0], cut])
    ends = np.concatenate([cut, [len(p)]])
    heap = [(-int(e - s + width - 1), int(p[s]), int(q[s])) for s, e in zip(starts, ends, strict=True)]
    heapq.heapify(heap)
    item = np.zeros(n_item, bool)
    text: set[int] = set()
    tiles = longest = 0
    while heap:
        n, a, b = heapq.heappop(heap)
        n = -n
        free = [not item[b + i] and a + i not in text for i in range(n)]
        if all(free):
            item[b:b + n] = True
            text.update(range(a, a + n))
            tiles += 1
            longest = max(longest, n)
            continue
        i = 0
        while i < n:  # the stretches that are still free
            if not free[i]:
                i += 1
                continue
            j = i
            while j < n and free[j]:
                j += 1
            if j - i >= width:
                heapq.heappush(heap, (-(j - i), a + i, b + i))
            i = j
    return int(item.sum()), tiles, longest


class Index:
    """The seeds of some benchmark items."""

    def __init__(self, items: list[tuple], width: int = MIN_MATCH):
        self.items = []  # id, number of words, width of its seeds
        found: dict[int, list] = {}
        for item_id, text in items:
            w = license_words(text)
            if not w:
                continue
            k = min(width, len(w))
            h = grams(C.word_hashes(w), k)
            found.setdefault(k, []).append((h, np.full(len(h), len(self.items)), np.arange(len(h))))
            self.items.append((item_id, len(w), k))
        self.by_width = {}
        for k, rows in found.items():
            h, i, q = (np.concatenate([r[j] for r in rows]) for j in range(3))
            o = np.argsort(h, kind="stable")
            self.by_width[k] = (h[o], i[o], q[o])

    def matches(self, text) -> list[tuple]:
        """(item id, coverage, tiles, longest tile) of each item that shares a seed."""
        w = license_words(text)
        if not w:
            return []
        h = C.word_hashes(w)
        out = []
        for k, (seeds, item, q) in self.by_width.items():
            g = grams(h, k)
            lo = np.searchsorted(seeds, g, "left")
            hit = np.flatnonzero(seeds[np.minimum(lo, len(seeds) - 1)] == g)
            if not len(hit):
                continue
            first = lo[hit]
            n = np.searchsorted(seeds, g[hit], "right") - first
            at = C.concat_ranges(first, n)
            p, i, qq = np.repeat(hit, n), item[at], q[at]
            for one in np.unique(i):
                own = i == one
                item_id, length, width = self.items[one]
                marked, tiles, longest = tile(p[own], qq[own], width, length)
                out.append((item_id, marked / length, tiles, longest))
        return out


def indexes(benchmark: DataFrame, chunk: int = CHUNK_SEEDS):
    """The benchmark in chunks of bounded size, one at a time."""
    b = benchmark.select("item_id", "text")
    size = b.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    n = max(1, math.ceil(size / 2 / chunk))  # a word takes two bytes at least
    for i in range(n):
        part = b.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else b
        yield Index([(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").collect()])


PAIRS = "doc_id long, item_id long, coverage double, tiles int, longest int"


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, coverage, tiles, longest) of every text and item covered so far."""
    out = None
    for index in indexes(benchmark):
        def run(batches, index=index):
            for pdf in batches:
                rows = [(d, *m) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) for m in index.matches(t) if m[1] >= coverage]
                if rows:
                    yield pd.DataFrame(rows, columns=["doc_id", "item_id", "coverage", "tiles", "longest"]).astype({"doc_id": "Int64", "item_id": "Int64"})
        part = docs.select("doc_id", "text").mapInPandas(run, PAIRS)
        out = part if out is None else out.unionByName(part)
    return out


def _clean(index: Index, coverage: float):
    @F.pandas_udf("boolean")
    def clean(text: pd.Series) -> pd.Series:
        return pd.Series([not any(m[1] >= coverage for m in index.matches(t)) for t in text], dtype=bool)
    return clean


def keep_clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` that cover no item, with all their columns."""
    cols = [F.col(f"`{c}`") for c in docs.columns]
    out = docs
    for index in indexes(benchmark):
        out = out.where(_clean(index, coverage)("text"))
    return out.select(*cols)
