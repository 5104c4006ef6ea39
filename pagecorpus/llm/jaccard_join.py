"""Operator 5, n-gram Jaccard join by prefix trees.

A document's set is the set of its distinct four-word shingles, as 64-bit hashes.  Two documents
link when 100 * intersection >= 85 * union.  Callers may ask for another width and share.

1. Global order.  Blocks of documents send their shingles (32-bit heads, packed and sorted) to
   ranges, which count in how many documents each occurs and answer with a frequency class.
   All sets are ordered by (class, hash), the rarest first.
2. Equal sets become one class, represented by its smallest doc_id.
3. Prefix filter.  Linked sets share one of their first ``n - ceil(0.85 n) + 1`` shingles.
   Only shingles that occur twice matter there, so a text that has enough shingles of its own
   sends nothing.  Classes that are connected by such shingles make a family.
4. Trie join.  Within a family the sets, most frequent shingle first, are stored in a radix trie.
   Each set walks down the trie; the overlap with a node's path is counted once for all sets
   below it, and a subtree is left when even its remaining length cannot reach the threshold.
   Families over ``MEMBERS`` sets are cut into groups, and every pair of groups is one task, so
   memory stays bounded and no pair is lost.  Only links that join two trees of the task's
   union-find are emitted.
5. Distributed union-find over these links.

Defined results: null texts and texts without words have an empty set and stand alone; fewer than
four words are one shingle; rows that repeat a doc_id share its component; a null doc_id has a
null component and represents no class that has another id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagecorpus.llm import common as C
from pagecorpus.session import materialize

SHINGLE = 4
TARGET = 8 * C.MB
MEMBERS = 1500
#: Linked when PART * intersection >= SHARE * union, unless a caller gives another share.
SHARE, PART = 85, 100


def shingle_set(text, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(C.shingle_hashes(C.word_hashes(C.words_of(text)), width))


def linked(overlap, n, m, share: int = SHARE):
    return (PART + share) * overlap >= share * (n + m)


def prefix_length(n: int, share: int = SHARE) -> int:
    return n - -(-share * n // PART) + 1


# ---- 1: global order --------------------------------------------------------------------------
def _heads(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    heads = np.concatenate(sets) >> np.uint64(32) if sets else np.empty(0, np.uint64)
    return np.unique(heads, return_counts=True)


def _cuts(heads: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(heads, np.array([(i << 32) // n for i in range(n + 1)], np.uint64))


def frequencies(blocks: DataFrame, n: int, width: int = SHINGLE) -> DataFrame:
    """(block, part, classes): the frequency class of each head of a block, in the order of heads:
    0 if it occurs once in the whole corpus, else 1 + floor(log2 of its count)."""
    def ask(key, pdf):
        heads, counts = _heads([shingle_set(t, width) for t in pdf["text"]])
        cut = _cuts(heads, n)
        rows = [(key[0], i, C.pack_sorted(heads[cut[i]:cut[i + 1]]), C.pack(counts[cut[i]:cut[i + 1]].astype("<i4"))) for i in range(n)]
        del heads, counts
        C.release()
        return pd.DataFrame(rows, columns=["block", "part", "heads", "counts"])

    def answer(key, pdf):
        heads = [C.unpack_sorted(x) for x in pdf["heads"]]
        every = np.concatenate(heads)
        order = np.argsort(every)
        ordered = every[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(every) else np.empty(0, np.int64)
        n_docs = np.add.reduceat(np.concatenate([C.unpack(x, "<i4") for x in pdf["counts"]])[order], first) if len(every) else first
        names = ordered[first]
        klass = np.where(n_docs > 1, 1 + np.log2(np.maximum(n_docs, 1)).astype(np.int64), 0).astype(np.uint8)
        return pd.DataFrame({"block": pdf["block"], "part": pdf["part"], "classes": [C.pack(klass[np.searchsorted(names, h)]) for h in heads]})
    asked = blocks.groupBy("block").applyInPandas(ask, "block int, part int, heads binary, counts binary")
    return asked.groupBy("part").applyInPandas(answer, "block int, part int, classes binary")


# ---- 2, 3: classes, prefixes, families --------------------------------------------------------
def prefixes(blocks: DataFrame, classes: DataFrame, width: int = SHINGLE, share: int = SHARE) -> DataFrame:
    """One row for each document: size of its set, a 128-bit name of the set, the shared shingles
    of its prefix, and the text where there are any."""
    def run(pdf, got):
        sets = [shingle_set(t, width) for t in pdf["text"]]
        heads, _ = _heads(sets)
        got = got.sort_values("part")
        klass = np.concatenate([C.unpack(x, np.uint8) for x in got["classes"]]) if len(got) else np.empty(0, np.uint8)
        out = []
        for doc_id, text, s in zip(pdf["doc_id"], pdf["text"], sets, strict=True):
            n = len(s)
            c = klass[np.searchsorted(heads, s >> np.uint64(32))]
            first = np.lexsort((s, c))[:prefix_length(n, share)] if n else np.empty(0, np.int64)
            shared = s[first[c[first] > 0]]
            name = xxhash.xxh128_digest(s.tobytes())
            out.append((doc_id, n, int.from_bytes(name[:8], "big", signed=True), int.from_bytes(name[8:], "big", signed=True),
                        shared.astype(np.int64), text if len(shared) else None))
        del sets, heads, klass
        C.release()
        return pd.DataFrame(out, columns=["doc_id", "n", "k1", "k2", "shared", "text"]).astype({"doc_id": "Int64"})
    return (blocks.groupBy("block").cogroup(classes.groupBy("block"))
            .applyInPandas(run, "doc_id long, n long, k1 long, k2 long, shared array<long>, text string"))


def families(reps: DataFrame) -> DataFrame:
    """(id, component): classes connected by a shared prefix shingle."""
    e = reps.select("rep", F.explode("shared").alias("s"))
    hubs = e.groupBy("s").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).where("n > 1").select("s", "hub")
    return C.components(e.join(hubs, "s").select(F.col("rep").alias("a"), F.col("hub").alias("b")).where("a <> b").distinct())


# ---- 4: trie join -----------------------------------------------------------------------------
class Trie:
    """Radix trie of rank sequences (ascending arrays).  Nodes stand in breadth-first order, the
    children of a node side by side."""

    def __init__(self, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        nodes: list[list] = [[-1, 0, 0, -1, []]]  # parent, start and end depth, a set that holds the path, members
        stack = [0]
        before = None
        for i in order:
            s = sets[i]
            common = 0
            if before is not None:
                m = min(len(before), len(s))
                differ = np.flatnonzero(before[:m] != s[:m])
                common = int(differ[0]) if len(differ) else m
            last = None
            while nodes[stack[-1]][2] > common:
                last = stack.pop()
            if last is not None and nodes[stack[-1]][2] < common:  # cut the edge to the last node
                old = nodes[last]
                nodes.append([stack[-1], nodes[stack[-1]][2], common, old[3], []])
                old[0], old[1] = len(nodes) - 1, common
                stack.append(len(nodes) - 1)
            if len(s) > nodes[stack[-1]][2]:
                nodes.append([stack[-1], nodes[stack[-1]][2], len(s), i, []])
                stack.append(len(nodes) - 1)
            nodes[stack[-1]][4].append(i)
            before = s
        children: list[list[int]] = [[] for _ in nodes]
        for k in range(1, len(nodes)):
            children[nodes[k][0]].append(k)
        bfs = [0]
        for k in bfs:
            bfs.extend(children[k])
        place = {k: j for j, k in enumerate(bfs)}
        self.child = np.array([place[children[k][0]] if children[k] else 0 for k in bfs])
        self.n_child = np.array([len(children[k]) for k in bfs])
        self.depth = np.array([nodes[k][2] for k in bfs])
        self.length = np.array([nodes[k][2] - nodes[k][1] for k in bfs])
        self.members = [nodes[k][4] for k in bfs]
        self.has = np.array([bool(m) for m in self.members])
        segments = [sets[nodes[k][3]][nodes[k][1]:nodes[k][2]] if nodes[k][3] >= 0 else np.empty(0, np.int64) for k in bfs]
        self.flat = np.concatenate(segments).astype(np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.last = np.array([int(s[-1]) if len(s) else -1 for s in segments])
        self.least, self.most = self.depth.copy(), self.depth.copy()
        self.least[~self.has] = np.iinfo(np.int64).max
        for j in range(len(bfs) - 1, 0, -1):
            up = place[nodes[bfs[j]][0]]
            self.least[up] = min(self.least[up], self.least[j])
            self.most[up] = max(self.most[up], self.most[j])

    def probe(self, s: np.ndarray, mark: np.ndarray, share: int = SHARE) -> list[tuple[int, int]]:
        """(member, overlap) of each stored set that links to ``s``.  ``mark`` is a scratch array
        over ranks, all False."""
        mark[s] = True
        n, out = len(s), []
        at = np.zeros(1, np.int64)
        overlap = np.zeros(1, np.int64)
        while len(at):
            kids = C.concat_ranges(self.child[at], self.n_child[at])
            overlap = np.repeat(overlap, self.n_child[at])
            if not len(kids):
                break
            tokens = C.concat_ranges(self.start[kids], self.length[kids])
            overlap = overlap + np.add.reduceat(mark[self.flat[tokens]].astype(np.int64), np.cumsum(self.length[kids]) - self.length[kids])
            for j in np.flatnonzero(self.has[kids] & linked(overlap, n, self.depth[kids], share)):
                out.extend((m, int(overlap[j])) for m in self.members[kids[j]])
            rest = np.minimum(n - np.searchsorted(s, self.last[kids], "right"), self.most[kids] - self.depth[kids])
            stay = (self.n_child[kids] > 0) & linked(overlap + rest, n, self.least[kids], share)
            at, overlap = kids[stay], overlap[stay]
        mark[s] = False
        return out


def group_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, share: int = SHARE) -> list[tuple[int, int]]:
    """Links that span the components among the pairs of the sets ``left`` and ``right``."""
    names, local, n_sets = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(names), np.int64)
    rank[np.lexsort((names, -n_sets))] = np.arange(len(names))
    cut = np.cumsum([len(s) for s in sets])[:-1]
    ranked = [np.sort(x) for x in np.split(rank[local], cut)]
    trie = Trie([ranked[i] for i in left])
    mark = np.zeros(len(names), bool)
    union, out = C.Sets(len(sets)), []
    for j in right:
        for m, _ in trie.probe(ranked[j], mark, share):
            if union.join(int(left[m]), int(j)):
                out.append((int(left[m]), int(j)))
    return out


def trie_links(members: DataFrame, limit: int = MEMBERS, *, width: int = SHINGLE, share: int = SHARE) -> DataFrame:
    """(a, b) links among ``members`` (family, rep, text), spanning within each task."""
    sizes = members.groupBy("family").agg(F.count("*").alias("n"))
    m = members.join(sizes, "family")
    groups = F.ceil(F.col("n") / limit).cast("int")
    own = F.pmod(F.xxhash64("rep"), groups.cast("long")).cast("int")
    m = m.select("family", "rep", "text", own.alias("own"), groups.alias("groups"))
    pairs = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    pairs = pairs.withColumn("g0", F.least("own", "other")).withColumn("g1", F.greatest("own", "other"))

    def run(key, pdf):
        sets = [shingle_set(t, width) for t in pdf["text"]]
        own, reps = pdf["own"].to_numpy(), pdf["rep"].to_numpy()
        left, right = np.flatnonzero(own == key[1]), np.flatnonzero(own == key[2])
        links = group_links(sets, left, right, share) if len(left) and len(right) else []
        del sets
        C.release()
        return pd.DataFrame([(reps[a], reps[b]) for a, b in links], columns=["a", "b"], dtype="int64")
    return pairs.select("family", "g0", "g1", "own", "rep", "text").groupBy("family", "g0", "g1").applyInPandas(run, "a long, b long")


# ---- all --------------------------------------------------------------------------------------
def join(docs: DataFrame, width: int = SHINGLE, share: int = SHARE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text): shingles of ``width``
    words, links from a similarity of ``share`` in a hundred."""
    d = docs.select("doc_id", "text")
    n = C.blocks_for(C.total_bytes(d), TARGET)
    blocks = C.in_blocks(d, n, "doc_id", "text")
    classes = materialize(frequencies(blocks, n, width), "join_classes")
    rows = materialize(prefixes(blocks, classes, width, share), "join_prefixes")
    named = rows.where("n > 0 and doc_id is not null")
    copies = named.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    candidates = named.where(F.size("shared") > 0).select("doc_id", "k1", "k2", "shared")
    reps = materialize(candidates.join(copies, ["k1", "k2"]).where("doc_id = rep").dropDuplicates(["rep"]).select("rep", "shared"), "join_reps")
    family = materialize(families(reps).select(F.col("id").alias("rep"), F.col("component").alias("family")), "join_families")
    texts = rows.where(F.col("text").isNotNull()).select(F.col("doc_id").alias("rep"), "text", "k1", "k2")
    members = texts.join(copies.select("k1", "k2", "rep"), ["k1", "k2", "rep"]).join(family, "rep").dropDuplicates(["rep"]).select("family", "rep", "text")
    found = C.components(trie_links(members, width=width, share=share)).select(F.col("id").alias("rep"), "component")
    top = copies.join(found, "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("component"))
    out = rows.select("doc_id", "n", "k1", "k2").join(top, ["k1", "k2"], "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
    return out


def keep_one(docs: DataFrame, width: int = SHINGLE, share: int = SHARE) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest doc_id (equal ids:
    the smallest hash of the text, then any of equal rows).  Texts without words are kept."""
    cols = [F.col(f"`{c}`") for c in docs.columns]
    found = materialize(join(docs, width, share).where("doc_id is not null"), "join_result")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__id")).distinct()
    kept = docs.join(C.small(gone), F.col("doc_id") == F.col("__id"), "left_anti")
    again = found.where("doc_id = component_id").groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("__n")).where("__n > 1").select("__id")
    if again.isEmpty():
        return kept.select(*cols)
    again = C.small(again)
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), F.monotonically_increasing_id())
    many = kept.join(again, F.col("doc_id") == F.col("__id")).withColumn("__r", F.row_number().over(first)).where("__r = 1")
    return kept.join(again, F.col("doc_id") == F.col("__id"), "left_anti").select(*cols).unionByName(many.select(*cols))
