"""Operator 8, fuzzy line dedup by MinHash.

Lines (pieces between line feeds, without blanks at their ends, lower case) that are equal are one
class at once, named by a 64-bit hash.  The signature of a class has ``BANDS * ROWS`` minima over the
hashes of its ``SHINGLE``-character shingles (in UTF-8 bytes; each minimum under an odd factor and a
term of its own, since minima under XOR masks that agree in their top bits fall on the same shingle);
lines with an equal band of ``ROWS`` minima are candidates.  At similarity 0.8 a pair shares a band
with probability 1 - (1 - 0.8**6)**18 = 0.996, and one of similarity 0.1 with 0.00002.  Candidates are
verified by the exact Jaccard similarity of their character shingles (0.8 or more), as arrays of numbers
that stand for the shingles one to one.

Round 1 verifies each line against the smallest line of each of its bands and joins the links by
distributed union-find.  Round 2 looks at the other lines of the bands where these still lie in different
components, once for each set of lines: tasks hold a band's lines, compare them (more than ``FEW``: search
them by their rarest shingles) and emit the links that join components, fewer than there are lines; no pairs
of a band are made.

Signatures and similarities are array work inside tasks: a form in DataFrame functions only took
more than five times the budget (README).  Joins, bands and union-find are DataFrame work.  Text is
read where it lies; only lines that have a candidate are shuffled.  Band rows are shuffled once.

Two of n distinct lines share a 64-bit name with a chance of about n * n / 2**65.

Defined results: blank lines are kept and belong to no component; lines shorter than ``SHINGLE``
are one shingle; a null text has no lines; equal (doc_id, line_no) rows each count.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagecorpus.llm import common as C
from pagecorpus.session import materialize

SHINGLE = 5
ROWS, BANDS = 6, 18
SHARE, PART = 80, 100
_RNG = np.random.default_rng(8)
_FACTORS = _RNG.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint32) | np.uint32(1)
_TERMS = _RNG.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint32)
_FOLD = _RNG.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
#: Characters of lines signed at a time, few enough that their hashes stay in a core's cache.
PIECE = 1 << 17
#: Names of lines that a task remembers.
KNOWN = 1 << 19
#: Lines of a band that a task holds from each of two groups.
MEMBERS = 2000
#: Lines of a band that are compared without an index.
FEW = 256
#: Characters of pairs of lines that are verified at a time.
CHARS = 1 << 18
#: Bits of a band's key; a clash costs a comparison only.
KEY = np.uint64((1 << 48) - 1)
BLANKS = " \t\r"


def line_name(line: str) -> int:
    x = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"))
    return x - (1 << 64) if x >> 63 else x


def signatures(lines: list[bytes]) -> np.ndarray:
    """Band keys, one row for each line (no line is empty)."""
    padded = [x if len(x) >= SHINGLE else x + b"\n" * (SHINGLE - len(x)) for x in lines]
    a = np.frombuffer(b"".join(padded), np.uint8)
    ends = np.cumsum([len(x) for x in padded])
    code = np.zeros(len(a) - SHINGLE + 1, np.uint64)
    for j in range(SHINGLE):
        code |= a[j:len(code) + j].astype(np.uint64) << np.uint64(8 * j)
    keep = np.ones(len(code), bool)
    for back in range(1, SHINGLE):  # shingles that run over into the next line
        keep[ends[:-1] - back] = False
    n = np.array([len(x) - SHINGLE + 1 for x in padded])
    h = (C.mix64(code[keep]) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum(n) - n
    minima = np.empty((ROWS * BANDS, len(lines)), np.uint32)
    x = np.empty_like(h)
    for m, t, least in zip(_FACTORS, _TERMS, minima, strict=True):
        np.multiply(h, m, out=x)
        np.add(x, t, out=x)
        np.minimum.reduceat(x, starts, out=least)
    minima = minima.T.reshape(len(lines), BANDS, ROWS).astype(np.uint64)
    return (C.mix64((minima * _FOLD).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)) & KEY).view(np.int64)


def lines_of(text) -> list[tuple[int, str]]:
    """(line number, line as it is compared) of the lines that are not blank."""
    if not isinstance(text, str):
        return []
    return [(i, low) for i, raw in enumerate(text.split("\n")) if (low := raw.strip(BLANKS).lower())]


def marks(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, k) of every line that is not blank."""
    def run(batches):
        for pdf in batches:
            ids, no, names = [], [], []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                for i, line in lines_of(text):
                    ids.append(doc_id)
                    no.append(i)
                    names.append(line_name(line))
            yield pd.DataFrame({"doc_id": pd.Series(ids, dtype="Int64"), "line_no": pd.Series(no, dtype="int32"), "k": pd.Series(names, dtype="int64")})
    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, line_no int, k long")


def new_lines(batches):
    """(name, line) of the lines that a task meets for the first time, in lists of about ``PIECE`` characters.
    What it has met is forgotten after ``KNOWN`` lines, so a line may come again."""
    seen: set[int] = set()
    out, size = [], 0
    for pdf in batches:
        for text in pdf["text"]:
            for _, line in lines_of(text):
                k = line_name(line)
                if k not in seen:
                    seen.add(k)
                    out.append((k, line))
                    size += len(line)
                    if size >= PIECE:
                        yield out
                        out, size = [], 0
            if len(seen) > KNOWN:
                seen.clear()
    if out:
        yield out


def bands(docs: DataFrame) -> DataFrame:
    """(k, band) of the lines: every band of each, perhaps more than once."""
    def run(batches):
        for found in new_lines(batches):
            keys = signatures([line.encode("utf-8", "surrogatepass") for _, line in found])
            yield pd.DataFrame({"k": np.repeat(np.array([k for k, _ in found], np.int64), BANDS), "band": keys.ravel()})
    return docs.select("text").mapInPandas(run, "k long, band long")


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(k, line) of the wanted lines (k)."""
    def run(batches):
        for found in new_lines(batches):
            yield pd.DataFrame(found, columns=["k", "line"])
    every = docs.select("text").mapInPandas(run, "k long, line string")
    return every.join(C.small(wanted), "k", "left_semi").dropDuplicates(["k"])


def shingles(line: str) -> set[str]:
    return {line[i:i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def similar(a: set[str], b: set[str]) -> bool:
    if min(len(a), len(b)) * PART < max(len(a), len(b)) * SHARE:
        return False
    common = len(a & b)
    return (PART + SHARE) * common >= SHARE * (len(a) + len(b))


def coded(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, sizes): the distinct shingles of each line, line after line, ascending within each, as numbers that are
    equal for equal shingles and for no others; and how many each line has."""
    padded = [x if len(x) >= SHINGLE else x + "\n" * (SHINGLE - len(x)) for x in lines]  # no line holds a line feed
    a = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    there = np.zeros(int(a.max()) + 1, bool)
    there[a] = True
    place = np.cumsum(there) - 1
    a, base = place[a], int(place[-1]) + 1
    n = len(a) - SHINGLE + 1

    def run(start: int, width: int) -> np.ndarray:
        x = a[start:start + n].copy()
        for j in range(start + 1, start + width):
            x = x * base + a[j:j + n]
        return x
    if base ** SHINGLE < 1 << 63:
        code = run(0, SHINGLE)
    else:  # three letters and two are numbered first
        head, tail = (np.unique(run(*x), return_inverse=True)[1] for x in ((0, 3), (3, SHINGLE - 3)))
        code = head * (int(tail.max()) + 1) + tail
    ends = np.cumsum([len(x) for x in padded])
    keep = np.ones(n, bool)
    for back in range(1, SHINGLE):  # shingles that run over into the next line
        keep[ends[:-1] - back] = False
    code = code[keep]
    if (int(code.max()) + 1) * len(lines) >= 1 << 63:
        code = np.unique(code, return_inverse=True)[1]
    span = int(code.max()) + 1
    owner = np.repeat(np.arange(len(lines)), [len(x) - SHINGLE + 1 for x in padded])
    both = np.sort(owner * span + code)  # np.unique takes ten times as long
    both = both[np.append(True, both[1:] != both[:-1])]
    owner = both // span
    return both - owner * span, np.bincount(owner, minlength=len(lines))


def alike(common, a, b):
    """``similar`` by the sizes of an intersection and of the two sets."""
    return (PART + SHARE) * common >= SHARE * (a + b)


def similar_pairs(a: list[str], b: list[str]) -> np.ndarray:
    """Whether the lines of each pair are similar."""
    codes, sizes = coded(a + b)
    span = int(codes.max()) + 1
    if span * len(a) >= 1 << 63:
        codes = np.unique(codes, return_inverse=True)[1]
        span = int(codes.max()) + 1
    at = np.repeat(np.arange(len(a) + len(b)) % len(a), sizes) * span + codes
    both = np.sort(at)
    common = np.bincount(both[1:][both[1:] == both[:-1]] // span, minlength=len(a))
    return alike(common, sizes[:len(a)], sizes[len(a):])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of lines whose shingle sets have the similarity asked for."""
    a = texts.select(F.col("k").alias("a"), F.col("line").alias("line_a"))
    b = texts.select(F.col("k").alias("b"), F.col("line").alias("line_b"))

    def run(batches):
        for pdf in batches:
            lines = pdf["line_a"].str.len() + pdf["line_b"].str.len()
            for _, part in pdf.groupby(lines.cumsum() // CHARS):
                good = similar_pairs(part["line_a"].tolist(), part["line_b"].tolist())
                yield part.loc[good, ["a", "b"]]
    met = pairs.join(a, "a").join(b, "b")
    return met.select("a", "b", "line_a", "line_b").mapInPandas(run, "a long, b long")


def near_lines(docs: DataFrame) -> DataFrame:
    """(band, k, head) of the lines that share a band, and its smallest; the band rows are shuffled, sorted and read once."""
    band = Window.partitionBy("band")
    b = bands(docs).select("k", "band", F.min("k").over(band).alias("head"), F.max("k").over(band).alias("other"))
    return b.where("head < other").select("band", "k", "head").distinct()


def line_components(docs: DataFrame) -> DataFrame:
    """(id, component) of the distinct lines that have a near copy."""
    near = materialize(near_lines(docs), "line_near")
    texts = materialize(texts_of(docs, near.select("k").distinct()), "line_texts")
    star = near.where("k <> head").select(F.col("k").alias("a"), F.col("head").alias("b")).distinct()
    links = materialize(verified(star, texts), "line_links")
    first = materialize(C.components(links), "line_first").withColumnRenamed("id", "k")
    left = materialize(open_bands(near, first), "line_unsure")
    return C.components(links.unionByName(spanning_links(left, texts)))


def open_bands(near: DataFrame, first: DataFrame) -> DataFrame:
    """(band, k, c) of the lines whose pairs round two looks at.  The pairs with a band's smallest line are verified, so
    it stays out; a band whose other lines lie in one component needs nothing, and of bands with the same lines (by
    number, ends and a 64-bit hash of the set) one stands for all."""
    others = near.where("k <> head").join(first, "k", "left").select("band", "k", F.coalesce("component", "k").alias("c"))
    sets = others.groupBy("band").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("n"), F.min("k").alias("k0"),
                                      F.max("k").alias("k1"), F.bit_xor(F.xxhash64("k")).alias("x")).where("c0 <> c1")
    chosen = sets.groupBy("n", "k0", "k1", "x").agg(F.min("band").alias("band")).select("band")
    return others.join(chosen, "band", "left_semi")


def spanning_links(left: DataFrame, texts: DataFrame, members: int = MEMBERS) -> DataFrame:
    """Links (a, b) between the components of ``left`` (band, k, c): of each band as many as join its components,
    never its pairs.  A band of more than ``members`` lines is worked on in pairs of groups."""
    groups = left.groupBy("band").agg(F.ceil(F.count("*") / members).cast("int").alias("groups"))
    rows = left.join(groups, "band").withColumn("own", F.pmod(F.xxhash64("k"), "groups").cast("int"))
    rows = rows.select("band", "k", "c", "own", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"))
    rows = rows.select("band", F.least("own", "g").alias("g0"), F.greatest("own", "g").alias("g1"), "own", "k", "c")

    def run(batches):
        last, held = None, []
        for pdf in batches:
            found = []
            for band, g0, g1, *row in zip(*(pdf[x] for x in ("band", "g0", "g1", "own", "k", "c", "line")), strict=True):
                if (band, g0, g1) != last:
                    found += spanning(held)
                    last, held = (band, g0, g1), []
                held.append(row)
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")
        yield pd.DataFrame(spanning(held), columns=["a", "b"], dtype="int64")

    placed = rows.join(texts, "k").repartition("band", "g0", "g1").sortWithinPartitions("band", "g0", "g1", "k")
    return placed.select("band", "g0", "g1", "own", "k", "c", "line").mapInPandas(run, "a long, b long")


def spanning(rows: list) -> list[tuple[int, int]]:
    """Verified pairs that join the components of lines (group, k, c, line), at most one for each joining.
    Candidates share one of the rarest shingles of each: of two sets with a similarity of ``SHARE``, the
    rarest that exceed what may differ have one in common."""
    if len({r[2] for r in rows}) < 2:
        return []
    place: dict[int, int] = {}
    comp = [place.setdefault(r[2], len(place)) for r in rows]
    up, found = C.Sets(len(place)), []

    def joined(i: int, j: int) -> bool:
        return up.find(comp[i]) == up.find(comp[j])

    def link(i: int, j: int) -> None:
        up.join(comp[i], comp[j])
        found.append((max(rows[i][1], rows[j][1]), min(rows[i][1], rows[j][1])))

    if len(rows) <= FEW:  # so few are compared faster than they are indexed
        codes, sizes = coded([r[3] for r in rows])
        _, codes = np.unique(codes, return_inverse=True)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        held = np.zeros(int(codes.max()) + 1, np.int32)
        for i in range(1, len(rows)):
            if all(joined(i, j) for j in range(i)):
                continue
            mine = codes[starts[i]:ends[i]]
            held[mine] = 1
            common = np.add.reduceat(held[codes[:starts[i]]], starts[:i])
            held[mine] = 0
            for j in np.flatnonzero(alike(common, sizes[i], sizes[:i])):
                if not joined(i, j):
                    link(i, j)
        return found
    sets = [shingles(r[3]) for r in rows]
    often: dict[str, int] = {}
    for s in sets:
        for x in s:
            often[x] = often.get(x, 0) + 1
    cross = len({r[0] for r in rows}) > 1
    index: dict[str, list[int]] = {}
    for i, s in enumerate(sets):
        met = set()
        for x in sorted(s, key=lambda x: (often[x], x))[:len(s) - -(-len(s) * SHARE // PART) + 1]:
            at = index.setdefault(x, [])
            for j in at:
                if j not in met and not (cross and rows[i][0] == rows[j][0]):
                    met.add(j)
                    if not joined(i, j) and similar(sets[i], sets[j]):
                        link(i, j)
            at.append(i)
    return found


def fuzzy_lines(docs: DataFrame) -> DataFrame:
    """One row for each line that is not blank: (doc_id, line_no, line_id, component, keep).  Equal
    lines share line_id; ``keep`` marks the first line (smallest doc_id, then line_no) of a component."""
    marked = materialize(marks(docs), "line_marks")
    found = materialize(line_components(docs).select(F.col("id").alias("k"), "component"), "line_components")
    at = marked.select("doc_id", "line_no", "k").join(C.small(found), "k", "left")
    at = at.select("doc_id", "line_no", F.col("k").alias("line_id"), F.coalesce("component", "k").alias("component"))
    place = F.struct(F.col("doc_id").isNotNull().alias("x"), "doc_id", "line_no")
    first = at.groupBy("component").agg(F.min(place).alias("first"))
    return (at.join(first, "component")
            .select("doc_id", "line_no", "line_id", "component",
                    (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("line_no") == F.col("first.line_no"))).alias("keep")))


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every document with only the lines that are kept and its blank lines."""
    kept = fuzzy_lines(docs).where("keep").select(F.col("doc_id").alias("id2"), F.col("line_no").alias("no2")).distinct()
    d = docs.select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("line_no", "raw"))
    blank = F.trim(F.translate("raw", "\r\t", "  ")) == ""
    good = d.join(kept, F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("line_no") == F.col("no2")), "left")
    ordered = F.array_sort(F.collect_list(F.when(blank | F.col("no2").isNotNull(), F.struct("line_no", "raw"))))
    return good.groupBy("doc_id").agg(F.concat_ws("\n", F.transform(ordered, lambda x: x["raw"])).alias("text"))
