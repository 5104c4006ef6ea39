"""Shared pieces of the corpus operators: blocks of text, word hashes, packed integer arrays,
range buckets and distributed connected components.

Defined results that hold for every operator here: a null text counts as the empty text; rows
that repeat count as often as they occur; operators read only the columns that they name, so
further columns may have any name; an empty table gives an empty result of the same schema.
"""

from __future__ import annotations

import math
import os
import zlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagecorpus.session import apply_session_conf, materialize

MB = 1 << 20
#: Words kept by the per-process hash cache before it is emptied.
CACHE_WORDS = 150_000
_WIDTH = 0x9E3779B97F4A7C15
_MULT = np.uint64(0xD1342543DE82EF95)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, with the session prepared for the Python workers."""
    apply_session_conf(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def text_bytes(text) -> bytes:
    """UTF-8 of a text with A-Z in lower case; a missing text is empty."""
    return text.encode("utf-8", "surrogatepass").lower() if isinstance(text, str) else b""


def words_of(text) -> list[bytes]:
    """Lower-case words ``[^\\x20\\x09-\\x0D]+`` (``bytes.split`` cuts at just these bytes)."""
    return text_bytes(text).split()


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _Hashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word."""
    if len(_HASHES) > CACHE_WORDS:
        _HASHES.clear()
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words; with fewer words, of the whole sequence."""
    n = len(h)
    if n == 0:
        return h
    width = min(k, n)
    m = n - width + 1
    acc = h[:m].copy()
    for j in range(1, width):
        acc *= _MULT
        acc += h[j:j + m]
    return mix64(acc + np.uint64(width * _WIDTH % (1 << 64)))


def pack_sorted(a: np.ndarray) -> bytes:
    """Ascending uint64 values as compressed differences, byte planes apart."""
    d = np.diff(a, prepend=a[:1] * 0) if len(a) else a
    return zlib.compress(np.ascontiguousarray(d.astype("<u8")).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack_sorted(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(b), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def pack(a: np.ndarray) -> bytes:
    """A small-valued array, compressed as it is."""
    return zlib.compress(np.ascontiguousarray(a).tobytes(), 1)


def unpack(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), dtype)


def release() -> None:
    """Give freed memory back to the system at the end of a task: workers are reused, and what the
    allocators keep would add up over the stages of a job."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def total_bytes(df: DataFrame, col: str = "text") -> int:
    return int(df.agg(F.coalesce(F.sum(F.octet_length(F.col(col)).cast("long")), F.lit(0))).first()[0])


def blocks_for(size: int, target: int) -> int:
    """Blocks of about ``target`` bytes for an input of ``size`` bytes."""
    return max(1, math.ceil(size / target))


def in_blocks(docs: DataFrame, n: int, *cols: str) -> DataFrame:
    """The rows dealt to ``n`` blocks by a hash of id and text, one shuffle.  ``block`` is a
    function of the row alone, so a repeated run finds the same blocks."""
    return (docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("block"), *cols)
            .repartition(n, "block"))


def id_cuts(docs: DataFrame, n: int) -> np.ndarray:
    """Approximate quantiles of doc_id that cut it into ``n`` buckets; equal ones once."""
    if n < 2:
        return np.empty(0, np.int64)
    row = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100_000)).first()
    return np.array(sorted({int(x) for x in (row[0] or [])}), np.int64)


def buckets_of(ids: pd.Series, cuts: np.ndarray) -> np.ndarray:
    """Bucket numbers that ascend with the id, from 1; 0 for nulls."""
    missing = ids.isna().to_numpy()
    out = np.searchsorted(cuts, ids.fillna(0).to_numpy(np.int64), side="right").astype(np.int32) + 1
    out[missing] = 0
    return out


def id_buckets(docs: DataFrame, n: int) -> tuple[DataFrame, int]:
    """``docs`` with an int column ``_bucket`` that ascends with ``doc_id`` (nulls come first),
    cut at ``n`` approximate quantiles; and the number of buckets."""
    cuts = id_cuts(docs, n)

    @F.pandas_udf(T.IntegerType())
    def bucket(ids: pd.Series) -> pd.Series:
        return pd.Series(buckets_of(ids, cuts))
    return docs.withColumn("_bucket", bucket("doc_id")), len(cuts) + 2


class Sets:
    """Union-find over small integers, for the members that one task holds."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        lo, hi = (a, b) if a < b else (b, a)
        self.up[hi] = lo
        return True


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b longs): rows (id, component), where
    component is the smallest id reachable.  Nodes without edges are not listed.

    Distributed union-find by contraction, in DataFrame operations only: every node points to
    its smallest neighbour, pointers are doubled until each tree is a star, edges are rewritten
    between roots, and those inside a tree go.  Each round leaves at most half of the nodes of
    a component.  Rounds end when no edge is left; tables between rounds are written to the
    shared checkpoint folder."""
    e = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .where("a <> b").distinct(), "cc_edges")
    found = None
    while not e.isEmpty():
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = materialize(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m"))
                         .select("id", F.least("id", "m").alias("up")), "cc_up")
        while True:
            over = up.select(F.col("id").alias("up"), F.col("up").alias("up2"))
            up2 = materialize(up.join(over, "up").select("id", F.col("up2").alias("up"), (F.col("up") != F.col("up2")).alias("moved")), "cc_up")
            moved = not up2.where("moved").isEmpty()
            up = up2.drop("moved")
            if not moved:
                break
        if found is None:
            found = up
        else:
            step = up.select(F.col("id").alias("up"), F.col("up").alias("top"))
            found = materialize(found.join(step, "up", "left").select("id", F.coalesce("top", "up").alias("up")), "cc_found")
        a = up.select(F.col("id").alias("a"), F.col("up").alias("ra"))
        b = up.select(F.col("id").alias("b"), F.col("up").alias("rb"))
        e = materialize(e.join(a, "a").join(b, "b").select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b"))
                        .where("a <> b").distinct(), "cc_edges")
    if found is None:
        return e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return found.select("id", F.col("up").alias("component"))


#: Rows of a narrow table up to which it is broadcast (a few ids each, some tens of MB).
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count proves it small; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def held_out(doc_id, mod: int, rest: int):
    """Whether crc32(doc_id as text) mod ``mod`` is ``rest``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod == rest, F.lit(False))


class CodeTable:
    """Place of each distinct code, by open addressing with whole arrays at a time."""

    def __init__(self, room: int = 1 << 16):
        self.codes = np.empty(0, np.uint64)
        self._make(room)

    def _make(self, room: int) -> None:
        self.shift = np.uint64(64 - (room.bit_length() - 1))
        self.mask = room - 1
        self.slots = np.full(room, -1, np.int32)
        self._place(np.arange(len(self.codes), dtype=np.int32))

    def _start(self, codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def _place(self, which: np.ndarray) -> None:
        at = self._start(self.codes[which])
        while len(which):
            free = self.slots[at] < 0
            self.slots[at[free]] = which[free]  # of several at one slot the last one stays
            lost = self.slots[at] != which
            which, at = which[lost], at[lost] + 1 & self.mask

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Place of each code, -1 if it is not there."""
        if not len(self.codes):
            return np.full(len(codes), -1, np.int32)
        at = self._start(codes)
        out = self.slots[at]
        todo = np.flatnonzero((out >= 0) & (self.codes[out] != codes))
        while len(todo):
            at[todo] = at[todo] + 1 & self.mask
            got = self.slots[at[todo]]
            out[todo] = got
            todo = todo[(got >= 0) & (self.codes[got] != codes[todo])]
        return out

    def add(self, codes: np.ndarray) -> None:
        """Distinct codes that are not there yet."""
        old = len(self.codes)
        self.codes = np.concatenate([self.codes, codes])
        if len(self.codes) * 3 > len(self.slots):
            self._make(1 << (len(self.codes) * 4).bit_length())
        else:
            self._place(np.arange(old, len(self.codes), dtype=np.int32))


def concat_ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The integers of the ranges ``start .. start+count-1``, one after the other."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(counts)
    out = np.ones(total, np.int64)
    keep = counts > 0
    starts, counts, ends = starts[keep], counts[keep], ends[keep]
    out[0] = starts[0]
    out[ends[:-1]] = starts[1:] - (starts[:-1] + counts[:-1]) + 1
    return np.cumsum(out)

