"""Operator 1, document fingerprints: one-permutation MinHash with optimal densification and
packed low-order bits.

The hashes of a text's five-word shingles are dealt once to ``BINS`` bins by their top bits;
each bin keeps its smallest hash.  An empty bin copies from the first non-empty bin of its own
fixed random order of all bins (optimal densification: each non-empty bin is equally likely,
and two texts choose alike).  Of every bin the low ``BITS`` bits are stored.  The likeness of
two fingerprints is the share of equal bins, corrected for chance equality.

Defined results: null text = empty text; texts without words share one fingerprint; fewer than
five words are one shingle; the order for "next" is ascending doc_id (nulls first), equal ids
by text; a table of one row is its own next document.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagecorpus.llm import common as C

SHINGLE = 5
BINS = 512
BITS = 4
TARGET = 16 * C.MB
_LOG = BINS.bit_length() - 1
#: Each bin's random order of all bins, and each bin's rank in that order.
_ORDER = np.argsort(np.random.default_rng(20240).random((BINS, BINS)), axis=1).astype(np.int64)
_RANK = np.argsort(_ORDER, axis=1).astype(np.int16)
_FEW = 24
_NO_WORDS = np.array([0x5851F42D4C957F2D], np.uint64)


def signature(text) -> np.ndarray:
    """The low bits (0 to 2**BITS-1) of each bin."""
    s = C.shingle_hashes(C.word_hashes(C.words_of(text)), SHINGLE)
    s = np.sort(s) if len(s) else _NO_WORDS
    bins = (s >> np.uint64(64 - _LOG)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))  # the smallest hash of each bin stands first
    full = bins[first]
    out = np.zeros(BINS, np.uint8)
    out[full] = (s[first] & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    if len(full) <= _FEW:
        return out[full[np.argmin(_RANK[:, full], axis=1)]] if len(full) > 1 else np.full(BINS, out[full[0]])
    has = np.zeros(BINS, bool)
    has[full] = True
    todo = np.flatnonzero(~has)
    step = 0
    while len(todo):
        pick = _ORDER[todo, step]
        ok = has[pick]
        out[todo[ok]] = out[pick[ok]]
        todo = todo[~ok]
        step += 1
    return out


def packed(sig: np.ndarray) -> str:
    return base64.b64encode((sig[0::2] << 4 | sig[1::2]).tobytes()).decode()


def unpacked(fingerprint: str) -> np.ndarray:
    b = np.frombuffer(base64.b64decode(fingerprint), np.uint8)
    return np.stack([b >> 4, b & 15], axis=1).ravel()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity: equal bins less those equal by chance."""
    chance = 1.0 / (1 << BITS)
    return float(min(1.0, max(0.0, (np.count_nonzero(a == b) / BINS - chance) / (1 - chance))))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row of ``docs`` (doc_id, text); narrow, no shuffle."""
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fingerprint": [packed(signature(t)) for t in pdf["text"]]})
    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The text with its last quarter of code points replaced by the first of the next one."""
    k = len(text) // 4
    return text[:len(text) - k] + following[:k]


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (_bucket, _tail, doc_id, text), range-partitioned and sorted so that each document
    is followed by the next one of the whole table.  Text is shuffled once.  The last document
    of a bucket is followed by a copy (``_tail`` = 1) of the first one of the next bucket."""
    spark = docs.sparkSession
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d, n = C.id_buckets(d, C.blocks_for(C.total_bytes(d), TARGET))
    # a row for each bucket: bounded by the number of buckets
    heads = sorted((r[0], r[1]) for r in d.groupBy("_bucket").agg(F.min("doc_id")).collect())
    if not heads:
        return d.select("_bucket", F.lit(0).alias("_tail"), "doc_id", "text")
    follow = [(heads[i][0], heads[i][0] if len(heads) == 1 else heads[i - 1][0], heads[i][1]) for i in range(len(heads))]
    small = F.broadcast(spark.createDataFrame(follow, "_bucket int, _before int, _first long"))
    tails = (d.join(small, "_bucket").where(F.col("doc_id").eqNullSafe(F.col("_first")))
             .groupBy(F.col("_before").alias("_bucket"), "doc_id").agg(F.min("text").alias("text")))
    rows = d.select("_bucket", F.lit(0).alias("_tail"), "doc_id", "text").unionByName(
        tails.select("_bucket", F.lit(1).alias("_tail"), "doc_id", "text"))
    return rows.repartition(n, "_bucket").sortWithinPartitions("_bucket", "_tail", F.col("doc_id").asc_nulls_first(), "text")


SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def edit_report(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text and of its edited text, with their likeness and that of the
    next document's fingerprint."""
    def run(batches):
        last = None  # bucket, id, text, signature of the row before
        for pdf in batches:
            out = []
            for bucket, tail, doc_id, text in zip(pdf["_bucket"], pdf["_tail"], pdf["doc_id"], pdf["text"], strict=True):
                sig = signature(text)
                if last is not None and last[0] == bucket:
                    _, old_id, old, old_sig = last
                    new = edited(old, text)
                    new_sig = signature(new)
                    out.append((old_id, len(old), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(),
                                packed(old_sig), packed(new_sig), likeness(old_sig, new_sig), likeness(old_sig, sig)))
                last = None if tail else (bucket, None if pd.isna(doc_id) else int(doc_id), text, sig)
            if out:
                made = pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])
                yield made.astype({"doc_id": "Int64"})
    return with_next(docs).mapInPandas(run, SCHEMA)
