"""Operator 11, spelling variants of words by PartEnum signatures.

Words that differ by one inserted, deleted or replaced code point have letter multisets that, as
binary vectors (a dimension for the j-th occurrence of each letter), differ in one or two places:
two for a replaced letter (equal lengths), one for an inserted or deleted one (lengths differ by
one).  The dimensions are dealt to ``n`` parts, and a signature is the content of all parts but as
many as may differ, so near words share a signature for sure.  A signature also holds the length
class and one half of the word, since one edit leaves its first or its last half as it is.  Words
are equi-joined on signatures and each candidate is verified by its edit distance within the join.

A word's form is its near word of largest count if that is at least ``RATIO`` times its own; counts
at least double along a chain of forms, so chains are short and are followed by pointer doubling.

All joins are shuffled (merge hints).  Spark sizes a table by its compressed files, and the
signatures of a word by one row, so it would send either to the driver to broadcast it.

Defined results: a null text has no words; a null doc_id counts as the empty text in the hash; rows
that repeat count as often as they occur; ties go to the smallest word in code-point order; an
empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagecorpus.llm import common as C
from pagecorpus.session import materialize

MIN_LENGTH = 5
MIN_COUNT = 3
RATIO = 2
#: Parts of the dimensions for a distance of two and of one.
PARTS_2, PARTS_1 = 4, 3
#: Documents whose number and run have this factor in their crc32 lose a code point.
DELETE_MOD = 97
#: Words gathered for whole-array work, in signs.
GATHER = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Sides of the join: words of equal length, the shorter and the longer word of a pair.
EQUAL, SHORTER, LONGER = 0, 1, 2


def _result(doc_id: Column, run: Column) -> Column:
    """The run without one code point where the hash of document and run says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % DELETE_MOD == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def vocabulary(docs: DataFrame) -> DataFrame:
    """Rows (word, n) of all words that are long and frequent enough."""
    # a deletion only shortens, so shorter runs never become words
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(
        F.translate("text", _UPPER, _LOWER), F.lit(f"[a-zÀ-ÿ]{{{MIN_LENGTH},}}+"), F.lit(0))).alias("run"))
    words = runs.select(_result(F.col("doc_id"), F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= MIN_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT)


def _signatures(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(side, key of each word) of every signature of the words of one length, given as rows of code points."""
    n, length = codes.shape
    letters = np.sort(codes, axis=1).astype(np.uint64)
    new = np.ones((n, length), bool)
    new[:, 1:] = letters[:, 1:] != letters[:, :-1]
    place = np.arange(length)
    nth = place - np.maximum.accumulate(np.where(new, place, 0), axis=1)
    dims = C.mix64(letters * np.uint64(1 << 32) + nth.astype(np.uint64) + np.uint64(1))
    part = letters + nth.astype(np.uint64)
    plain = codes.astype(np.uint64) << np.uint64(32)
    zero = np.zeros(n, np.uint64)

    def halves(shorter: int) -> Iterator[np.ndarray]:
        """Hashes of the first and of the last half, for pairs whose shorter word has this length."""
        cut = shorter // 2
        for side, cols in ((1, slice(0, cut)), (2, slice(length - (shorter - cut), length))):
            one = plain[:, cols]
            yield C.mix64(C.mix64(one + np.arange(1, one.shape[1] + 1, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) + np.uint64(side))

    for parts, off, side, shorter in ((PARTS_2, 2, EQUAL, length), (PARTS_1, 1, SHORTER, length), (PARTS_1, 1, LONGER, length - 1)):
        of = part % np.uint64(parts)
        sums = [np.where(of == np.uint64(p), dims, np.uint64(0)).sum(axis=1, dtype=np.uint64) for p in range(parts)]
        for half in halves(shorter):
            for i, chosen in enumerate(combinations(range(parts), parts - off)):
                tag = np.uint64(((shorter * 64 + i) * 8 + parts) * 2 + (side == EQUAL))
                key = sum((C.mix64(sums[p] + np.uint64(p)) for p in chosen), zero)
                yield side, C.mix64(key ^ C.mix64(half + tag))


def _keyed(df: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for _, same in df.groupby(df["word"].str.len(), sort=False):
        codes = np.frombuffer("".join(same["word"]).encode("utf-32-le"), np.uint32).reshape(len(same), -1)
        sides, keys = zip(*_signatures(codes))
        many = len(sides)
        yield pd.DataFrame({"key": np.concatenate(keys).view(np.int64), "side": np.repeat(np.array(sides, np.int8), len(same)),
                            "word": np.tile(same["word"].to_numpy(), many), "n": np.tile(same["n"].to_numpy(), many)})


def _signature_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (key, side, word, n); small frames are gathered first, for whole-array work."""
    held: list[pd.DataFrame] = []
    size = 0
    for df in frames:
        held.append(df)
        size += len(df) * 16 + int(df["word"].str.len().sum())
        if size >= GATHER:
            yield from _keyed(pd.concat(held, ignore_index=True))
            held, size = [], 0
    if size:
        yield from _keyed(pd.concat(held, ignore_index=True))


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs (a, na, b, nb) of words (word, n) that one edit apart, each pair once."""
    rows = words.select("word", "n").mapInPandas(_signature_rows, "key long, side byte, word string, n long")
    left = rows.where(F.col("side") != LONGER).select("key", "side", F.col("word").alias("a"), F.col("n").alias("na"))
    right = rows.where(F.col("side") != SHORTER).select("key", F.col("side").alias("other"), F.col("word").alias("b"), F.col("n").alias("nb"))
    fits = ((F.col("side") == EQUAL) & (F.col("other") == EQUAL) & (F.col("a") < F.col("b"))
            | (F.col("side") == SHORTER) & (F.col("other") == LONGER))
    found = left.join(right.hint("merge"), (left["key"] == right["key"]) & fits & (F.levenshtein("a", "b", 1) == 1))
    return found.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form, from (word, form) rows."""
    up = materialize(forms.select("word", F.col("form").alias("up")), "spelling_up")
    while True:
        over = up.select(F.col("word").alias("up"), F.col("up").alias("up2"))
        nxt = materialize(up.join(over.hint("merge"), "up", "left").select("word", F.coalesce("up2", "up").alias("up"), F.col("up2").isNotNull().alias("moved")), "spelling_up")
        up = nxt.drop("moved")
        if nxt.where("moved").isEmpty():
            return up.select("word", F.col("up").alias("root"))


def variants(docs: DataFrame) -> DataFrame:
    """One row for each word: word, form, root, n, n_near, form_n."""
    words = materialize(vocabulary(docs), "spelling_words")
    sides = F.inline(F.array(F.struct(F.col("a").alias("word"), F.col("na").alias("n"), F.col("b").alias("other"), F.col("nb").alias("m")),
                             F.struct(F.col("b").alias("word"), F.col("nb").alias("n"), F.col("a").alias("other"), F.col("na").alias("m"))))
    best = (near_pairs(words).select(sides).groupBy("word")
            .agg(F.count("*").alias("n_near"), F.first("n").alias("n"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("top")))
    near = materialize(best.select("word", "n_near", (-F.col("top.m")).alias("m"), F.col("top.other").alias("other"), "n"), "spelling_near")
    good = F.col("m") >= RATIO * F.col("n")
    roots = _roots(near.where(good).select("word", F.col("other").alias("form")))
    forms = near.select("word", "n_near", F.when(good, F.col("other")).alias("form"), F.when(good, F.col("m")).alias("form_n")).join(roots.hint("merge"), "word", "left")
    return (words.join(forms.hint("merge"), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n"))
