"""Operator 3, language-model scoring by context-tree weighting.

A text is the sequence of its UTF-8 bytes (A-Z in lower case) with one end byte (0xFF, which
UTF-8 never holds); before its start stand ``DEPTH`` of these.  Each byte is eight binary
decisions, one for each node of the byte's bit tree.  For every decision node there is a tree
of contexts (0 to ``DEPTH`` bytes back); each context keeps Krichevsky-Trofimov counts, and the
estimates of all depths are mixed with the context-tree weights

    P_w(s) = 1/2 P_kt(s) + 1/2 prod P_w(children of s),    P_w = P_kt at full depth.

The score is the log10 probability of the text under the tree learned from the training rows;
``bits_per_byte`` is the code length per byte.

Distribution.  Texts are dealt to blocks.  A block sends its distinct (context, byte) pairs,
with their counts among training rows, to ranges of the last two context bytes, as packed
sorted arrays.  A range sums the counts of all blocks, weights its subtrees, and answers every
block with the log probability of each pair that the block asked for; the two shallowest depths
(at most 257 contexts of 255 decisions, whatever the input) are combined in between.  The block
then adds up its texts.  Unseen pairs take part with count 0, so a text never misses an answer.
The word counts of the base score travel in the same rows.  Memory is bounded by a block and a
range; nothing of the model is held whole anywhere.

Defined results: null text = empty text (one end token); rows with null id train; with no
training rows every decision has probability 1/2 and the base score is 0; repeated rows count
each time.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagecorpus.llm import common as C
from pagecorpus.llm.common import CodeTable
from pagecorpus.session import materialize

DEPTH = 5
TARGET = 16 * C.MB
PIECE = 2 * C.MB
STOP = 0xFF
_U8, _U16 = np.uint64(8), np.uint64(16)
_LN2, _LNPI = math.log(2.0), math.log(math.pi)


# ---- pairs of a block -------------------------------------------------------------------------
def pieces(texts: list[bytes]):
    """(codes, row of each code): context bytes, the most recent one highest, then the next
    byte, for every byte and end of the texts, in arrays of about ``PIECE`` entries."""
    pad = bytes([STOP]) * DEPTH

    def codes(buffer: bytes) -> np.ndarray:
        a = np.frombuffer(buffer, np.uint8)
        n = len(a) - DEPTH
        out = a[DEPTH:].astype(np.uint64)
        for back in range(1, DEPTH + 1):
            out |= a[DEPTH - back:DEPTH - back + n].astype(np.uint64) << np.uint64(8 * (DEPTH + 1 - back))
        return out

    held: list[bytes] = []
    rows: list[int] = []
    size = 0

    def flush():
        whole = codes(b"".join(held))
        n = np.array([len(h) for h in held])
        ends = np.cumsum(n) - DEPTH  # the paddings between two texts are no predictions
        keep = np.ones(len(whole), bool)
        for e in ends[:-1]:
            keep[e:e + DEPTH] = False
        return whole[keep], np.repeat(np.array(rows), n - DEPTH)

    for i, t in enumerate(texts):
        seq = pad + t + bytes([STOP])
        for lo in range(0, len(seq) - DEPTH, PIECE):
            part = seq[lo:lo + PIECE + DEPTH]
            held.append(part)
            rows.append(i)
            size += len(part)
            if size >= PIECE:
                yield flush()
                held, rows, size = [], [], 0
    if held:
        yield flush()


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of each one's counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def block_pairs(texts: list[bytes], train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of the texts, in order, and their counts among the training rows."""
    table, counts = CodeTable(), np.zeros(0, np.int64)
    for code, row in pieces(texts):
        new = np.unique(code[table.find(code) < 0])
        if len(new):
            table.add(new)
            counts = np.concatenate([counts, np.zeros(len(new), np.int64)])
        counts += np.bincount(table.find(code[train[row]]), minlength=len(counts))
    order = np.argsort(table.codes)
    return table.codes[order], counts[order]


def ranges_of(codes: np.ndarray, n: int) -> np.ndarray:
    """Range of each pair, by its last two context bytes."""
    return (C.mix64(codes >> np.uint64(8 * (DEPTH - 1))) % np.uint64(n)).astype(np.int64)


# ---- the tree ---------------------------------------------------------------------------------
def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 1/2 by Stirling's series after moving x up by 8."""
    shift = np.zeros_like(x)
    z = x.copy()
    for _ in range(8):
        shift += np.log(z)
        z += 1
    r = 1 / z
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + r / 12 - r**3 / 360 + r**5 / 1260 - shift


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1.0) - _LNPI


def weighted(own: np.ndarray, children: np.ndarray) -> np.ndarray:
    return np.logaddexp(own, children) - _LN2


def decisions(next_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decision nodes (1 to 255) and bits of each byte, as (8, n) arrays."""
    level = np.arange(8, dtype=np.uint64)[:, None]
    node = np.uint64(1) << level | next_byte >> (_U8 - level)
    return node, (next_byte >> (np.uint64(7) - level) & np.uint64(1)).astype(np.int64)


class Tree:
    """Contexts of depth 2 to DEPTH of one range, from distinct pairs and their counts."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        node, self.bit = decisions(codes & np.uint64(0xFF))
        ones = (self.bit * counts).ravel().astype(float)
        zeros = ((1 - self.bit) * counts).ravel().astype(float)
        self.keys, self.at, self.n0, self.n1, self.own = {}, {}, {}, {}, {}
        for d in range(2, DEPTH + 1):
            context = codes >> np.uint64(8 * (DEPTH + 1 - d))
            keys, at = np.unique((context << _U8 | node).ravel(), return_inverse=True)
            self.keys[d], self.at[d] = keys, at.reshape(node.shape)
            self.n0[d] = np.bincount(at.ravel(), zeros, len(keys))
            self.n1[d] = np.bincount(at.ravel(), ones, len(keys))
            self.own[d] = log_kt(self.n0[d], self.n1[d])
        self.log_w = {DEPTH: self.own[DEPTH]}
        for d in range(DEPTH - 1, 1, -1):
            self.log_w[d] = weighted(self.own[d], self.to_parents(d + 1, self.keys[d], self.log_w[d + 1]))

    def to_parents(self, d: int, parents: np.ndarray, values: np.ndarray) -> np.ndarray:
        up = self.keys[d] >> _U16 << _U8 | self.keys[d] & np.uint64(0xFF)
        return np.bincount(np.searchsorted(parents, up), values, len(parents))

    def shallow(self) -> tuple[np.ndarray, ...]:
        """Keys of depth 1 with the sums over their children here: n0, n1, log P_w."""
        parents = np.unique(self.keys[2] >> _U16 << _U8 | self.keys[2] & np.uint64(0xFF))
        return (parents, *(self.to_parents(2, parents, v) for v in (self.n0[2], self.n1[2], self.log_w[2])))

    def log10_p(self, codes: np.ndarray, top: dict) -> np.ndarray:
        """log10 probability of each pair's byte, all depths mixed."""
        def kt(n0, n1):
            return (np.where(self.bit == 1, n1, n0) + 0.5) / (n0 + n1 + 1.0)
        p = None
        for d in range(DEPTH, 1, -1):
            at = self.at[d]
            here = kt(self.n0[d][at], self.n1[d][at])
            share = np.exp(self.own[d] - _LN2 - self.log_w[d])[at] if d < DEPTH else 1.0
            p = here if p is None else share * here + (1 - share) * p
        node, _ = decisions(codes & np.uint64(0xFF))
        last = codes >> np.uint64(8 * DEPTH)
        for at in ((last << _U8 | node).astype(np.int64) + 256, node.astype(np.int64)):  # depth 1, then 0
            share = top["share"][at]
            p = share * kt(top["n0"][at], top["n1"][at]) + (1 - share) * p
        return np.log10(p).sum(axis=0)


def top_of(rows) -> dict:
    """Depths 1 and 0 from the summed rows (key, n0, n1, log_w): dense arrays, depth 0 first,
    65 792 entries at any size of the input."""
    size = 257 * 256
    n0, n1, below = np.zeros(size), np.zeros(size), np.zeros(size)
    for key, a, b, w in rows:
        n0[256 + key], n1[256 + key], below[256 + key] = a, b, w
    own = log_kt(n0, n1)
    log_w = weighted(own, below)
    for part, values in ((n0, n0), (n1, n1), (below, log_w)):
        part[:256] = values[256:].reshape(256, 256).sum(axis=0)
    own[:256] = log_kt(n0[:256], n1[:256])
    log_w[:256] = weighted(own[:256], below[:256])
    return {"n0": n0, "n1": n1, "share": np.exp(own - _LN2 - log_w)}


# ---- distribution -----------------------------------------------------------------------------
_ASK = "block int, part int, codes binary, counts binary, words binary, word_counts binary"
_ANSWER = "block int, codes binary, log10_p binary, words binary, word_counts binary"


def _words_by_part(words: list[bytes], counts: np.ndarray, n: int):
    part = (C.word_hashes(words) % np.uint64(n)).astype(np.int64) if words else np.empty(0, np.int64)
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(n + 1))
    for r in range(n):
        at = order[cut[r]:cut[r + 1]]
        yield C.zlib.compress(b" ".join([words[i] for i in at]), 1), C.pack(counts[at].astype("<i8"))


def asked(blocks: DataFrame, n: int) -> DataFrame:
    """What each block asks of each range: its pairs and words with their training counts."""
    def run(key, pdf):
        from collections import Counter

        texts = [C.text_bytes(t) for t in pdf["text"]]
        train = ~pdf["held_out"].to_numpy(bool)
        codes, counts = block_pairs(texts, train)
        seen: Counter = Counter()
        known: Counter = Counter()
        for t, is_train in zip(texts, train, strict=True):
            (known if is_train else seen).update(t.split())
        words = list(known) + [w for w in seen if w not in known]
        word_counts = np.array([known[w] for w in words], np.int64)
        part = ranges_of(codes, n)
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(n + 1))
        out = [(key[0], r, C.pack_sorted(codes[order[cut[r]:cut[r + 1]]]), C.pack(counts[order[cut[r]:cut[r + 1]]].astype("<i8")), w, c)
               for r, (w, c) in enumerate(_words_by_part(words, word_counts, n))]
        return pd.DataFrame(out, columns=["block", "part", "codes", "counts", "words", "word_counts"])
    return blocks.groupBy("block").applyInPandas(run, _ASK)


def _merge(pdf):
    """Pairs of all blocks with their summed counts, and the summed word counts."""
    codes = [C.unpack_sorted(x) for x in pdf["codes"]]
    merged, counts = summed(np.concatenate(codes), np.concatenate([C.unpack(x, "<i8") for x in pdf["counts"]]))
    total: dict[bytes, int] = {}
    words = [C.zlib.decompress(x).split() for x in pdf["words"]]
    for some, c in zip(words, pdf["word_counts"], strict=True):
        for w, k in zip(some, C.unpack(c, "<i8").tolist(), strict=True):
            total[w] = total.get(w, 0) + k
    return codes, merged, counts, words, total


def sums(ask: DataFrame) -> tuple[dict, int, int]:
    """The two shallowest depths, the number of training words and of distinct ones."""
    def run(key, pdf):
        _, merged, counts, _, total = _merge(pdf)
        keys, n0, n1, w = Tree(merged, counts).shallow() if len(merged) else (np.empty(0, np.uint64), *[np.empty(0)] * 3)
        keys, n0, n1, w = keys.astype(np.int64), n0, n1, w
        seen = sum(1 for v in total.values() if v)
        return pd.DataFrame({"key": np.append(keys, -1), "n0": np.append(n0, sum(total.values())), "n1": np.append(n1, seen), "w": np.append(w, 0.0)})
    got = (ask.groupBy("part").applyInPandas(run, "key long, n0 double, n1 double, w double")
           .groupBy("key").agg(F.sum("n0"), F.sum("n1"), F.sum("w")).collect())  # at most 65 536 rows
    n, v = next(((int(r[1]), int(r[2])) for r in got if r[0] == -1), (0, 0))
    return top_of([tuple(r) for r in got if r[0] >= 0]), n, v


def answers(ask: DataFrame, top: dict) -> DataFrame:
    def run(key, pdf):
        codes, merged, counts, words, total = _merge(pdf)
        lp = Tree(merged, counts).log10_p(merged, top) if len(merged) else np.empty(0)
        return pd.DataFrame({"block": pdf["block"], "codes": pdf["codes"], "log10_p": [lp[np.searchsorted(merged, c)].astype("<f4").tobytes() for c in codes],
                             "words": pdf["words"], "word_counts": [C.pack(np.array([total[w] for w in some], "<i8")) for some in words]})
    return ask.groupBy("part").applyInPandas(run, _ANSWER)


SCHEMA = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, "
          "bits_per_byte double")


def score(docs: DataFrame, mod: int = 10, rest: int = 0) -> DataFrame:
    """Scores of all rows of ``docs`` (doc_id, text), learned from those that are not held out
    (crc32 of the id as text, modulo ``mod``, is ``rest``)."""
    d = docs.select("doc_id", "text", C.held_out("doc_id", mod, rest).alias("held_out"))
    n = C.blocks_for(C.total_bytes(d), TARGET)
    blocks = C.in_blocks(d, n, "doc_id", "text", "held_out")
    ask = materialize(asked(blocks, n), "lm_pairs")
    top, n_words, n_distinct = sums(ask)
    ends = d.where("not held_out").count()  # one end token for each training row
    total, distinct = n_words + ends, n_distinct + (ends > 0)
    floor = total + 0.1 * (distinct + 1)

    def run(pdf, got):
        texts = [C.text_bytes(t) for t in pdf["text"]]
        table = CodeTable()
        if len(got):
            table.add(np.concatenate([C.unpack_sorted(x) for x in got["codes"]]))
        lp = np.concatenate([np.empty(0), *(np.frombuffer(x, "<f4") for x in got["log10_p"])])
        points = np.zeros(len(texts))
        for code, row in pieces(texts):
            points += np.bincount(row, lp[table.find(code)], len(texts))
        known: dict[bytes, float] = {}
        for some, c in zip(got["words"], got["word_counts"], strict=True):
            known.update(zip(C.zlib.decompress(some).split(), np.log10((C.unpack(c, "<i8") + 0.1) / floor).tolist(), strict=True))
        unseen = math.log10((0 + 0.1) / floor)
        end_point = math.log10((ends + 0.1) / floor)
        out = []
        for i, (doc_id, held, t) in enumerate(zip(pdf["doc_id"], pdf["held_out"], texts, strict=True)):
            words = t.split()
            found = np.fromiter(map(known.__getitem__, words), float, len(words))
            n_known = np.count_nonzero(found > unseen + 1e-9) + (ends > 0)
            out.append((doc_id, bool(held), len(words) + 1, n_known, total, float(found.sum()) + end_point, points[i],
                        -points[i] / math.log10(2) / (len(t) + 1)))
        made = pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])
        return made.astype({"doc_id": "Int64", "n_known": "int64"})
    return (blocks.groupBy("block").cogroup(answers(ask, top).groupBy("block")).applyInPandas(run, SCHEMA))
