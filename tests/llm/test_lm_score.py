import math
import zlib
from collections import Counter

import pytest

from pagecorpus.llm import lm_score as S


def _held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def _log_kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


class _Plain:
    """Context-tree weighting with dictionaries and recursion."""

    def __init__(self, texts, depth):
        self.depth, self.n = depth, {}
        for t in texts:
            for context, byte in self.steps(t):
                for node, bit in self.path(byte):
                    for d in range(depth + 1):
                        self.n.setdefault((node, context[len(context) - d:]), [0, 0])[bit] += 1
        self.kids = {}
        for node, c in self.n:
            if c:
                self.kids.setdefault((node, c[1:]), []).append((node, c))
        self.cache = {}

    def steps(self, t):
        s = b"\xff" * self.depth + t + b"\xff"
        return [(s[i - self.depth:i], s[i]) for i in range(self.depth, len(s))]

    def path(self, byte):
        return [(1 << lv | byte >> (8 - lv), byte >> (7 - lv) & 1) for lv in range(8)]

    def log_w(self, key):
        if key not in self.cache:
            own = _log_kt(*self.n[key])
            if len(key[1]) < self.depth:
                below = sum(self.log_w(k) for k in self.kids.get(key, []))
                own = math.log(0.5 * math.exp(own) + 0.5 * math.exp(below)) if max(own, below) > -600 else max(own, below) + math.log(
                    0.5 * math.exp(own - max(own, below)) + 0.5 * math.exp(below - max(own, below)))
            self.cache[key] = own
        return self.cache[key]

    def score(self, t):
        total = 0.0
        for context, byte in self.steps(t):
            for node, bit in self.path(byte):
                p = None
                for d in range(self.depth, -1, -1):
                    key = (node, context[len(context) - d:])
                    n = self.n.get(key, [0, 0])
                    here = (n[bit] + 0.5) / (sum(n) + 1)
                    if p is None:
                        p = here
                    else:
                        share = math.exp(_log_kt(*n) + math.log(0.5) - self.log_w(key)) if key in self.n else 0.5
                        p = share * here + (1 - share) * p
                total += math.log10(p)
        return total


def _low(t):
    return (t or "").encode().lower()


def test_matches_plain_version(spark, documents, monkeypatch):
    rows = [(r.doc_id, r.text[:300]) for r in documents.orderBy("doc_id").limit(60).collect()] + [(1001, ""), (1002, None), (None, "Null id"), (1003, "中 x")]
    monkeypatch.setattr(S, "TARGET", 3000)  # several blocks and ranges
    monkeypatch.setattr(S, "PIECE", 700)
    got = {(r.doc_id): r for r in S.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    train = [_low(t) for i, t in rows if not _held(i)]
    plain = _Plain(train, S.DEPTH)
    counts = Counter(w for t in train for w in t.split())
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    for doc_id, t in rows:
        r, words = got[doc_id], _low(t).split()
        assert r.held_out == _held(doc_id) and r.train_tokens == n and r.n_tokens == len(words) + 1
        assert r.n_known == sum(counts[w] > 0 for w in words) + 1
        base = sum(math.log10((c + 0.1) / (n + 0.1 * (v + 1))) for c in [*(counts[w] for w in words), len(train)])
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(plain.score(_low(t)), rel=1e-4, abs=1e-3)


def test_probabilities_sum_to_one():
    import numpy as np
    texts = [b"abracadabra", b"banana band"]
    codes, counts = S.block_pairs(texts, np.array([True, True]))
    context = codes[5] >> np.uint64(8) << np.uint64(8)
    every = np.unique(np.concatenate([codes, context | np.arange(256, dtype=np.uint64)]))
    full = np.zeros(len(every), np.int64)
    full[np.searchsorted(every, codes)] = counts
    tree = S.Tree(every, full)
    keys, n0, n1, w = tree.shallow()
    p = 10 ** tree.log10_p(every, S.top_of(list(zip(keys.astype(np.int64), n0, n1, w, strict=True))))
    assert p[(every >> np.uint64(8)) == (context >> np.uint64(8))].sum() == pytest.approx(1, abs=1e-9)


def test_odd_rows_and_empty(odd, nothing):
    got = S.score(odd).collect()
    assert len(got) == odd.count() and all(math.isfinite(r.score) and r.score <= 0 for r in got)
    assert S.score(nothing).count() == 0


def test_learned_text_beats_base(documents):
    got = [r for r in S.score(documents).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
