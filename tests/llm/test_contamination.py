import numpy as np

from pagecorpus.llm import contamination as X
from pagecorpus.llm.licenses import license_words


def _plain(text, item, width):
    """Greedy string tiling by search over all pairs of places."""
    a, b = license_words(text), license_words(item)
    k = min(width, len(b))
    ma, mb = [False] * len(a), [False] * len(b)
    while b:
        best, at = 0, []
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not ma[i + n] and not mb[j + n]:
                    n += 1
                if n > best:
                    best, at = n, (i, j)
        if best < k:
            break
        for n in range(best):
            ma[at[0] + n] = mb[at[1] + n] = True
    return sum(mb) / len(b) if b else 0.0


def test_matches_plain_tiling():
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(14)]
    for _ in range(60):
        item = " ".join(rng.choice(words, 25))
        w = item.split()
        a, b = sorted(rng.integers(0, 25, 2))
        text = " ".join([*rng.choice(words, 10), *w[b:], *rng.choice(words, 5), *w[a:b], *w[:a]])
        got = dict((m[0], m[1]) for m in X.Index([(1, item)]).matches(text)).get(1, 0.0)
        assert abs(got - _plain(text, item, X.MIN_MATCH)) <= 2 / 25  # ties may be cut otherwise


def test_reordered_passages_count(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, "x " + item.upper() + ", y"), (2, "seven eight nine ten eleven twelve and then one two three four five six"), (3, "one two three four and nothing else"),
            (4, None), (5, ""), (6, "Short item!"), (7, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(10, item), (11, "short item"), (12, None), (13, ""), (10, item)], "item_id long, text string")
    got = sorted(set((r.doc_id, r.item_id, r.coverage) for r in X.leaks(docs, bench).collect()))
    assert got == [(1, 10, 1.0), (2, 10, 1.0), (6, 11, 1.0)]
    assert sorted(r.doc_id for r in X.keep_clean(docs, bench).collect()) == [3, 4, 5, 7]


def test_chunks_agree(spark, documents, sf_dir, monkeypatch):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = sorted(map(tuple, X.leaks(documents, bench).collect()))
    monkeypatch.setattr(X.indexes, "__defaults__", (500,))
    assert len(list(X.indexes(bench))) > 3
    assert sorted(map(tuple, X.leaks(documents, bench).collect())) == want and want
    leaked = {r[0] for r in want}
    texts = {r.item_id: r.text for r in bench.collect()}
    for r in documents.collect():  # whole passages are always found
        if any(t in r.text for t in texts.values()):
            assert r.doc_id in leaked


def test_odd_rows(odd, nothing, spark, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert X.leaks(odd, bench).count() == 0 and X.keep_clean(odd, bench).count() == odd.count()
    assert X.keep_clean(odd, bench.limit(0)).columns == odd.columns
    assert X.leaks(nothing, bench).count() == 0 and X.keep_clean(nothing, bench).count() == 0
