import numpy as np
import pytest

from pagecorpus.llm import common as C
from pagecorpus.llm import jaccard_join as J


def _plain(rows, width=4, share=85):
    """All pairs, sets of word tuples."""
    sets = {}
    for doc_id, text in rows:
        w = (text or "").encode().lower().split()
        if doc_id is not None:
            sets.setdefault(doc_id, []).append(frozenset(tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset())
    flat = [(i, s) for i, group in sorted(sets.items()) for s in group]
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    for x, (i, s) in enumerate(flat):
        for j, t in flat[:x]:
            if s and t and 100 * len(s & t) >= share * len(s | t):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}, {i: [len(s) for s in g] for i, g in sets.items()}


@pytest.mark.parametrize("members", [1500, 3])
def test_matches_all_pairs(documents, spark, members, monkeypatch):
    monkeypatch.setattr(J, "MEMBERS", members)
    monkeypatch.setattr(J, "TARGET", 150_000)
    monkeypatch.setattr(J.trie_links, "__defaults__", (members,))
    base = [(r.doc_id, r.text) for r in documents.limit(260).collect()]
    rng = np.random.default_rng(1)
    words = base[3][1].split()
    for i in range(25):  # a family around one text, some near the threshold
        w = list(words)
        for at in rng.integers(0, len(w), 1 + i // 2):
            w[at] = f"new{i}x{at}"
        base.append((5000 + i, " ".join(w)))
    df = spark.createDataFrame(base, "doc_id long, text string")
    want, sizes = _plain(base)
    got = J.join(df).collect()
    assert len(got) == len(base)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles in sizes[r.doc_id] for r in got)
    assert len(set(want.values())) < len(want)


def test_odd_rows(odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want, _ = _plain(rows)
    got = [r for r in J.join(odd).collect()]
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None and r.doc_id != 7} == {k: v for k, v in want.items() if k != 7}
    assert all(r.component_id is None for r in got if r.doc_id is None)
    kept = J.keep_one(odd)
    assert kept.columns == odd.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert len(ids) == len(set(ids)) and set(ids) == set(want.values())
    assert J.join(nothing).count() == 0 and J.keep_one(nothing).count() == 0


def test_trie_finds_what_brute_force_finds():
    rng = np.random.default_rng(5)
    base = np.sort(rng.choice(400, 60, replace=False))
    sets = []
    for _ in range(120):
        keep = base[rng.random(60) > rng.random() * 0.2]
        sets.append(np.unique(np.concatenate([keep, rng.integers(0, 400, rng.integers(0, 8))])))
    sets += [sets[0], sets[3][:5], np.array([7])]
    trie, mark = J.Trie(sets), np.zeros(400, bool)
    for s in sets:
        want = {i for i, t in enumerate(sets) if J.linked(len(np.intersect1d(s, t)), len(s), len(t))}
        assert {m for m, _ in trie.probe(s, mark)} == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 103), (7, 7)]
    got = {r.id: r.component for r in C.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 105: 100, 103: 100}
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_width_and_share_of_a_caller(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join(words + [f"end{i}" for i in range(46)])),  # 196 of 242 shingles of five words: 0.81
            (3, " ".join(words[:90] + [f"mid{i}" for i in range(14)] + words[104:])),  # 178 of 214: 0.83
            (4, " ".join(words[:100] + [f"far{i}" for i in range(60)] + words[160:]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: J.shingle_set(t, 5) for i, t in rows}
    near = {i for i in sets if 100 * len(np.intersect1d(sets[1], sets[i])) >= 80 * len(np.union1d(sets[1], sets[i]))}
    assert near == {1, 2, 3}
    assert {r.doc_id: r.component_id for r in J.join(df, 5, 80).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    assert {r.doc_id for r in J.keep_one(df, 5, 80).collect()} == {1, 4}
    assert {r.doc_id: r.component_id for r in J.join(df).collect()} == {i: i for i in sets}
