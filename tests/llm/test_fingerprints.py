import hashlib

import numpy as np

from pagecorpus.llm import common as C
from pagecorpus.llm import fingerprints as P


def _expected(rows):
    """Sequential version: (id, n, sha) of each row in order."""
    rows = sorted(((r[0] is not None, r[0] or 0, r[1] or "") for r in rows))
    out = []
    for i, (has, doc_id, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][2]
        n = len(text)
        new = text[:n - n // 4] + after[:n // 4]
        out.append((doc_id if has else None, n, hashlib.sha256(new.encode()).hexdigest()))
    return sorted(out, key=repr)


def _got(df):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in df.collect()), key=repr)


def test_edits_match_sequential_version(odd, documents, monkeypatch):
    monkeypatch.setattr(P, "TARGET", 40_000)  # many buckets
    for df in (odd, documents):
        assert _got(P.edit_report(df)) == _expected([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])


def test_one_row_and_no_row(spark, nothing):
    one = spark.createDataFrame([(5, "some words of text")], "doc_id long, text string")
    r = P.edit_report(one).collect()
    assert len(r) == 1 and r[0].near_next == 1.0
    assert P.edit_report(nothing).count() == 0 and P.fingerprints(nothing).count() == 0


def test_equal_texts_have_equal_fingerprints(odd):
    got = {}
    for r in P.edit_report(odd).join(odd.select("doc_id", "text"), "doc_id").collect():
        got.setdefault(r.text, set()).add(r.fingerprint) if r.doc_id != 7 else None
    assert all(len(v) == 1 for v in got.values())


def test_likeness_estimates_jaccard(documents):
    texts = [r.text for r in documents.limit(300).collect()]

    def exact(a, b):
        a, b = (set(C.shingle_hashes(C.word_hashes(C.words_of(t)), 5).tolist()) for t in (a, b))
        return len(a & b) / len(a | b) if a | b else 1.0
    errors = [P.likeness(P.signature(a), P.signature(e := P.edited(a, b))) - exact(a, e) for a, b in zip(texts, texts[1:], strict=False)]
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.04
    assert P.likeness(P.signature("a b c d e f g"), P.signature("q r s t u v w")) < 0.2


def test_densification_is_uniform_and_consistent():
    few = P.signature("one two three four five six seven")
    assert len(np.unique(few)) > 1  # three shingles share 512 bins
    sig = P.signature(" ".join(map(str, range(60))))
    assert (P.unpacked(P.packed(sig)) == sig).all()
    assert (P._ORDER[np.arange(P.BINS), P._RANK[:, 3]] == 3).all()  # rank inverts the order
