import re

from pagecorpus.llm import licenses as L

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def _plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    at, labels = [], set()
    for phrase, label in L.BASE.items():
        p = phrase.split()
        hits = [i for i in range(len(w)) if w[i:i + len(p)] == p]
        at += hits
        labels |= {label} if hits else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_base_places_match_plain_scan(spark, documents, odd):
    more = [(9001, "Under the MIT License under the mit license; CC BY NC cc-by-nc " * 30), (9002, "Apache License, Version 2.0"),
            (9003, "under the mit"), (9004, "cc by nc"), (9005, "the mit license apache license version")]
    df = documents.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in L.scan(df).collect()), key=repr)
    assert got == sorted(((i, *_plain(t)) for i, t in rows), key=repr)
    assert sum(g[2] for g in got) > 100


def test_notices_with_small_edits(spark):
    mit = L.NOTICES[7][1]
    rows = [(1, "x y " + mit + " z"), (2, "x " + mit.replace("free of charge", "free of any charge")), (3, mit[:40]), (4, "Licensed under the GNU General Public License, version 3. Under the MIT license")]
    got = {r.doc_id: r for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == got[2].labels == "mit" and got[1].score == 1.0 and 0.8 <= got[2].score <= 1
    assert got[3].labels == "" and got[3].score == 0 and got[3].first_word is None
    assert got[4].labels == "gpl-3,mit" and got[4].base_labels == "mit"


def test_beyond_the_broadcast(documents, monkeypatch):
    want = sorted(map(tuple, L.scan(documents).collect()), key=repr)
    monkeypatch.setattr(L, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, L.scan(documents).collect()), key=repr) == want


def test_empty(nothing):
    assert L.scan(nothing).count() == 0
