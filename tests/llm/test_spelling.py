"""Spelling variants against a plain version over the whole small table."""

import re
import zlib
from collections import Counter, defaultdict

from pagecorpus.llm import spelling as S
from pagecorpus.session import materialize


def plain_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def plain_variants(words):
    near, slots = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            slots[w[:i] + "\n" + w[i + 1:]].add(w)
            less = w[:i] + w[i + 1:]
            if less in words:
                near[w].add(less)
                near[less].add(w)
    for same in slots.values():
        for w in same:
            near[w] |= same - {w}
    top = {w: min(near[w], key=lambda o: (-words[o], o)) for w in words if near[w]}
    form = {w: o for w, o in top.items() if words[o] >= 2 * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


def check(spark, df):
    words = plain_words([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    got = S.variants(df).collect()
    assert {r.word: tuple(r)[1:] for r in got} == plain_variants(words)
    assert len(got) == len(words)
    return words


def test_whole_small_table(spark, documents):
    assert len(check(spark, documents)) > 10_000


def test_chains_ties_and_accents(spark):
    said = {"colour": 40, "colou": 9, "color": 19, "colar": 4, "côlor": 3, "zolour": 20, "straße": 8, "strasse": 3, "aaaaa": 3, "aaaaaa": 6, "b" * 300: 3, "b" * 299: 7,
            "Ÿtest": 5, "ÀÖØöøÿ": 3, "ab×cd": 3, "listen": 5, "silent": 10, "abcdef": 3, "abcdfe": 9}
    df = spark.createDataFrame([(i, f"{w}, {w.upper() if w.isascii() else w}.") for i, (w, n) in enumerate(said.items()) for _ in range(n)], "doc_id long, text string")
    check(spark, df)


def test_odd_rows(spark, odd, nothing):
    check(spark, odd)
    assert S.variants(nothing).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert S.variants(nothing).count() == 0


def test_no_table_goes_to_the_driver(spark, monkeypatch):
    """No join broadcasts, neither by Spark's estimate before the run nor by its measures within."""
    plans = []

    def ran(df):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(S, "materialize", lambda df, kind: materialize(ran(df), kind))
    said = {"colour": 12, "colou": 6, "coloür": 3, "listen": 4, "alone": 3}
    df = spark.createDataFrame([(i, f"{w}.") for i, (w, n) in enumerate(said.items()) for _ in range(n)], "doc_id long, text string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        got = ran(S.variants(df)).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    words = plain_words([(i, w) for i, (w, n) in enumerate(said.items()) for _ in range(n)])
    assert {r.word: tuple(r)[1:] for r in got} == plain_variants(words)
    assert all("isFinalPlan=true" in p for p in plans if "Join" in p)
    assert sum("SortMergeJoin" in p for p in plans) >= 3  # signatures, roots, result
    assert not [p for p in plans if "Broadcast" in p]
