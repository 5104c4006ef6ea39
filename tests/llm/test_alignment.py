"""Token alignment against a plain version, by words, by chunks and by any tree of fragments."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from pagecorpus.llm import alignment as A
from pagecorpus.llm import common as C
from tests.llm.conftest import SF


def plain_tokens(co, text):
    """Byte ends and ids of both tokenizers over the whole text; None if their bytes differ from it."""
    if not text:
        return None
    a = co.a.encode(" " + text, add_special_tokens=False).ids
    b = co.b.encode(text)
    raw = (" " + text).encode()
    if b"".join(co.a_bytes[i] for i in a) != raw or b"".join(co.b_bytes[i] for i in b) != raw:
        return None
    ends = []
    for ids, names in ((a, co.a_bytes), (b, co.b_bytes)):
        at, out = 0, []
        for i in ids:
            at += len(names[i])
            out.append((at, i))
        ends.append(out)
    return ends


def plain_report(co, texts):
    rows, links = [], []
    for text in texts:
        got = plain_tokens(co, text)
        if got is None:
            rows.append([0, 0, 0, "", ""])
            links.append([])
            continue
        a, b = got
        cuts = sorted({e for e, _ in a} & {e for e, _ in b})
        groups, last = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for e, i in x if last < e <= cut) for x in (a, b)))
            last = cut
        end_a, end_b = dict(a), dict(b)
        links.append([(end_a[e], end_b[e]) for e in cuts])
        rows.append([len(a), len(b), len(groups), ";".join(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()])
    counts = Counter(x for xs in links for x in xs)
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    return [(r[0], r[1], r[2], len(xs), sum(counts[x] == top[x[1]] for x in xs), sum(counts[x] for x in xs), r[4], r[3]) for r, xs in zip(rows, links)]


def coders():
    return A.Coders(public_tokenizers.path(A.A_FILE), public_tokenizers.path(A.B_FILE))


ODD = [None, "", " ", "   two  spaces ", "\n\nlines\n \tand\ttabs \n", "<s> </s> <unk> <|endoftext|> <0x0A>", "▁ sign", "你好，世界。这是一个很长的句子，没有空格。" * 8,
       "don't 'tis x's ''s", "naïve café é — “quotes” … 🙂🙃 ​x", "a  b　c \x85d \x1c e", "x" * 700, "1234567890 " * 30, "\x00 nul",
       "word" * 90 + "。" + "слово " * 40, "http://a.b/c?d=e&f=g#h " * 12, "def f(x):\n    return x  # ok\n" * 9, "Ａｂｃ ﬁ ǅ ²³ Ⅷ"]


def check(spark, texts, chunk, whole=True):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    want = plain_report(coders(), texts)
    got = {r.doc_id: tuple(r)[1:] for r in A.alignment_report(df, chunk=chunk).collect()}
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        assert got[i] == w[:7], (chunk, texts[i])
    if whole:
        text = {r.doc_id: r.groups for r in A.groups(df, chunk=chunk).collect()}
        assert [text[i] for i in range(len(texts))] == [w[7] for w in want]


def test_words_give_the_whole_text(spark):
    texts = [r.text for r in C.table(spark, SF, "documents").select("text").limit(60).collect()]
    check(spark, texts + ODD, A.CHUNK, whole=False)


def test_chunks_give_the_whole_text(spark):
    check(spark, ODD + [" ".join(t for t in ODD if t and "▁" not in t)], 100)


def test_any_tree_gives_the_same():
    """Fragments of cuts at any token borders of either tokenizer, composed in any order."""
    co, rng = coders(), random.Random(5)
    for text in [t for t in ODD if plain_tokens(co, t)]:
        a, b = plain_tokens(co, text)
        for _ in range(6):
            n = rng.randint(1, 9)
            cut_a = sorted(rng.randint(0, len(a)) for _ in range(n)) + [len(a)]
            cut_b = sorted(rng.randint(0, len(b)) for _ in range(n)) + [len(b)]
            parts, i, j = [], 0, 0
            for x, y in zip(cut_a, cut_b):
                parts.append(A.Fragment.of(tuple(np.array([t[k] for t in src], np.int64) for src in (a[i:x], b[j:y]) for k in (1, 0))))
                i, j = x, y
            # tokens of one side may lie ahead by any amount; what counts is that each side is in order
            while len(parts) > 1:
                at = rng.randrange(len(parts) - 1)
                parts[at:at + 2] = [parts[at].then(parts[at + 1])]
            whole = A.Fragment.of(tuple(np.array([t[k] for t in src], np.int64) for src in (a, b) for k in (1, 0)))
            texts = [";".join(";".join(A.group_text(*A.unpack_groups(p))) for p in f.pieces()) for f in (parts[0], whole)]
            assert texts[0] == texts[1]
            assert not len(parts[0].tail[0])


def test_odd_rows(spark):
    """Null and large ids, repeated rows, empty tables, clashing columns."""
    rows = [(None, "same text here", 1, "x"), (7, "same text here", 2, "y"), (7, "same text here", 2, "y"), ((1 << 53) + 1, None, 3, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, block long, data string")
    got = A.alignment_report(df).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_groups > 0) for r in got) == sorted([(True, 0, True), (False, 7, True), (False, 7, True), (False, (1 << 53) + 1, False)])
    same = [r for r in got if r.n_groups]
    assert {r.count_sum for r in same} == {same[0].n_links * 3}
    assert A.alignment_report(df.limit(0)).count() == 0
    assert A.alignment_report(df, chunk=4).agg(F.sum("n_links")).first()[0] == sum(r.n_links for r in got)
