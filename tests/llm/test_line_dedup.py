import numpy as np
import pytest

from pagecorpus.llm import line_dedup as D


def _sets(line):
    return frozenset(line[i:i + 5] for i in range(max(1, len(line) - 4)))


def _plain(rows):
    """Components of all lines by all pairs."""
    lines = {}
    for _, text in rows:
        for raw in (text or "").split("\n"):
            low = raw.replace("\r", " ").replace("\t", " ").strip(" ").lower()
            if low:
                lines.setdefault(low, _sets(low))
    names = sorted(lines)
    up = {x: x for x in names}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for i, a in enumerate(names):
        for b in names[:i]:
            s, t = lines[a], lines[b]
            if min(len(s), len(t)) * 100 >= 80 * max(len(s), len(t)) and 100 * (c := len(s & t)) >= 80 * (len(s) + len(t) - c):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {x: find(x) for x in names}


def _low(raw):
    return raw.replace("\r", " ").replace("\t", " ").strip(" ").lower()


def test_matches_all_pairs(part, spark):
    rows = [(r.doc_id, r.text) for r in part.limit(120).collect()]
    words = "the quick brown fox jumps over the lazy dog while many other animals look on from behind the old wooden fence".split()
    for i in range(30):  # a chain of variants
        words[(i * 7) % len(words)] += "x" if i % 3 else ""
        rows.append((6000 + i, f"start {i} of its own kind\n" + " ".join(words) + "\n\n" + " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = _plain(rows)
    got = D.fuzzy_lines(df).collect()
    text = {i: t for i, t in rows}
    group = {}
    for r in got:
        group.setdefault(r.component, set()).add(want[_low(text[r.doc_id].split("\n")[r.line_no])])
    assert all(len(g) == 1 for g in group.values())  # nothing is joined that exact search keeps apart
    assert len(group) <= 1.01 * len(set(want.values()))  # and hardly anything is missed
    assert len(got) == sum(1 for _, t in rows for x in t.split("\n") if _low(x))
    keep = [r for r in got if r.keep]
    assert len(keep) == len(group)
    for r in got:
        first = next(k for k in keep if k.component == r.component)
        assert (first.doc_id, first.line_no) <= (r.doc_id, r.line_no)


def test_odd_rows(odd, nothing):
    got = D.fuzzy_lines(odd).collect()
    assert {r.line_no for r in got if r.doc_id == 28} == {0, 1, 3}
    d = {r.doc_id: r.text for r in D.dedup(odd).collect()}
    assert d[28] == "été à la plage\nune ligne\n" and d[1] == "" and d[4] == ""
    assert D.fuzzy_lines(nothing).count() == 0 and D.dedup(nothing).count() == 0


def test_band_probability():
    import numpy as np

    rng = np.random.default_rng(0)
    base = "".join(rng.choice(list("abcdefghijklmnop "), 400))
    hits = trials = 0
    for _ in range(200):
        w = list(base)
        for at in rng.integers(0, 400, 8):
            w[at] = "z"
        other = "".join(w)
        if D.similar(D.shingles(base), D.shingles(other)):
            a, b = D.signatures([base.encode(), other.encode()])
            hits += bool((a == b).any())
            trials += 1
    assert trials > 50 and hits / trials > 0.97


def test_signature_stands_alone():
    lines = [b"abc", b"abcdefg", b"abcdef", b"x"]
    assert (D.signatures(lines) == [D.signatures([x])[0] for x in lines]).all()


@pytest.mark.parametrize("union", [10, 15, 20, 30, 40, 100])
def test_recall_at_the_threshold_by_line_length(union):
    """Pairs of lines of similarity 0.8 exactly, found by their sets, that share a band."""
    rng = np.random.default_rng(union)
    lines, pairs = [], 0
    letters = list("abcdefghijklmnopqrstuvwxyz0123456789 ")
    while pairs < 2000:  # a line and the same with a longer end
        other = "".join(rng.choice(letters, union + 4))
        body = other[:union * 8 // 10 + 4]
        s, t = D.shingles(body), D.shingles(other)
        if len(s & t) * 10 == 8 * len(s | t):
            lines += [body.encode(), other.encode()]
            pairs += 1
    keys = D.signatures(lines)
    found = (keys[0::2] == keys[1::2]).any(axis=1).mean()
    assert found > 0.99, found  # 0.996 by the formula


def test_round_two_joins_what_all_pairs_join(spark):
    """Templated lines below and above the threshold: the links join what all pairs join, and are few."""
    rng = np.random.default_rng(4)
    base = "order {} was shipped on day {} to the customer with number {} in the usual way"
    lines = [base.format(*rng.integers(0, 10 ** int(rng.integers(1, 9)), 3)) for _ in range(300)]
    rows = [(0, i, i % 250, x) for i, x in enumerate(lines)]  # some lie in one component already

    def joined(pairs):
        up = D.C.Sets(250)
        for a, b in pairs:
            up.join(a % 250, b % 250)
        return [up.find(i) for i in range(250)]
    sets = [D.shingles(x) for x in lines]
    every = [(i, j) for i in range(300) for j in range(i) if D.similar(sets[i], sets[j])]
    found = D.spanning(rows)
    assert joined(found) == joined(every) and len(found) < 250 and set(found) <= set(every)
    assert len(set(joined(every))) > 20
    for few in (2, 9, 16, 17):
        some = rows[-few:] + rows[:2]
        near = [(i, j) for i, j in every if {i, j} <= {r[1] for r in some}]
        assert joined(D.spanning(some)) == joined(near)
    left = spark.createDataFrame([(7, k, c) for _, k, c, _ in rows], "band long, k long, c long")
    texts = spark.createDataFrame([(k, x) for _, k, _, x in rows], "k long, line string")
    for members in (1000, 40):
        got = [tuple(r) for r in D.spanning_links(left, texts, members).collect()]
        assert joined(got) == joined(every) and set(got) <= set(every)
    assert D.spanning([]) == [] and D.spanning(rows[:1]) == []


def test_round_two_gets_each_set_of_lines_once_and_no_verified_pair(spark, monkeypatch):
    """Templated lines share many bands: each set of lines is sent once, without the line that round one compared all with."""
    rng = np.random.default_rng(5)
    base = "order {} was shipped on day {} to the customer with number {} in the usual way"
    rows = [(i, base.format(*rng.integers(0, 10 ** int(rng.integers(1, 9)), 3))) for i in range(200)]
    got, links = [], D.spanning_links

    def seen(left, texts):
        got.extend(tuple(r) for r in left.collect())
        return links(left, texts)
    monkeypatch.setattr(D, "spanning_links", seen)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component for r in D.fuzzy_lines(df).collect()}
    want = _plain(rows)
    groups = {}
    for i, text in rows:
        groups.setdefault(found[i], set()).add(want[_low(text)])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) <= 1.05 * len(set(want.values()))
    every, sent = {}, {}
    for r in D.bands(df).distinct().collect():
        every.setdefault(r.band, set()).add(r.k)
    for band, k, _ in got:
        sent.setdefault(band, set()).add(k)
    assert sent and all(ks == every[band] - {min(every[band])} for band, ks in sent.items())
    assert len({frozenset(ks) for ks in sent.values()}) == len(sent)


def test_similarities_as_arrays_are_those_of_sets():
    """Short lines, letters beyond the basic plane, and more letters than five fit into one number."""
    rng = np.random.default_rng(5)
    for letters in ("abcde ", "é漢字😀ab", "".join(map(chr, range(0x4E00, 0x4E00 + 9000)))):
        for longest in (3, 12, 400):
            a = ["".join(rng.choice(list(letters), int(n))) for n in rng.integers(1, longest + 1, 60)]
            b = ["".join(c if rng.random() > 0.02 else "x" for c in x) for x in a]
            b[0], b[1] = a[0], a[1] + a[1]
            sets = [(D.shingles(x), D.shingles(y)) for x, y in zip(a, b, strict=True)]
            assert D.similar_pairs(a, b).tolist() == [D.similar(s, t) for s, t in sets]
            assert D.coded(a)[1].tolist() == [len(s) for s, _ in sets]


def test_round_two_is_the_same_with_and_without_an_index(monkeypatch):
    lines = [f"row {i % 7} of the table holds {i * i} items and {i % 3} remarks from the office" for i in range(60)]
    rows = [(0, i, i, x) for i, x in enumerate(lines)]

    def joined():
        up = D.C.Sets(len(rows))
        for a, b in D.spanning(rows):
            up.join(a, b)
        return [up.find(i) for i in range(len(rows))]
    without = joined()
    monkeypatch.setattr(D, "FEW", 1)
    assert joined() == without and 1 < len(set(without)) < len(rows)


def test_band_rows_are_narrow_and_shuffled_once(spark, part):
    """The rows of the bands are most of what is shuffled: 48 bits a key, and one exchange for them."""
    keys = D.signatures([b"a line of some length", b"another line", b"x"])
    assert (keys >= 0).all() and (keys < 1 << 48).all()
    near = D.near_lines(part)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert plan.count("mapInPandas") + plan.count("MapInPandas") == 1, plan
