import math
from collections import Counter, defaultdict

import pytest

from pagecorpus.llm import mixing as M


def _targets(sizes):
    order = sorted([s for s in sizes if s is not None], key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, out, free = sum(sizes.values()), {}, list(order)
    while free:
        left, w = total - sum(out.values()), sum(weight[s] for s in free)
        high = [s for s in free if left * weight[s] / w > 3 * sizes[s]]
        if not high:
            return out | {s: left * weight[s] / w for s in free}
        for s in high:
            out[s] = 3.0 * sizes[s]
            free.remove(s)
    return out


@pytest.mark.parametrize("name", ["odd", "documents"])
def test_report(name, request):
    df = request.getfixturevalue(name)
    rows = [(r.doc_id, r.text, r.source) for r in df.collect()]
    size = lambda t: len((t or "").encode().split())
    per = Counter()
    for _, t, s in rows:
        per[s] += size(t)
    want = _targets(per)
    got = M.decisions(df).collect()
    assert sorted(((r.doc_id, r.size, r.source_size) for r in got), key=repr) == sorted(((i, size(t), per[s]) for i, t, s in rows), key=repr)
    taken, ranks = Counter(), defaultdict(list)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and 0 <= r.copies <= 3
        taken[r.source] += r.size * r.copies
        ranks[r.source].append((r["rank"], r.size, r.copies))
    for s, some in ranks.items():
        some.sort()
        assert [x[0] for x in some] == list(range(1, len(some) + 1))
        assert [x[1] for x in some] == sorted(x[1] for x in some)
        rate = min(3, want[s] / per[s]) if per[s] else 0
        assert abs(sum(x[2] for x in some) - rate * len(some)) <= 1 + 1e-6
        largest = max(x[1] for x in some)
        assert abs(taken[s] - want[s]) <= 2 * largest + 1  # order by size keeps the words near the target


def test_reruns_agree(documents):
    a = {(r.doc_id, r.copies) for r in M.decisions(documents).collect()}
    assert a == {(r.doc_id, r.copies) for r in M.decisions(documents.repartition(7)).collect()}


def test_mix_repeats_rows(odd, nothing):
    want = Counter()
    for r in M.decisions(odd).collect():
        want[r.doc_id, r.source, r.size] += r.copies
    out = M.mix(odd)
    got = Counter((r.doc_id, r.source, len((r.text or "").encode().split())) for r in out.collect())
    assert out.columns == odd.columns and got == Counter({k: v for k, v in want.items() if v})
    assert M.mix(nothing).count() == 0 and M.decisions(nothing).count() == 0


def test_excess_is_shared():
    got = M.targets({"a": 10, "b": 1000, "c": 0, None: 100})
    assert got["a"] == 30 and got["c"] == 0 and got[None] == 300 and math.isclose(sum(got.values()), 1110)
