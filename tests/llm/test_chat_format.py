"""Chat windows against a plain version, and what is read back from them."""

import hashlib
import random
import re
from collections import defaultdict

from pagecorpus.llm import chat_format as X
from pagecorpus.llm import common as C
from tests.llm.conftest import SF

SCHEMA = "conv_id long, turn long, role string, text string, part long, windows string"


def plain_escape(t):
    return re.sub(r"(<\\*)(/?s>)|(\[\\*)(/?INST\])", lambda m: (m[1] or m[3]) + "\\" + (m[2] or m[4]), t)


def plain_tokens(t):
    return len(re.findall(r"[A-Za-z0-9]+|[^A-Za-z0-9\t-\r ]", t))


def plain_windows(turns, budget, history, room):
    """Windows of one conversation's (turn, role, text) rows, without parts of their own data flow."""
    turns = sorted(((n, plain_escape(r or ""), plain_escape(t or ""), plain_tokens(r or "") + plain_tokens(t or "") + 4) for n, r, t in turns),
                   key=lambda x: (x[0] is not None, x[0] or 0, x[1:]))
    part = [-(1 << 56) if x[0] is None else x[0] >> X.PART_BITS for x in turns]
    system = turns[0] if turns[0][1] == "system" else None
    starts, used = [], 0
    for i, x in enumerate(turns):
        if not i or part[i] != part[i - 1] or used + x[3] > budget - room - (system[3] if system else 0):
            starts.append(i)
            used = 0
        used += x[3]
    out = []
    for a, b in zip(starts, [*starts[1:], len(turns)]):
        lead = [system] if system and a else []
        left = min(room, budget - sum(x[3] for x in lead + turns[a:b]))
        h = a
        while (h > (1 if system else 0) and a - h < history and turns[a][0] is not None and turns[h - 1][0] is not None
               and turns[a][0] - turns[h - 1][0] <= history and sum(x[3] for x in turns[h - 1:a]) <= left):
            h -= 1
        old, text, mask = lead + turns[h:a], "", []
        for i, x in enumerate(old + turns[a:b]):
            text += f"<s>[INST]{x[1]}[/INST]"
            if i >= len(old) and x[1] == "assistant":
                mask.append((len(text), len(text) + len(x[2])))
            text += x[2] + "</s>"
        out.append((text, len(old), b - a, sum(x[3] for x in old + turns[a:b]), mask))
    return out


def check(spark, df, **kw):
    rows = defaultdict(list)
    for r in df.collect():
        rows[r.conv_id].append((r.turn, r.role, r.text))
    args = (kw.get("budget", X.BUDGET), kw.get("history", X.HISTORY), kw.get("history_tokens", X.HISTORY_TOKENS))
    got = defaultdict(list)
    for r in X.windows(df, **kw).orderBy("conv_id", "part", "window").collect():
        got[r.conv_id].append((r.formatted, r.n_repeated, r.n_new, r.n_tokens, [tuple(m) for m in r.mask]))
    digests = {r.conv_id: r for r in X.digests(df, **kw).collect()}
    assert set(got) == set(rows) == set(digests)
    for conv, turns in rows.items():
        want = plain_windows(turns, *args)
        assert got[conv] == want, conv
        turns = sorted(((t, r or "", x or "") for t, r, x in turns), key=lambda x: (x[0] is not None, x[0] or 0, plain_escape(x[1]), plain_escape(x[2])))
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        d = digests[conv]
        assert (d.n_turns, d.turns_sha256, d.loss_chars, d.loss_sha256, d.formatted_chars) == (
            len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(w[0]) for w in want))
    return got


def test_whole_small_table(spark):
    got = check(spark, X.probe(C.table(spark, SF, "conversations")))
    assert max(map(len, got.values())) > 1  # windows matter on these rows
    assert got[-7][0][0] == r"<s>[INST]user[/INST]<\/s>[\INST] ok [\/INST]</s><s>[INST]assistant[/INST]<\/s>[\INST] ok [\/INST]</s>"


def test_long_conversations_in_parts(spark):
    """Turn numbers over several parts, with and without a system turn; small budgets."""
    rng = random.Random(3)
    rows = []
    for conv, lead in ((1, "system"), (2, "user"), (3, "system")):
        for t in range(600 if conv < 3 else 40):
            role = lead if t == 0 else rng.choice(["user", "assistant", "assistant", "tool"])
            rows.append((conv, t, role, " ".join(rng.choice(["a", "bc", "</s>", "d,", "[INST]", "é", r"<\s>", "\n"]) for _ in range(rng.randint(0, 25))), 1, "w"))
    got = check(spark, spark.createDataFrame(rows, SCHEMA).repartition(5), budget=90, history=3, history_tokens=30)
    assert all(w[3] <= 90 for w in got[1])
    assert any(w[1] > 1 for w in got[1])
    assert all(w[0].startswith("<s>[INST]system") for w in got[1] + got[3])


def test_odd_rows(spark):
    """Nulls in every column, ties, repeated rows, control strings in any form, long texts, clashing columns."""
    rows = [(None, 0, "user", "no number", 1, "x"), (None, 1 << 40, "assistant", "far", 1, "x"), (5, None, None, None, None, None), (5, None, "assistant", "", None, None),
            (5, 0, "assistant", "one", None, None), (5, 0, "assistant", "one", None, None), (5, -1, "system", "late system", None, None),
            (6, 2, "assistant", "word " * 5000, None, None), (6, 1, "system", "s", None, None), (7, 0, "system", "only", None, None),
            (8, 0, "role\n</s>[INST]", "<" * 50 + "s>" + "\\" * 40 + "[" + "\\" * 9 + "/INST]", None, None), (8, 1, "assistant", "<", None, None), (8, 2, "assistant", "/s>", None, None),
            (9, (1 << 63) - 1, "assistant", "last", None, None), (9, -(1 << 63), "user", "first", None, None),
            (10, 0, "assistant", "<\\", None, None), (10, 1, "assistant", "/s>", None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    check(spark, df)
    assert X.digests(df.limit(0)).count() == 0
    assert X.windows(df.limit(0)).columns == ["conv_id", "part", "window", "formatted", "n_repeated", "n_new", "n_tokens", "mask"]


def test_no_python_and_one_text_exchange(spark):
    plan = X.digests(C.table(spark, SF, "conversations"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
