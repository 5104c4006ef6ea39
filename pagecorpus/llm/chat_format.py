"""Operator 12, conversations as training text in budgeted windows.

A turn is written as ``<s>[INST]role[/INST]text</s>``.  Control strings inside roles and texts get a
backslash after their first sign (``</s>`` becomes ``<\\/s>``, ``<\\/s>`` becomes ``<\\\\/s>``), which is undone
by taking one away; all other text stays as it is.

A conversation is cut into windows of whole turns.  Prefix sums of the turns' tokens choose the
spans: a window takes new turns while they fit into the budget beside the system turn and the
room for history.  A system turn that opens the conversation stands in every window; up to
``history`` turns before the span are repeated where they fit.  The loss mask, spans of code points
in the formatted text, covers the texts of the assistant's new turns only, so repeated turns are
context and every assistant text is learned once.

Long conversations are worked on in parts of ``PART`` turn numbers; windows begin anew at a part,
and a part gets the last turns of the one before and the system turn as copies, so that no task
holds more than a part.  Only DataFrame functions are used.

Defined results: turns stand by turn number, nulls first, equal ones by role and text, and repeated
rows count as often as they occur; null roles and texts are empty; a null conv_id is a conversation
of its own; a turn that alone exceeds the budget has a window of its own and is never cut; an empty
table gives no rows; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUDGET = 512
HISTORY = 4
HISTORY_TOKENS = 128
#: Turn numbers to a part of a conversation, as a power of two.
PART_BITS = 8
#: Tokens that a turn costs besides its role and text.
TURN_TOKENS = 4
_NO_TURN = -(1 << 56)


def escape(text: Column) -> Column:
    """One more backslash in every control string."""
    return F.regexp_replace(text, r"(<\\*)(/?s>)|(\[\\*)(/?INST\])", r"$1$3\\$2$4")


def unescape(text: Column) -> Column:
    """One backslash less in every control string."""
    return F.regexp_replace(text, r"(<\\*)\\(/?s>)|(\[\\*)\\(/?INST\])", "$1$3$2$4")


def tokens(text: Column) -> Column:
    """Words of letters and digits, and other signs but white space."""
    return F.char_length(F.regexp_replace(text, r"([A-Za-z0-9])[A-Za-z0-9]*|[\x09-\x0D\x20]+", "$1"))


def _with(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it inside loops."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _rows(convs: DataFrame) -> DataFrame:
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    return convs.select("conv_id", "turn", F.coalesce(F.shiftright("turn", PART_BITS), F.lit(_NO_TURN)).alias("part"),
                        escape(role).alias("role"), escape(text).alias("text"),
                        (tokens(role) + tokens(text) + TURN_TOKENS).alias("tok"))


def _marks(convs: DataFrame) -> DataFrame:
    """A row for each part of a conversation of several parts: whether it is a later one, and the
    system turn that later ones repeat."""
    at = convs.select("conv_id", "turn", F.coalesce(F.shiftright("turn", PART_BITS), F.lit(_NO_TURN)).alias("part"),
                      F.coalesce(F.col("role"), F.lit("")).alias("role"))
    many = (at.groupBy("conv_id").agg(F.min("part").alias("p0"), F.max("part").alias("p1")).where("p0 < p1")
            .select(F.col("conv_id").alias("_id"), "p0"))
    same = F.col("conv_id").eqNullSafe(F.col("_id"))
    parts = at.select("conv_id", "part").join(many, same).groupBy("conv_id", "part").agg(F.min("p0").alias("p0"))
    heads = at.join(many, same).groupBy("_id").agg(F.min(F.struct("turn", "role")).alias("head")).where("head.role = 'system'")
    system = (_rows(convs.where("role = 'system'")).join(heads, same & F.col("turn").eqNullSafe(F.col("head.turn")))
              .groupBy("_id").agg(F.min(F.struct("turn", "role", "text", "tok")).alias("system")))
    return (parts.join(system, same, "left")
            .select("conv_id", "part", (F.col("part") > F.col("p0")).alias("later"), F.when(F.col("part") > F.col("p0"), F.col("system")).alias("system")))


def _parts(convs: DataFrame, history: int) -> DataFrame:
    """One row for each part: its sorted turns (``carried`` ones come from the part before), ``later``
    (null unless the conversation has several parts) and the system turn of an earlier part."""
    rows = _rows(convs)
    near_end = F.col("turn").bitwiseAND((1 << PART_BITS) - 1) >= (1 << PART_BITS) - history
    to = F.when(near_end, F.array(F.col("part"), F.col("part") + 1)).otherwise(F.array("part"))
    turns = rows.select("conv_id", F.explode(to).alias("to"), "part", "turn", "role", "text", "tok").select(
        "conv_id", F.col("to").alias("part"),
        F.struct("turn", "role", "text", "tok", (F.col("to") != F.col("part")).alias("carried")).alias("one"),
        F.lit(None).cast("boolean").alias("later"), F.lit(None).cast("struct<turn:bigint,role:string,text:string,tok:int>").alias("system"))
    marks = _marks(convs).select("conv_id", "part", F.lit(None).cast(turns.schema["one"].dataType).alias("one"), "later", "system")
    return (turns.unionByName(marks).groupBy("conv_id", "part")
            .agg(F.array_sort(F.collect_list("one")).alias("turns"), F.max("later").alias("later"), F.max("system").alias("system"))
            .where(F.exists("turns", lambda t: ~t["carried"])))


def _render(t: Column) -> Column:
    return F.concat(F.lit("<s>[INST]"), t["role"], F.lit("[/INST]"), t["text"], F.lit("</s>"))


def _window(turns: Column, before: Column, own_system: Column, system: Column, a: Column, b: Column,
            budget: int, history: int, history_tokens: int) -> Column:
    """The window whose new turns are ``turns[a:b]``."""
    lead = F.when(own_system & (a > 0), F.slice(turns, 1, 1)).when(system.isNotNull(), F.array(system)).otherwise(F.slice(turns, 1, 0))
    used = F.aggregate(lead, F.lit(0), lambda s, t: s + t["tok"]) + before[b] - before[a]
    lo = F.greatest(F.when(own_system, 1).otherwise(0), a - history)

    def fits(j: Column) -> Column:
        back = F.try_subtract(turns[a]["turn"], turns[j]["turn"])
        return (back <= history) & (before[a] - before[j] <= F.least(F.lit(history_tokens), F.lit(budget) - used))

    first = F.when(lo < a, F.coalesce(F.array_min(F.filter(F.sequence(lo, a - 1), fits)), a)).otherwise(a)
    return _with(first, lambda h: _with(
        F.struct(F.concat(lead, F.slice(turns, h + 1, a - h)).alias("old"), F.slice(turns, a + 1, b - a).alias("new")), lambda w: _with(
            F.array_join(F.transform(w["old"], _render), ""), lambda seen: F.struct(
                F.concat(seen, F.array_join(F.transform(w["new"], _render), "")).alias("formatted"),
                F.size(w["old"]).alias("n_repeated"), F.size(w["new"]).alias("n_new"),
                F.aggregate(F.concat(w["old"], w["new"]), F.lit(0), lambda s, t: s + t["tok"]).alias("n_tokens"),
                _mask(w["new"], F.char_length(seen)).alias("mask")))))


def _mask(new: Column, start: Column) -> Column:
    """Spans of the assistant's texts among the new turns, the first of which begins at ``start``."""
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def step(s: Column, t: Column) -> Column:
        begin = s["at"] + 16 + F.char_length(t["role"])  # <s>[INST] and [/INST]
        end = begin + F.char_length(t["text"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + 4).alias("at"), F.when(t["role"] == "assistant", F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(new, F.struct(start.alias("at"), empty.alias("spans")), step, lambda s: s["spans"])


def _windowed(convs: DataFrame, budget: int, history: int, history_tokens: int) -> DataFrame:
    """Rows (conv_id, part, later, windows): the windows of each part in order."""
    parts = _parts(convs, history)
    plain = "array<struct<turn:bigint,role:string,text:string,tok:int>>"

    def starts(p: Column) -> Column:
        room = F.lit(budget - history_tokens) - p["system_tok"]
        none = F.struct(F.array().cast("array<int>").alias("s"), F.lit(0).alias("from"))

        def step(s: Column, i: Column) -> Column:
            full = (F.size(s["s"]) == 0) | (p["before"][i + 1] - s["from"] > room)
            return F.struct(F.when(full, F.concat(s["s"], F.array(i))).otherwise(s["s"]).alias("s"),
                            F.when(full, p["before"][i]).otherwise(s["from"]).alias("from"))

        n = F.size(p["turns"])
        own = F.when(p["carried"] < n, F.sequence(p["carried"], n - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(own, none, step, lambda s: s["s"])

    def all_windows(p: Column) -> Column:
        return _with(starts(p), lambda s: F.transform(s, lambda a, k: _window(
            p["turns"], p["before"], p["own_system"], p["system"], a,
            F.coalesce(F.get(s, k + 1), F.size(p["turns"])), budget, history, history_tokens)))

    own_system = ~F.coalesce(F.col("later"), F.lit(False)) & (F.col("turns")[0]["role"] == "system")
    part = F.struct(
        F.transform("turns", lambda t: F.struct(t["turn"], t["role"], t["text"], t["tok"])).cast(plain).alias("turns"),
        F.aggregate("turns", F.array(F.lit(0)), lambda s, t: F.concat(s, F.array(F.element_at(s, -1) + t["tok"]))).alias("before"),
        F.size(F.filter("turns", lambda t: t["carried"])).alias("carried"),
        own_system.alias("own_system"), F.col("system").alias("system"),
        F.coalesce(F.when(own_system, F.col("turns")[0]["tok"]).otherwise(F.col("system")["tok"]), F.lit(0)).alias("system_tok"))
    return parts.select("conv_id", "part", "later", _with(part, all_windows).alias("windows"))


def windows(convs: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """Rows (conv_id, part, window, formatted, n_repeated, n_new, n_tokens, mask): the training texts.  ``window``
    counts within ``part``; the first ``n_repeated`` turns of a text are repeated ones."""
    return (_windowed(convs, budget, history, history_tokens)
            .select("conv_id", "part", F.posexplode_outer("windows").alias("window", "w")).select("conv_id", "part", "window", "w.*"))


def _read_back(w: Column) -> Column:
    """New turns of a formatted window as ``role``, newline, ``text``, newline each.  Escaped texts hold no
    control string, so the marks found are the template's."""
    turns = F.slice(F.split(w["formatted"], "</s>"), w["n_repeated"] + 1, w["n_new"])
    joined = F.concat(F.array_join(turns, "\n"), F.lit("\n"))
    return unescape(F.replace(F.replace(joined, F.lit("<s>[INST]")), F.lit("[/INST]"), F.lit("\n")))


def _learned(w: Column) -> Column:
    """Text under the loss mask."""
    return F.array_join(F.transform(w["mask"], lambda m: unescape(F.substring(w["formatted"], m["start"] + 1, m["end"] - m["start"]))), "")


def digests(convs: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """What the windows of each conversation hold, read back from them: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars, n_windows."""
    read = _windowed(convs, budget, history, history_tokens).select(
        "conv_id", "part", "later",
        F.array_join(F.transform("windows", _read_back), "").alias("turns"), F.array_join(F.transform("windows", _learned), "").alias("loss"),
        F.aggregate("windows", F.lit(0).cast("bigint"), lambda s, w: s + w["n_new"]).alias("n_turns"),
        F.aggregate("windows", F.lit(0).cast("bigint"), lambda s, w: s + F.char_length(w["formatted"])).alias("formatted_chars"),
        F.size("windows").cast("bigint").alias("n_windows"))
    # a conversation of one part is whole where its part is; only the others travel again
    pieces = F.array_sort(F.collect_list(F.struct("part", "turns", "loss")))
    joined = (read.where("later is not null").groupBy("conv_id")
              .agg(pieces.alias("p"), *(F.sum(c).alias(c) for c in ("n_turns", "formatted_chars", "n_windows")))
              .select("conv_id", F.array_join("p.turns", "").alias("turns"), F.array_join("p.loss", "").alias("loss"),
                      "n_turns", "formatted_chars", "n_windows"))
    both = read.where("later is null").select(*joined.columns).unionByName(joined)
    return both.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"),
                       F.char_length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       "formatted_chars", "n_windows")


def probe(convs: DataFrame) -> DataFrame:
    """``convs`` and conversation -7, whose two turns consist of control strings."""
    said = convs.sparkSession.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return convs.select("conv_id", "turn", "role", "text").unionByName(said)


def _sql_escape(c: str) -> str:
    return rf"regexp_replace({c}, '(<\\*)(/?s>)|(\[\\*)(/?INST\])', '\1\3\\\2\4', 'g')"


def _sql_tokens(c: str) -> str:
    return rf"length(regexp_replace({c}, '([A-Za-z0-9])[A-Za-z0-9]*|[\x09-\x0D\x20]+', '\1', 'g'))"


#: The query's rows in DuckDB SQL: windows by a recursion over the turns of each conversation.
ORACLE_SQL = f"""WITH RECURSIVE said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
  SELECT *, turn >> {PART_BITS} AS part, {_sql_tokens('role')} + {_sql_tokens('text')} + {TURN_TOKENS} AS tok,
         length({_sql_escape('role')}) + length({_sql_escape('text')}) + 20 AS len,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM said),
sys AS (SELECT conv_id, tok AS sys_tok, len AS sys_len FROM t WHERE i = 1 AND role = 'system'),
walk AS (
  SELECT t.conv_id, t.i, t.part, t.tok AS used, t.i AS first FROM t WHERE i = 1
  UNION ALL
  SELECT t.conv_id, t.i, t.part,
         CASE WHEN t.part <> walk.part OR walk.used + t.tok > {BUDGET - HISTORY_TOKENS} - coalesce(sys_tok, 0) THEN t.tok ELSE walk.used + t.tok END,
         CASE WHEN t.part <> walk.part OR walk.used + t.tok > {BUDGET - HISTORY_TOKENS} - coalesce(sys_tok, 0) THEN t.i ELSE walk.first END
  FROM walk JOIN t ON t.conv_id = walk.conv_id AND t.i = walk.i + 1 LEFT JOIN sys ON sys.conv_id = t.conv_id),
win AS (
  SELECT walk.conv_id, first AS a, sum(tok) AS new_tok, sum(len) AS new_len, any_value(sys_tok) AS sys_tok, any_value(sys_len) AS sys_len
  FROM walk JOIN t USING (conv_id, i) LEFT JOIN sys ON sys.conv_id = walk.conv_id GROUP BY walk.conv_id, first),
hist AS (
  SELECT w.conv_id, w.a, coalesce(max(back_len), 0) AS back_len FROM win w LEFT JOIN (
    SELECT f.conv_id, f.i AS a, j.i AS j, f.turn - j.turn AS back, j.role,
           sum(j.tok) OVER run AS back_tok, sum(j.len) OVER run AS back_len
    FROM t f JOIN t j ON j.conv_id = f.conv_id AND j.i BETWEEN f.i - {HISTORY} AND f.i - 1
    WINDOW run AS (PARTITION BY f.conv_id, f.i ORDER BY j.i DESC)) h
  ON h.conv_id = w.conv_id AND h.a = w.a AND h.j > CASE WHEN sys_tok IS NULL THEN 0 ELSE 1 END AND back <= {HISTORY}
     AND back_tok <= least({HISTORY_TOKENS}, {BUDGET} - CASE WHEN w.a > 1 THEN coalesce(sys_tok, 0) ELSE 0 END - new_tok)
  GROUP BY w.conv_id, w.a),
size AS (
  SELECT conv_id, sum(new_len + back_len + CASE WHEN a > 1 THEN coalesce(sys_len, 0) ELSE 0 END) AS formatted_chars, count(*) AS n_windows
  FROM win JOIN hist USING (conv_id, a) GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars, n_windows
FROM (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS turns,
             coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '') AS loss FROM t GROUP BY conv_id)
JOIN size USING (conv_id)"""
