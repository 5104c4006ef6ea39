"""Keep-newest cut-offs without a global window (design 4.3 of the survey).

"Delete the oldest until at most N rows / S bytes remain" equals "keep the rows whose
newest-first running total (inclusive) stays within the limit", as weights are never
negative.  So there is one row at which the total first exceeds the limit, and a row is kept
if it is newer than that one.  To find it:

1. weights are summed per hour (partial aggregation, one row for each hour of the time span
   reaches the driver), which gives the hour that holds the row;
2. only the rows of that hour, as ``(micros, tie, weight)``, are dealt by range into parts of
   about ``PART_ROWS`` rows, newest first, and summed per part;
3. only the part that holds the row gets a running total.

The table itself is never shuffled or written: each row is compared with the cut-off.  An hour
or a second with all rows (a bulk load) is split like any other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagecorpus.session import materialize

#: Rows of a part, the unit that one task ranks row by row.
PART_ROWS = 500_000


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _crossing(sums: list, limit: int, before: int) -> tuple:
    """The first of ``sums`` (in order) whose weight takes the running total over ``limit``, and the
    total before it; (None, total) if all fit."""
    for one in sums:
        if before + one["w"] > limit:
            return one, before
        before += one["w"]
    return None, before


def cut_offs(df: DataFrame, ts: str, tie: str, limits: list[tuple]) -> list[tuple | None]:
    """For each ``(limit, weight)`` the ``(us, tie)`` of the newest row that no longer fits; None if all rows
    fit.  All limits share the pass that sums the hours."""
    spark = df.sparkSession
    weights = [F.coalesce(F.col(weight).cast("long"), F.lit(0)) if weight else F.lit(1).cast("long") for _, weight in limits]
    rows = df.select(_micros(ts).alias("us"), F.col(tie).alias("tie"), *(w.alias(f"w{i}") for i, w in enumerate(weights))).filter("us is not null")
    hour = F.floor(F.col("us") / 3_600_000_000)
    hours = rows.groupBy(hour.alias("h")).agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"w{i}").alias(f"w{i}") for i in range(len(limits)))).collect()
    hours.sort(key=lambda r: -r["h"])
    out: list[tuple | None] = []
    for i, (limit, _) in enumerate(limits):
        most = limit if not isinstance(limit, Column) else spark.range(1).select(limit).first()[0]
        at, before = _crossing([{"h": r["h"], "n": r["n"], "w": r[f"w{i}"]} for r in hours], most, 0)
        if at is None:
            out.append(None)
            continue
        part = rows.filter(hour == at["h"]).select("us", "tie", F.col(f"w{i}").alias("w"), F.lit(0).alias("part"))
        if at["n"] > PART_ROWS:  # split like any other: only the part that holds the row is ranked
            parts = part.repartitionByRange(math.ceil(at["n"] / PART_ROWS), F.desc("us"), F.desc("tie"))
            parts = materialize(parts.withColumn("part", F.spark_partition_id()), "boundary_hour")
            found, before = _crossing(parts.groupBy("part").agg(F.sum("w").alias("w")).orderBy("part").collect(), most, before)
            part = parts.filter(F.col("part") == found["part"])
        newest_first = Window.partitionBy("part").orderBy(F.desc("us"), F.desc("tie")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranked = part.withColumn("run", F.lit(before) + F.sum("w").over(newest_first))
        out.append(tuple(ranked.filter(F.col("run") > most).orderBy("run", F.desc("us"), F.desc("tie")).select("us", "tie").first()))
    return out


def cut_off(df: DataFrame, ts: str, tie: str, limit, weight: str | None = None):
    """``(us, tie)`` of the newest row that no longer fits ``limit``; None if all rows fit."""
    return cut_offs(df, ts, tie, [(limit, weight)])[0]


def newer_than(ts: str, tie: str, stop: tuple | None) -> Column:
    """Whether a row is newer than the cut-off, and so kept; all are without one."""
    if stop is None:
        return F.lit(True)
    us, last = stop
    newer = F.col(tie).isNotNull() if last is None else F.col(tie) > F.lit(last)
    return F.coalesce((_micros(ts) > us) | ((_micros(ts) == us) & newer), F.lit(False))


def keep_newest(df: DataFrame, ts: str, tie: str, limit, weight: str | None = None,
                out: str = "keep") -> DataFrame:
    """Add boolean ``out``: row is among the newest whose running weight fits ``limit``.

    ``limit`` is a number or a scalar column; ``weight`` defaults to 1 per row (null counts 0).  Ties on
    the timestamp break on ``tie`` (the larger is newer, nulls are oldest); rows equal in both stand or
    fall together.  Rows without a timestamp are never kept unless all rows fit.  ``df`` is read three
    times, so give a table or a cheap view of one."""
    return df.withColumn(out, newer_than(ts, tie, cut_off(df, ts, tie, limit, weight)))
