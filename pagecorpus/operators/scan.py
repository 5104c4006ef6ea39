"""Ordered scans (running sum, running max, previous row) per group, in parts of equal row count.

A window partitioned by a group key sends the whole group to one task; a domain or a second
that holds a third of all rows would then be one task.  Here the rows are dealt by range of
``(group, ts, tie)`` into as many parts as the session shuffles into, whatever their times are:

1. the dealt rows are written once with their part number, so that a repeated task finds the same parts;
2. a window scans each (part, group) on its own;
3. one summary row for each (part, group) is scanned over the parts of a group -- there are as
   many as parts and groups together, and few for one group;
4. each row combines its local result with what the parts before carry in.

Ordering is ``(ts, tie)`` ascending, nulls first; rows that agree in both stand in any order, so
``tie`` should tell rows apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pagecorpus.session import materialize


class Parts:
    """Rows dealt into parts; ``rows`` has the part number in ``_part``."""

    def __init__(self, df: DataFrame, group: list[str], ts: str, tie: str):
        self.group, self.ts, self.tie = group, ts, tie
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = df.repartitionByRange(n, *group, ts, tie).withColumn("_part", F.spark_partition_id())
        self.rows = materialize(dealt, "scan_parts")

    def window(self) -> WindowSpec:
        """The rows of a group within a part, in order."""
        return Window.partitionBy("_part", *self.group).orderBy(self.ts, self.tie)

    def up_to_here(self) -> WindowSpec:
        return self.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def with_carry(self, local: DataFrame, summary: dict[str, Column], carry: list[Callable[[WindowSpec], dict[str, Column]]]) -> DataFrame:
        """``local`` with the carried-in columns: ``summary`` columns of each (part, group), then the columns
        of each ``carry`` step over the group's parts before."""
        order = Window.partitionBy(*self.group).orderBy("_part") if self.group else Window.orderBy("_part")
        parts = local.groupBy("_part", *self.group).agg(*(c.alias(n) for n, c in summary.items()))
        kept: list[str] = []
        for step in carry:
            made = step(order.rowsBetween(Window.unboundedPreceding, -1))
            parts = parts.withColumns(made)
            kept += made
        keys = ["_part", *self.group]
        right = parts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *kept)
        on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) if i else F.col(k) == F.col("_k0") for i, k in enumerate(keys)]
        return local.join(right, on, "left").drop("_part", *(f"_k{i}" for i in range(len(keys))))


def running_sum(df: DataFrame, part: list[str], ts: str, tie: str, value: str, out: str, inclusive: bool = True) -> DataFrame:
    """``out`` = sum of ``value`` over the group's rows up to this one (or strictly before)."""
    p = Parts(df, part, ts, tie)
    frame = p.window().rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    local = p.rows.withColumn("_loc", F.coalesce(F.sum(value).over(frame), F.lit(0)))
    whole = p.with_carry(local, {"_cs": F.sum(value)}, [lambda before: {"_carry": F.coalesce(F.sum("_cs").over(before), F.lit(0))}])
    return whole.withColumn(out, F.col("_carry") + F.col("_loc")).drop("_loc", "_carry")


def running_max(df: DataFrame, part: list[str], ts: str, tie: str, value: str, out: str) -> DataFrame:
    """``out`` = max of ``value`` over the group's rows up to and including this one."""
    p = Parts(df, part, ts, tie)
    local = p.rows.withColumn("_loc", F.max(value).over(p.up_to_here()))
    whole = p.with_carry(local, {"_cm": F.max(value)}, [lambda before: {"_carry": F.max("_cm").over(before)}])
    return whole.withColumn(out, F.greatest(F.col("_carry"), F.col("_loc"))).drop("_loc", "_carry")


def previous_value(df: DataFrame, part: list[str], ts: str, tie: str, value: str, out: str) -> DataFrame:
    """``out`` = ``value`` of the group's previous row in ``(ts, tie)`` order (null first)."""
    p = Parts(df, part, ts, tie)
    local = p.rows.withColumns({"_loc": F.lag(value).over(p.window()), "_first": F.row_number().over(p.window()) == 1})
    last = F.max_by(F.struct(value), F.struct(F.col(ts).isNotNull(), F.col(ts), F.col(tie).isNotNull(), F.col(tie)))
    # of all parts before, the newest that has rows of the group
    whole = p.with_carry(local, {"_last": last}, [lambda before: {"_carry": F.last("_last").over(before)}])
    return (whole.withColumn(out, F.when(F.col("_first"), F.col("_carry")[value]).otherwise(F.col("_loc")))
            .drop("_loc", "_carry", "_first"))


def queue_starts(df: DataFrame, part: list[str], ts: str, tie: str, arrival: str, cost: str, out: str) -> DataFrame:
    """``out`` = earliest start of each row in a queue served one at a time: with ``P`` the ``cost`` of all rows
    before, ``P + max(arrival - P)`` over the rows so far.  Both prefixes come from one table: where
    ``c`` is what the parts before cost, a part's ``P`` is ``c`` and its own prefix, so its maximum of
    ``arrival - P`` is the local one less ``c``."""
    p = Parts(df, part, ts, tie)
    before_row = p.window().rowsBetween(Window.unboundedPreceding, -1)
    local = p.rows.withColumn("_lp", F.coalesce(F.sum(cost).over(before_row), F.lit(0)))
    local = local.withColumn("_lm", F.max(F.col(arrival) - F.col("_lp")).over(p.up_to_here()))
    whole = p.with_carry(
        local, {"_cost": F.sum(cost), "_most": F.max("_lm")},
        [lambda before: {"_cp": F.coalesce(F.sum("_cost").over(before), F.lit(0))},
         lambda before: {"_cm": F.max(F.col("_most") - F.col("_cp")).over(before)}])
    start = F.col("_cp") + F.col("_lp") + F.greatest(F.col("_cm"), F.col("_lm") - F.col("_cp"))
    return whole.withColumn(out, start).drop("_lp", "_lm", "_cp", "_cm")
