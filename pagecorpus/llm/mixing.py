"""Operator 10, mixing sources to target weights by systematic sampling.

Sources in ascending code-point order (null last) weigh 5, 2, 1, repeating, and share 100 % of
all sizes; a target stops at 3 times its source's size and the excess is shared by weight among
the rest.  Every document of a source expects ``target / source size`` copies.  Within a source
documents stand in the order (size, hash of id, id); a prefix sum of the expected copies plus
one offset per source, fixed by a seed, gives a document one copy for every integer boundary
that its stretch crosses.  Since the order is by size, each size is sampled at the same rate,
and the words taken come near the target.

The prefix sum is distributed: rows are range-partitioned by (source, order), each partition
ranks its own rows, and a table of one row for each partition and source carries the offsets,
so a source that holds a third of all rows is spread over a third of the partitions.

Defined results: null text = size 0; equal rows are ranked one after the other; no document is
taken more than 3 times; a source without words has target 0 and takes nothing; a null id is a
document as any other.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagecorpus.llm import common as C
from pagecorpus.session import materialize

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
SEED = 17
ROWS = 200_000


def word_count(col: str = "text"):
    """Number of words without building them: a word starts where white space ends."""
    t = F.coalesce(F.col(col), F.lit(""))
    squeezed = F.trim(F.regexp_replace(F.translate(t, "\t\n\x0b\x0c\r", "     "), " +", " "))
    return F.when(squeezed == "", F.lit(0)).otherwise(
        F.length(squeezed) - F.length(F.replace(squeezed, F.lit(" "), F.lit(""))) + 1).cast("long")


def targets(sizes: dict, weights=WEIGHTS, most: float = MOST) -> dict:
    """Target words of each source.  ``sizes`` has one entry for each source (None: no source).
    Excess over ``most`` times a source's size goes to the others by weight, until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total = float(sum(sizes.values()))
    fixed: dict = {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = sum(weight[s] for s in free)
        goal = {s: left * weight[s] / share for s in free}
        over = [s for s in free if goal[s] > most * sizes[s]]
        if not over:
            return {**fixed, **goal}
        fixed.update({s: most * sizes[s] for s in over})
        if len(over) == len(free):
            return fixed


def decisions(docs: DataFrame, weights=WEIGHTS, most: float = MOST, seed: int = SEED) -> DataFrame:
    """One row for each document: (doc_id, key, source, size, source_size, target, copies).
    ``key`` is a hash of the text, which with doc_id names the row's text."""
    spark = docs.sparkSession
    d = docs.select("doc_id", "source", word_count().alias("size"), F.xxhash64("text").alias("key"))
    d = materialize(d, "mix_sizes")
    # one row for each source
    per = {r["source"]: (int(r["s"]), int(r["n"])) for r in d.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()}
    goal = targets({s: v[0] for s, v in per.items()}, weights, most)
    plan = [(s, s is None, v[0], goal[s], min(most, goal[s] / v[0]) if v[0] else 0.0,
             xxhash.xxh64_intdigest(f"{seed}:{s}".encode()) / 2.0**64) for s, v in per.items()]
    plans = spark.createDataFrame(plan, "source string, _null boolean, source_size long, target double, rate double, offset double")
    keys = [F.col("source").isNull(), F.col("source"), F.col("size"), F.xxhash64("doc_id"), F.col("doc_id"), F.col("key")]
    n = C.blocks_for(sum(v[1] for v in per.values()), ROWS)
    n = max(n, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = materialize(d.repartitionByRange(n, *keys).withColumn("part", F.spark_partition_id()), "mix_ranges")
    # one row for each partition and source that meet
    counts = cut.groupBy("source", "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select(F.col("source").alias("s2"), F.col("part").alias("p2"), F.coalesce("before", F.lit(0)).alias("before"))
    own = Window.partitionBy("part", "source").orderBy("size", F.xxhash64("doc_id"), "doc_id", "key")
    ranked = cut.withColumn("rank", F.row_number().over(own))
    ranked = (ranked.join(before, F.col("source").eqNullSafe(F.col("s2")) & (F.col("part") == F.col("p2")))
              .withColumn("rank", F.col("rank") + F.col("before")).drop("s2", "p2", "before", "part"))
    p = plans.select(F.col("source").alias("s2"), "source_size", "target", "rate", "offset")
    ranked = ranked.join(F.broadcast(p), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")  # a row for each source
    crossed = (F.floor(F.col("rank") * F.col("rate") + F.col("offset"))
               - F.floor((F.col("rank") - 1) * F.col("rate") + F.col("offset")))
    return ranked.select("doc_id", "key", "source", "size", "source_size", "target", "rank",
                         F.least(crossed, F.ceil("rate")).cast("int").alias("copies"))


def mix(docs: DataFrame, weights=WEIGHTS, most: float = MOST, seed: int = SEED) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as it is taken, with all its columns."""
    cols = [F.col(f"`{c}`") for c in docs.columns]
    chosen = (decisions(docs, weights, most, seed)
              .groupBy(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.col("source").alias("__source"))
              .agg(F.sum("copies").alias("__sum"), F.count("*").alias("__rows")).where("__sum > 0"))
    chosen = C.small(materialize(chosen, "mix_chosen"))
    met = docs.withColumn("__k", F.xxhash64("text")).join(
        chosen, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__k") == F.col("__key")) & F.col("source").eqNullSafe(F.col("__source")))
    one = met.where("__rows = 1").select(*cols, F.col("__sum").alias("__n"))
    # equal rows share the sum of their copies by place
    place = Window.partitionBy("__id", "__key", "__source").orderBy(F.monotonically_increasing_id())
    many = (met.where("__rows > 1").withColumn("__p", F.row_number().over(place))
            .select(*cols, F.expr("(__p * __sum) div __rows - ((__p - 1) * __sum) div __rows").alias("__n")))
    out = one.unionByName(many).where("__n > 0").withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))))
    return out.select(*cols)
