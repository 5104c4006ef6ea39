"""Kernels on the node table: subtree removal (O-H2) and visible text (O-H17).

Subtree removal uses the pre-order interval of each node: node ``x`` lies inside a flagged
subtree iff some flagged node ``f <= x`` has ``last_desc(f) >= x``.  That is one running
max per page over ``node_id`` order -- one narrow exchange by ``page_id`` and no
row-multiplying explode of ``path``.  Page size is bounded by the store's size cap, so a
page is a bounded window partition even when one domain dominates the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagecorpus.functions.text import text_lines



def _page_order():
    return Window.partitionBy("page_id").orderBy("node_id")

# Elements whose subtrees are not visible text.
TEXT_DROP_TAGS = ["script", "style", "noscript", "template"]
TEXT_KINDS = ["text", "cdata"]


def inside_flagged(flag: Column) -> Column:
    """True when the row or one of its ancestors carries ``flag`` (needs page_id, node_id,
    last_desc)."""
    reach = F.max(F.when(flag, F.col("last_desc"))).over(_page_order().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return F.coalesce(reach >= F.col("node_id"), F.lit(False))


def remove_subtrees(nodes: DataFrame, flag: Column) -> DataFrame:
    """Drop every node inside a subtree whose root satisfies ``flag`` (O-H2)."""
    return (nodes.withColumn("_gone", inside_flagged(flag))
            .filter(~F.col("_gone")).drop("_gone"))


def ordered_join(df: DataFrame, key_cols: list[str], order_col: str, value_col: str,
                 sep: str, out: str) -> DataFrame:
    """Per key, the values in ``order_col`` order joined by ``sep`` (empty values skipped)."""
    pairs = F.collect_list(F.struct(F.col(order_col).alias("o"), F.col(value_col).alias("v")))
    return (df.filter(F.col(value_col) != "")
            .groupBy(*key_cols)
            .agg(F.array_join(F.transform(F.array_sort(pairs), lambda p: p["v"]), sep).alias(out)))


def visible_text(nodes: DataFrame) -> DataFrame:
    """Visible text per page (O-H17): drop script / style / noscript / template subtrees,
    one line per text piece, whitespace collapsed, blank lines dropped.

    Returns ``(page_id, text)``; pages with no text get ''.
    """
    kept = remove_subtrees(
        nodes.select("page_id", "node_id", "last_desc", "kind", "tag", "text"),
        (F.col("kind") == "element") & F.col("tag").isin(TEXT_DROP_TAGS))
    pieces = (kept.filter(F.col("kind").isin(TEXT_KINDS))
              .select("page_id", "node_id", text_lines(F.col("text")).alias("piece")))
    text = ordered_join(pieces, ["page_id"], "node_id", "piece", "\n", "text")
    pages = nodes.filter(F.col("node_id") == 0).select("page_id")
    return (pages.join(text, "page_id", "left")
            .select("page_id", F.coalesce(F.col("text"), F.lit("")).alias("text")))
