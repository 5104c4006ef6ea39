"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagecorpus.llm import (alignment, chat_format, contamination, fingerprints, html_text, jaccard_join, language, licenses,
                            line_dedup, lm_score, mixing, spelling, tokens)
from pagecorpus.llm import common as C

# corpus_pipeline.py stands at the repository top
_TOP = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
if _TOP not in sys.path:
    sys.path.insert(0, _TOP)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_report(C.table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").withColumn("held_out", C.held_out("doc_id", 4, 2))
    model = language.fit(docs.where("not held_out"))
    return language.predict(docs, model, "doc_id", "held_out")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(C.table(spark, sf_dir, "documents"))


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_report(C.table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(C.table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(C.table(spark, sf_dir, "pages"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(C.table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.fuzzy_lines(C.table(spark, sf_dir, "documents"))


def op9_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.leaks(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    return mixing.decisions(docs).select("doc_id", "size", "source_size", "target",
                                         (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(C.table(spark, sf_dir, "documents"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.digests(chat_format.probe(C.table(spark, sf_dir, "conversations")))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_report(C.table(spark, sf_dir, "documents"))


def queries() -> dict:
    import corpus_pipeline

    found = (op1_fingerprints, op2_language, op3_lm_score, op4_tokens, op5_jaccard_join, op6_html_text, op7_licenses,
             op8_line_dedup, op9_contamination, op10_mixing, op11_spelling, op12_chat_format, op13_alignment)
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """SQL where it can express an operator over whole tables; the others are tested against a brute-force
    version (tests/llm)."""
    import corpus_pipeline

    found = {"op12_chat_format": chat_format.ORACLE_SQL, "pipeline": corpus_pipeline.ORACLE_SQL}
    return {name: sql for name, sql in found.items() if sql}
