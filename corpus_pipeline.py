"""The corpus pipeline: language ID, n-gram Jaccard join, benchmark decontamination, mixing of
sources, token files.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's ``docs``.  All stages but
the last return the columns of ``documents``.

Defined results: rows that a stage keeps are kept whole, with every column; an empty table passes
through; details of null, repeated and very long rows stand with the operators.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from pagecorpus.llm import common, contamination, jaccard_join, language, mixing, tokens
from pagecorpus.session import apply_session_conf, checkpoint_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labelled rows of its input."""
    apply_session_conf(spark)
    return language.keep_known(docs, language.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join, at five words and a similarity of 0.8."""
    apply_session_conf(spark)
    return jaccard_join.keep_one(docs, 5, 80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item."""
    apply_session_conf(spark)
    return contamination.keep_clean(docs, common.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    apply_session_conf(spark)
    return mixing.mix(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixed corpus; returns what is read back from them."""
    apply_session_conf(spark)
    return tokens.token_report(docs)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate),
          ("mix_sources", mix_sources), ("token_files", token_files)]

#: The classifier, the tokenizer and the sampling hash have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    base = f"{checkpoint_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(os.path.join(base, name))
        docs = spark.read.parquet(os.path.join(base, name))
    return STAGES[-1][1](spark, docs, sf_dir)
