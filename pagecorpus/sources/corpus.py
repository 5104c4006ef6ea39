"""The shredded node table as a written table in the shared checkpoint folder.

Shredding runs Python once per page, so it happens once per corpus: the node table is
written as parquet under ``spark.checkpoint.dir`` (shared storage on a cluster, so a lost
executor costs a re-read, not a re-parse) and read back with column pruning.  Repeated
calls in one session reuse the written table.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from pagecorpus.session import checkpoint_dir, fs_exists, fs_identity
from pagecorpus.sources.shred import shred
from pagecorpus.sources.tables import read_table, table_path

_WRITTEN: dict[tuple[str, str], str] = {}


def nodes_table(spark: SparkSession, sf_dir: str, pages: DataFrame | None = None,
                key: str | None = None) -> DataFrame:
    """Node table of ``sf_dir``'s pages (or of ``pages`` under a caller-chosen ``key``)."""
    src_key = (key or "") + fs_identity(spark, table_path(sf_dir, "pages"))
    cache_key = (spark.sparkContext.applicationId, src_key)
    path = _WRITTEN.get(cache_key)
    if path is None or not fs_exists(spark, path):
        if pages is None:
            pages = read_table(spark, sf_dir, "pages")
        # Parsing is CPU-bound Python: when the input has fewer splits than the cluster has
        # cores (one large file, one row group), spread pages round-robin first.  A large
        # corpus already has many splits and is never shuffled here.
        target = spark.sparkContext.defaultParallelism
        if pages.rdd.getNumPartitions() < target:
            pages = pages.repartition(target)
        path = os.path.join(checkpoint_dir(spark), "nodes", uuid.uuid4().hex)
        # One file group per page-id range keeps each page's nodes together on disk.
        shred(pages).write.mode("overwrite").parquet(path)
        _WRITTEN[cache_key] = path
    return spark.read.parquet(path)
