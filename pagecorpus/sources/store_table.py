"""The store as a table of immutable files and small version manifests (O-S1, O-C3, O-C5..O-C8).

Rows lie in ``data/version=V/bucket=B/fetch_date=D``: ``B`` is a hash of the key, so one key is
always in one bucket, ``D`` the day of the fetch.  A manifest names the version whose files hold
each live (bucket, date) partition.  A write puts files of the partitions it touches under a new
version and then commits by one rename of the manifest: readers see the old or the new table, an
attempt that failed leaves no trace, and a version that is already committed is not written again.

The driver holds manifests only, whose size is buckets times days, never rows.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagecorpus.session import fs_list, fs_read_text, fs_write_once, materialize

SCHEMA = T.StructType([
    T.StructField("cache_key", T.StringType()), T.StructField("url", T.StringType()), T.StructField("final_url", T.StringType()),
    T.StructField("status_code", T.IntegerType()), T.StructField("fetched_at", T.TimestampNTZType()),
    T.StructField("expires_at", T.TimestampNTZType()), T.StructField("mode", T.StringType()),
    T.StructField("content_length", T.LongType()), T.StructField("seq", T.LongType())])
COLUMNS = SCHEMA.fieldNames()
PLACED = T.StructType([*SCHEMA.fields, T.StructField("bucket", T.IntegerType()), T.StructField("fetch_date", T.StringType())])
BUCKETS = 16
ORDER = ("fetched_at", "seq")


class StoreTable:
    """The table at one version; writes return the table at the version they commit."""

    def __init__(self, spark: SparkSession, root: str, version: int = 0):
        self.spark, self.root, self.version = spark, root, version
        text = fs_read_text(spark, self._manifest(version)) if version else None
        state = json.loads(text) if text else {"buckets": BUCKETS, "parts": {}, "report": {}}
        self.buckets: int = state["buckets"]
        self.parts: dict[str, int] = state["parts"]
        #: What the write of this version did: rows deleted or put, partitions written anew.
        self.report: dict[str, int] = state["report"]

    def _manifest(self, version: int) -> str:
        return os.path.join(self.root, "versions", f"v{version}.json")

    @classmethod
    def latest(cls, spark: SparkSession, root: str) -> StoreTable:
        found = [int(f[1:-5]) for f in fs_list(spark, os.path.join(root, "versions")) if f.endswith(".json")]
        return cls(spark, root, max(found, default=0))

    def committed(self, version: int) -> bool:
        return f"v{version}.json" in fs_list(self.spark, os.path.join(self.root, "versions"))

    def _placed(self, folders) -> DataFrame:
        paths = [os.path.join(self.root, "data", f"version={self.parts[f]}", f) for f in sorted(folders)]
        if not paths:
            return self.spark.createDataFrame([], PLACED)
        found = self.spark.read.schema(SCHEMA).option("basePath", os.path.join(self.root, "data")).parquet(*paths)
        return found.select(*COLUMNS, F.col("bucket").cast("int").alias("bucket"), F.col("fetch_date").cast("string").alias("fetch_date"))

    def read(self, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
        """The rows; days outside the range are not listed or read."""
        def inside(folder: str) -> bool:
            day = folder.rpartition("=")[2]
            return (date_from is None or day >= date_from) and (date_to is None or day <= date_to)
        return self._placed([f for f in self.parts if inside(f)]).select(*COLUMNS)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """O-S2: the rows of the given ``cache_key`` values; only their buckets are read."""
        wanted = {r[0] for r in keys.select(self._bucket()).distinct().collect()}
        return self._placed(self._in_buckets(wanted)).select(*COLUMNS).join(keys.select("cache_key").distinct(), "cache_key", "left_semi")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("cache_key"), F.lit(self.buckets)).cast("int").alias("bucket")

    def _in_buckets(self, wanted: set[int]) -> list[str]:
        return [f for f in self.parts if int(f.split("/")[0].partition("=")[2]) in wanted]

    def _rewrite(self, version: int, touched: set[str], rows: DataFrame, report: dict[str, int]) -> StoreTable:
        """Put ``rows`` in place of the touched partitions and commit."""
        out = os.path.join(self.root, "data", f"version={version}")
        written: list[str] = []
        if touched:
            # rebalanced by partition: a large one is split over several tasks and files
            rows.select(*PLACED.fieldNames()).hint("rebalance", "bucket", "fetch_date").write.mode("overwrite") \
                .partitionBy("bucket", "fetch_date").parquet(out)
            written = [f"{b}/{d}" for b in fs_list(self.spark, out) if b.startswith("bucket=")
                       for d in fs_list(self.spark, os.path.join(out, b)) if d.startswith("fetch_date=")]
        parts = {f: v for f, v in self.parts.items() if f not in touched} | {f: version for f in written}
        state = {"buckets": self.buckets, "parts": parts, "report": report | {"partitions": len(written), "dropped": len(touched - set(written))}}
        fs_write_once(self.spark, self._manifest(version), json.dumps(state, sort_keys=True))
        return StoreTable(self.spark, self.root, version)

    def _next(self) -> int:
        return StoreTable.latest(self.spark, self.root).version + 1

    def upsert(self, rows: DataFrame, version: int | None = None) -> StoreTable:
        """O-C3: the newest row of each key by ``(fetched_at, seq)`` stays.  Only partitions that lose or
        get a row are written.  A version that is committed already is returned as it is."""
        from pagecorpus.sources.derived import upsert_latest

        version = self._next() if version is None else version
        if self.committed(version):
            return StoreTable(self.spark, self.root, version)
        # the passes that write also tell which partitions they meet: as many values as there are of them
        seen, won = Observation(), Observation()
        new = materialize(upsert_latest(rows.select(*COLUMNS)).select(
            *COLUMNS, self._bucket(), F.coalesce(F.to_date("fetched_at").cast("string"), F.lit("none")).alias("fetch_date"))
            .observe(seen, F.collect_set("bucket").alias("buckets")), "store_new")
        old = self._placed(self._in_buckets(set(seen.get["buckets"]))).select(
            "cache_key", "bucket", F.struct(*ORDER).alias("_old"), F.col("fetch_date").alias("_old_date"))
        folder = lambda day: F.concat(F.lit("bucket="), F.col("bucket").cast("string"), F.lit("/fetch_date="), F.col(day))
        wins = materialize(new.join(old, ["cache_key", "bucket"], "left")
                           .where(F.col("_old").isNull() | (F.struct(*ORDER) > F.col("_old"))).drop("_old")
                           .observe(won, F.count(F.lit(1)).alias("put"), F.collect_set(folder("fetch_date")).alias("now"),
                                    F.collect_set(folder("_old_date")).alias("before")), "store_wins")
        touched = set(won.get["now"]) | set(won.get["before"])
        rest = self._placed([f for f in touched if f in self.parts]).join(wins.select("cache_key"), "cache_key", "left_anti")
        return self._rewrite(version, touched, rest.unionByName(wins.drop("_old_date")), {"put": won.get["put"]})

    def _without(self, victims: DataFrame) -> StoreTable:
        """The table without the given rows (cache_key, bucket, fetch_date); one pass counts and lists them."""
        seen = Observation()
        folder = F.concat(F.lit("bucket="), F.col("bucket").cast("string"), F.lit("/fetch_date="), "fetch_date")
        gone = materialize(victims.select("cache_key", "bucket", "fetch_date").observe(
            seen, F.count(F.lit(1)).alias("n"), F.collect_set(folder).alias("folders")), "store_gone")
        touched = set(seen.get["folders"])
        rest = self._placed(touched).join(gone.select("cache_key"), "cache_key", "left_anti")
        return self._rewrite(self._next(), touched, rest, {"deleted": seen.get["n"]})

    def delete_keys(self, keys: DataFrame) -> StoreTable:
        """O-C5: delete by key; only the keys' buckets are read."""
        wanted = {r[0] for r in keys.select(self._bucket()).distinct().collect()}
        return self._without(self._placed(self._in_buckets(wanted)).join(keys.select("cache_key").distinct(), "cache_key", "left_semi"))

    def delete_urls(self, urls: DataFrame) -> StoreTable:
        """O-C6: delete by exact stored URL."""
        return self._without(self._placed(self.parts).join(urls.select("url").distinct(), "url", "left_semi"))

    def delete_where(self, gone: Column) -> StoreTable:
        """O-C8, O-C12: delete rows by a condition (null keeps)."""
        return self._without(self._placed(self.parts).where(gone))

    def purge(self) -> StoreTable:
        """O-C7: an empty table; its rows are counted from the files' footers."""
        version = self._next()
        state = {"buckets": self.buckets, "parts": {}, "report": {"deleted": self._placed(self.parts).count(), "partitions": 0, "dropped": len(self.parts)}}
        fs_write_once(self.spark, self._manifest(version), json.dumps(state, sort_keys=True))
        return StoreTable(self.spark, self.root, version)

    def compact(self, max_files: int = 1) -> StoreTable:
        """O-C18: partitions of more than ``max_files`` files are written anew; the rows stay."""
        def files(folder: str) -> int:
            return sum(f.startswith("part-") for f in fs_list(self.spark, os.path.join(self.root, "data", f"version={self.parts[folder]}", folder)))
        touched = {f for f in self.parts if files(f) > max_files}
        return self._rewrite(self._next(), touched, self._placed(touched), {"compacted": len(touched)})
