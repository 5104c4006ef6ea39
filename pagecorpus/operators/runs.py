"""Counters and gauges of runs (O-M3, O-M5, O-M8): taken by ``observe`` from the jobs that do the work, so
no table is read again to count it.  The driver holds a fixed set of numbers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pagecorpus.operators import store as st
from pagecorpus.session import materialize
from pagecorpus.sources.store_table import StoreTable

#: Counters that runs give.
COUNTERS = ("cache_cleanup_runs_total", "cache_cleanup_deleted_entries_total", "cache_cleanup_errors_total", "cache_vacuum_runs_total",
            "cache_vacuum_errors_total", "extraction_requests_total", "extraction_success_total", "extraction_error_total",
            "auth_requests_total", "auth_failures_total", "proxy_requests_total", "proxy_errors_total")


class RunMetrics:
    """What the runs of one process have counted."""

    def __init__(self) -> None:
        self.counters = dict.fromkeys(COUNTERS, 0)
        self.gauges: dict[str, float] = {}

    def add(self, **counts: int) -> None:
        for name, n in counts.items():
            self.counters[name] += n or 0

    def frame(self, spark: SparkSession) -> DataFrame:
        """Long form (metric, kind, value)."""
        rows = [(n, "counter", float(v)) for n, v in self.counters.items()] + [(n, "gauge", float(v)) for n, v in self.gauges.items()]
        return spark.createDataFrame(rows, "metric string, kind string, value double")

    def counted(self, df: DataFrame, **conditions: Column) -> DataFrame:
        """``df`` written, its rows that meet each condition added to the counter of that name."""
        seen = Observation()
        out = materialize(df.observe(seen, *(F.count(F.when(c, 1)).alias(n) for n, c in conditions.items())), "run")
        self.add(**seen.get)
        return out

    def extraction(self, results: DataFrame) -> DataFrame:
        """Results (.., extraction_error) of one extraction run."""
        failed = F.col("extraction_error").isNotNull()
        return self.counted(results, extraction_requests_total=F.lit(True), extraction_success_total=~failed, extraction_error_total=failed)

    def auth(self, attributed: DataFrame) -> DataFrame:
        """Requests (.., auth) after attribution."""
        ok = F.col("auth") == "ok"
        return self.counted(attributed, auth_requests_total=ok, auth_failures_total=~ok)

    def proxy(self, chosen: DataFrame) -> DataFrame:
        """Requests (.., proxy, proxy_error, outcome): those answered by the store use no proxy."""
        return self.counted(chosen, proxy_requests_total=F.col("proxy").isNotNull() & (F.col("outcome") != "hit"),
                            proxy_errors_total=F.col("proxy_error").isNotNull())

    def cleanup(self, table: StoreTable, now: datetime, grace_seconds: int, max_entries: int, max_size: int, vacuum: bool = False) -> StoreTable:
        """O-C15 on the written table, counted (O-M8); a run that fails leaves the table as it is."""
        at = F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")
        try:
            if min(grace_seconds, max_entries, max_size) < 0:
                raise ValueError("limits of a cleanup must not be negative")
            kept, seen = F.col("phase").isNull(), Observation()
            tagged = st.cleanup(table.read(), at, grace_seconds, max_entries, max_size).observe(
                seen, F.count(F.when(kept, 1)).alias("entries"), F.count(F.when(~kept, 1)).alias("deleted"),
                F.coalesce(F.sum(F.when(kept, F.col("content_length"))), F.lit(0)).alias("size"),
                F.count(F.when(kept & (F.col("expires_at") < at), 1)).alias("expired"))
            gone = materialize(tagged.where(~kept).select("cache_key"), "cleanup_gone")
            after = table.delete_keys(gone)
        except Exception:
            self.add(cache_cleanup_errors_total=1)
            return table
        got = seen.get
        self.add(cache_cleanup_runs_total=1, cache_cleanup_deleted_entries_total=got["deleted"])
        self.gauges |= {"cache_size_bytes": got["size"], "cache_entries_total": got["entries"], "cache_expired_entries_total": got["expired"]}
        if vacuum:
            try:
                after = after.compact()
                self.add(cache_vacuum_runs_total=1)
            except Exception:
                self.add(cache_vacuum_errors_total=1)
        return after

    def health(self, log: DataFrame) -> None:
        """Up, if a request of the newest hour of the log did not fail."""
        hour = F.date_trunc("hour", "requested_at")
        last = log.groupBy(hour.alias("h")).agg(F.max((~F.col("failed")).cast("int")).alias("up")).agg(F.max_by("up", "h")).first()[0]
        self.gauges["scraper_up"] = last or 0
