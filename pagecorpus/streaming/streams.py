"""Structured Streaming twins of the batch operators (O-T1..O-T5).

Sources are parquet folders read with ``readStream``; every query runs with
``trigger(availableNow=True)`` and a checkpoint under the shared checkpoint folder, so a
restarted query resumes where it stopped.  Sinks are idempotent per micro-batch id.

* O-T1 snapshot ingest: ``foreachBatch`` upserts each batch into the versioned store table
  (``sources/store_table.py``): only touched partitions are written, and a replayed batch finds
  its version committed.
* O-T2 duplicate suppression by each row's own TTL: keyed state (``state.Suppression``), late rows
  in an output of their own.
* O-T3 windowed counters: watermark + tumbling ``window`` + ``groupBy`` in append mode, so closed
  windows leave the state; late rows are counted.
* O-T4 job states: ``foreachBatch`` folds each batch into the state of all live jobs (``state.advance``), which
  leave it when the watermark is past their result TTL; a replayed batch finds its version committed.
* O-T5 periodic retention: the O-C15 cleanup run over the ingested store.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagecorpus.session import checkpoint_dir, fs_list
from pagecorpus.sources.store_table import StoreTable
from pagecorpus.streaming.state import JOB_ROWS, LOOKBACK, SUPPRESSED_ROWS, JobLog, Suppression, advance, job_rows, late_rows


def scratch(spark: SparkSession, kind: str) -> str:
    return os.path.join(checkpoint_dir(spark), "streams", kind, uuid.uuid4().hex)


def write_source_files(df: DataFrame, path: str, n_files: int, order_col: str) -> str:
    """Land a table as ``n_files`` parquet files cut by ``order_col`` ranges (a stream's input); files that
    are there already stay and come first.

    The file source reads files in modification-time order; parallel writers finish in any
    order, so the files' times are set in range order afterwards (Hadoop file-system API),
    making every replay see the ranges oldest first."""
    spark = df.sparkSession
    before = set(fs_list(spark, path))
    df.repartitionByRange(n_files, order_col).write.mode("append").parquet(path)
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stats = [st for st in fs.listStatus(root) if st.getPath().getName().startswith("part-")]
    old = [int(st.getModificationTime()) for st in stats if st.getPath().getName() in before]
    parts = sorted((st.getPath() for st in stats if st.getPath().getName() not in before),
                   key=lambda p: p.getName())  # part-00000.. follow the range order
    base = max([int(fs.getFileStatus(root).getModificationTime()), *old])
    for i, p in enumerate(parts):
        fs.setTimes(p, base + 1000 * (i + 1), -1)
    return path


#: Micro-batches that a replay takes: files are read in order, so many to a batch.
REPLAY_BATCHES = 6


def input_files(spark: SparkSession) -> int:
    """Files of a landed stream input: as many as the session shuffles into."""
    return max(REPLAY_BATCHES, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    if files_per_trigger is None:
        files_per_trigger = max(1, sum(f.startswith("part-") for f in fs_list(spark, path)) // REPLAY_BATCHES)
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path))


def _run(writer, ckpt: str):
    """Run a query over all files that are there; returns it, ended."""
    q = writer.option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def _keyed_state(spark: SparkSession) -> None:
    """State with timers lives in RocksDB, on each executor's disk and in the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _with_event_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    # event time as TIMESTAMP (the session zone is UTC, so the instant is unchanged)
    return df.withColumn("_evt", F.col(ts).cast("timestamp")).withWatermark("_evt", delay)


def _put(out_dir: str, *by: str):
    """A sink that writes each batch to its own folder, so that a replayed batch replaces itself."""
    def put(batch: DataFrame, batch_id: int) -> None:
        path = os.path.join(out_dir, f"batch_id={batch_id}")
        (batch.write.partitionBy(*by) if by else batch.write).mode("overwrite").parquet(path)
    return put


def _read_batches(spark: SparkSession, out_dir: str, columns: str) -> DataFrame:
    """What ``_put`` wrote, with ``batch_id``."""
    if not any(f.startswith("batch_id=") for f in fs_list(spark, out_dir)):
        return spark.createDataFrame([], columns + ", batch_id int")
    return spark.read.schema(columns + ", batch_id int").parquet(out_dir)


def ingest_snapshots(spark: SparkSession, source: str, schema, store_dir: str) -> DataFrame:
    """O-T1: stream of snapshot rows -> upserted store table; returns its rows."""
    def merge(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        StoreTable.latest(s, store_dir).upsert(batch, batch_id + 1)

    _run(_stream(spark, source, schema).writeStream.foreachBatch(merge), store_dir + "_ckpt")
    return StoreTable.latest(spark, store_dir).read()


def _state_rows(q) -> int:
    """Rows in the state of an ended query: states, pending rows and timers."""
    done = q.recentProgress
    return done[-1]["stateOperators"][0]["numRowsTotal"] if done else 0


def suppress_within_ttl(spark: SparkSession, source: str, schema, out_dir: str, key: str = "cache_key",
                        lateness_seconds: int = 3600) -> tuple[DataFrame, int]:
    """O-T2: a row is dropped while the last kept row of its key has not expired (its own ``expires_at``).
    Returns (key, seq, ts_us, kind): ``kept`` rows, and ``late`` ones that came after the watermark;
    and the number of rows left in the state."""
    _keyed_state(spark)
    rows = _with_event_time(_stream(spark, source, schema), "fetched_at", LOOKBACK).select(
        F.col(key).alias("key"), "seq", F.unix_micros("_evt").alias("ts_us"),
        F.unix_micros(F.col("expires_at").cast("timestamp")).alias("until_us"), "_evt")
    out = rows.groupBy("key").transformWithState(Suppression(lateness_seconds), SUPPRESSED_ROWS, "append", "EventTime")
    q = _run(out.writeStream.outputMode("append").foreachBatch(_put(out_dir, "kind")), out_dir + "_ckpt")
    return _read_batches(spark, out_dir, SUPPRESSED_ROWS).drop("batch_id"), _state_rows(q)


def windowed_counts(spark: SparkSession, source: str, schema, out_dir: str, ts: str, keys: list[str],
                    width: str = "1 hour", delay: str = "2 hours") -> tuple[DataFrame, dict]:
    """O-T3: counts per tumbling window and key, in append mode: a window is given out once, when the
    watermark passes its end, and leaves the state.  Also returns what the run measured: rows read
    (``rows_in``) and windows left in the state (``state_rows``)."""
    rows = _with_event_time(_stream(spark, source, schema), ts, delay).observe("seen", F.count(F.lit(1)).alias("rows_in"))
    agg = rows.groupBy(F.window("_evt", width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"),
                                                                     F.sum("elapsed_ms").alias("elapsed_ms_sum"))
    q = _run(agg.writeStream.outputMode("append").foreachBatch(_put(out_dir)), out_dir + "_ckpt")
    seen = sum(p["observedMetrics"]["seen"]["rows_in"] for p in q.recentProgress if p["numInputRows"])
    kinds = ", ".join(f"{c} {t}" for c, t in agg.dtypes)
    return _read_batches(spark, out_dir, kinds).drop("batch_id"), {"rows_in": seen, "state_rows": _state_rows(q)}


def job_state_stream(spark: SparkSession, source: str, schema, out_dir: str, ttl_seconds: int,
                     lateness_seconds: int = 3600) -> tuple[DataFrame, int]:
    """O-T4: job events -> rows (job_id, kind, ...): ``state`` rows hold a job's state after a batch,
    ``expired`` rows tell that a finished job outlived the TTL and left the state, ``late`` rows
    are events from before the watermark; and the number of rows left in the state.

    The watermark of a batch is the newest time of the batches before it, in milliseconds, less the allowed
    lateness.  When all files are read, a batch without events lets the jobs go that the last one outdated.  Batch
    ``b`` is version ``2 * b`` of the state and of the output, the one without events ``2 * b + 1``."""
    root = out_dir + "_state"

    def put(batch: DataFrame, version: int) -> None:
        s = batch.sparkSession
        log = JobLog(s, root)
        if log.version >= version:  # replayed
            return
        now = None if log.newest_us is None else log.newest_us // 1000 * 1000 - lateness_seconds * 1_000_000
        late = F.coalesce(F.col("ts_us") < F.lit(now).cast("long"), F.lit(False))
        state = log.write(version, advance(log.state(), batch.where(~late), now, ttl_seconds * 1_000_000))
        _put(out_dir, "kind")(job_rows(state).union(late_rows(batch.where(late))), version)
        newest = batch.agg(F.max("ts_us")).first()[0]
        log.commit(version, max((x for x in (newest, log.newest_us) if x is not None), default=None))

    events = _stream(spark, source, schema).select("job_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "event")
    _run(events.writeStream.foreachBatch(lambda batch, batch_id: put(batch, 2 * batch_id)), out_dir + "_ckpt")
    last = JobLog(spark, root).version
    if last >= 0 and last % 2 == 0:
        put(spark.createDataFrame([], "job_id long, ts_us long, event string"), last + 1)
    return _read_batches(spark, out_dir, JOB_ROWS), JobLog(spark, root).rows()


def latest_states(rows: DataFrame) -> DataFrame:
    """The last state of each job, as in the batch fold (O-J1)."""
    cols = ["status", "created_us", "started_us", "finished_us", "updated_us"]
    last = rows.where("kind = 'state'").groupBy("job_id").agg(F.max_by(F.struct(*cols), "batch_id").alias("s")).select("job_id", "s.*")
    return last.select("job_id", "status", *(F.timestamp_micros(c).cast("timestamp_ntz").alias(c.replace("_us", "_at")) for c in cols[1:]))
