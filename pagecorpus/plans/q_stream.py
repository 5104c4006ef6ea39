"""Registered streaming queries (O-T1..O-T5): each replays derived input files through a
Structured Streaming query (``availableNow``) and returns the sink's final table; where a
batch twin exists the same DuckDB SQL checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagecorpus.operators import store as st
from pagecorpus.plans import sqlbits as S
from pagecorpus.plans.q_jobs import RESULT_TTL, q_job_states
from pagecorpus.plans.q_store import CLEANUP_SQL, GRACE_SECONDS, MAX_ENTRIES, MAX_SIZE
from pagecorpus.plans.registry import ORACLES, register
from pagecorpus.sources import derived as D
from pagecorpus.streaming import streams as T


def _snapshot_rows(spark, sf_dir):
    raw = D.snapshots_raw(spark, sf_dir).join(D.page_keys(spark, sf_dir).select("page_id", "cache_key"), "page_id")
    return raw.drop("page_id").withColumn("final_url", F.col("url"))


def _ingested_store(spark, sf_dir):
    rows = _snapshot_rows(spark, sf_dir)
    src = T.write_source_files(rows, T.scratch(spark, "snap_src"), T.input_files(spark), "fetched_at")
    return T.ingest_snapshots(spark, src, rows.schema, T.scratch(spark, "store"))


@register("stream_ingest", ORACLES["store_upsert"])
def q_stream_ingest(spark, sf_dir):
    """O-T1: continuous snapshot ingest -- the streamed upsert equals the batch store."""
    return _ingested_store(spark, sf_dir).select(
        "cache_key", "url", "final_url", "status_code", "fetched_at", "expires_at", "mode", "content_length", "seq")


#: Every so many rows are held back and arrive last, to show what becomes of late rows.
HELD_BACK = 97
LATENESS = 3600

DEDUP_SQL = S.with_views(["snapshots_raw", "fetch_log", "page_keys"], f"""
SELECT cache_key, seq, fetched_at, kind FROM (
  SELECT cache_key, seq, fetched_at, 'late' AS kind FROM rows_in WHERE late
  UNION ALL SELECT cache_key, seq, fetched_at, 'kept' FROM walk WHERE kept)""", f"""
rows_in AS (
  SELECT k.cache_key, r.seq, r.fetched_at, r.expires_at, r.seq % {HELD_BACK} = 0 AS held,
         r.seq % {HELD_BACK} = 0 AND r.fetched_at < (SELECT date_trunc('milliseconds', max(fetched_at)) FROM snapshots_raw
                                                     WHERE seq % {HELD_BACK} <> 0) - INTERVAL {LATENESS} SECOND AS late
  FROM snapshots_raw r JOIN fetch_log f ON f.request_id = r.seq JOIN page_keys k USING (page_id)),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY held, fetched_at, seq) AS i FROM rows_in WHERE NOT late),
walk AS (
  WITH RECURSIVE w AS (
    SELECT cache_key, seq, fetched_at, i, true AS kept, expires_at AS until FROM ordered WHERE i = 1
    UNION ALL
    SELECT o.cache_key, o.seq, o.fetched_at, o.i, coalesce(o.fetched_at > w.until, false),
           CASE WHEN coalesce(o.fetched_at > w.until, false) THEN o.expires_at ELSE w.until END
    FROM w JOIN ordered o ON o.cache_key = w.cache_key AND o.i = w.i + 1)
  SELECT * FROM w)""")


@register("stream_dedup", DEDUP_SQL)
def q_stream_dedup(spark, sf_dir):
    """O-T2: repeated fetches of a key dropped while its last kept row holds; rows that come too late
    (every ``HELD_BACK``-th arrives after all others) are given out as such."""
    rows = _snapshot_rows(spark, sf_dir)
    src, out = T.scratch(spark, "dedup_src"), T.scratch(spark, "dedup_out")
    held = F.col("seq") % HELD_BACK == 0
    T.write_source_files(rows.where(~held), src, T.input_files(spark), "fetched_at")
    T.suppress_within_ttl(spark, src, rows.schema, out, lateness_seconds=LATENESS)
    T.write_source_files(rows.where(held), src, T.REPLAY_BATCHES, "fetched_at")
    got, _ = T.suppress_within_ttl(spark, src, rows.schema, out, lateness_seconds=LATENESS)  # goes on where it stopped
    return got.select(F.col("key").alias("cache_key"), "seq", F.timestamp_micros("ts_us").cast("timestamp_ntz").alias("fetched_at"), "kind")


WINDOW_SQL = S.with_views(["fetch_log"], """
SELECT date_trunc('hour', requested_at) AS window_start, mode, count(*) AS n, sum(elapsed_ms) AS elapsed_ms_sum
FROM fetch_log GROUP BY 1, 2""")


def _end_of_stream(rows):
    """One row a day after all others, which closes their windows; its own stays open."""
    last = rows.agg(F.max("requested_at").alias("requested_at")).where("requested_at is not null")
    cols = [(F.col(c) + F.expr("interval 1 day") if c == "requested_at" else F.lit(None).cast(t)).alias(c) for c, t in rows.dtypes]
    return last.select(*cols)


@register("stream_window_counts", WINDOW_SQL)
def q_stream_window_counts(spark, sf_dir):
    """O-T3: hourly request counters per mode from the fetch-log stream, each window given out when
    the watermark has passed it."""
    rows = D.fetch_log(spark, sf_dir)
    src, out = T.scratch(spark, "win_src"), T.scratch(spark, "win_out")
    T.write_source_files(rows, src, T.input_files(spark), "requested_at")
    T.windowed_counts(spark, src, rows.schema, out, "requested_at", ["mode"])
    T.write_source_files(_end_of_stream(rows), src, 1, "requested_at")
    got, _ = T.windowed_counts(spark, src, rows.schema, out, "requested_at", ["mode"])
    return got.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "mode", "n", "elapsed_ms_sum")


LATE_SQL = S.with_views(["fetch_log"], f"""
SELECT 'rows_in' AS metric, CAST(count(*) AS BIGINT) AS value FROM rows_in
UNION ALL SELECT 'rows_counted', CAST(count(*) FILTER (WHERE NOT late) AS BIGINT) FROM rows_in
UNION ALL SELECT 'rows_late', CAST(count(*) FILTER (WHERE late) AS BIGINT) FROM rows_in
UNION ALL SELECT 'windows', CAST(count(*) AS BIGINT) FROM (
  SELECT DISTINCT date_trunc('hour', requested_at), mode FROM rows_in WHERE NOT late)
UNION ALL SELECT 'state_rows', CAST(1 AS BIGINT)""", f"""
rows_in AS (
  SELECT requested_at, mode, request_id % {HELD_BACK} = 0
         AND date_trunc('hour', requested_at) + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', max(requested_at)) FROM fetch_log
             WHERE request_id % {HELD_BACK} <> 0) - INTERVAL 2 HOUR AS late
  FROM fetch_log)""")


@register("stream_late_counts", LATE_SQL)
def q_stream_late_counts(spark, sf_dir):
    """O-T3: what the windowed counters measure when every ``HELD_BACK``-th row arrives last: rows read,
    counted and late, windows given out, and windows left in the state (that of the closing row)."""
    rows = D.fetch_log(spark, sf_dir)
    src, out = T.scratch(spark, "late_src"), T.scratch(spark, "late_out")
    held = F.col("request_id") % HELD_BACK == 0
    T.write_source_files(rows.where(~held), src, T.input_files(spark), "requested_at")
    _, first = T.windowed_counts(spark, src, rows.schema, out, "requested_at", ["mode"])
    T.write_source_files(rows.where(held), src, T.REPLAY_BATCHES, "requested_at")
    _, second = T.windowed_counts(spark, src, rows.schema, out, "requested_at", ["mode"])
    T.write_source_files(_end_of_stream(rows), src, 1, "requested_at")
    got, third = T.windowed_counts(spark, src, rows.schema, out, "requested_at", ["mode"])
    seen = first["rows_in"] + second["rows_in"] + third["rows_in"] - 1  # without the closing row
    counted = got.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("w"))
    return counted.select(F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), v.cast("long").alias("value")) for m, v in (
        ("rows_in", F.lit(seen)), ("rows_counted", F.col("n")), ("rows_late", F.lit(seen) - F.col("n")), ("windows", F.col("w")),
        ("state_rows", F.lit(third["state_rows"])))))))


def _job_rows(spark, sf_dir):
    ev = D.job_events(spark, sf_dir).select("job_id", "ts", "event")
    src = T.write_source_files(ev, T.scratch(spark, "job_src"), T.input_files(spark), "ts")
    return T.job_state_stream(spark, src, ev.schema, T.scratch(spark, "job_out"), RESULT_TTL, LATENESS)[0]


@register("stream_job_states", ORACLES["job_states"])
def q_stream_job_states(spark, sf_dir):
    """O-T4: job states maintained by a stateful stream over the job event log."""
    return T.latest_states(_job_rows(spark, sf_dir)).select("job_id", "status", "created_at", "started_at", "finished_at", "updated_at")


@register("stream_job_expiry", S.with_views(["job_events"], f"""
SELECT job_id, status, updated_at FROM (
  SELECT job_id, max(ts) AS updated_at, CASE WHEN bool_or(event = 'succeeded') THEN 'succeeded' WHEN bool_or(event = 'failed') THEN 'failed'
         WHEN bool_or(event = 'cancelled') THEN 'cancelled' END AS status
  FROM job_events GROUP BY job_id)
WHERE status IS NOT NULL AND updated_at + INTERVAL {RESULT_TTL} SECOND
      < (SELECT date_trunc('milliseconds', max(ts)) FROM job_events) - INTERVAL {LATENESS} SECOND"""))
def q_stream_job_expiry(spark, sf_dir):
    """O-T4: jobs that the stream's timers removed from the state, finished for longer than the result TTL."""
    gone = _job_rows(spark, sf_dir).where("kind = 'expired'")
    return gone.select("job_id", "status", F.timestamp_micros("updated_us").cast("timestamp_ntz").alias("updated_at"))


@register("stream_retention", CLEANUP_SQL)
def q_stream_retention(spark, sf_dir):
    """O-T5: the periodic cleanup run over the stream-ingested store."""
    store = _ingested_store(spark, sf_dir)
    return st.cleanup_report(st.cleanup(store, D.now_col(), GRACE_SECONDS, MAX_ENTRIES, MAX_SIZE))


_ = q_job_states  # keep the batch twin registered first
