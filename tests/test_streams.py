"""Keyed state of the streams: order of arrival, illegal and late events, timers, restarts."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pagecorpus.operators import jobs as J
from pagecorpus.session import fs_delete
from pagecorpus.sources.store_table import SCHEMA, StoreTable
from pagecorpus.streaming import streams as T
from pagecorpus.streaming.state import JOB_STATE, advance, fold, live

T0 = datetime(2024, 3, 1)
EVENTS = "job_id long, ts timestamp_ntz, event string"


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def land(spark, path, rows, schema, order="ts", files=1):
    return T.write_source_files(spark.createDataFrame(rows, schema), path, files, order)


def test_fold_drops_illegal_transitions():
    job = {"status": None, "created_us": None, "started_us": None, "finished_us": None, "updated_us": None, "ignored": 0}
    done = fold(job, [(5, "succeeded"), (1, "created"), (2, "started"), (2, "cancelled"), (9, "failed"), (9, "created")])
    assert done == {"status": "succeeded", "created_us": 1, "started_us": 2, "finished_us": 5, "updated_us": 5, "ignored": 3}
    assert fold(job, [(1, "started")])["status"] is None


def test_job_states_in_any_order_of_arrival(spark):
    """Batches mix times within the allowed lateness; states equal the batch fold, which sees all events."""
    rng = random.Random(4)
    rows = []
    for j in range(60):
        t = rng.randrange(0, 4000)
        rows += [(j, at(t), "created"), (j, at(t + rng.randrange(0, 40)), "started"), (j, at(t + rng.randrange(30, 90)), rng.choice(["succeeded", "failed", "cancelled"]))]
        rows += [(j, at(t + rng.randrange(0, 90)), rng.choice(["started", "created", "cancelled"]))]
    src, out = T.scratch(spark, "t_src"), T.scratch(spark, "t_out")
    rows.sort(key=lambda r: r[1] + timedelta(seconds=rng.randrange(0, 600)))
    for i in range(0, len(rows), 80):
        land(spark, src, rows[i:i + 80], EVENTS)
    got, _ = T.job_state_stream(spark, src, spark.createDataFrame([], EVENTS).schema, out, 10**6, lateness_seconds=1200)
    assert got.where("kind <> 'state'").count() == 0
    want = J.fold_events(spark.createDataFrame(rows, EVENTS)).select("job_id", "status", "created_at", "started_at", "finished_at", "updated_at")
    assert sorted(map(tuple, T.latest_states(got).collect())) == sorted(map(tuple, want.collect()))


def test_finished_jobs_leave_the_state(spark):
    src, out = T.scratch(spark, "t_src"), T.scratch(spark, "t_out")
    schema = spark.createDataFrame([], EVENTS).schema

    def run():
        return T.job_state_stream(spark, src, schema, out, 600, lateness_seconds=60)

    land(spark, src, [(j, at(j), e) for j in range(20) for e in ("created", "started", "succeeded")], EVENTS)
    rows, left = run()
    assert left >= 20 and rows.where("kind = 'expired'").count() == 0
    land(spark, src, [(99, at(5000), "started")], EVENTS)  # illegal, but it moves the watermark past the TTL
    rows, left = run()
    assert rows.where("kind = 'expired' and status = 'succeeded'").count() == 20
    land(spark, src, [(99, at(9000), "succeeded"), (3, at(8), "failed")], EVENTS)  # the second one is late by far
    rows, left = run()
    late = rows.where("kind = 'late'").select("job_id", "event").collect()
    assert [tuple(r) for r in late] == [(3, "failed")]
    land(spark, src, [(98, at(20_000), "started")], EVENTS)
    rows, left = run()
    assert left <= 4  # the illegal event that is newer than the watermark, and its timer


def test_suppression_by_own_ttl_and_late_rows(spark):
    src, out = T.scratch(spark, "t_src"), T.scratch(spark, "t_out")

    def row(key, t, seq, ttl):
        return (key, "u", "u", 200, at(t), None if ttl is None else at(t + ttl), "http", 1, seq)

    def run(rows):
        land(spark, src, rows, SCHEMA, "fetched_at")
        return T.suppress_within_ttl(spark, src, SCHEMA, out, lateness_seconds=100)

    run([row("a", 0, 1, 50), row("a", 50, 2, 50), row("a", 51, 3, 500), row("b", 10, 4, None), row("b", 10, 5, 1)])
    run([row("a", 400, 6, 1), row("b", 9000, 7, 1), row("c", 9000, 8, 10)])
    got, left = run([row("a", 9001, 9, 5), row("a", 700, 10, 5), row("c", 9010, 11, 5), row("c", 9011, 12, 5)])
    kinds = {r.seq: r.kind for r in got.collect()}
    assert kinds == {1: "kept", 3: "kept", 4: "kept", 8: "kept", 9: "kept", 10: "late", 12: "kept"}
    got, left = run([row("z", 50_000, 20, 1)])
    assert left <= 3  # b never expires, z is new; its timer


def test_windows_leave_the_state_and_late_rows_are_counted(spark):
    src, out = T.scratch(spark, "t_src"), T.scratch(spark, "t_out")
    schema = "ts timestamp_ntz, k string, elapsed_ms long"

    def run(rows):
        land(spark, src, rows, schema)
        return T.windowed_counts(spark, src, spark.createDataFrame([], schema).schema, out, "ts", ["k"], "10 seconds", "20 seconds")

    got, first = run([(at(i), "x", i) for i in range(100)])
    got, second = run([(at(5), "x", 1), (at(95), "x", 1)])  # late; within the allowed lateness
    got, third = run([(at(1000), "end", 0)])
    assert first["rows_in"] + second["rows_in"] + third["rows_in"] == 103
    n = {r.w.start: r.n for r in got.collect()}
    assert n == {at(10 * i): 10 + (i == 9) for i in range(10)}
    assert third["state_rows"] == 1


def test_ingest_rewrites_touched_partitions_and_replays(spark):
    src, store = T.scratch(spark, "t_src"), T.scratch(spark, "t_store")
    day = 86_400
    for b in range(3):
        land(spark, src, [(f"k{i}", "u", "u", 200, at(b * day + i), None, "http", 1, b * 100 + i) for i in range(40 if b == 0 else 1)], SCHEMA, "fetched_at")
    T.ingest_snapshots(spark, src, SCHEMA, store)
    versions = [StoreTable(spark, store, v) for v in (1, 2, 3)]
    assert [v.read().count() for v in versions] == [40] * 3
    for old, new in zip(versions, versions[1:]):
        assert len({f.split("/")[0] for f in old.parts.keys() | new.parts.keys() if old.parts.get(f) != new.parts.get(f)}) == 1
    assert T.ingest_snapshots(spark, src, SCHEMA, store).agg(F.max("seq")).first()[0] == 200  # nothing new: as it was
    assert StoreTable.latest(spark, store).version == 3


def test_job_columns_fold_as_the_plain_form(spark):
    """Any events, in batches: settled, pending and late ones, illegal jobs and a null id."""
    rng = random.Random(9)
    events = ["created", "started", "succeeded", "failed", "cancelled", "odd", None]
    empty = {"status": None, "created_us": None, "started_us": None, "finished_us": None, "updated_us": None, "ignored": 0}
    state, plain = spark.createDataFrame([], JOB_STATE), {}
    for now in (None, 200, 400, 900, 5000):
        rows = [(rng.choice([*range(40), None]), rng.randrange(now or 0, (now or 0) + 400), rng.choice(events)) for _ in range(150 if now != 5000 else 0)]
        rows = list({(j, ts): (j, ts, e) for j, ts, e in rows}.values())  # one event an instant
        state = spark.createDataFrame(advance(state, spark.createDataFrame(rows, "job_id long, ts_us long, event string"), now, 600).collect(), JOB_STATE)
        want = {}
        for j in {r[0] for r in rows} | plain.keys():
            job, newer = plain.pop(j, (empty, []))
            newer = newer + [(ts, e) for k, ts, e in rows if k == j]
            job = fold(job, [e for e in newer if now is not None and e[0] < now])
            newer = [e for e in newer if now is None or e[0] >= now]
            seen = fold(job, newer)
            gone = now is not None and seen["status"] in J.TERMINAL and seen["updated_us"] + 600 < now
            want[j] = (*seen.values(), any(r[0] == j for r in rows), gone)
            if not gone and (job["status"] or newer):
                plain[j] = (job, newer)
        got = {r.job_id: (*r.seen, r.came, r.gone) for r in state.collect()}
        assert got == want
    assert live(state).count() == len(plain) and any(x[-1] for x in want.values())


def test_job_states_stay_out_of_python_workers(spark):
    """Millions of jobs: no per-job exchange with a Python worker."""
    one = spark.createDataFrame([(1, 5, "created")], "job_id long, ts_us long, event string").repartition("job_id")
    plan = advance(spark.createDataFrame([], JOB_STATE), one, 3, 600)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_replayed_batch_changes_nothing(spark):
    src, out = T.scratch(spark, "t_src"), T.scratch(spark, "t_out")
    schema = spark.createDataFrame([], EVENTS).schema
    land(spark, src, [(j, at(j), e) for j in range(5) for e in ("created", "started")], EVENTS)
    land(spark, src, [(9, at(5000), "created")], EVENTS)
    land(spark, src, [(3, at(8), "failed")], EVENTS)  # late
    rows, left = T.job_state_stream(spark, src, schema, out, 600, lateness_seconds=60)
    first = sorted(map(str, rows.collect()))
    fs_delete(spark, out + "_ckpt/commits")  # as if it had stopped before the batches were noted
    rows, again = T.job_state_stream(spark, src, schema, out, 600, lateness_seconds=60)
    assert sorted(map(str, rows.collect())) == first and again == left and sum("late" in x for x in first) == 1
