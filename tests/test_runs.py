"""Counters of runs: taken from the pass, errors counted, a failed cleanup leaves the table."""

import uuid
from datetime import datetime, timedelta

from pagecorpus.operators.runs import RunMetrics
from pagecorpus.session import checkpoint_dir
from pagecorpus.sources.store_table import SCHEMA, StoreTable

NOW = datetime(2024, 1, 10)


def test_runs(spark):
    rows = [(f"k{i}", "u", "u", 200, NOW - timedelta(hours=i), NOW - timedelta(hours=i) + timedelta(hours=5) if i % 2 else None, "http", 10, i) for i in range(40)]
    table = StoreTable(spark, f"{checkpoint_dir(spark)}/runs_test/{uuid.uuid4().hex}").upsert(spark.createDataFrame(rows, SCHEMA))
    m = RunMetrics()
    kept = m.cleanup(table, NOW, 3600, 20, 150, vacuum=True)
    assert sorted(r.seq for r in kept.read().collect()) == [0, 1, 2, 3, 4, 5, 6, 8, 10, 12, 14, 16, 18, 20, 22]
    assert m.counters["cache_cleanup_deleted_entries_total"] == 25 and m.counters["cache_vacuum_runs_total"] == 1
    assert m.gauges == {"cache_size_bytes": 150, "cache_entries_total": 15, "cache_expired_entries_total": 0}
    same = m.cleanup(kept, NOW, 3600, -1, 150)
    assert same.version == kept.version and m.counters["cache_cleanup_errors_total"] == 1
    m.extraction(spark.createDataFrame([(1, None), (2, ("f", "m")), (3, None)], "page_id long, extraction_error struct<field:string,message:string>"))
    m.auth(spark.createDataFrame([("ok",), ("missing",), ("invalid",)], "auth string"))
    m.proxy(spark.createDataFrame([("p", None, "hit"), ("p", None, "miss"), (None, "e", "hit"), (None, None, "miss")], "proxy string, proxy_error string, outcome string"))
    m.health(spark.createDataFrame([(NOW, True), (NOW, False), (NOW - timedelta(hours=2), True)], "requested_at timestamp_ntz, failed boolean"))
    got = {r.metric: r.value for r in m.frame(spark).collect()}
    assert (got["extraction_requests_total"], got["extraction_success_total"], got["extraction_error_total"]) == (3, 2, 1)
    assert (got["auth_requests_total"], got["auth_failures_total"]) == (1, 2)
    assert (got["proxy_requests_total"], got["proxy_errors_total"], got["scraper_up"]) == (1, 1, 1)
    assert len(got) == 16
