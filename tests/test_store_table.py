"""The versioned store table: partitions touched, replay, deletions, lookups."""

import random
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pagecorpus.session import checkpoint_dir
from pagecorpus.sources.store_table import SCHEMA, StoreTable

DAY = datetime(2024, 1, 1)


def row(key, days, seq, size=10, url=None):
    t = None if days is None else DAY + timedelta(days=days)
    return (key, url or f"https://{key}.example/", "f", 200, t, None, "http", size, seq)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def table(spark):
    t = StoreTable(spark, f"{checkpoint_dir(spark)}/store_test/{uuid.uuid4().hex}")
    return t.upsert(frame(spark, [row(f"k{i}", i % 5, i) for i in range(400)]))


def content(t):
    return sorted((r.cache_key, r.fetched_at, r.seq) for r in t.read().collect())


def changed(a, b):
    return {f for f in a.parts.keys() | b.parts.keys() if a.parts.get(f) != b.parts.get(f)}


def test_one_key_touches_its_own_partitions_only(spark, table):
    assert len(table.parts) > 40
    after = table.upsert(frame(spark, [row("k7", 9, 1000)]))
    touched = changed(table, after)
    assert len(touched) == 2  # where the old row was, and the new day
    assert len({f.split("/")[0] for f in touched}) == 1
    assert after.read().count() == 400
    assert [r.seq for r in after.lookup(frame(spark, [row("k7", 0, 0)])).collect()] == [1000]
    assert content(StoreTable(spark, table.root, table.version)) == content(table)  # the old version stays readable


def test_older_rows_change_nothing(spark, table):
    after = table.upsert(frame(spark, [row("k9", 0, 3), row("k9", 4, 8)]))  # the store has (day 4, seq 9)
    assert after.parts == table.parts and after.report["put"] == 0


def test_replay_changes_nothing(spark, table):
    batch = frame(spark, [row("k1", 7, 2000), row("new", 7, 2001), row("new", 8, 2002)])
    once = table.upsert(batch, table.version + 1)
    again = StoreTable.latest(spark, table.root).upsert(batch, table.version + 1)
    assert (again.version, again.parts, again.report) == (once.version, once.parts, once.report)
    assert again.read().count() == 401


def test_a_failed_write_leaves_the_table(spark, table):
    bad = frame(spark, [row("k1", 7, 2000)])
    with pytest.raises(Exception):
        table._rewrite(table.version + 1, {"bucket=0/fetch_date=x"}, bad, {})  # lacks the placing columns
    assert StoreTable.latest(spark, table.root).version == table.version
    assert table.upsert(bad).read().count() == 400


def test_against_a_plain_store(spark):
    rng = random.Random(2)
    t = StoreTable(spark, f"{checkpoint_dir(spark)}/store_test/{uuid.uuid4().hex}")
    plain, seq = {}, 0
    for _ in range(4):
        rows = []
        for _ in range(60):
            seq += 1
            rows.append(row(f"k{rng.randrange(40)}", rng.choice([0, 1, 2, 3, None]) if rng.random() < 0.9 else 5, seq))
        for r in rows:
            old = plain.get(r[0])
            rank = lambda x: (x[4] is not None, x[4] or DAY, x[8])
            if old is None or rank(r) > rank(old):
                plain[r[0]] = r
        t = t.upsert(frame(spark, rows))
        gone = {f"k{rng.randrange(40)}" for _ in range(5)}
        before = len(plain)
        plain = {k: r for k, r in plain.items() if k not in gone}
        t = t.delete_keys(spark.createDataFrame([(k,) for k in gone], "cache_key string"))
        assert t.report["deleted"] == before - len(plain)
        assert content_keys(t) == sorted((k, r[8]) for k, r in plain.items())


def content_keys(t):
    return sorted((r.cache_key, r.seq) for r in t.read().collect())


def test_deletions(spark, table):
    by_url = table.delete_urls(frame(spark, [row("k3", 0, 0)]))
    assert by_url.report["deleted"] == 1 and len(changed(table, by_url)) == 1
    like = by_url.delete_where(F.col("url").like("https://k1%"))
    assert like.report["deleted"] == 111 and like.read().count() == 288
    empty = like.purge()
    assert empty.report["deleted"] == 288 and empty.read().count() == 0 and empty.parts == {}
    assert empty.upsert(frame(spark, [row("k1", 0, 1)])).read().count() == 1
    assert like.delete_keys(frame(spark, [])).read().count() == 288


def test_days_are_pruned(spark, table):
    some = table.read("2024-01-02", "2024-01-03")
    assert some.count() == 160
    assert all("fetch_date=2024-01-02" in f or "fetch_date=2024-01-03" in f for f in some.inputFiles())
