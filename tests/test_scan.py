"""Ordered scans in parts of equal row count, against plain loops."""

import random
from datetime import datetime, timedelta


from pagecorpus.operators import scan
from pagecorpus.plans.q_profiles import q_settings_resolution

SCHEMA = "g string, ts timestamp_ntz, tie long, v long"


def rows_of(n, one_second):
    rng = random.Random(6)
    return [(None if one_second is None and i % 5 == 0 else rng.choice(["hot", "hot", "hot", "b", "c"]),
             datetime(2024, 1, 1) + timedelta(seconds=0 if one_second else rng.randrange(500)), i, rng.randrange(-50, 100)) for i in range(n)]


def plain(rows):
    out, by = {}, {}
    for g, ts, tie, v in sorted(rows, key=lambda r: (r[1], r[2])):
        by.setdefault(g, []).append((tie, v))
    for same in by.values():
        total, most, before, start_cost, ready = 0, None, None, 0, None
        for tie, v in same:
            most = v if most is None else max(most, v)
            ready = v - total if ready is None else max(ready, v - total)
            out[tie] = (total + v, total, most, before, total + ready)
            total, before = total + v, v
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain(rows)
    got = {}
    for i, d in enumerate((scan.running_sum(df, ["g"], "ts", "tie", "v", "o"), scan.running_sum(df, ["g"], "ts", "tie", "v", "o", inclusive=False),
                           scan.running_max(df, ["g"], "ts", "tie", "v", "o"), scan.previous_value(df, ["g"], "ts", "tie", "v", "o"),
                           scan.queue_starts(df, ["g"], "ts", "tie", "v", "v", "o"))):
        found = {r.tie: r.o for r in d.collect()}
        assert found == {t: w[i] for t, w in want.items()}, i
        got[i] = d
    assert got[0].columns == ["g", "ts", "tie", "v", "o"]


def test_scans(spark):
    check(spark, rows_of(700, False))
    check(spark, rows_of(300, None))
    check(spark, rows_of(3, True))
    assert scan.running_sum(spark.createDataFrame([], SCHEMA), ["g"], "ts", "tie", "v", "o").count() == 0


def test_one_second_is_spread_over_parts(spark):
    rows = rows_of(2000, True)
    check(spark, rows)
    p = scan.Parts(spark.createDataFrame(rows, SCHEMA), ["g"], "ts", "tie")
    sizes = [r["count"] for r in p.rows.groupBy("_part").count().collect()]
    assert len(sizes) > 4 and max(sizes) < 3 * 2000 / len(sizes)
    hot = p.rows.where("g = 'hot'").select("_part").distinct().count()
    assert hot > 2


def test_without_a_group(spark):
    rows = rows_of(500, True)
    got = {r.tie: r.o for r in scan.previous_value(spark.createDataFrame(rows, SCHEMA), [], "ts", "tie", "v", "o").collect()}
    assert got == {t: w[3] for t, w in plain([("x", *r[1:]) for r in rows]).items()}


def test_settings_need_no_exchange_of_the_log(spark):
    plan = q_settings_resolution(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    log = [line for line in plan.splitlines() if "Relation" in line and "event_id" in line]
    assert len(log) == 1  # the log is read once
    physical = q_settings_resolution(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    lines = physical.splitlines()
    scan_at = next(i for i, line in enumerate(lines) if "event_id" in line and "Scan" in line)
    depth = len(lines[scan_at]) - len(lines[scan_at].lstrip(" :+-"))
    above = []
    for line in reversed(lines[:scan_at]):
        d = len(line) - len(line.lstrip(" :+-"))
        if d < depth:
            above.append(line)
            depth = d
    assert not [x for x in above if "Exchange" in x and "Broadcast" not in x]


