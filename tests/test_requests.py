"""The full request schema: malformed lines, rules by path, nested fields, defaults."""

import json

from pagecorpus.operators import requests as R
from pagecorpus.streaming.streams import scratch


def read(spark, lines):
    path = scratch(spark, "t_requests")
    spark.createDataFrame([(x if isinstance(x, str) else json.dumps(x),) for x in lines], "value string").coalesce(1).write.text(path)
    return R.read_requests(spark, path)


def broken(spark, lines, **kw):
    out = {}
    for r in R.rejected(read(spark, lines), **kw).collect():
        out.setdefault(r.request_id, set()).add((r.path, r.code))
    return out


def test_each_rule_by_its_path(spark):
    ok = {"url": "https://a.example/"}
    cases = {
        1: ({}, {("url", "missing")}), 2: ({"url": ""}, {("url", "length")}), 3: ({"url": "x" * 8193}, {("url", "length")}),
        4: (ok | {"mode": "ftp"}, {("mode", "enum")}), 5: (ok | {"cache_ttl_seconds": 59}, {("cache_ttl_seconds", "range")}),
        6: (ok | {"cache_ttl_seconds": 2592001}, {("cache_ttl_seconds", "range")}), 7: (ok | {"wait_until": "idle"}, {("wait_until", "enum")}),
        8: (ok | {"wait_selector": "s" * 501}, {("wait_selector", "length")}), 9: (ok | {"timeout_seconds": 4}, {("timeout_seconds", "range")}),
        10: (ok | {"timeout_seconds": 181, "mode": "browser"}, {("timeout_seconds", "range"), ("timeout_seconds", "browser_over_60")}),
        11: (ok | {"mode": "browser"}, {("timeout_seconds", "browser_over_60")}), 12: (ok | {"mode": "browser", "timeout_seconds": 60}, None),
        13: (ok | {"scroll": {"max_scrolls": 0, "delay_ms": 99}}, {("scroll.max_scrolls", "range"), ("scroll.delay_ms", "range")}),
        14: (ok | {"scroll": {"max_scrolls": 100, "delay_ms": 30000}}, None), 15: (ok | {"normalize": {"preset": "heavy"}}, {("normalize.preset", "enum")}),
        16: (ok | {"extract": {"fields": {"a": {}, "b": {"selector": "x", "type": "list"}}}}, {("extract.fields.a.selector", "missing"), ("extract.fields.b.type", "enum")}),
        17: (ok | {"extract": {"fields": {"o": {"selector": "x", "type": "object", "fields": {"i": {"selector": "y", "fields": {"j": {"type": "no"}}}}}}}},
             {("extract.fields.o.fields.i.fields.j.selector", "missing"), ("extract.fields.o.fields.i.fields.j.type", "enum")}),
        18: (ok | {"extract": {"fields": {"a": {"selector": "x", "fields": {"b": {"selector": "x", "fields": {"c": {"selector": "x", "fields": {"d": {"selector": "x"}}}}}}}}}},
             {("extract.fields.a.fields.b.fields.c.fields", "depth")}),
    }
    got = broken(spark, [{"request_id": i} | r for i, (r, _) in cases.items()])
    assert got == {i: want for i, (_, want) in cases.items() if want}
    assert 11 not in broken(spark, [{"request_id": 11} | cases[11][0]], cross_field=False)


def test_malformed_lines(spark):
    lines = ['{"request_id":1,"url":"htt', '{"request_id":2,"url":"https://a/","timeout_seconds":"soon"}', "no json", '{"request_id":4,"url":"https://a/","scroll":[1]}',
             {"request_id": 5, "url": "https://a/", "unknown": 1}]
    r = read(spark, lines)
    bad = R.rejected(r).collect()
    assert sorted((x.request_id or 0, x.path, x.code) for x in bad) == [(i, "$", "malformed") for i in (0, 1, 2, 4)]
    assert all(x.line in lines for x in bad)
    assert [x.request_id for x in R.accepted(r).collect()] == [5]


def test_defaults(spark):
    got = R.accepted(read(spark, [{"request_id": 1, "url": "https://a/"}, {"request_id": 2, "url": "https://a/", "scroll": {"delay_ms": 200}, "normalize": {"minify": True}}]))
    a, b = got.orderBy("request_id").collect()
    assert (a.mode, a.wait_until, a.timeout_seconds, a.force_refresh, a.cache_ttl_seconds) == ("auto", "networkidle", 90, False, None)
    assert tuple(a.scroll) == (False, 5, 1000, True) and tuple(b.scroll) == (False, 5, 200, True)
    assert tuple(a.debug) == (False, False) and a.proxy.enabled is False and a.proxy.url is None
    assert a.extract.fields == {} and a.normalize.preset is None and a.normalize.minify is False and b.normalize.minify is True
