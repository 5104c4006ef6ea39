"""Randomised cross-checks of the scalable kernels against plain-Python loops on small
literal fixtures: keep-newest cut-offs, chunked scans, pacing, job fold, cleaning and
extraction semantics."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from pagecorpus.operators import clean as C
from pagecorpus.operators import policy as pol
from pagecorpus.operators.extract import extract
from pagecorpus.operators.jobs import fold_events
from pagecorpus.operators.retention import keep_newest
from pagecorpus.operators.select import match_columns
from pagecorpus.operators.scan import previous_value, running_sum
from pagecorpus.sources.shred import shred

BASE = dt.datetime(2024, 1, 1)


def _rows(n, seed):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        # heavy ties: many rows share a second, some share a microsecond
        ts = BASE + dt.timedelta(seconds=rnd.choice([0, 1, 2, 3600, 3601, 7200]) + rnd.randint(0, 3),
                                 microseconds=rnd.choice([0, 0, 5]))
        out.append((f"k{i:04d}", ts, rnd.choice([0, 10, 50, 100, 500])))
    return out


def test_keep_newest_matches_sort_and_cumulate(spark):
    rows = _rows(400, 7)
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, size long")
    order = sorted(rows, key=lambda r: (r[1], r[0]), reverse=True)
    for limit in (0, 1, 57, 200, 399, 400, 1000):
        got = {r.key for r in keep_newest(df, "ts", "key", limit).filter("keep").collect()}
        assert got == {r[0] for r in order[:limit]}, limit
    for limit in (0, 100, 5000, 20000, 10**9):
        run, want = 0, set()
        for r in order:
            run += r[2]
            if run <= limit:
                want.add(r[0])
        got = {r.key for r in keep_newest(df, "ts", "key", limit, weight="size").filter("keep").collect()}
        assert got == want, limit


def test_keep_newest_splits_one_second(spark, monkeypatch):
    """Every row in one second, in parts of a few rows; null weights, times and ties."""
    from pagecorpus.operators import retention

    monkeypatch.setattr(retention, "PART_ROWS", 20)
    rows = [(f"k{i * 37 % 300:03d}", BASE, i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, size long")
    for limit in (0, 1, 150, 299, 300):
        got = {r.key for r in keep_newest(df, "ts", "key", limit).filter("keep").collect()}
        assert got == {f"k{i:03d}" for i in range(300 - limit, 300)}
    assert all(r.keep for r in keep_newest(df, "ts", "key", 300, weight="size").collect())
    odd = spark.createDataFrame([("a", BASE, None), (None, BASE, 5), ("b", None, 1)], "key string, ts timestamp_ntz, size long")
    assert [r.keep for r in keep_newest(odd, "ts", "key", 4, weight="size").collect()] == [True, False, False]
    assert keep_newest(df.limit(0), "ts", "key", 0).count() == 0


def test_chunked_scans_match_loops(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("ab"), BASE + dt.timedelta(minutes=rnd.randint(0, 600)), i, rnd.randint(1, 9))
            for i in range(300)]
    df = spark.createDataFrame(rows, "g string, ts timestamp_ntz, id long, v long")
    rs = {r.id: r.s for r in running_sum(df, ["g"], "ts", "id", "v", "s").collect()}
    pv = {r.id: r.p for r in previous_value(df, ["g"], "ts", "id", "v", "p").collect()}
    for g in "ab":
        seq = sorted([r for r in rows if r[0] == g], key=lambda r: (r[1], r[2]))
        tot, prev = 0, None
        for r in seq:
            tot += r[3]
            assert rs[r[2]] == tot
            assert pv[r[2]] == prev
            prev = r[3]


def test_pacing_closed_form_matches_recursion(spark):
    rnd = random.Random(11)
    rows = [(rnd.choice(["x.org", "y.org"]), i, BASE + dt.timedelta(seconds=rnd.randint(0, 5000)),
             rnd.randint(0, 9000), float(rnd.choice([1, 2, 5])), 1) for i in range(250)]
    df = spark.createDataFrame(rows, "domain string, request_id long, requested_at timestamp_ntz, "
                                     "elapsed_ms long, min_delay_seconds double, max_concurrent_requests int")
    got = {r.request_id: r.planned_start_us for r in pol.pacing_plan(df).collect()}
    for d in ("x.org", "y.org"):
        seq = sorted([r for r in rows if r[0] == d], key=lambda r: (r[2], r[1]))
        free = None
        for _, rid, ts, dur, delay, _k in seq:
            arr = int((ts - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)
            start = arr if free is None else max(arr, free)
            free = start + dur * 1000 + int(delay * 1_000_000)
            assert got[rid] == start


def test_job_fold_ignores_illegal_transitions(spark):
    t = [BASE + dt.timedelta(seconds=s) for s in range(6)]
    ev = [(1, t[0], "created"), (1, t[1], "started"), (1, t[2], "cancelled"), (1, t[3], "succeeded"),
          (2, t[0], "created"), (2, t[2], "cancelled"), (2, t[3], "started"), (2, t[4], "failed"),
          (3, t[1], "started"), (3, t[0], "created"), (3, t[1], "started")]
    df = spark.createDataFrame(ev, "job_id long, ts timestamp_ntz, event string")
    got = {r.job_id: r for r in fold_events(df).collect()}
    assert got[1].status == "succeeded" and got[1].ignored == 1
    assert got[2].status == "cancelled" and got[2].finished_at is None and got[2].ignored == 2
    assert got[3].status == "running" and got[3].started_at == t[1] and got[3].ignored == 1


RICH = ("<html><head><meta charset='utf-8'><script>x()</script><style>p{}</style></head><body>"
        "<!-- c --><div data-x='1' style='color:red'>Keep  me</div>"
        "<div style='display: none'>hidden</div><p hidden>h2</p><span aria-hidden='TRUE'>h3</span>"
        "<input type='hidden' value='v'><template><b>t</b></template><noscript>ns</noscript>"
        "<img src='a.png' srcset='a.png 1x, /b.png 2x,, c.png'><pre>  keep   this  </pre>"
        "<a href='../up'>up</a>   <p>  tail  </p></body></html>")


def test_clean_content_and_aggressive(spark):
    nodes = shred(spark.createDataFrame([(1, RICH)], "page_id long, html string")).cache()
    html = C.rebuild_html(C.clean_nodes(nodes, C.resolve_features("content"))).collect()[0].html
    for gone in ("x()", "p{}", "<!--", "hidden", "h2", "h3", 'type="hidden"', "<b>t</b>", "ns", "data-x",
                 "style=", "<meta"):
        assert gone not in html, gone
    assert "<div>Keep me</div>" in html and "<pre>  keep   this  </pre>" in html
    assert "<p>tail</p>" in html and "<img" in html
    agg = C.rebuild_html(C.clean_nodes(nodes, C.resolve_features("aggressive"))).collect()[0].html
    assert "<img" not in agg
    bases = spark.createDataFrame([(1, "https://ex.com/a/b/page.html")], "page_id long, base_url string")
    feats = {f: False for f in C.FEATURES}
    feats["absolute_urls"] = True
    absd = C.rebuild_html(C.clean_nodes(nodes, feats, bases)).collect()[0].html
    assert 'href="https://ex.com/a/up"' in absd
    assert 'srcset="https://ex.com/a/b/a.png 1x, https://ex.com/b.png 2x, https://ex.com/a/b/c.png"' in absd


def test_presets_are_additive():
    f = C.resolve_features("light", minify=False)
    assert f["minify"] and f["remove_comments"] and not f["remove_scripts"]
    assert C.resolve_features(None, False, minify=True) == {}


SIMPLE = ("<html><head><title>Test Page</title></head><body><h1>Main Heading</h1>"
          "<p class='description'>Bold <b>and</b> <i>italic</i></p>"
          "<a id='main-link' href='/page1'>Link 1</a><img src='/img.png'>"
          "<ul><li class='item'>One</li><li class='item'>Two</li><li class='item'>Three</li></ul>"
          "<div class='card'><h2>A</h2><span class='price'>1</span></div>"
          "<div class='card'><h2>B</h2></div></body></html>")


def test_extraction_semantics(spark):
    pages = spark.createDataFrame([(1, SIMPLE), (2, "<html><body></body></html>"), (3, "")],
                                  "page_id long, html string")
    nodes = shred(pages).cache()
    bases = spark.createDataFrame([(1, "https://ex.com/x/"), (2, "https://ex.com/"), (3, "https://ex.com/")],
                                  "page_id long, base_url string")
    spec = {
        "title": {"selector": "title"},
        "desc": {"selector": ".description"},
        "link": {"selector": "#main-link", "type": "attr", "attribute": "href", "absolute_url": True},
        "img": {"selector": "img", "type": "attr"},
        "noattr": {"selector": "h1", "type": "attr", "attribute": "data-x", "default": "d"},
        "items": {"selector": "li.item", "multiple": True},
        "none": {"selector": ".missing", "multiple": True},
        "cards": {"selector": ".card", "type": "object", "multiple": True,
                  "fields": {"name": {"selector": "h2"}, "price": {"selector": ".price", "default": "0"}}},
        "inner": {"selector": "ul", "type": "html"},
    }
    got = {r.page_id: r for r in extract(nodes, spec, bases).collect()}
    e = got[1].extracted
    assert e.title == "Test Page" and e.desc == "Boldanditalic"
    assert e.link == "https://ex.com/page1" and e.img == "/img.png"
    assert e.noattr is None                       # matched, attribute missing -> null, not default
    assert e.items == ["One", "Two", "Three"] and e.none is None
    assert [(c.name, c.price) for c in e.cards] == [("A", "1"), ("B", "0")]
    assert e.inner == '<li class="item">One</li><li class="item">Two</li><li class="item">Three</li>'
    assert got[2].extracted.noattr == "d" and got[2].extracted.title is None   # no match -> default
    assert got[3].extracted is None and got[3].extraction_error is None      # empty HTML: gated
    req = extract(nodes, {"t": {"selector": "title"}, "x": {"selector": "h1", "required": True}}, bases)
    r1 = {r.page_id: r for r in req.collect()}
    assert r1[1].extracted.x == "Main Heading"
    assert r1[2].extracted is None and r1[2].extraction_error.field == "x"
    nested = {"cards": {"selector": ".card", "type": "object", "multiple": True,
                        "fields": {"price": {"selector": ".price", "required": True}}}}
    r2 = {r.page_id: r for r in extract(nodes, nested, bases).collect()}
    assert r2[1].extracted is None
    assert r2[1].extraction_error.field == "price"


def test_unknown_field_type_gives_outer_html(spark):
    nodes = shred(spark.createDataFrame([(1, "<div><p class='a'>x &amp; y</p></div>")], "page_id long, html string"))
    r = extract(nodes, {"raw": {"selector": "p", "type": "weird"}}).collect()[0]
    assert r.extracted.raw == '<p class="a">x &amp; y</p>'


def test_text_of_raw_and_cleaned_nodes(spark):
    """A cleaned node table has gaps in its ids and texts of its own."""
    raw = shred(spark.createDataFrame([(1, "<i>z</i><div>a   b<script>drop()</script><b>c</b></div>")], "page_id long, html string"))
    feats = {f: False for f in C.FEATURES} | {"collapse_whitespace": True, "remove_scripts": True}
    cleaned = C.clean_nodes(raw, feats)
    spec = {"div": {"selector": "div"}, "b": {"selector": "b"}, "script": {"selector": "script"}}
    assert tuple(extract(raw, spec).collect()[0].extracted) == ("a   bc", "c", "drop()")
    assert tuple(extract(cleaned, spec).collect()[0].extracted) == ("a bc", "c", None)


def _random_page(rnd):
    out, open_tags = [], []
    for _ in range(rnd.randint(0, 80)):
        if open_tags and rnd.random() < 0.4:
            out.append(f"</{open_tags.pop()}>")
        elif rnd.random() < 0.6:
            open_tags.append(rnd.choice("abcd"))
            out.append(f"<{open_tags[-1]}>")
        else:
            out.append(rnd.choice(["x ", "y", " ", "z"]))
    return "".join(out)


def test_selectors_match_a_tree_walk(spark):
    rnd = random.Random(5)
    nodes = shred(spark.createDataFrame([(i, _random_page(rnd)) for i in range(150)], "page_id long, html string")).cache()
    pages = {}
    for r in nodes.collect():
        pages.setdefault(r.page_id, {})[r.node_id] = r
    left = {" ": lambda t, x, f: f < x <= t[f].last_desc, ">": lambda t, x, f: t[x].parent_id == f,
            "+": lambda t, x, f: t[x].parent_id == t[f].parent_id and t[x].esib == t[f].esib + 1,
            "~": lambda t, x, f: t[x].parent_id == t[f].parent_id and t[x].esib > t[f].esib}
    cases = {"a b": ["a", " ", "b"], "a > b": ["a", ">", "b"], "a + b": ["a", "+", "b"], "a ~ b": ["a", "~", "b"],
             "a b > c": ["a", " ", "b", ">", "c"], "a > c ~ b d": ["a", ">", "c", "~", "b", " ", "d"],
             "c + c > d": ["c", "+", "c", ">", "d"]}
    got = match_columns(nodes, {f"m{i}": s for i, s in enumerate(cases)}, []).collect()
    assert len(got) == sum(map(len, pages.values()))
    for i, steps in enumerate(cases.values()):
        want = set()
        for pid, t in pages.items():
            found = {n for n, r in t.items() if r.tag == steps[0]}
            for comb, tag in zip(steps[1::2], steps[2::2]):
                found = {n for n, r in t.items() if r.tag == tag and any(left[comb](t, n, f) for f in found)}
            want |= {(pid, n) for n in found}
        assert {(r.page_id, r.node_id) for r in got if r[f"m{i}"]} == want and want, list(cases)[i]


def test_nested_matches_keep_their_own_text_and_markup(spark):
    nodes = shred(spark.createDataFrame([(1, "<div>a<div>b<p>c</p></div><script>1<2</script></div>"), (2, None)], "page_id long, html string"))
    spec = {"t": {"selector": "div", "multiple": True}, "h": {"selector": "div", "type": "html", "multiple": True},
            "s": {"selector": "script", "type": "html"}, "e": {"selector": "br", "type": "html", "default": "none"},
            "o": {"selector": "div", "type": "object", "multiple": True, "fields": {
                "in": {"selector": "div", "type": "object", "fields": {"p": {"selector": "p"}}}}}}
    got = {r.page_id: r.extracted for r in extract(nodes, spec).collect()}
    e = got[1]
    assert e.t == ["abc", "bc"]
    assert e.h == ["a<div>b<p>c</p></div><script>1<2</script>", "b<p>c</p>"]
    assert e.s == "1<2" and e.e == "none"
    assert e.o[0]["in"].p == "c" and e.o[1]["in"] is None
    assert got[2] is None


def test_extraction_plans_deal_each_page_once(spark, tmp_path):
    from pagecorpus.plans import q_extract as Q

    path = str(tmp_path / "nodes")
    shred(spark.createDataFrame([(1, SIMPLE)], "page_id long, html string")).write.parquet(path)
    nodes = spark.read.parquet(path)
    bases = spark.createDataFrame([(1, "https://ex.com/")], "page_id long, base_url string")
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for spec, most in ((Q.HEAD_SPEC, 1), (Q.REQUIRED_SPEC, 1), (Q.ITEMS_SPEC, 1), (Q.NAV_OBJECT_SPEC, 1), (Q.NAV_SPEC, 2)):
            plan = extract(nodes, spec, bases)._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") <= most, plan
            assert "Exchange SinglePartition" not in plan
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_shredded_cells_grow_with_the_page():
    from pagecorpus.sources.shred import shred_page

    cells = [sum(len(v) for v in shred_page(1, "<li>x" * n).values()) for n in (8_000, 16_000)]
    assert cells[1] < 2.1 * cells[0]


def test_checkpoint_folder_is_required_on_a_cluster(spark, monkeypatch):
    import types

    import pytest

    from pagecorpus import session

    context = types.SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None,
                                    getConf=lambda: types.SimpleNamespace(get=lambda k, d=None: d))
    fake = types.SimpleNamespace(sparkContext=context, conf=types.SimpleNamespace(get=lambda k, d=None: d))
    with pytest.raises(RuntimeError):
        session.checkpoint_dir(fake)


def test_many_closed_void_tags_parse_in_linear_time():
    import time

    from pagecorpus.sources.shred import shred_page

    t = time.time()
    shred_page(1, "<p>" + "<br></br>" * 16_000 + "</p>" + "<br>" * 16_000)
    assert time.time() - t < 10


def test_disabled_extraction_keeps_the_type(spark):
    from pagecorpus.operators.extract import extract
    from pagecorpus.sources.shred import shred

    nodes = shred(spark.createDataFrame([(1, "<h1>x</h1>")], "page_id long, html string"))
    spec = {"title": {"selector": "h1"}, "all": {"selector": "p", "type": "object", "multiple": True, "fields": {"b": {"selector": "b"}}}}
    on = extract(nodes, spec)
    off = extract(nodes, spec, enabled=False)
    assert off.schema.simpleString() == on.schema.simpleString() and off.collect()[0].extracted is None
