"""Clean, then extract, then format, on pages whose cleaning changes what extraction finds."""

import pytest
from pyspark.sql import functions as F

from pagecorpus.operators.clean import clean_nodes, rebuild_html, resolve_features
from pagecorpus.operators.extract import extract
from pagecorpus.operators.process import as_parsed, base_url, process
from pagecorpus.sources.shred import shred

PAGES = [
    (1, "https://a.example/x/", '<div><p hidden>no</p><p>first<!-- c --> one</p><p>second</p><script>s()</script></div><a href="y">l</a>', "https://b.example/z/"),
    (2, "https://a.example/", "", None),
    (3, "https://a.example/", "<script>only</script>", ""),
    (4, "https://a.example/", None, None),
    (5, "https://a.example/q", "<ul><li>1</li><template><li>t</li></template><li>2</li><!--x--><li>3</li></ul><b>a</b> <i>b</i>tail", ""),
]
SPEC = {"first": {"selector": "p:first-child"}, "third": {"selector": "li:nth-child(3)", "default": "-"}, "last": {"selector": "li:last-child", "multiple": True},
        "script": {"selector": "script", "default": "none"}, "link": {"selector": "a", "type": "attr", "absolute_url": True}}


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string, final_url string")


def by_page(df):
    return {r.page_id: r for r in df.collect()}


def test_extraction_sees_the_cleaned_page(pages):
    """As extracting from the cleaned markup, parsed anew."""
    nodes = shred(pages)
    for features in (resolve_features("content"), resolve_features("aggressive"), resolve_features(enabled=True, remove_comments=True, remove_hidden=True)):
        done = by_page(process(pages, nodes, features, SPEC))
        markup = rebuild_html(clean_nodes(nodes, features))
        bases = pages.select("page_id", base_url(None, F.col("final_url"), F.col("url")).alias("base_url"))
        again = by_page(extract(shred(markup), SPEC, bases))
        for p in again:
            assert done[p].extracted == again[p].extracted, p
        html = {r.page_id: r.html for r in markup.collect()}
        assert {p: r.content for p, r in done.items()} == {p: html.get(p, "") for p in done}


def test_what_cleaning_changes(pages):
    nodes = shred(pages)
    raw = by_page(process(pages, nodes, {}, SPEC))
    done = by_page(process(pages, nodes, resolve_features(enabled=True, remove_comments=True, remove_hidden=True, remove_scripts=True), SPEC))
    assert (raw[1].extracted.first, done[1].extracted.first) == ("no", "first one")
    assert (raw[1].extracted.script, done[1].extracted.script) == ("s()", "none")
    assert (raw[5].extracted.third, done[5].extracted.third) == ("2", "3")
    assert raw[1].extracted.link == done[1].extracted.link == "https://b.example/z/y"
    assert [raw[p].extracted is None for p in (2, 3, 4)] == [True, False, True]
    assert done[3].extracted is None and done[3].content == ""
    assert [done[p].normalized for p in range(1, 6)] == [True, False, True, False, True]
    assert raw[1].content == PAGES[0][2] and raw[1].content_length == len(PAGES[0][2]) and raw[4].content == ""


def test_text_format_and_base(pages):
    nodes = shred(pages)
    done = by_page(process(pages, nodes, resolve_features("content"), SPEC, "text", "https://spec.example/"))
    assert done[1].content == "first one\nsecond\nl" or done[1].content == "firstone\nsecond\nl"
    assert done[1].extracted.link == "https://spec.example/y"
    with pytest.raises(ValueError):
        process(pages, nodes, {}, SPEC, "pdf")
    empty = process(pages.limit(0), shred(pages.limit(0)), resolve_features("light"), SPEC)
    assert empty.count() == 0


def test_neighbouring_strings_become_one(pages):
    nodes = shred(pages)
    kept = as_parsed(clean_nodes(nodes, resolve_features(enabled=True, remove_comments=True)))
    texts = [r.text for r in kept.where("page_id = 1 and kind = 'text'").orderBy("node_id").collect()]
    assert texts == ["no", "first one", "second", "l"]
