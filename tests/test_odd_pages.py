"""No page kills a job: deep, wide and malformed pages give rows, and cost what their length costs."""

import json
import time

import pytest

from weftlake.functions import dom, video
from weftlake.operators import page as P

DEEP = {
    "divs": "<div>" * 10_000 + "bottom" + "</div>" * 10_000,
    "mixed": "".join(f"<div>a{i}<b>" for i in range(10_000)),
    "lists": "<ul><li>x" * 10_000,
    "quotes": "<blockquote>q" * 3_000,
    "inline": "<b><i><a href='/x'>" * 10_000 + "t",
    "wide": "<main>" + "<span></span>" * 100_000 + "word " * 30 + "</main>",
    "rows": "<table>" + "<tr><td>1</td>" * 20_000,
    "cut": "<div class=\"<a href='<<<&#x;&#99999999;",
    "ld": "<script type='application/ld+json'>" + "[" * 100_000 + "</script>",
}


@pytest.mark.parametrize("name", DEEP)
def test_tree(name):
    began = time.perf_counter()
    root = dom.parse(DEEP[name])
    assert max_depth(root) <= dom.MAX_DEPTH + 1
    text = root.text()
    md = dom.markdown(dom.clean(root))
    assert dom.json_ld(root) == [] and isinstance(dom.inner_html(root), str) and dom.links(root, "http://[x") == [] and dom.metadata(root, "")["title"] == ""
    if name in ("divs", "wide"):
        assert md == text.strip()
    assert time.perf_counter() - began < 30


def max_depth(root):
    most, stack = 0, [(root, 0)]
    while stack:
        n, d = stack.pop()
        most = max(most, d)
        stack += [(c, d + 1) for c in n.children if isinstance(c, dom.Node)]
    return most


def test_cleaning_is_linear():
    def took(n):
        root = dom.parse("<main>" + "<span></span>" * n + "</main>")
        began = time.perf_counter()
        dom.clean(root)
        return time.perf_counter() - began

    took(1_000)
    assert took(80_000) < 12 * took(20_000) + 0.2  # fourfold in proportion, sixteenfold as a square


def test_empty_elements_go_but_not_what_held_them():
    assert dom.inner_html(dom.clean(dom.parse("<body><div><span> </span></div><p></p><div>x</div></body>"))) == "<div></div><div>x</div>"


def test_pages_in_spark(spark):
    rows = [(k, f"https://h.example/{k}", v) for k, v in DEEP.items()] + [("none", None, None), ("base", "http://[x", "<a href='/y'>y</a>ok"), ("good", "https://h.example/g", "<title>T</title><p>fine")]
    df = spark.createDataFrame(rows, "id string, url string, html string").repartition(3)
    got = {r["id"]: r for r in P.scrape(df).collect()}
    assert set(got) == {r[0] for r in rows}
    assert got["good"]["meta"]["title"] == "T" and "fine" in got["good"]["markdown"] and got["good"]["parse_error"] is None
    assert got["base"]["links"] == [] and "ok" in got["base"]["markdown"]
    everything = P.parse(df, tuple(P.FIELDS), {"t": "title"})
    assert everything.count() == len(rows)


def test_an_unreadable_page_has_a_reason(spark, monkeypatch):
    df = spark.createDataFrame([("a", "x" * 100), ("b", "<p>y</p>")], "url string, html string")
    plain = dom.metadata

    def failing(root, url):
        if url == "a":
            raise RuntimeError("broken page")
        return plain(root, url)

    import sys

    # workers load the library themselves: the loop is called here as a task calls it
    captured = {}
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: captured.setdefault("f", f))
    P.parse(df, ("meta", "markdown", "parse_error"))
    import pyarrow as pa

    monkeypatch.setattr(sys.modules["weftlake.functions.dom"], "metadata", failing)
    batch = pa.RecordBatch.from_pydict({"url": ["a", "b"], "html": ["x" * 100, "<p>y</p>"]})
    rows = pa.Table.from_batches(list(captured["f"](iter([batch])))).to_pylist()
    assert [(r["url"], r["markdown"], r["parse_error"]) for r in rows] == [("a", "", "RuntimeError: broken page"), ("b", "y", None)]


def test_a_bad_selector_fails_on_the_driver(spark):
    with pytest.raises(ValueError):
        P.parse(spark.createDataFrame([], "url string, html string"), ("css",), {"x": "p >> q["})


def player(**details):
    return "<script>var ytInitialPlayerResponse = " + json.dumps({"videoDetails": {"title": "t", "author": "a", **details}}) + ";</script>"


@pytest.mark.parametrize(
    "field,value,want",
    [("title", 5, None), ("viewCount", "9" * 30, None), ("viewCount", "9223372036854775807", 2**63 - 1), ("viewCount", True, None), ("isLiveContent", "yes", None), ("isLiveContent", False, False), ("keywords", ["a", 5, None], ["a"]), ("keywords", "a", []), ("lengthSeconds", {}, None), ("shortDescription", ["x"], None), ("channelId", 1.5, None), ("thumbnail", {"thumbnails": "x"}, None), ("thumbnail", {"thumbnails": [{"url": 3}]}, None)],
)
def test_video_fields_are_typed(field, value, want):
    name = {"viewCount": "views", "isLiveContent": "is_live", "lengthSeconds": "duration", "shortDescription": "description", "channelId": "channel_id", "thumbnail": "image"}.get(field, field)
    got = video.extract(player(**{field: value}), "v")
    assert got["type"] == "video" and got[name] == want and isinstance(got["markdown"], str)


def test_video_odd_shapes():
    assert video.extract("<script>var ytInitialPlayerResponse = {\"videoDetails\": [1]};</script>", "v") is None
    data = {"x": [{"chapterRenderer": {"title": {"simpleText": "one"}, "timeRangeStartMillis": t}} for t in ("abc", 61000, None, [1], "1e999")]}
    got = video.extract(player() + "<script>var ytInitialData = " + json.dumps(data) + ";</script>", "v")
    assert [c["time"] for c in got["chapters"]] == [None, 61.0, 0.0, None, None] and "**1:01** — one" in got["markdown"]
    odd = {"lockupViewModel": {"contentId": "c", "metadata": {"lockupMetadataViewModel": {"title": {"content": {"a": 1}}, "metadata": {"contentMetadataViewModel": {"metadataRows": {"metadataParts": 3}}}}}}}
    assert video.extract("<script>var ytInitialData = " + json.dumps(odd) + ";</script>", "v")["videos"][0] == {"title": "", "video_id": "c", "views": "", "duration": "", "published": ""}


def test_a_site_is_parsed_once(spark):
    """A crawl's waves read what was parsed from a table: no plan after it runs Python."""
    from weftlake.operators import site

    pages = spark.createDataFrame([(f"https://h.org/{i}", f"<p>page {i}</p><a href='/{i + 1}'>n</a>") for i in range(5)], "url string, html string")
    for df in site.site_tables(pages):
        assert "MapInArrow" not in df._jdf.queryExecution().toString()
    assert site.crawl_site(pages, "https://h.org/0").pages.count() == 5


def test_adaptive_compiles(spark):
    """Every stage of the query's plan compiles to code that a method can hold."""
    import os

    from weftlake.plans import registry

    data = os.environ.get("WEFTLAKE_TESTDATA", "/root/testdata/sf0.001")
    plan = registry.queries()["adaptive_fetch"](spark, data)._jdf.queryExecution()
    stages = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$").codegenStringSeq(plan.executedPlan())
    for i in range(stages.size()):
        assert stages.apply(i)._3().maxMethodCodeSize() != -1
