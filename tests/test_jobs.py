"""The tracker's job, crawls of pages, adaptive tiers, whole scrapes and the command line on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from weftlake import __main__ as cli, api
from weftlake.functions import dom
from weftlake.functions.text import content_key
from weftlake.operators import adaptive as N, crawl as X, plugins as G, track as M
from weftlake.sources import results as E, state as A

NOW = "2026-06-18 00:00:00"
ENTITIES = [("Acme", ["ACM-5"], ["ai"]), ("Bolt", ["BLT"], ["markets"]), ("Quiet", [], [])]


def sweeps(spark, *rows):
    return spark.createDataFrame(rows, "entity string, rank int, title string, url string, snippet string")


def items(spark, *rows):
    return spark.createDataFrame(rows, "domain string, feed string, ord int, title string, url string, date string")


def test_track(spark, tmp_path):
    at, log = f"file://{tmp_path}/state", f"file://{tmp_path}/log"
    found = sweeps(spark, ("Acme", 0, "acme ships", "https://x.org/a/?q=1", ""), ("Bolt", 0, "news", "https://x.org/a", "for ACM-5 and BLT"), ("Acme", 1, "acme", "https://x.org/old", None))
    feed = items(spark, ("ai", "f", 0, "Acme in a feed", "https://x.org/a#top", None), ("sports", "g", 0, "Acme plays", "https://x.org/s", None), ("markets", "h", 0, "abltx", "https://x.org/n", "2026-06-01"), ("markets", "h", 1, "Bolt up", "https://x.org/b/", "2026-06-01"))
    A.write_state(spark.createDataFrame([("Acme", "https://x.org/old", "t", "u", "s", "2026-06-01"), ("Bolt", "https://x.org/gone", "t", "u", "s", "2026-01-01"), ("Bolt", "https://x.org/odd", "t", "u", "s", "garbage")], A.MENTIONS), at)
    got = {r["entity"]: r for r in M.track(spark, ENTITIES, found, feed, at, NOW, log).collect()}
    assert {e: (r["n_new"], r["total_known"]) for e, r in got.items()} == {"Acme": (1, 2), "Bolt": (2, 3), "Quiet": (0, 0)}
    assert got["Acme"]["section"] == "## Acme\n- [acme ships](https://x.org/a/?q=1)" and got["Quiet"]["section"] is None
    state = {(r["entity"], r["url_key"], r["source"]) for r in A.read_state(spark, at).collect()}
    assert ("Bolt", "https://x.org/a", "sweep:Bolt") in state and ("Bolt", "https://x.org/b", "h") in state and not any("gone" in k for _, k, _ in state)
    again = M.track(spark, ENTITIES, found, feed, at, NOW, log)
    assert [r["n_new"] for r in again.collect()] == [0, 0, 0]
    assert "_nothing new since last run._" in M.digest_text(again, NOW).first()["markdown"]
    lines = [json.loads(x) for f in (tmp_path / "log").glob("*.json") for x in f.read_text().splitlines()]
    assert sorted(x["new_mentions"] for x in lines) == [0, 3] and all(set(x["by_entity"]) == {"Acme", "Bolt", "Quiet"} for x in lines)
    none = M.track(spark, ENTITIES, found.limit(0), None, f"file://{tmp_path}/empty", NOW)
    assert [r["total_known"] for r in none.collect()] == [0, 0, 0]


def site(spark):
    link = lambda *to: "".join(f"<a href='{x}'>{x}</a>" for x in to)
    rows = [
        ("https://s.org/", "<p>home</p>" + link("/a", "/b#x", "/skip/1", "https://other.org/", "/gone"), "http"), ("https://s.org/a", "<p>first page</p>" + link("/c", "/"), "browser"),
        ("https://s.org/b/", "<p>second page</p>" + link("/d"), "http"), ("https://s.org/c", "<p>third page</p>" + link("/e"), "http"), ("https://s.org/d", "<p>third page</p>" + link("/e", "/f"), "jsdom"),
        ("https://s.org/e", "<p>deep</p>", "http"), ("https://s.org/skip/1", "<p>skipped</p>", "http"), ("https://s.org/f", "<p>last</p>", "http"), (None, "<p>none</p>", "http"),
    ]
    return spark.createDataFrame([(u, f"<html><head><title>t</title></head><body>{h}</body></html>", t) for u, h, t in rows], "url string, html string, tier string")


def test_crawl_site(spark):
    pages = site(spark)
    c = api.crawl_site(pages, "https://s.org/#top", exclude=["https://s.org/skip/**"])
    depth = {r["url"]: r["depth"] for r in c.pages.collect()}
    assert depth == {"https://s.org/": 0, "https://s.org/a": 1, "https://s.org/b/": 1, "https://s.org/c": 2, "https://s.org/d": 2, "https://s.org/e": 3, "https://s.org/f": 3}
    assert {r["id"]: r["depth"] for r in c.errors.collect()} == {"https://s.org/gone": 1}
    assert sum(r["n"] for r in c.tiers.collect()) >= 5 and {r["tier"] for r in c.tiers.collect()} == {"http", "jsdom", "browser"}
    assert api.crawl_site(pages, "https://s.org", max_pages=2).pages.count() == 2 and api.crawl_site(pages, "https://s.org", max_depth=0).pages.count() == 1
    only = G.Plugin("a", filter_url=lambda url, parent: F.endswith(url, F.lit("/a")))
    assert {r["url"] for r in api.crawl_site(pages, "https://s.org", plugins=[only]).pages.collect()} == {"https://s.org/", "https://s.org/a"}
    lost = api.crawl_site(pages, "https://s.org/nowhere")
    assert lost.pages.count() == 0 and [r["n"] for r in lost.tiers.collect()] == [0, 0, 0] and lost.errors.count() == 1


def test_crawl_repeats_use_budget(spark):
    pages = spark.createDataFrame([(0, "h"), (1, "x"), (2, "x"), (3, "y")], "id long, content_hash string")
    edges = spark.createDataFrame([(0, 2, 0), (0, 1, 1), (1, 3, 0)], "src long, dst long, pos int")
    assert [r["id"] for r in X.crawl(pages, edges, 0).orderBy("depth", "ord").collect()] == [0, 2]
    c = X.crawl_report(pages, edges, 0, 2)
    assert [r["id"] for r in c.pages.orderBy("depth").collect()] == [0, 2] and sum(r["n"] for r in c.tiers.collect()) == 2


def test_map_site(spark):
    xml = spark.createDataFrame([("<loc>https://s.org/z</loc><loc>https://s.org/a</loc>",)], "xml string")
    got = [r["url"] for r in api.map_site(site(spark), "https://s.org/", 5, xml).collect()]
    # the crawl reads as many pages as are wanted still, one of which is listed already
    assert got == ["https://s.org/z", "https://s.org/a", "https://s.org", "https://s.org/b"]
    assert [r["url"] for r in api.map_site(site(spark), "https://s.org/", 1, xml).collect()] == ["https://s.org/z"]


SHELL, PLAIN = '<div id="root"></div><script src="react.min.js"></script>', "<p>" + "plain words " * 80 + "</p>"


@pytest.mark.parametrize(("have", "learned", "tier"), [
    ({"http": PLAIN}, None, "http"), ({"http": SHELL}, None, "http"), ({"http": SHELL, "browser": PLAIN}, None, "browser"), ({"jsdom": PLAIN, "browser": PLAIN}, None, "jsdom"),
    ({"browser": PLAIN}, None, "browser"), ({}, None, None), ({"http": SHELL, "jsdom": PLAIN}, "jsdom", "jsdom"), ({"http": PLAIN}, "browser", None),
])
def test_adaptive(spark, have, learned, tier):
    asked = spark.createDataFrame([(1, "https://x.org/p")], "k int, url string")
    snaps = spark.createDataFrame([("https://x.org/p", t, h) for t, h in have.items()], "url string, tier string, html string")
    memory = spark.createDataFrame([("x.org", learned)] if learned else [], "host string, tier string")
    r = N.adaptive(asked, snaps, memory).first()
    assert (r["k"], r["tier"], r["html"]) == (1, tier, have.get(tier)) and r["escalated"] == (tier is not None and tier != r["predicted"])
    assert N.predict(asked, memory).first()["confidence"] == (0.9 if learned else 1.0)
    assert N.adaptive(asked, snaps, memory, forced="http").first()["tier"] == ("http" if "http" in have else None)
    assert N.outcomes(N.adaptive(asked, snaps), F.lit(3)).first()["success"] == bool(have)


def test_scrape_with_cache(spark):
    pages = site(spark)
    asked = spark.createDataFrame([("https://s.org/a",), ("https://s.org/a",), ("https://s.org/c",), ("https://s.org/none",), (None,)], "url string")
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    fresh = api.scrape(asked, pages, chunk_tokens=50, per_second=2.0)
    got = {r["url"]: r for r in fresh.records.collect()}
    assert set(got) == {"https://s.org/a", "https://s.org/c"} and sorted(r["at"] for r in got.values()) == [0.0, 0.5] and got["https://s.org/a"]["chunks"][0]["index"] == 0
    assert [r["url"] for r in fresh.missing.collect()] == ["https://s.org/none"]
    cache = fresh.records.drop("host", "at", "from_cache").withColumn("fetched_at", F.when(F.col("url") == "https://s.org/a", F.lit("2024-01-01 23:30:00")).otherwise("2024-01-01").cast("timestamp"))
    again = {r["url"]: r["from_cache"] for r in api.scrape(asked, pages, cache, now, chunk_tokens=50).records.collect()}
    assert again == {"https://s.org/a": True, "https://s.org/c": False}


def test_extract_many_and_reader(spark):
    asked = spark.createDataFrame([(0, "https://s.org/none"), (1, "https://s.org/a"), (2, None), (3, "https://s.org/a")], "ord int, url string")
    got = {r["ord"]: (r["title"], r["approx_tokens"], r["captcha"], r["extracted_via"]) for r in api.extract_many(asked, site(spark)).collect()}
    assert got[0] == got[2] == ("", 0, False, "none") and got[1] == got[3] and got[1][0] == "t" and got[1][3] == "cleaner"
    rows = spark.createDataFrame([(0, 200, "x" * 200), (1, 200, "x" * 199), (2, 404, "x" * 300), (3, 200, None)], "k int, status int, body string")
    assert {r["k"]: (r["ok"], r["approx_tokens"]) for r in E.reader(rows).collect()} == {0: (True, 50), 1: (False, None), 2: (False, None), 3: (False, None)}


def test_agent_links_and_clean():
    html = "<body><nav><a href='/n'>n</a></nav><a href='a#x'> first </a><a href='a#x'>again</a><a href='mailto:x@y.z'>m</a><a href='#top'>top</a><a>none</a><main><p>" + "text " * 30 + "<span class='my-newsletter-box'>no</span><span></span></p><div id='x'><article class='share'>kept</article></div></main></body>"
    root = dom.parse(html)
    assert dom.agent_links(root, "https://s.org/d/") == [("https://s.org/n", "n"), ("https://s.org/d/a#x", "first"), ("https://s.org/d/#top", "top")]
    main = dom.clean(root)
    assert main.tag == "main" and "no" not in main.text().split() and "kept" in main.text() and "<span>" not in dom.inner_html(main)


def test_content_key(spark):
    d = spark.createDataFrame([("<b>A</b>  b",), ("a b",), ("a c",), (None,)], "t string").select(content_key(F.col("t")).alias("k"))
    a, b, c, n = (r["k"] for r in d.collect())
    assert a == b != c and n is None


def test_command_line(spark, tmp_path, capsys):
    at = f"{tmp_path}/pages"
    site(spark).write.parquet(at)
    assert {r["url"] for r in cli.run(spark, ["scrape", at, "https://s.org/a"]).collect()} == {"https://s.org/a"}
    assert cli.run(spark, ["crawl", at, "https://s.org/", "-n", "3", "-d", "1", "--exclude", "https://s.org/skip/**"]).count() == 3
    assert cli.run(spark, ["map", at, "https://s.org/", "-n", "4"]).count() == 4
    spark.createDataFrame([("q", "bing", "<li class='b_algo'><h2><a href='https://x.org'>T</a></h2></li>")], "query string, engine string, html string").write.parquet(f"{tmp_path}/serp")
    assert [r["title"] for r in cli.run(spark, ["search", f"{tmp_path}/serp", "q"]).collect()] == ["T"]
    with pytest.raises(SystemExit):
        cli.run(spark, ["crawl", at])
