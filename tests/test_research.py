"""Best-first reading, articles by density, result pages, video pages, plugins, caches, pacing and state on small fixtures."""

import pytest
from pyspark.sql import functions as F

from weftlake.functions import dom, readable, urls as U, video as V
from weftlake.operators import browse as W, plugins as G
from weftlake.sources import results as E, state as A

PROSE = "Quantum chips, said the lab, now hold their state for an hour. " * 8


def page(body, title="Quantum news"):
    return f"<html><head><title>{title}</title></head><body><article><p>{body}</p></article></body></html>"


def link(url, text="quantum story of the day"):
    return f"<a href='{url}'>{text}</a>"


def story(spark, pages, **more):
    rows = [(u, h, s) for u, h, *rest in pages for s in (rest or ["direct"])]
    return tuple([tuple(r) for r in d.collect()] for d in W.browse(spark.createDataFrame(rows, "url string, html string, strategy string"), "quantum", **more))


def test_browse_follows_gates_and_caps(spark):
    a, b, c, thin, other = (f"https://{h}.org/2024/quantum-story-{h}" for h in ("a", "b", "c", "thin", "other"))
    pages = [
        (a, page(PROSE + link(b) + link(thin) + link(other) + link("https://a.org/2024/quantum-story-second") + link("https://gone.org/2024/quantum-story-gone"))),
        (b, page(PROSE + link(c))), (c, page(PROSE)), (thin, page("quantum")), (other, page("Pasta, said the cook, is best with oil and salt. " * 8, "Pasta")),
        ("https://a.org/2024/quantum-story-second", page(PROSE)),
    ]
    seen, skipped = story(spark, pages, seed_urls=[a], per_page_links=5, per_domain=1)
    assert [r[1] for r in seen] == [a, b, c] and [r[3] for r in seen] == [0, 1, 2]
    assert dict(skipped) == {thin: "thin", other: "off topic", "https://a.org/2024/quantum-story-second": "domain cap", "https://gone.org/2024/quantum-story-gone": "no snapshot"}
    assert len(story(spark, pages, seed_urls=[a], max_pages=1)[0]) == 1
    ranked = story(spark, pages, seed_urls=[a], per_page_links=1, rank_links=lambda q, found: ["https://a.org/2024/quantum-story-second"])[0]
    assert [r[1] for r in ranked] == [a, "https://a.org/2024/quantum-story-second"]


def test_browse_climbs_the_ladder(spark):
    u = "https://a.org/2024/quantum-story-a"
    pages = [(u, page("thin")), (u, page(PROSE), "wayback")]
    assert [r[1] for r in story(spark, pages, seed_urls=[u])[0]] == [u]
    assert story(spark, [], seed_urls=[u]) == ([], [(u, "no snapshot")]) and story(spark, pages) == ([], [])


def test_browse_recency(spark):
    u, v = "https://a.org/2024/quantum-story-a", "https://b.org/2024/quantum-story-b"
    pages = [(u, page("January 5, 2020 " + PROSE + link(v))), (v, page(PROSE))]
    assert [r[1] for r in story(spark, pages, seed_urls=[u], max_age_days=30)[0]] == [u, v]
    assert story(spark, pages, seed_urls=[u], max_age_days=30, hard_recency=True) == ([], [(u, "stale")])


def test_article():
    html = "<body><div class=menu>" + "<p><a href=x>a link that is long enough to vote</a></p>" * 9 + f"</div><div id=story><h1>Head</h1><p>{PROSE}</p><p>{PROSE}</p><script>x</script></div></body>"
    a = readable.article(dom.parse(html), html)
    assert a["ok"] and "Quantum chips" in a["text"] and "a link" not in a["text"] and "Head" in a["text"] and a["excerpt"].startswith("Quantum")
    for none in ("", "<p>short</p>", "x" * 5_000_001):
        assert not readable.article(dom.parse(none[:100]), none)["ok"]


def test_results(spark):
    rows = [("q", "bing", "<li class=b_algo><h2><a href='https://www.bing.com/ck/a?!&u=a1aHR0cHM6Ly94Lm9yZy9h&ntb=1'>A</a></h2></li><li class=b_algo><h2><a href='/b'>B</a></h2></li>"), ("q", "mojeek", None), ("q", "other", "x")]
    got = E.hits(spark.createDataFrame(rows, "query string, engine string, html string")).collect()
    assert [tuple(r) for r in got] == [("q", "bing", 2, 0, "A", "https://x.org/a", "")]


@pytest.mark.parametrize(("raw", "plain"), [("//d.com/l/?uddg=https%3A%2F%2Fx.org%2Fa%2520b&rut=1", "https://x.org/a b"), ("https://x.org", "https://x.org"), ("//d.com/l/?uddg=%zz", "//d.com/l/?uddg=%zz")])
def test_unwrap_parameter(spark, raw, plain):
    assert spark.createDataFrame([(raw,)], "x string").select(U.unwrap_parameter(F.col("x"))).first()[0] == plain


def test_video_layouts():
    lockup = '{"lockupViewModel":{"contentId":"i","metadata":{"lockupMetadataViewModel":{"title":{"content":"T"},"metadata":{"contentMetadataViewModel":{"metadataRows":[{"metadataParts":[{"text":{"content":"5 views"}},{"text":{"content":"2 days ago"}}]}]}}}}}}'
    grid = '{"gridVideoRenderer":{"videoId":"g","title":{"runs":[{"text":"a"},{"text":"b"}]},"publishedTimeText":{"simpleText":"p"}}}'
    both = V.extract(f"var ytInitialData = {{\"x\":[{lockup},{grid}]}};", "")
    assert both["type"] == "channel" and both["videos"] == [{"title": "T", "video_id": "i", "views": "5 views", "duration": "", "published": "2 days ago"}]
    old = V.extract(f"var ytInitialData = {{\"x\":[{grid}],\"channelMetadataRenderer\":{{\"title\":\"C\",\"vanityChannelUrl\":\"http://y/@c\"}}}};", "")
    assert old["videos"][0]["title"] == "ab" and (old["title"], old["handle"]) == ("C", "@c") and old["markdown"].startswith("# C\n\n**@c** |  | ")
    for none in ("", "var ytInitialData = {bad};", "var ytInitialData = {\"a\":1};"):
        assert V.extract(none, "") is None


def test_video_pages(spark):
    html = 'var ytInitialPlayerResponse = {"videoDetails":{"title":"T","author":"A","viewCount":"1500","lengthSeconds":"65"}};'
    rows = [(1, "https://youtu.be/abc", html), (2, "https://x.org/", html), (3, "https://youtube.com/watch?v=k", None), (4, None, None)]
    got = {r["id"]: r["video"] for r in E.video_pages(spark.createDataFrame(rows, "id int, url string, html string")).collect()}
    assert (got[1]["video_id"], got[1]["views"], got[1]["duration"]) == ("abc", 1500, 65) and got[1]["markdown"].startswith("# T\n\n**A** | 1.5K views | 1:05\n")
    assert got[2] is got[3] is got[4] is None


def test_transcript(spark):
    rows = [(1, "m", '<text start="65" dur="1">a &amp; b</text>'), (2, "m", None)]
    got = {r["id"]: (r["markdown"], r["full_text"], r["words"]) for r in E.with_transcript(spark.createDataFrame(rows, "id int, markdown string, captions string")).collect()}
    assert got == {1: ("m\n\n## Transcript\n\n**[1:05]** a & b", "a & b", 3), 2: ("m", None, None)}


def test_discover(spark):
    text = "x" * 200 + "\nSports\na first event of the day\n"
    days = spark.createDataFrame([(0, "2024-01-02", text), (1, "2024-01-01", text), (2, "2023-12-31", "Sports\nan event of a short page")], "ord long, date string, markdown string")
    assert [tuple(r) for r in E.discover(days).collect()] == [("Sports", "a first event of the day", "2024-01-01", 1)]
    counts = E.discover_domains(spark, spark.createDataFrame([], "feed string, status int, xml string"), "2024-01-02", domains=["ai"])
    assert counts[0].count() == 0 and tuple(counts[1].first()) == (0, 4)
    swept = spark.createDataFrame([("record market move January 2024", 0, "t", "https://x.org/a"), ("other", 0, "t", "https://x.org/b")], "query string, rank int, title string, url string")
    items = E.discover_domains(spark, spark.createDataFrame([], "feed string, status int, xml string"), "2024-01-02", swept)[0]
    assert [(r["domain"], r["feed"]) for r in items.collect()] == [("markets", "sweep:record market move January 2024")]


def test_plugins(spark):
    p = [G.Plugin("a", filter_url=lambda u, parent: ~F.contains(u, F.lit("x"))), G.Plugin("b", filter_url=lambda u, parent: u != parent), G.Plugin("c")]
    d = spark.createDataFrame([("a", "b"), ("x", "b"), ("b", "b"), (None, "b")], "u string, p string")
    assert [r[0] for r in d.where(G.allowed(p, F.col("u"), F.col("p"))).collect()] == ["a"]
    assert d.select(G.extracted([G.Plugin("n", extract=lambda: F.lit(None).cast("map<string,string>"))])).first()[0] == {}


def test_cache(spark):
    for sizes, limit, left in (([3, 9, 1], 10, {1, 2}), ([9, 5], 10, {1}), ([3, 20], 10, {1}), ([], 10, set()), ([1, 1], 10, {0, 1})):
        d = spark.createDataFrame(list(enumerate(sizes)), "seq long, size long").withColumn("seq", F.col("seq") * 100_000)
        assert {r["seq"] // 100_000 for r in A.evict(d, limit).collect()} == left


def test_pace(spark):
    d = spark.createDataFrame([(i * 40_000, "https://a.org/") for i in range(5)] + [(1, "https://b.org"), (2, None)], "ord long, url string")
    got = {r["ord"]: r["at"] for r in A.pace(d, 2.0).collect()}
    assert [got[i * 40_000] for i in range(5)] == [0.0, 0.5, 1.0, 1.5, 2.0] and got[1] == got[2] == 0.0
    assert [r["proxy"] for r in A.rotate(d, ["p", "q"]).orderBy("ord").limit(3).collect()] == ["p", "q", "p"]


def test_state(spark, tmp_path):
    at = f"file://{tmp_path}/state"
    assert A.read_state(spark, at).count() == 0 and A.watchlist(spark, at).count() == 8
    row = spark.createDataFrame([("e", "u", "t", "u", "s", "2024-01-01")], A.MENTIONS)
    A.write_state(row, at)
    A.write_state(A.read_state(spark, at).union(row.withColumn("entity", F.lit("f"))), at)
    assert {r["entity"] for r in A.read_state(spark, at).collect()} == {"e", "f"}
    A.write_results(spark.createDataFrame([("https://x.org/a?b", "m")], "url string, markdown string"), f"file://{tmp_path}/out")
    assert tuple(spark.read.parquet(f"file://{tmp_path}/out").first()) == ("https://x.org/a?b", "x_org_a_b.md", "m")
