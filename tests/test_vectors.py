"""Hand-worked values of the column functions and the page tree."""

import pytest
from pyspark.sql import functions as F

from weftlake.functions import dom, scoring as S, text as T, urls as U
from weftlake.operators import chunk as K, crawl as X, track as M
from weftlake.sources import feeds as B


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(("text", "tokens"), [("", 0), ("   ", 1), ("hello world", 3), ("`ab`", 4), ("漢字", 3)])
def test_tokens(spark, text, tokens):
    assert one(spark, text, T.token_estimate) == tokens == K.tokens(text)


@pytest.mark.parametrize(("text", "digest"), [("", "811c9dc5"), ("a", "e40c292c"), ("hello", "a82fb4a1"), (" <b>Hello</b> ", "a82fb4a1")])
def test_hash(spark, text, digest):
    assert one(spark, text, T.content_hash) == digest


def test_tokenize(spark):
    assert one(spark, "The QUICK brown fox", S.tokenize) == ["quick", "brown", "fox"]
    assert "4.8" in one(spark, "Model 4.8 is out", S.tokenize)
    assert one(spark, "the and for", S.tokenize) == []


def test_relevance(spark):
    r = lambda doc, title="": one(spark, doc, lambda c: S.relevance(["quantum"], c, F.lit(title)))
    assert r("pasta") == 0 and r("quantum") == pytest.approx(0.4) and r("quantum", "quantum") == pytest.approx(0.6)
    assert r("quantum " * 50) == pytest.approx(0.970874, abs=1e-6)


def test_link_score(spark):
    s = lambda href, text, terms: one(spark, href, lambda c: S.link_score(c, F.lit(text), terms))
    assert s("https://site.com/2026/06/big-news-story", "big news story", ["news", "story"]) == pytest.approx(7.6)
    assert s("https://site.com/login", "login", ["news"]) == -6
    assert s("https://twitter.com/x/status", "x", ["news"]) < 0 and s("not a url", "x", ["news"]) == -100


def test_recency(spark):
    r = lambda d: one(spark, d, S.recency, "double")
    assert (r(None), r(0.0), r(30.0)) == (0.5, 1.0, 0.5) and r(45.0) == pytest.approx(0.353553, abs=1e-6)


@pytest.mark.parametrize(("raw", "key"), [("https://WWW.Example.com/Path/#section", "https://example.com/Path"), ("https://x.com/a?utm_source=t&utm_medium=e&id=5&fbclid=z", "https://x.com/a?id=5"), ("https://x.com/post?utm_campaign=a", "https://x.com/post"), ("https://x.com/post/", "https://x.com/post"), ("::::/", "::::")])
def test_search_key(spark, raw, key):
    assert one(spark, raw, U.search_key) == key


def test_unwrap(spark):
    assert one(spark, "https://www.bing.com/ck/a?!&u=a1aHR0cHM6Ly94Lm9yZy9h&ntb=1", U.unwrap_redirect) == "https://x.org/a"
    for kept in ("https://x.org/", "https://www.bing.com/ck/a?u=a1Z2FyYmFnZQ"):
        assert one(spark, kept, U.unwrap_redirect) == kept


def test_tiers(spark):
    t = one(spark, "https://app.x.com/", S.tier_before)
    assert (t.tier, t.score) == ("jsdom", 0.30000000000000004)
    t = one(spark, '<div id="root"></div><script src="/react.min.js"></script>', S.tier_after)
    assert (t.tier, t.confidence, t.score) == ("browser", 1.0, pytest.approx(1.15))
    t = one(spark, "<html><body><p>" + "x" * 48 + "</p></body></html>", S.tier_after)
    assert (t.tier, t.score) == ("http", 0.0)


def test_entities(spark):
    hit = lambda text, *terms: one(spark, text, lambda c: F.rlike(c, F.lit(M.pattern(terms))))
    assert hit("news of ACME corp", "Acme", "Roadrunner") and hit("roadrunner wins", "Acme", "Roadrunner")
    assert hit("BTC rises", "BTC") and not hit("abtch", "BTC") and hit("now GPT-5 is out", "GPT-5") and hit("éBTC", "BTC")


def test_prune(spark):
    s = spark.createDataFrame([("2026-06-01",), ("2025-12-15",), ("garbage",)], "first_seen string")
    kept = {r[0] for r in M.prune(s, F.lit("2026-06-02").cast("timestamp")).collect()}
    assert kept == {"2026-06-01", "garbage"}


def test_chunks():
    pack = lambda limit, overlap=0: K.pack_sections(["# A\nx\n", "## B\ny"], "# A\nx\n## B\ny", limit, overlap)
    for limit in (4, 3):
        assert [(c["content"], c["start_offset"], c["end_offset"], c["tokens"]) for c in pack(limit)] == [("# A\nx\n", 0, 6, 4), ("## B\ny", 6, 12, 4)]
    assert pack(4, 1)[1]["content"] == "\n\n## B\ny" and pack(4, 1)[1]["end_offset"] == 14


def test_durations(spark):
    assert one(spark, 3661, B.duration, "long") == "1:01:01" and one(spark, 65, B.duration, "long") == "1:05" and one(spark, 1500, B.views, "long") == "1.5K"


def test_dom():
    root = dom.parse("<html lang=en><head><title> A &amp; B </title><meta property='og:image' content=i></head><body><nav><a href=/n>n</a></nav><article><h1>T</h1><p>one <b>two</b> <a href='/x#h'>link</a><p>three<ul><li>a<li>b</ul><img src=s alt=pic>" + "word " * 30 + "</article><a href='mailto:x'>m</a></body></html>")
    m = dom.metadata(root, "https://h.org/p")
    assert (m["title"], m["language"], m["og_image"], m["canonical"]) == ("A & B", "en", "i", "https://h.org/p")
    assert [x[0] for x in dom.links(root, "https://h.org/p")] == ["https://h.org/n", "https://h.org/x"]
    md = dom.markdown(dom.clean(root))
    assert md.startswith("# T\n\none **two** [link](/x#h)\n\nthree\n\n-   a\n-   b") and "![pic](s)" in md and "[n]" not in md


def test_dom_malformed():
    for html in ("", "<", "<p>a<p>b</div></p>", "<b><i>x</b>y</i>", "<script>var a='</p>'</script>t", "<table><tr><td>1<td>2<tr><td>3</table>"):
        root = dom.parse(html)
        dom.links(root, "https://h.org"), dom.markdown(dom.clean(root)), dom.tables(root)
    assert dom.tables(dom.parse("<table><tr><th>h<tr><td>1<td>2<tr><td>3</table>")) == [{"headers": ["h"], "rows": [["1", "2"], ["3"]]}]


def test_crawl_budget(spark):
    pages = spark.createDataFrame([(0, "a"), (1, "b"), (2, "b"), (3, "c"), (4, "d")], "id long, content_hash string")
    edges = spark.createDataFrame([(0, 1, 0), (0, 2, 1), (0, 9, 2), (2, 3, 0), (1, 4, 0), (1, 0, 1)], "src long, dst long, pos int")
    out = lambda **k: sorted(tuple(r)[:2] for r in X.crawl(pages, edges, 0, **k).collect())
    assert out() == [(0, 0), (1, 1), (4, 2)]  # 2 repeats 1's content: not yielded, its link to 3 not followed
    assert out(max_pages=3) == [(0, 0), (1, 1)]  # the copy used budget
    assert out(max_depth=1) == [(0, 0), (1, 1)]
