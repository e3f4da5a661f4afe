"""Result pages of search engines, video pages, and the composites over searches, feeds and days."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import constants as C, scoring as S, text as T, urls as U, video as V
from ..functions.batches import pieces
from . import feeds as B

#: Of each engine its number, and the selectors of a result, its title (a link) and its snippet.
ENGINES = {
    "duckduckgo": (1, ".result", ".result__a", ".result__snippet"),
    "bing": (2, "li.b_algo", "h2 a", ".b_caption p, p.b_lineclamp2, .b_caption"),
    "mojeek": (3, 'ul.results-standard > li[class^="r"], ol.results li', "h2 a", "p.s, .s"),
}


def hits(results: DataFrame, per_engine: int = 10) -> DataFrame:
    """results(query, engine, html): (query, engine, engine_no, rank from 0, title, url, snippet) of the first per_engine results.

    Results need a title and, redirects unwrapped, an http url. Null html has none; unknown engines are left out.
    """
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from ..functions import dom

        for batch in pieces(batches):
            out = []
            for engine, html in zip(batch.column("engine").to_pylist(), batch.column("html").to_pylist(), strict=True):
                _, item, title, snippet = ENGINES[engine]
                rows = []
                for n in dom.select(dom.parse(html or ""), item):
                    a, s = next(iter(dom.select(n, title)), None), next(iter(dom.select(n, snippet)), None)
                    if a is not None:
                        rows.append({"title": a.text().strip(dom.SPACE), "url": a.attrs.get("href", ""), "snippet": s.text().strip(dom.SPACE) if s else ""})
                out.append(rows)
            found = pa.array(out, pa.list_(pa.struct([("title", pa.string()), ("url", pa.string()), ("snippet", pa.string())])))
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("engine"), found], ["query", "engine", "found"])

    d = results.select("query", "engine", "html").where(F.col("engine").isin(*ENGINES)).mapInArrow(run, "query string, engine string, found array<struct<title:string,url:string,snippet:string>>")
    u = lambda x: F.when(F.col("engine") == "bing", U.unwrap_redirect(x["url"])).when(F.col("engine") == "duckduckgo", U.unwrap_parameter(x["url"])).otherwise(x["url"])
    real = F.transform("found", lambda x: F.struct(x["title"].alias("title"), u(x).alias("url"), x["snippet"].alias("snippet")))
    kept = F.slice(F.filter(real, lambda x: (x["title"] != "") & F.startswith(x["url"], F.lit("http"))), 1, per_engine)
    no = F.create_map(*[F.lit(y) for k, v in ENGINES.items() for y in (k, v[0])])
    return d.select("query", "engine", no[F.col("engine")].alias("engine_no"), F.posexplode(kept).alias("rank", "x")).select("query", "engine", "engine_no", "rank", "x.*")


def search(results: DataFrame, max_results: int = 10) -> DataFrame:
    """The engines' results of each query fused by reciprocal ranks: query, title, url, snippet, score, engines."""
    from ..operators import ranking as R

    return R.rrf(hits(results, max(max_results, 10)), max_results, ("query",))


def reader(snapshots: DataFrame) -> DataFrame:
    """snapshots(status, body, ...): adds ok, title, markdown, approx_tokens; not ok (and null) beside status 200 or under 200 characters."""
    ok = F.coalesce((F.col("status") == 200) & (T.len16(F.col("body")) >= 200), F.lit(False))
    return snapshots.withColumn("ok", ok).withColumn("title", F.when(F.col("ok"), "")).withColumn("markdown", F.when(F.col("ok"), F.col("body"))).withColumn("approx_tokens", T.js_round(T.len16(F.col("markdown")) / 4).cast("long"))


def feed_registry(spark: SparkSession, domains: Sequence[str] | None = None) -> DataFrame:
    """(domain, feed, feed_ord) of the known feeds."""
    rows = [(d, f) for d in (domains or C.DOMAIN_FEEDS) for f in C.DOMAIN_FEEDS[d]]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "domain string, feed string, feed_ord int")


def sweep_queries(spark: SparkSession, today: str, domains: Sequence[str] | None = None) -> DataFrame:
    """(domain, query, query_ord): the dated searches of each domain."""
    rows = [(d, q) for d in (domains or C.DOMAIN_SEARCHES) for q in C.DOMAIN_SEARCHES[d]]
    d = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "domain string, query string, query_ord int")
    t = F.lit(today).cast("date")
    return d.withColumn("query", F.replace(F.replace("query", F.lit("{M}"), F.date_format(t, "MMMM")), F.lit("{Y}"), F.date_format(t, "yyyy")))


def latest(snapshots: DataFrame, by: str = "fetched_at") -> DataFrame:
    """snapshots(feed, status, xml, by, ...), a row a fetch: the last fetch of each feed (nulls are no time). Maxima are combined before the shuffle."""
    rest = [c for c in snapshots.columns if c not in ("feed", by)]
    return snapshots.where(F.col(by).isNotNull()).groupBy("feed").agg(F.max_by(F.struct(*rest), by).alias("_x")).select("feed", "_x.*")


def discover_domains(spark: SparkSession, feeds: DataFrame, today: str, swept: DataFrame | None = None, domains: Sequence[str] | None = None, per_feed: int = 12, max_age_days: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(items: domain, feed, title, url, date, one row a url key; counts: feeds_read, feeds_failed).

    feeds(feed, status, xml) are snapshots of the registry's feeds; one that is missing or not of status 200 failed. Feeds
    come before swept(query, rank, title, url) results, each in the registry's order, and the first of a url key wins.
    Items older than max_age_days go; those without a readable date stay.
    """
    known = feed_registry(spark, domains).join(feeds.withColumnRenamed("feed", "_f"), F.col("feed") == F.col("_f"), "left")
    read = F.coalesce(F.col("status") == 200, F.lit(False))
    counts = known.agg(F.count_if(read).alias("feeds_read"), F.count_if(~read).alias("feeds_failed"))
    items = B.feed_items(known.where(read).select("feed", "xml"), per_feed).join(feed_registry(spark, domains).withColumnRenamed("feed", "_f"), F.col("feed") == F.col("_f"))
    items = items.select("domain", "feed", "title", "url", "date", F.lit(0).alias("kind"), F.col("feed_ord").alias("a"), F.col("ord").cast("int").alias("b"))
    if max_age_days is not None:
        t = S.parse_date(F.col("date"))
        items = items.where(t.isNull() | (t >= F.lit(today).cast("timestamp") - F.expr(f"interval {int(max_age_days)} days")))
    if swept is not None:
        q = sweep_queries(spark, today, domains).withColumnRenamed("query", "_q")
        s = swept.join(q, F.col("query") == F.col("_q")).where(F.col("rank") < 8)
        items = items.union(s.select("domain", F.concat(F.lit("sweep:"), "query").alias("feed"), "title", "url", F.lit(None).cast("string").alias("date"), F.lit(1).alias("kind"), F.col("query_ord").alias("a"), F.col("rank").cast("int").alias("b")))
    return B.first_of_key(items, "kind", "a", "b").select("domain", "feed", "title", "url", "date", "kind", "a", "b"), counts


def discover(days: DataFrame, cap: int = 60, category: str | None = None) -> DataFrame:
    """days(ord from the newest, date, markdown): (category, text, date, place), pages under 200 characters left out."""
    e = B.day_events(days.where(F.length("markdown") >= 200)).join(days.select(F.col("date").alias("_d"), F.col("ord").alias("day")), F.col("date") == F.col("_d"))
    e = e.withColumn("ord", F.struct("day", "k", "pos"))
    return B.dedup_events(e, cap, category).select("category", "text", "date", "place")


def video_pages(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """pages' columns without html, and `video` (see functions.video.TYPE): null for urls of other hosts and pages without its data."""
    kept = [f for f in pages.schema.fields if f.name != html]
    d = pages.withColumn("_id", U.video_id(F.col(url)))
    d = d.withColumn(html, F.when(F.col("_id").isNotNull(), F.col(html)))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"video {V.TYPE}"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(pages.sparkSession.createDataFrame([], f"video {V.TYPE}").schema[0].dataType)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in pieces(batches):
            out = [V.extract(h.as_py(), i.as_py() or "") if h.is_valid else None for h, i in zip(batch.column(html), batch.column("_id"), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(out, kind)], [*(f.name for f in kept), "video"])

    return d.mapInArrow(run, schema)


def with_transcript(pages: DataFrame, xml: str = "captions", md: str = "markdown") -> DataFrame:
    """pages with the captions' transcript appended to the markdown, and full_text and words; without captions as they were."""
    seg = B.captions(F.col(xml))
    full = F.array_join(F.transform("_seg", lambda s: s["text"]), " ")
    d = pages.withColumn("_seg", seg)
    some = F.coalesce(F.size("_seg") > 0, F.lit(False))
    d = d.withColumn("full_text", F.when(some, full)).withColumn("words", F.when(some, F.size(F.split(F.col("full_text"), C.JS_SPACE + "+")).cast("long")))
    return d.withColumn(md, F.when(some, F.concat(F.col(md), F.lit("\n\n## Transcript\n\n"), B.render_transcript(F.col("_seg")))).otherwise(F.col(md))).drop("_seg")


