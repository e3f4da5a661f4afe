"""Sitemaps, feeds, day pages, captions and embedded JSON read from snapshot columns with native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import constants as C
from ..functions.text import squeeze
from ..functions.urls import item_key


def sitemap_urls(xml: Column) -> Column:
    return F.regexp_extract_all(xml, F.lit("(?i)<loc>(.*?)</loc>"), F.lit(1))


def _tag(block: Column, name: str) -> Column:
    """The text of the block's first such element, without CDATA marks and markup; null where there is none."""
    inside = F.regexp_extract(block, rf"(?is)<{name}[^>]*>(.*?)</{name}>", 1)
    t = F.regexp_replace(F.regexp_replace(inside, r"<!\[CDATA\[|\]\]>", ""), "<[^>]+>", "")
    return F.when(F.rlike(block, F.lit(rf"(?is)<{name}[^>]*>.*?</{name}>")), F.regexp_replace(t, f"^{C.JS_SPACE}+|{C.JS_SPACE}+$", ""))


def feed_items(feeds: DataFrame, per_feed: int = 12) -> DataFrame:
    """feeds(feed, xml): (feed, ord, title, url, date) of the first per_feed items with a title and an http url."""
    some = lambda c: F.nullif(c, F.lit(""))
    b = feeds.select("feed", F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?is)<(?:item|entry).*?</(?:item|entry)>"), F.lit(0))).alias("pos", "b"))
    atom = some(F.regexp_extract("b", r"""(?i)<link[^>]*href=["']([^"']+)["']""", 1))
    url = F.trim(F.regexp_replace(F.coalesce(atom, some(_tag(F.col("b"), "link")), F.lit("")), r"<!\[CDATA\[|\]\]>", ""))
    date = F.coalesce(*[some(_tag(F.col("b"), t)) for t in ("pubDate", "published", "updated", "dc:date")])
    d = b.select("feed", "pos", _tag(F.col("b"), "title").alias("title"), url.alias("url"), date.alias("date"))
    d = d.where((F.col("title") != "") & F.startswith("url", F.lit("http")))
    d = d.withColumn("ord", F.row_number().over(Window.partitionBy("feed").orderBy("pos")) - 1)
    return d.where(F.col("ord") < per_feed).select("feed", "ord", "title", "url", "date")


def first_of_key(items: DataFrame, *order: str) -> DataFrame:
    """Items (url, ...) once for each url without query and hash; the first by order wins."""
    d = items.withColumn("key", item_key(F.col("url")))
    first = d.groupBy("key").agg(F.min(F.struct(*order)).alias("_f"))
    return d.join(first.select(F.col("key").alias("_k"), "_f"), (F.col("key") == F.col("_k")) & (F.struct(*order) == F.col("_f"))).drop("_k", "_f")


def day_pages(spark, days: int, today: str) -> DataFrame:
    """(ord, date, page) of the last days, newest first."""
    return page_names(spark.range(days).select(F.col("id").alias("ord"), F.date_sub(F.lit(today).cast("date"), F.col("id").cast("int")).alias("day"))).select("ord", "date", "page")


def page_names(days: DataFrame, day: str = "day") -> DataFrame:
    """days(day date, ...) with date and page, the name of the portal's page of that day."""
    d = F.col(day)
    return days.withColumn("date", F.date_format(d, "yyyy-MM-dd")).withColumn("page", F.concat(F.lit("Portal:Current_events/"), F.year(d), F.lit("_"), F.date_format(d, "MMMM"), F.lit("_"), F.dayofmonth(d)))


def day_events(days: DataFrame) -> DataFrame:
    """days(date, markdown): (date, category, pos, text), the lines of each category's block, in the order of the blocks."""
    low = F.lower("markdown")
    found = F.filter(F.array(*[F.struct(F.instr(low, c.lower()).alias("i"), F.lit(c).alias("category")) for c in C.CATEGORIES]), lambda x: x["i"] > 0)
    d = days.withColumn("found", F.sort_array(found))
    ends = F.concat(F.transform(F.slice("found", 2, F.greatest(F.size("found"), F.lit(1))), lambda x: x["i"]), F.array(F.length("markdown") + 1))
    d = d.withColumn("blocks", F.zip_with("found", ends, lambda x, e: F.struct(x["category"].alias("category"), x["i"].alias("i"), e.alias("e")))).where(F.size("found") > 0)
    d = d.select("date", "markdown", F.posexplode("blocks").alias("k", "b"))
    block = F.substring("markdown", F.col("b.i") + F.length("b.category"), F.greatest(F.col("b.e") - F.col("b.i") - F.length("b.category"), F.lit(0)))
    lines = F.transform(F.split(block, r"\n|(?: - )", -1), lambda s: squeeze(F.regexp_replace(F.regexp_replace(s, r"\*\*", ""), r"\[([^\]]+)\]\([^)]*\)", "$1")))
    kept = F.filter(lines, lambda s: (F.length(s) > 12) & (F.length(s) < 400) & F.rlike(s, F.lit("[A-Za-z0-9_]")))
    return d.select("date", F.col("b.category").alias("category"), "k", F.posexplode(kept).alias("pos", "text"))


def dedup_events(events_: DataFrame, cap: int = 60, category: str | None = None) -> DataFrame:
    """events_(category, text, date, ord): each text of a category once, with its oldest date; the cap newest dates, first seen first."""
    if category:
        events_ = events_.where(F.contains(F.lower("category"), F.lit(category.lower())))
    g = events_.groupBy("category", "text").agg(F.min("date").alias("date"), F.min("ord").alias("ord"))
    w = Window.partitionBy("category").orderBy(F.desc("date"), "ord")
    return g.withColumn("place", F.row_number().over(w)).where(F.col("place") <= cap)


def captions(xml: Column) -> Column:
    """array<struct<start, duration, text>> of caption XML; empty texts go."""
    body = r'(?s)<text start="([\d.]+)" dur="([\d.]+)"[^>]*>(.*?)</text>'
    t = F.regexp_extract_all(xml, F.lit(body), F.lit(0))

    def plain(x):
        c = F.regexp_extract(x, body, 3)
        for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("&quot;", '"')):
            c = F.replace(c, F.lit(a), F.lit(b))
        return F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), f"^{C.JS_SPACE}+|{C.JS_SPACE}+$", "")

    segs = F.transform(t, lambda x: F.struct(F.regexp_extract(x, body, 1).cast("double").alias("start"), F.regexp_extract(x, body, 2).cast("double").alias("duration"), plain(x).alias("text")))
    return F.filter(segs, lambda s: s["text"] != "")


def render_transcript(segments: Column) -> Column:
    stamp = lambda s: F.format_string("**[%d:%02d]** %s", F.floor(s["start"] / 60), F.floor(F.pmod(s["start"], F.lit(60.0))), s["text"])
    return F.array_join(F.transform(segments, stamp), "\n")


def duration(seconds: Column) -> Column:
    h, m, s = F.floor(seconds / 3600), F.floor(F.pmod(seconds, F.lit(3600)) / 60), F.pmod(seconds, F.lit(60))
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def views(n: Column) -> Column:
    c = F.when(n >= 1_000_000_000, F.concat(F.format_string("%.1f", n / 1e9), F.lit("B"))).when(n >= 1_000_000, F.concat(F.format_string("%.1f", n / 1e6), F.lit("M")))
    return c.when(n >= 1_000, F.concat(F.format_string("%.1f", n / 1e3), F.lit("K"))).otherwise(n.cast("string"))
