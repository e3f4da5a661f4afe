"""Whole jobs over page snapshots: scraping with a cache, pacing, plugins and chunks in one call, and crawling pages by their own links."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T, urls as U
from ..sources import state as A
from ..sources.feeds import sitemap_urls
from . import chunk as K, crawl as X, page as P, plugins as G


class Scraped(NamedTuple):
    """records: a row a distinct url that was found; missing (url): asked for, without a snapshot."""

    records: DataFrame
    missing: DataFrame


def scrape(requests: DataFrame, snapshots: DataFrame, cache: DataFrame | None = None, as_of: Column | None = None, ttl_seconds: int = 3600, per_second: float | None = None, chunk_tokens: int | None = None, overlap: int = 0, plugins: Sequence[G.Plugin] = ()) -> Scraped:
    """requests(url) answered from cache(url, fetched_at, ...records' columns) while fresh, else from snapshots(url, html).

    Records have the page's columns (see page.scrape), extracted (plugins), from_cache, chunks if chunk_tokens is given, and host
    and at, the second from which each fetched url may go, if per_second is. Fetched urls are numbered by a hash, since a table has
    no order. Null urls are not asked for; repeated ones are asked for once.
    """
    asked = requests.select("url").where("url is not null").distinct()
    known = None
    if cache is not None:
        answered = A.lookup(asked, cache, as_of if as_of is not None else F.current_timestamp(), ttl_seconds)
        known = answered.where("from_cache").drop("fetched_at")
        asked = answered.where("not from_cache").select("url")
    missing = asked.join(snapshots.select("url"), "url", "left_anti")
    d = G.scrape(asked, snapshots, plugins)
    if chunk_tokens is not None:
        d = K.chunk(d, chunk_tokens, overlap)
    d = d.withColumn("from_cache", F.lit(False))
    if known is not None:
        d = d.unionByName(known, allowMissingColumns=True)
    if per_second is not None:
        go = A.pace(d.where("not from_cache").select("url", F.xxhash64("url").alias("ord")), per_second).select(F.col("url").alias("_u"), "host", "at")
        d = d.join(go, F.col("url") == F.col("_u"), "left").drop("_u")
    return Scraped(d, missing)


def site_tables(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pages(url, html; tier if there) as crawl's tables, one parse a page: pages (id, content_hash, tier, url), edges (src, dst, pos, url, parent_url) of inner links.

    Ids are urls without hash and trailing slashes; of several pages of one id the first url counts. Content is told apart by 256 bits.
    What was parsed is written, as a crawl reads both tables in each of its waves.
    """
    tier = F.col("tier") if "tier" in pages.columns else F.lit("http")
    d = P.parse(pages.select("url", tier.alias("tier"), "html").where("url is not null"), ("links", "markdown"))
    d = d.select(U.frontier_key(F.col("url")).alias("id"), "url", "tier", T.content_key(F.col("markdown")).alias("content_hash"), "links")
    d = d.groupBy("id").agg(F.min_by(F.struct("url", "tier", "content_hash", "links"), "url").alias("x")).select("id", "x.*")
    d = A.settle(d, "site")
    edges = d.select(F.col("id").alias("src"), F.col("url").alias("parent_url"), F.posexplode("links").alias("pos", "x")).where("x.is_internal")
    edges = edges.select("src", U.frontier_key(F.col("x.url")).alias("dst"), "pos", F.col("x.url").alias("url"), "parent_url")
    return d.select("id", "content_hash", "tier", "url"), edges


def crawl_site(pages: DataFrame, url: str, max_pages: int = 50, max_depth: int = 10, include: Sequence[str] = (), exclude: Sequence[str] = (), plugins: Sequence[G.Plugin] = ()) -> X.Crawl:
    """A crawl of pages(url, html) by their own links from url: Crawl(pages with their url, tiers, errors)."""
    nodes, edges = site_tables(pages)
    seed = url.split("#", 1)[0].rstrip("/")
    c = X.crawl_report(nodes, edges, seed, max_pages, max_depth, include, exclude, plugins)
    return X.Crawl(c.pages.join(nodes.select("id", "url"), "id"), c.tiers, c.errors)


def map_site(pages: DataFrame, url: str, max_urls: int = 100, sitemap: DataFrame | None = None) -> DataFrame:
    """(url): the site map's addresses (sitemap(xml)), in their order, filled up by a crawl where they are few."""
    if sitemap is None:
        listed = pages.sparkSession.createDataFrame([], "url string, ord long")
    else:
        listed = sitemap.select(F.posexplode(sitemap_urls(F.col("xml"))).alias("ord", "url")).select("url", F.col("ord").cast("long").alias("ord"))
    nodes, edges = site_tables(pages)
    return X.map_site(listed, max_urls, nodes, edges, url.split("#", 1)[0].rstrip("/"))
