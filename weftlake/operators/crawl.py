"""Bounded traversal of a link graph held in tables, a wave at a time."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, functions as F

from ..sources.state import scratch
from . import plugins as G, ranking as R

TIERS = ("http", "jsdom", "browser")


class Crawl(NamedTuple):
    """pages (id, depth, ord), tiers (tier, n: pages read, repeated ones too, each tier with a row), errors (id, depth: urls without a page)."""

    pages: DataFrame
    tiers: DataFrame
    errors: DataFrame


def links_followed(edges: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), plugins: Sequence[G.Plugin] = ()) -> DataFrame:
    """edges(src, dst, pos; url and parent_url where the ids aren't urls): those that a crawl may follow, by globs and the plugins' filters."""
    url = F.col("url") if "url" in edges.columns else F.col("dst").cast("string")
    parent = F.col("parent_url") if "parent_url" in edges.columns else F.col("src").cast("string")
    d = R.glob_filter(edges.withColumn("_url", url), "_url", include, exclude).drop("_url")
    return d.where(G.allowed(plugins, url, parent)) if plugins else d


#: A wave's progress: urls in the frontier, pages read, of those new, urls without a page (of the whole frontier), tokens of the new pages.
PROGRESS = "frontier long, pages long, new long, failures long, tokens long, wave int"


class Waves:
    """A crawl's state in a folder, a wave for each depth: what the frontier holds, what was read of it, what was new.

    step(depth) reads the waves before it and writes its own, over what a step that failed has left, so that it can be run again.
    Where tell is set, a wave that has ended leaves a row of PROGRESS, counted while its tables are written, which progress() shows to anyone while the crawl goes on.
    """

    def __init__(self, at: str, pages: DataFrame, edges: DataFrame, max_pages: int = 50, max_depth: int = 10, include: Sequence[str] = (), exclude: Sequence[str] = (), plugins: Sequence[G.Plugin] = (), tell: bool = False):
        self.tell = tell
        self.at, self.spark, self.max_pages, self.max_depth = at, pages.sparkSession, max_pages, max_depth
        kind = pages.schema["id"].dataType.simpleString()
        tier = F.col("tier") if "tier" in pages.columns else F.lit(None).cast("string")
        tokens = F.col("tokens") if "tokens" in pages.columns else F.lit(None)
        self.pages = pages.select("id", F.col("content_hash").cast("string").alias("content_hash"), tier.alias("tier"), tokens.cast("long").alias("tokens"))
        self.edges = links_followed(edges, include, exclude, plugins).select("src", "dst", "pos")
        self.first = f"id {kind}, ord long"
        self.schemas = {"wave": f"id {kind}, ord long, depth int", "read": f"id {kind}, ord long, content_hash string, tier string, tokens long, depth int"}
        self.schemas["new"] = self.schemas["read"]

    def _put(self, df: DataFrame, name: str, depth: int) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.at}/{name}/depth={depth}")
        return self._of(name, depth)

    def _of(self, name: str, depth: int) -> DataFrame:
        return self.spark.read.schema(self.schemas[name]).option("basePath", f"{self.at}/{name}").parquet(f"{self.at}/{name}/depth={depth}")

    def every(self, name: str, upto: int | None = None) -> DataFrame:
        df = self.spark.read.schema(self.schemas[name]).parquet(f"{self.at}/{name}")
        return df if upto is None else df.where(F.col("depth") <= upto)

    def start(self, seed) -> None:
        self._put(self.spark.createDataFrame([(seed, 0)], self.first), "wave", 0)

    def step(self, depth: int, used: int | None = None) -> int:
        """Reads the wave of a depth, `used` pages of the budget being spent (counted where not given), and writes the next one; pages read, negative where the crawl ends here."""
        if used is None:
            used = self.every("read", depth - 1).count() if depth else 0
        wave, seen, read, fresh = self._of("wave", depth).drop("depth"), Observation(), Observation(), Observation()
        here = wave.join(self.pages.withColumn("there", F.lit(True)), "id", "left" if self.tell else "inner")
        if self.tell:
            here = here.observe(seen, F.count("*").alias("frontier"), F.count_if(F.col("there").isNull()).alias("failures"))
        got = here.where("there").orderBy("ord").limit(self.max_pages - used).select("id", "ord", "content_hash", "tier", "tokens")
        got = self._put(got.observe(read, F.count("*").alias("n")), "read", depth)
        n = read.get["n"]
        new = got.join(got.groupBy("content_hash").agg(F.min("ord").alias("ord")), ["content_hash", "ord"], "left_semi")
        if depth:
            new = new.join(self.every("new", depth - 1).select("content_hash"), "content_hash", "left_anti")
        new = new.select("id", "ord", "content_hash", "tier", "tokens").observe(fresh, F.count("*").alias("new"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
        new = self._put(new, "new", depth)
        if self.tell:
            told = seen.get | fresh.get
            row = [(told["frontier"], n, told["new"], told["failures"], told["tokens"])]
            self.spark.createDataFrame(row, PROGRESS.rpartition(",")[0]).coalesce(1).write.mode("overwrite").parquet(f"{self.at}/progress/wave={depth}")
        if not n or used + n >= self.max_pages or depth >= self.max_depth:
            return -n - 1
        found = self.edges.join(new.select(F.col("id").alias("src"), F.col("ord").alias("parent")), "src")
        found = found.groupBy(F.col("dst").alias("id")).agg(F.min(F.struct("parent", "pos")).alias("at")).join(self.every("wave", depth).select("id"), "id", "left_anti")
        self._put(found.orderBy("at").select("id", F.monotonically_increasing_id().alias("ord")), "wave", depth + 1)
        return n

    def progress(self) -> DataFrame:
        """A row of PROGRESS for each wave that has ended."""
        return self.spark.read.schema(PROGRESS).parquet(f"{self.at}/progress")

    def result(self) -> Crawl:
        none = self.spark.createDataFrame([(t, 0) for t in TIERS], "tier string, n long")
        tiers = self.every("read").groupBy("tier").agg(F.count("*").alias("n")).union(none).groupBy("tier").agg(F.sum("n").alias("n"))
        return Crawl(self.every("new").select("id", "depth", "ord"), tiers, self.every("wave").join(self.pages.select("id"), "id", "left_anti").select("id", "depth"))


def crawl_report(pages: DataFrame, edges: DataFrame, seed, max_pages: int = 50, max_depth: int = 10, include: Sequence[str] = (), exclude: Sequence[str] = (), plugins: Sequence[G.Plugin] = ()) -> Crawl:
    """pages(id, content_hash; tier if there), edges (see links_followed).

    A wave is the whole frontier of one depth, cut to what the budget leaves, in the order of (parent's place, pos).
    Pages that repeat a content hash use budget, aren't yielded, and aren't followed; ids without a page use none and are
    reported. content_hash should tell contents apart whatever their number (text.content_key does). The seed is read
    whatever the globs say. Waves, ids seen and hashes are appended to folders in the shared one, so that plans don't grow
    from wave to wave; places are numbered by range, so that no task orders a whole frontier.
    """
    w = Waves(scratch(pages.sparkSession, "crawl"), pages, edges, max_pages, max_depth, include, exclude, plugins)
    w.start(seed)
    used = depth = 0
    while (n := w.step(depth, used)) >= 0:
        used, depth = used + n, depth + 1
    return w.result()


def crawl(pages: DataFrame, edges: DataFrame, seed, max_pages: int = 50, max_depth: int = 10, include: Sequence[str] = (), exclude: Sequence[str] = (), plugins: Sequence[G.Plugin] = ()) -> DataFrame:
    """The pages yielded by crawl_report, (id, depth, ord)."""
    return crawl_report(pages, edges, seed, max_pages, max_depth, include, exclude, plugins).pages


def merge_urls(listed: DataFrame, crawled: DataFrame, max_urls: int) -> DataFrame:
    """listed(url, ord) first, then crawled(url, ord) urls that aren't listed, up to max_urls."""
    both = listed.select("url", F.struct(F.lit(0).alias("src"), F.lit(0).alias("depth"), F.col("ord").alias("ord")).alias("at"))
    depth = F.col("depth") if "depth" in crawled.columns else F.lit(0)
    both = both.union(crawled.select("url", F.struct(F.lit(1).alias("src"), depth.alias("depth"), F.col("ord").alias("ord")).alias("at")))
    return both.groupBy("url").agg(F.min("at").alias("at")).orderBy("at").limit(max_urls).select("url")


def map_site(listed: DataFrame, max_urls: int, pages: DataFrame, edges: DataFrame, seed: str) -> DataFrame:
    """listed(url, ord), a site map's urls; where they are fewer than max_urls, a crawl of pages and edges (ids are urls) from the seed, three deep, fills up."""
    first = listed.orderBy("ord").limit(max_urls)
    n = first.count()
    if n >= max_urls:
        return first.select("url")
    return merge_urls(first, crawl(pages, edges, seed, max_urls - n, 3).select(F.col("id").alias("url"), "depth", "ord"), max_urls)
