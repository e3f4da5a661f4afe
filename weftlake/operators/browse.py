"""Best-first reading of snapshots for a query: pages and links are scored in bulk, the choices replayed over few rows.

The frontier holds the seeds and at most per_page_links links of each accepted page, so that what comes to the driver is
bounded by the arguments, whatever the size of the tables; a job looks up all frontier urls not seen before.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scoring as S, text as T, urls as U
from . import page as P, track as M

STORY = "hop int, url string, title string, depth int, relevance double, publish_date string, dated array<string>, snippet string"
_DOMAIN = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")


def _terms(spark: SparkSession, query: str) -> list[str]:
    return list(spark.range(1).select(S.tokenize(F.lit(query))).first()[0])


def _key(url: str) -> str:
    return url.split("#", 1)[0].rstrip("/")


def _domain(url: str) -> str:
    m = _DOMAIN.match(url)
    return m[1].lower().removeprefix("www.") if m else ""


def read_pages(pages: DataFrame, terms: Sequence[str], as_of: str, links: int, min_prose: int = 200, cap: int = 600) -> DataFrame:
    """pages(url, html[, strategy]): a row a url with what the gates and the links of a hop need.

    The direct snapshot counts; where it is thin or shows a challenge, the first good one up the ladder does. Of a page's
    links the best `links` with a score above 0 are kept, by score, then place.
    """
    d = pages if "strategy" in pages.columns else pages.withColumn("strategy", F.lit("direct"))
    d = P.agent_extract(d.select("url", "html", "strategy"), ("links",)).withColumn("prose", T.prose(F.col("markdown")))
    d = d.withColumn("n_prose", T.len16(F.col("prose"))).withColumn("page_class", S.page_class(F.coalesce("title", F.lit("")), F.col("markdown"), F.col("captcha"), min_prose))
    via = M.reach(d.select("url", "strategy", "page_class")).where("ok").select(F.col("url").alias("_u"), "via")
    d = d.join(via, F.col("url") == F.col("_u"), "left").drop("_u")
    rank = F.when((F.col("strategy") == "direct") & ~F.col("captcha") & (F.col("n_prose") >= min_prose), 0).when(F.col("strategy") == F.col("via"), 1).when(F.col("strategy") == "direct", 2)
    scored = F.transform("links", lambda x, i: F.struct((-S.link_score(x["url"], x["text"], terms)).alias("minus"), i.alias("pos"), x["url"].alias("url"), x["text"].alias("text")))
    best = F.slice(F.array_sort(F.filter(scored, lambda x: x["minus"] < 0)), 1, links)
    d = d.select(
        "url", rank.alias("rank"), "title", "captcha", "n_prose", "publish_date",
        S.relevance(terms, T.left16(F.col("prose"), 4000), F.coalesce("title", F.lit(""))).alias("relevance"),
        S.age_days(S.parse_date(F.col("publish_date")), F.lit(as_of).cast("timestamp")).alias("days"),
        T.dated_strings(F.col("markdown")).alias("dated"), T.left16(F.col("prose"), cap).alias("snippet"), best.alias("best"),
    ).where("rank is not null")
    return d.groupBy("url").agg(F.min_by(F.struct(*[c for c in d.columns if c != "url"]), "rank").alias("x")).select("url", "x.*")


def browse(pages: DataFrame, query: str, hits: DataFrame | None = None, seed_urls: Sequence[str] = (), *, max_pages: int = 6, max_seeds: int = 3, max_depth: int = 2, per_page_links: int = 3, per_domain: int = 2, char_cap: int = 600, min_relevance: float = 0.18, max_age_days: float | None = None, hard_recency: bool = False, as_of: str = "2024-01-01", rank_links: Callable[[str, list[tuple[str, str]]], list[str]] | None = None, max_rankings: int = 4) -> tuple[DataFrame, DataFrame]:
    """(story: see STORY, skipped: url, reason). hits(ord, url) are search results, of which ranking.seeds() admits the first max_seeds.

    The url with the highest priority goes next, the earlier of equals. A page is accepted when its domain has room, no
    challenge shows, it has 200 characters of prose, the relevance is reached and (hard recency) it isn't too old. Its
    best links join the frontier with their score, half of it from a page too old. Urls without a snapshot are skipped.
    """
    from . import ranking as R

    spark = pages.sparkSession
    terms = _terms(spark, query)
    bound = len(seed_urls) + max_seeds + (max_pages + 1) * per_page_links
    frontier: list[tuple[float, int, str, int]] = []
    known: set[str] = set()

    def put(url: str, depth: int, priority: float) -> None:
        if _key(url) not in known:
            known.add(_key(url))
            frontier.append((-priority, len(known), url, depth))

    for u in seed_urls:
        if _domain(u):
            put(u, 0, 3.0)
    if hits is not None:
        for k, r in enumerate(R.seeds(hits, max_seeds).collect()):  # at most max_seeds rows
            put(r["url"], 0, 2 - k * 0.1)
    read: dict[str, object] = {}
    story, skipped, used, rankings = [], [], {}, 0
    while frontier and len(story) < max_pages:
        frontier.sort()
        url, depth = frontier[0][2:]
        if url not in read:
            new = sorted({x[2] for x in frontier} - set(read))
            names = {_key(u): u for u in new}
            found = pages.where(U.frontier_key(F.col("url")).isin(*names)).withColumn("url", U.frontier_key(F.col("url")))
            read.update(dict.fromkeys(new))
            # at most a row for each url asked for
            read.update({names[r["url"]]: r for r in read_pages(found, terms, as_of, per_page_links + bound, cap=char_cap).collect()})
        frontier.pop(0)
        site, p = _domain(url), read[url]
        if not site:
            continue
        stale = p is not None and max_age_days is not None and p["days"] is not None and p["days"] > max_age_days
        if used.get(site, 0) >= per_domain:
            skipped.append((url, "domain cap"))
        elif p is None:
            skipped.append((url, "no snapshot"))
        elif p["captcha"]:
            skipped.append((url, "captcha"))
        elif p["n_prose"] < 200:
            skipped.append((url, "thin"))
        elif p["relevance"] < min_relevance:
            skipped.append((url, "off topic"))
        elif stale and hard_recency:
            skipped.append((url, "stale"))
        else:
            used[site] = used.get(site, 0) + 1
            story.append((len(story), url, p["title"], depth, round(p["relevance"], 3), p["publish_date"], p["dated"], p["snippet"]))
            if depth < max_depth and len(story) < max_pages:
                best = [(x["url"], x["text"], -x["minus"]) for x in p["best"] if _key(x["url"]) not in known and _domain(x["url"])]
                if rank_links and best and rankings < max_rankings:
                    rankings += 1
                    place = {u: i for i, u in enumerate(rank_links(query, [b[:2] for b in best[: 2 * per_page_links]]))}
                    best.sort(key=lambda b: place.get(b[0], 99))
                for u, _, score in best[:per_page_links]:
                    put(u, depth + 1, score * (0.5 if stale else 1.0))
    return spark.createDataFrame(story, STORY), spark.createDataFrame(skipped, "url string, reason string")
