"""User hooks around the page record: each a DataFrame or Column function, applied in the order of the list."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from . import page as P


@dataclass(frozen=True)
class Plugin:
    """name and hooks; what is None is left out.

    before_fetch: requests to requests (a row that it drops is not read); after_fetch: pages to pages; before_process: the
    html column and the url to html; after_process: records to records; extract: a map<string,string> column of a record,
    whose keys a later plugin's overwrite; filter_url: (url, parent url) to a boolean, all of which must hold.
    """

    name: str
    before_fetch: Callable[[DataFrame], DataFrame] | None = None
    after_fetch: Callable[[DataFrame], DataFrame] | None = None
    before_process: Callable[[Column, Column], Column] | None = None
    after_process: Callable[[DataFrame], DataFrame] | None = None
    extract: Callable[[], Column] | None = None
    filter_url: Callable[[Column, Column], Column] | None = None


def allowed(plugins: Sequence[Plugin], url: Column, parent: Column) -> Column:
    ok = F.lit(True)
    for p in plugins:
        if p.filter_url:
            ok = ok & F.coalesce(p.filter_url(url, parent), F.lit(False))
    return ok


def extracted(plugins: Sequence[Plugin]) -> Column:
    """One map of all plugins' extracts; of equal keys the later plugin's value stands, nulls among the maps count as empty."""
    out = F.create_map().cast("map<string,string>")
    for p in plugins:
        if p.extract:
            new = F.coalesce(p.extract(), F.create_map().cast("map<string,string>"))
            # keys of the new map leave the old one first, so that keys never meet
            out = F.map_concat(_without(out, new), new)
    return out


def _without(old: Column, new: Column) -> Column:
    return F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))


def scrape(requests: DataFrame, snapshots: DataFrame, plugins: Sequence[Plugin] = (), on: Sequence[str] = ("url",)) -> DataFrame:
    """requests(url) read from snapshots(url, html, ...): the page records with `extracted`, all hooks applied.

    Several snapshots of an asked url are read all; `on` names further columns of both sides that tell them apart.
    Metadata and markdown see the html after before_process; html tokens and links that before it.
    """
    for p in plugins:
        requests = p.before_fetch(requests) if p.before_fetch else requests
    pages = snapshots.join(requests.select(*on).distinct(), list(on), "left_semi")
    for p in plugins:
        pages = p.after_fetch(pages) if p.after_fetch else pages
    if any(p.before_process for p in plugins):
        new = F.col("html")
        for p in plugins:
            new = p.before_process(new, F.col("url")) if p.before_process else new
        # the raw page's links and tokens, then the rest from the rewritten one
        raw = P.parse(pages.withColumn("_new", new).withColumn("html_tokens", T.token_estimate(F.coalesce("html", F.lit("")))), ("links",))
        d = P.finish(P.parse(raw.withColumnRenamed("_new", "html"), ("meta", "markdown")))
    else:
        d = P.scrape(pages)
    d = d.withColumn("extracted", extracted(plugins))
    for p in plugins:
        d = p.after_process(d) if p.after_process else d
    return d
