"""Command line over snapshot tables: scrape, crawl, map and search. Tables are Parquet; results are printed as JSON lines or written."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import api


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="python -m weftlake", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, table: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=text)
        c.add_argument(table, help=f"Parquet table of {table}")
        c.add_argument("-o", "--output", help="folder to write to; printed where left out")
        return c

    c = command("scrape", "page records of urls (all, where none is named)", "pages")
    c.add_argument("urls", nargs="*")
    c.add_argument("-f", "--format", choices=("markdown", "html", "text", "json"), default="markdown")
    c.add_argument("--chunk", type=int, help="tokens a chunk")
    c.add_argument("--overlap", type=int, default=0)
    c = command("crawl", "pages reached from a url by inner links", "pages")
    c.add_argument("url")
    c.add_argument("-n", "--max-pages", type=int, default=50)
    c.add_argument("-d", "--max-depth", type=int, default=10)
    c.add_argument("--include", action="append", default=[])
    c.add_argument("--exclude", action="append", default=[])
    c = command("map", "a site's urls", "pages")
    c.add_argument("url")
    c.add_argument("-n", "--max-urls", type=int, default=100)
    c.add_argument("--sitemap", help="Parquet table with an xml column")
    c = command("search", "fused results of result pages (query, engine, html)", "results")
    c.add_argument("query")
    c.add_argument("-n", "--max-results", type=int, default=10)
    return p


def run(spark: SparkSession, argv: list[str]) -> DataFrame:
    """The rows that a command line asks for."""
    a = _parser().parse_args(argv)
    if a.command == "search":
        return api.search(spark.read.parquet(a.results).where(F.col("query") == a.query), a.max_results)
    pages = spark.read.parquet(a.pages)
    if a.command == "scrape":
        asked = pages.where(F.col("url").isin(*a.urls)) if a.urls else pages
        d = api.scrape(asked.select("url"), pages.select("url", "html"), chunk_tokens=a.chunk, overlap=a.overlap).records
        if a.output and a.format != "json":
            d = d.join(pages.select("url", "html"), "url") if a.format == "html" else d
        return d
    if a.command == "crawl":
        return api.crawl_site(pages, a.url, a.max_pages, a.max_depth, a.include, a.exclude).pages
    return api.map_site(pages, a.url, a.max_urls, spark.read.parquet(a.sitemap) if a.sitemap else None)


def main(argv: list[str] | None = None) -> None:
    argv = sys.argv[1:] if argv is None else argv
    a = _parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"weftlake {a.command}").getOrCreate()
    d = run(spark, argv)
    if not a.output:
        for row in api.as_json(d).toLocalIterator():
            print(row["json"])
    elif a.command == "scrape":
        api.write_results(d, a.output, a.format)
    else:
        d.write.json(a.output)


if __name__ == "__main__":
    main()
