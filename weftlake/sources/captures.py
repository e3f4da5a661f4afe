"""Archived responses: a table of captures with status and headers, laid out by host, and fetching from it with redirects followed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import urls as U
from ..operators import page as P
from .state import scratch

SCHEMA = "url string, fetched_at timestamp, status int, headers map<string,string>, html string"
BUCKETS, MAX_REDIRECTS = 64, 20
REDIRECTS = (301, 302, 303, 307, 308)


def bucket(host: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(host, F.lit(""))), F.lit(buckets)).cast("int")


def write(captures: DataFrame, path: str, buckets: int = BUCKETS, mode: str = "append") -> None:
    """Adds captures (SCHEMA) to an archive: a folder for each bucket of hosts, sorted by host in it, so that a reader of few hosts skips folders and row groups.

    A large bucket is several files: rows are dealt by bucket and url, so a host with a third of all captures doesn't meet in one task. Header names are
    kept in lower case.
    """
    lower = F.transform_keys(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, v: F.lower(k))
    d = captures.select("url", "fetched_at", F.col("status").cast("int").alias("status"), lower.alias("headers"), "html")
    d = d.withColumn("host", U.host(F.col("url"))).withColumn("bucket", bucket(F.col("host"), buckets))
    d = d.repartition(F.col("bucket"), F.pmod(F.xxhash64("url"), F.lit(16))).sortWithinPartitions("bucket", "host", "url")
    d.write.mode(mode).partitionBy("bucket").parquet(path)


def read(spark: SparkSession, path: str, hosts: Sequence[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """An archive's captures; of some hosts, where they are given: the scan lists their buckets' folders only and pushes the hosts down."""
    d = spark.read.schema(f"{SCHEMA}, host string, bucket int").parquet(path)
    if hosts is not None:
        wanted = spark.range(1).select(F.array_distinct(F.transform(F.array(*map(F.lit, hosts)).cast("array<string>"), lambda h: bucket(h, buckets))).alias("b")).first()["b"]
        d = d.where(F.col("bucket").isin(*wanted) & F.col("host").isin(*hosts)) if hosts else d.where(F.lit(False))
    return d.drop("bucket")


def fetch(requests: DataFrame, captures: DataFrame, as_of: Column | None = None, max_redirects: int = MAX_REDIRECTS) -> DataFrame:
    """requests(url, ...) with status, headers, html, final_url, hops and error, as a fetch at a time (now: any capture) would answer.

    The last capture of a url up to as_of counts. A redirect with a location is followed, the location resolved against its url by the standard; any other status
    is an answer, errors of the server included. error tells why there is none: `missing` (no capture), `redirects` (more than max_redirects of them,
    a circle among these), `location` (one that is no url); status and html are null then. Repeated requests are answered alike; a null url is missing. Each hop is a
    join of the urls still on their way, written, and ends when none is. Hops carry no html: it is read from the captures for the answers, and only where it is asked for.
    """
    spark = requests.sparkSession
    at = scratch(spark, "fetch")
    known = captures if as_of is None else captures.where(F.col("fetched_at") <= as_of)
    last = _last(known, f"{at}/last")
    steps = last.select(F.col("url").alias("_u"), "status", F.when(F.col("status").isin(*REDIRECTS), F.col("headers")["location"]).alias("_to"))
    way = requests.select(F.col("url").alias("asked")).distinct().select("asked", F.col("asked").alias("url"), F.lit(0).alias("hops"))
    for hop in range(max_redirects + 2):
        d = way.join(steps, way["url"] == steps["_u"], "left").drop("_u")
        d = P.resolve(d, "_to", "url", "_next")
        ends = F.when(F.col("status").isNull(), "missing").when(F.col("_to").isNull(), "").when(F.col("_next").isNull(), "location").when(F.lit(hop >= max_redirects), "redirects")
        d = d.select("asked", "url", "hops", F.col("_next.href").alias("_next"), ends.alias("error"))
        d.write.parquet(f"{at}/hop={hop}")
        d = spark.read.schema(d.schema).parquet(f"{at}/hop={hop}")
        way = d.where("error is null").select("asked", F.col("_next").alias("url"), (F.col("hops") + 1).alias("hops"))
        if way.isEmpty():
            break
    got = spark.read.schema(d.schema).parquet(*[f"{at}/hop={k}" for k in range(hop + 1)]).where("error is not null")
    got = got.select("asked", F.col("url").alias("final_url"), "hops", F.nullif("error", F.lit("")).alias("error"), F.when(F.col("error") == "", F.col("url")).alias("_u"))
    # a url a row: the optimizer leaves this join out where no html is asked for
    pages = known.groupBy(F.col("url").alias("_p")).agg(F.min_by("html", F.struct(*_newest(), "html")).alias("html"))
    got = got.join(last.select(F.col("url").alias("_l"), "status", "headers"), F.col("_u") == F.col("_l"), "left").join(pages, F.col("_u") == F.col("_p"), "left")
    got = got.select("asked", "final_url", "hops", "status", "headers", "html", "error")
    return requests.join(got, requests["url"].eqNullSafe(got["asked"]), "left").drop("asked")


def _newest() -> list[Column]:
    """The order of a url's captures, the last one first; html decides between those that are alike in it."""
    return [F.col("fetched_at").isNull().alias("_none"), (-F.unix_micros("fetched_at")).alias("_ago"), F.col("status").alias("_status")]


def _last(known: DataFrame, at: str) -> DataFrame:
    """Each url's last capture (url, status, headers), written: found without html but for the urls whose last ones are alike in time and status."""
    spark = known.sparkSession
    newest = Window.partitionBy("url").orderBy(*_newest())
    first = known.select("url", "fetched_at", "status", "headers").withColumn("_k", F.rank().over(newest)).where("_k = 1")
    first = first.withColumn("_same", F.count("*").over(Window.partitionBy("url"))).drop("_k")
    first.write.parquet(f"{at}/first")
    first = spark.read.schema(first.schema).parquet(f"{at}/first")
    last, same = first.where("_same = 1").select("url", "status", "headers"), first.where("_same > 1").select("url").distinct()
    if same.isEmpty():
        return last
    told = known.join(same, "url", "left_semi").withColumn("_k", F.row_number().over(Window.partitionBy("url").orderBy(*_newest(), "html"))).where("_k = 1")
    told.select("url", "status", "headers").write.parquet(f"{at}/told")
    return last.unionByName(spark.read.schema(last.schema).parquet(f"{at}/told"))
