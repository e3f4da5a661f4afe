"""State tables between runs, result tables and files, a result cache with an age limit, and per-host pacing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import constants as C, urls as U

MENTIONS = "entity string, url_key string, title string, url string, source string, first_seen string"
_WATCH = "name string, type string, aliases array<string>, domains array<string>"
PART = 65536


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder's path in the shared folder (spark.checkpoint.dir); a local one where that is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: driver and executors share no folder")
        base = f"file://{tempfile.gettempdir()}/checkpoints/weftlake"
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def settle(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read again, where several parts of a plan would work it out again."""
    at = scratch(df.sparkSession, tag)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def _there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_state(spark: SparkSession, path: str, schema: str = MENTIONS, upto: int | None = None) -> DataFrame:
    """The newest version of a state table (of those up to a number, where one is given), empty where there is none."""
    found = spark.read.schema(f"{schema}, version long").parquet(path) if _there(spark, path) else None
    if found is not None and upto is not None:
        found = found.where(F.col("version") <= upto)
    last = found.agg(F.max("version")).first()[0] if found is not None else None
    if last is None:
        return spark.createDataFrame([], schema)
    return found.where(F.col("version") == last).drop("version")


def write_state(state: DataFrame, path: str, version: int | None = None) -> None:
    """Adds a version beside the one that is read, so that a run can read, prune and write one table; earlier ones stay until removed.

    A numbered version replaces what a run that failed has left of it.
    """
    spark = state.sparkSession
    if version is not None:
        state.write.mode("overwrite").parquet(f"{path}/version={version}")
        return
    last = spark.read.parquet(path).agg(F.max("version")).first()[0] if _there(spark, path) else None
    state.write.mode("errorifexists").parquet(f"{path}/version={0 if last is None else last + 1}")


def written(spark: SparkSession, path: str) -> bool:
    """Whether a table's folder was written to its end."""
    return _there(spark, f"{path}/_SUCCESS")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if it is there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def watchlist(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(name, type, aliases, domains) as stored, the default entities where nothing is."""
    stored = read_state(spark, path, _WATCH) if path else spark.createDataFrame([], _WATCH)
    return stored if not stored.isEmpty() else spark.createDataFrame([(n, t, list(a), list(d)) for n, t, a, d in C.WATCHLIST], _WATCH)


def append_log(row: DataFrame, path: str) -> None:
    """Adds rows to a log of JSON lines."""
    row.write.mode("append").json(path)


def as_json(df: DataFrame) -> DataFrame:
    """(json): each row as a JSON object."""
    return df.select(F.to_json(F.struct("*")).alias("json"))


def write_results(pages: DataFrame, path: str, form: str = "markdown", more: Sequence[str] = ()) -> None:
    """Page records as one of markdown, html, text (parquet of url, file_name, content and the columns named by `more`) or json (lines)."""
    if form == "json":
        pages.write.json(path)
        return
    content = {"markdown": "markdown", "html": "html", "text": "text"}[form]
    pages.select("url", U.file_name(F.col("url")).alias("file_name"), F.col(content).alias("content"), *more).write.parquet(path)


def lookup(urls: DataFrame, cache: DataFrame, as_of, ttl_seconds: int = 3600) -> DataFrame:
    """urls(url, ...) with the cache's columns (url, fetched_at, ...) and from_cache; entries older than the limit don't count."""
    fresh = cache.where(F.unix_micros(as_of) - F.unix_micros("fetched_at") <= ttl_seconds * 1_000_000)
    last = fresh.groupBy(F.col("url").alias("_u")).agg(F.max_by(F.struct(*[c for c in cache.columns if c != "url"]), "fetched_at").alias("_c"))
    d = urls.join(last, F.col("url") == F.col("_u"), "left")
    return d.select(*urls.columns, "_c.*", F.col("_c").isNotNull().alias("from_cache"))


def evict(cache: DataFrame, max_size: int) -> DataFrame:
    """cache(seq long, size long, ...): what first-in-first-out eviction at max_size leaves, the newest entry in any case.

    That is the longest run of newest entries within the size. Sums by block of seq find the block where it starts, so
    no task orders more than one block of distinct seq.
    """
    block = F.floor(F.col("seq") / PART)
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    sums = cache.groupBy(block.alias("block")).agg(F.sum("size").alias("n")).withColumn("later", F.coalesce(F.sum("n").over(after), F.lit(0)))
    newest = cache.agg(F.max("seq").alias("newest"))
    d = cache.withColumn("_b", block).join(sums.where(F.col("later") <= max_size).select(F.col("block").alias("_k"), "later"), F.col("_b") == F.col("_k")).drop("_k")
    within = F.sum("size").over(Window.partitionBy("_b").orderBy(F.desc("seq"))) + F.col("later")
    d = d.withColumn("_sum", within).join(F.broadcast(newest))  # one row
    return d.where((F.col("_sum") <= max_size) | (F.col("seq") == F.col("newest"))).select(*cache.columns)


def pace(requests: DataFrame, per_second: float = 2.0, url: str = "url") -> DataFrame:
    """requests(ord long, distinct; url, ...): adds host and at, the second (from 0) from which a host's next request may go.

    A host's requests are numbered by ord in blocks of PART, and the blocks' counts give each block its start: a host with
    a third of all rows is never ordered in one task.
    """
    d = requests.withColumn("host", U.host(F.col(url))).withColumn("_b", F.floor(F.col("ord") / PART))
    n = d.groupBy(F.col("host").alias("_h"), F.col("_b").alias("_k")).agg(F.count("*").alias("n"))
    n = n.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("_h").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    d = d.join(n, F.col("host").eqNullSafe(F.col("_h")) & (F.col("_b") == F.col("_k")))
    place = F.row_number().over(Window.partitionBy("host", "_b").orderBy("ord")) - 1 + F.col("before")
    return d.withColumn("at", place / F.lit(float(per_second))).select(*requests.columns, "host", "at")


def rotate(requests: DataFrame, proxies: Sequence[str]) -> DataFrame:
    """requests(ord long, ...) with one of the proxies in turn."""
    return requests.withColumn("proxy", F.element_at(F.array(*map(F.lit, proxies)), (F.pmod("ord", F.lit(len(proxies))) + 1).cast("int")))
