"""The tracker as a stream: each micro-batch is a run on versioned state, so that a run which is played again changes nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import constants as C
from ..operators import track as T
from ..sources import state as S

NEW = "entity string, url_key string, title string, url string, source string, first_seen string"
RUNS = "entity string, n_new long, total_known long, run long, ran_at timestamp"
#: Versions of the state that stay: the one that a run reads, for as long as it can be played again, and the one that it writes.
KEPT = 2


def run(batch: DataFrame, number: int, watchlist: Sequence[tuple[str, Sequence[str]]], path: str, days: int = C.PRUNE_DAYS) -> None:
    """One run over batch(title, snippet, url, source, ord, seen timestamp), as of the batch's latest `seen`; an empty batch is no run.

    What earlier runs know is the newest version up to `number`; the run writes its new mentions, its counts, and at last the version
    number + 1. A batch whose version is there has been run; one that failed on its way finds the state that it began with.
    """
    spark = batch.sparkSession
    state_path, version = f"{path}/state", number + 1
    if S.written(spark, f"{state_path}/version={version}"):
        return
    now = batch.agg(F.date_format(F.max("seen"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("now")).first()["now"]
    if now is None:
        return
    state = S.read_state(spark, state_path, upto=number)
    new = T.new_mentions(T.mentions(batch.drop("seen"), watchlist), state)
    new.select("entity", "url_key", "title", "url", "source", F.lit(now).alias("first_seen")).write.mode("overwrite").parquet(f"{path}/new/run={number}")
    new = spark.read.schema(NEW).parquet(f"{path}/new/run={number}")
    after = S.settle(T.prune(state.unionByName(new), F.lit(now).cast("timestamp"), days), "tracker")
    T.digest(watchlist, new, after).withColumn("ran_at", F.lit(now).cast("timestamp")).write.mode("overwrite").parquet(f"{path}/runs/run={number}")
    S.write_state(after, state_path, version)
    S.remove(spark, f"{state_path}/version={version - KEPT}")


def track_stream(items: DataFrame, watchlist: Sequence[tuple[str, Sequence[str]]], path: str, days: int = C.PRUNE_DAYS) -> StreamingQuery:
    """Starts the runs over what the stream items(title, snippet, url, source, ord, seen) holds now; started again at the same path it goes on after the last one."""
    watch = [(n, list(a)) for n, a in watchlist]
    w = items.writeStream.foreachBatch(lambda batch, number: run(batch, number, watch, path, days))
    return w.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()


def new_mentions(spark: SparkSession, path: str) -> DataFrame:
    """What the runs at a path found, with the number of the run."""
    return spark.read.schema(f"{NEW}, run long").option("basePath", f"{path}/new").parquet(f"{path}/new/run=*")


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The digest's numbers of each run at a path: RUNS."""
    return spark.read.schema(RUNS).option("basePath", f"{path}/runs").parquet(f"{path}/runs/run=*")
