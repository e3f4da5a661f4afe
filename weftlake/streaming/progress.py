"""Progress while a job runs: what each wave of a crawl has done, and what each micro-batch of a stream has, as rows of a table that others can read meanwhile."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener

BATCHES = "name string, run string, batch long, at timestamp, rows long, seconds double, observed map<string,string>"


class Batches(StreamingQueryListener):
    """Appends a row a micro-batch of the session's streams to a table of JSON lines: its rows, its time and what the stream observes (DataFrame.observe).

    Batches without input are left out. The listener's own thread writes; spark.streams.addListener(Batches(spark, path)) starts it, stop() ends it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        spark.streams.addListener(self)

    def stop(self) -> None:
        """No more rows: whatever has been reported by now is written."""
        self.spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if not p.numInputRows:
            return
        observed = {f"{name}.{k}": str(v) for name, row in p.observedMetrics.items() for k, v in row.asDict().items()}
        row = (json.dumps({"name": p.name, "run": str(p.runId), "batch": p.batchId, "at": p.timestamp, "rows": p.numInputRows, "seconds": p.batchDuration / 1000, "observed": observed}),)
        self.spark.createDataFrame([row], "value string").coalesce(1).write.mode("append").text(self.path)


def batches(spark: SparkSession, path: str) -> DataFrame:
    """The rows that Batches has written: BATCHES."""
    return spark.read.schema(BATCHES).json(path)


def observed(df: DataFrame, name: str, **what: Column) -> DataFrame:
    """A stream whose batches report these aggregates (counts by default)."""
    return df.observe(name, *[c.alias(k) for k, c in (what or {"n": F.count(F.lit(1))}).items()])
