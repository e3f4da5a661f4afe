"""Structured Streaming forms: new mentions as they come, and windows over events. Each runs what is there and ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.state import scratch


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Everything that the stream's source holds now, through Parquet in the shared folder: appended, or in other modes the last whole result."""
    spark = stream.sparkSession
    at = scratch(spark, "stream")
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    if mode == "append":
        w.format("parquet").option("path", f"{at}/out").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{at}/out")
    last: list[str] = []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out-{number}")
        last[:] = [f"{at}/out-{number}"]

    w.foreachBatch(put).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(*last) if last else spark.createDataFrame([], stream.schema)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream, be it one file or a folder of them: a pattern names either, where a plain path must be a folder and a filter of names sees files only."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}[.]parquet")


def window_counts(events: DataFrame, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("value"))


def new_mentions_stream(found: DataFrame, days: int = 90) -> DataFrame:
    """found(entity, url_key, seen timestamp, ...): each (entity, url_key) once within the retention, by the watermark."""
    return found.withWatermark("seen", f"{days} days").dropDuplicatesWithinWatermark(["entity", "url_key"])
