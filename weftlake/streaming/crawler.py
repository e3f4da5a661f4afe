"""The crawl as a stream: its frontier is a source of files, a wave a file, and each micro-batch reads one wave and adds the next."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.crawl import Crawl, Waves
from ..sources.state import written


def crawl_stream(pages: DataFrame, edges: DataFrame, seed, at: str, max_waves: int | None = None, **how) -> Crawl:
    """crawl_report's result, reached by micro-batches; `at` keeps frontier, waves and checkpoint. how: see Waves.

    The frontier source lists one small file for each wave, beside which the wave's ids lie as a table of any size, so that a batch never
    sees half a wave. A stopped crawl (max_waves batches at most, or a driver that was lost) goes on from its checkpoint when it is called with the
    same folder; a batch that is played again overwrites what it wrote.
    """
    spark = pages.sparkSession
    waves, frontier, done = Waves(f"{at}/crawl", pages, edges, tell=True, **how), f"{at}/frontier", []

    def add(depth: int) -> None:
        if not written(spark, f"{frontier}/wave-{depth}"):
            spark.createDataFrame([(depth,)], "depth int").coalesce(1).write.mode("overwrite").json(f"{frontier}/wave-{depth}")

    def read(batch: DataFrame, number: int) -> None:
        for r in batch.collect():  # one file, one row
            more = waves.step(r["depth"]) >= 0
            done.append(r["depth"])
            if more and (max_waves is None or len(done) < max_waves):
                add(r["depth"] + 1)

    if not written(spark, f"{at}/crawl/wave/depth=0"):
        waves.start(seed)
    depth = 0
    while written(spark, f"{at}/crawl/wave/depth={depth}"):  # the last wave's file is missing where a crawl was stopped
        add(depth)
        depth += 1
    source = spark.readStream.schema("depth int").option("maxFilesPerTrigger", 1).json(f"{frontier}/wave-*")
    query = source.writeStream.foreachBatch(read).option("checkpointLocation", f"{at}/checkpoint").trigger(processingTime="0 seconds").start()
    try:
        before = -1
        while len(done) > before:  # a batch that has ended may have added a file
            before = len(done)
            query.processAllAvailable()
    finally:
        query.stop()
    return waves.result()
