"""What the operators of this subpackage share: work tables, null-safe texts, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word is a maximal run of characters other than the space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset and the master is local (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: driver and executors share no folder")
        base = f"file://{tempfile.gettempdir()}/checkpoints/weftlake"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def unused(columns, *names: str) -> list[str]:
    """The names, lengthened until none of columns is called so (case aside, as Spark resolves)."""
    taken = {c.lower() for c in columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


#: Paths of the work tables that this driver has written and not deleted.
made: list[str] = []


#: Rows of an Arrow batch while a work table is written: whole texts in thousands would fill a batch of some hundred MB in the JVM and in Python.
BATCH_ROWS = 1024
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(df: DataFrame, tag: str, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Writes df as a work table in the shared folder and rereads it, so that a lost executor costs no earlier step.

    Operators drop() those that no result reads any more. A lazy result still reads its last ones: a caller that has written
    it somewhere can delete_made() what was made for it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftlake-{tag}-{uuid.uuid4().hex}"
    before = int(spark.conf.get(_ROWS))
    spark.conf.set(_ROWS, str(min(before, batch_rows) if before > 0 else batch_rows))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_ROWS, str(before))
    out = spark.read.schema(df.schema).parquet(path)
    out._weftlake_path = path
    made.append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if path in made:
        made.remove(path)


def drop(*frames: DataFrame) -> None:
    """Deletes work tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_weftlake_path", None)
        if path:
            _delete(df.sparkSession, path)


def delete_made(spark: SparkSession, since: int = 0, *but: DataFrame) -> None:
    """Deletes the work tables made since (a length of `made` then), but those."""
    keep = {getattr(df, "_weftlake_path", None) for df in but}
    for path in made[since:]:
        if path not in keep:
            _delete(spark, path)


def trimmed(batches):
    """batches, after which this Python worker gives free memory back: idle workers stay, with all that their last task took."""
    import ctypes

    import pyarrow as pa

    yield from batches
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library, which has no such call
        pass


def free_shuffles(spark: SparkSession) -> None:
    """Shuffle files live until the driver collects the garbage of their plans; a long loop asks for that itself."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def let(c: Column, f) -> Column:
    """f(c) with c worked out once: lambdas have no common subexpressions."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def prefix_sums(xs: Column, block: int = 256) -> Column:
    """Of an array<long>: the sum of what stands before each element. Within blocks, then over blocks, as appending to one array costs its square."""
    none = F.array().cast("array<long>")
    zero = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))

    def sums(values):
        return F.aggregate(values, zero, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    def joined(blocks):
        before = sums(F.transform(blocks, lambda b: b["at"]))["out"]
        return F.flatten(F.zip_with(blocks, before, lambda b, s: F.transform(b["out"], lambda o: o + s)))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / block).cast("int")), lambda k: sums(F.slice(xs, k * block + 1, F.lit(block))))
    return F.when(F.size(xs) > 0, let(blocks, joined)).otherwise(none)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges(a long, b long): (node, component), component being the smallest node.

    Minimum labels spread over the edges and jump to their label's label each round (O(log n) rounds on
    chains and stars alike). Only minima are shuffled, combined before the exchange, so a node with very many
    edges stays cheap; the joins read written tables, which leaves AQE free to split a hot key. Empty edges
    give an empty result; null ends and loops are ignored.
    """
    spark = edges.sparkSession
    # written before it is read twice: worked out twice, edges that depend on the order of rows would not match
    once = table(edges.where("a is not null and b is not null and a <> b").select("a", "b"), "once")
    both = once
    both = table(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    drop(once)
    labels = table(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels, both.a == labels.node).select(F.col("b").alias("node"), "component")
        hook = labels.withColumnRenamed("node", "n").withColumnRenamed("component", "c")
        low = table(near.groupBy("node").agg(F.min("component").alias("low")).join(hook, F.col("node") == F.col("n")).select("node", F.col("c").alias("old"), F.least("low", "c").alias("low")), "low")
        # the old label, a node itself, learns the smallest label seen by those that carry it
        push = low.groupBy(F.col("old").alias("node")).agg(F.min("low").alias("push"))
        best = table(low.join(push, "node", "left").select("node", "old", F.least("low", F.coalesce("push", "low")).alias("component")), "best")
        up = best.select(F.col("node").alias("u"), F.col("component").alias("uc"))
        new = table(best.join(up, best.component == up.u, "left").select("node", F.least("component", F.coalesce("uc", "component")).alias("component"), F.col("old")), "labels")
        changed = new.where("component <> old").limit(1).count()
        drop(low, best, labels)
        labels = new
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    drop(both)
    return labels.select("node", "component")
