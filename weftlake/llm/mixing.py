"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import WORD, drop, table

BINS = 4096


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: float = 3.0) -> DataFrame:
    """sizes(source, source_size long): adds target double.

    The shares of the total follow the weights, dealt out in turn over the sources by code point, null last. A
    source stops at max_epochs times its size, and what is cut off is reshared by weight until none is above: the level
    (a share by weight) rises from round to round as more sources are capped, and stays once no other is. Sources are numbered by
    ranges, and a round takes three sums to the driver, so that millions of sources (domains) are never in one task.
    """
    s = sizes.select("source", F.col("source_size").cast("long").alias("source_size")).orderBy(F.col("source").asc_nulls_last())
    s = table(s.withColumn("_id", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_id", 33)), "source-order")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = s.groupBy("_range").agg(F.count("*").alias("_n")).select(F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    rank = F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    d = s.join(starts, F.col("_range") == F.col("_r")).select("source", "source_size", w.alias("_w"), (F.col("source_size") * F.lit(float(max_epochs))).alias("_cap"))
    d = table(d, "source-weights")
    all_of = d.agg(F.sum("source_size").alias("size"), F.sum("_w").alias("w")).first()
    size, weight, capped = float(all_of["size"] or 0), float(all_of["w"] or 0), -1
    level = size / weight if weight else 0.0
    while True:
        r = d.where(F.col("_cap") <= F.col("_w") * F.lit(level)).agg(F.sum("_cap").alias("cap"), F.sum("_w").alias("w"), F.count("*").alias("n")).first()
        if r["n"] == capped or weight <= (r["w"] or 0.0):
            break
        capped, level = r["n"], (size - (r["cap"] or 0.0)) / (weight - (r["w"] or 0.0))
    drop(s)
    return d.select("source", "source_size", F.least(F.col("_cap"), F.col("_w") * F.lit(level)).alias("target"))


def _sized(docs: DataFrame, seed: int, key: str, text: str, source: str) -> DataFrame:
    """docs' columns and, for each row, _source, _size and its seeded draw: _u from key and text, _v from its place, for rows that repeat.

    To be written before it is used, which settles _v. A place is a row's number in its task, so that reruns over the same
    files agree; where files are dealt differently, rows of equal key and text may change places among themselves.
    """
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.col(text)), F.lit(BINS * BINS))
    v = F.pmod(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()), F.lit(BINS))
    return docs.withColumn("_source", F.col(source)).withColumn("_size", words).withColumn("_u", u).withColumn("_v", v)


def source_rule(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: float = 3.0) -> DataFrame:
    """sizes(_source, _size, _u, _v), read from a written table: for each source _s, _source_size, _target, _whole, _cut, _tie.

    A source whose target is e times its size takes every document floor(e) times, and once more those whose draw
    (_u, _v) lies below (_cut, _tie). That comes from three histograms of sizes over the draw (4096 bins, 4096 within the
    bin that holds the cut, 4096 of _v within that), so the taken words meet the target but for the documents of one
    bin in 69 thousand millions.
    """
    bins = table(sizes.groupBy(F.col("_source").alias("source"), F.floor(F.col("_u") / BINS).alias("bin")).agg(F.sum("_size").alias("n")), "bins")
    targets = source_targets(bins.groupBy("source").agg(F.sum("n").alias("source_size")), weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(max_epochs)))).otherwise(F.lit(0)).cast("long")
    plan = table(targets.withColumn("whole", whole).withColumn("rest", F.when(F.col("whole") < max_epochs, F.col("target") - F.col("whole") * F.col("source_size")).otherwise(F.lit(0.0))), "targets")

    def reached(b: DataFrame) -> DataFrame:
        """b(source, bin, n, rest, more): the bin of each source in which the running sum passes rest, what is left for it, and more."""
        b = b.withColumn("sum", F.sum("n").over(Window.partitionBy("source").orderBy("bin")))
        left = F.col("rest") - (F.col("sum") - F.col("n"))
        return b.where(F.col("sum") > F.col("rest")).groupBy("source").agg(F.min_by(F.struct("bin", left.alias("left"), F.col("n").alias("n"), "more"), "bin").alias("x")).select(F.col("source").alias("s"), "x.*")

    p = plan.select(F.col("source").alias("s0"), "rest", F.lit(0).cast("long").alias("more"))
    first = table(reached(bins.join(p, bins.source.eqNullSafe(p.s0)).drop("s0")), "cut1")
    fine = sizes.join(first, sizes["_source"].eqNullSafe(first.s) & (F.floor(sizes["_u"] / BINS) == first.bin))
    fine = fine.groupBy("_source", F.col("_u").alias("u"), F.col("left").alias("rest")).agg(F.sum("_size").alias("n"))
    second = table(reached(fine.select(F.col("_source").alias("source"), F.col("u").alias("bin"), "n", "rest", F.lit(0).cast("long").alias("more"))), "cut2")
    last = sizes.join(second.withColumnRenamed("n", "n2"), sizes["_source"].eqNullSafe(second.s) & (sizes["_u"] == second.bin))
    last = last.groupBy("_source", "_v", F.col("left").alias("rest"), F.col("bin").alias("more")).agg(F.sum("_size").alias("n"))
    third = reached(last.select(F.col("_source").alias("source"), F.col("_v").alias("bin"), "n", "rest", "more"))
    third = third.select(F.col("s").alias("s3"), F.col("more").alias("cut"), (F.col("bin") + (2 * F.col("left") > F.col("n")).cast("int")).alias("tie"))  # the last bin whole, if most of it is due
    # a rest that no bin passes takes them all
    rule = plan.join(third, plan.source.eqNullSafe(third.s3), "left")
    cut = F.when(F.col("rest") <= 0, F.lit(-1)).otherwise(F.coalesce("cut", F.lit(BINS * BINS)))
    out = table(rule.select(F.col("source").alias("_s"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.col("whole").alias("_whole"), cut.alias("_cut"), F.coalesce("tie", F.lit(0)).alias("_tie")), "rule")
    drop(bins, plan, first, second)
    return out


def _copies(max_epochs: float) -> Column:
    below = (F.col("_u") < F.col("_cut")) | ((F.col("_u") == F.col("_cut")) & (F.col("_v") < F.col("_tie")))
    return F.least(F.col("_whole") + F.when(below, 1).otherwise(0), F.lit(int(max_epochs))).cast("long")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: float = 3.0, seed: int = 7, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row a document: doc_id, source, size (words), source_size, target, copies, taken = copies * size.

    Null texts have size 0; null sources are a source of their own; rows of equal or null keys are drawn by their texts,
    rows that repeat wholly by their places; an empty table gives an empty result; columns beside key, text and source
    are ignored. Only sums are shuffled, combined before the exchange: a source with a third of all rows costs no more
    than another.
    """
    d = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    d = table(_sized(d, seed, "doc_id", "text", "source").drop("text"), "sizes")
    rule = source_rule(d, weights, max_epochs)
    out = d.join(rule, d["_source"].eqNullSafe(rule["_s"])).withColumn("copies", _copies(max_epochs))
    return out.select("doc_id", "source", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), "copies", (F.col("copies") * F.col("_size")).alias("taken"))


def repeated(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: float = 3.0, seed: int = 7, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs' rows as often as mix() takes them, and with the same columns, whatever their names. The rows are written once with their draws."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names, strict=True))
    d = table(_sized(docs.toDF(*names), seed, at[key], at[text], at[source]), "drawn")
    rule = source_rule(d, weights, max_epochs)
    d = d.join(rule, d["_source"].eqNullSafe(rule["_s"])).where(_copies(max_epochs) > 0)
    d = d.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), _copies(max_epochs).cast("int"))))
    return d.select(*names).toDF(*docs.columns)


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's size, its source's size and target, and the words that the mix takes (see mix for nulls, ties and repeats)."""
    m = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return m.select("doc_id", "size", "source_size", "target", "taken", "copies")
