"""Documents to packed training sequences: quality rules, line dedup, near-dedup, mixing, packing. Counted as part of weftlake.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftlake.llm import lines, mixing, packing, quality, simhash
from weftlake.llm.common import delete_made, drop, free_shuffles, made, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their host's verdict reject go: null, empty and short texts among them; repeated rows are judged alike; an empty table stays empty."""
    return quality.judge(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go from the texts; every document stays, null ids last in order, n_chars follows its text (see lines.dedup_lines)."""
    d = lines.dedup_lines(docs.select(*COLUMNS))
    return d.withColumn("n_chars", F.when(F.col("n_removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five-word shingles, Jaccard similarity of 0.8 or more, chained) stays.

    It is the one with the smallest id; rows without an id come last, and of rows with one id the least by a hash of the
    columns stays. What goes is decided for each row, so an id that is null or repeated elsewhere takes nothing along.
    """
    d = simhash.near_groups(docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("_hash")))
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "_hash", "row")
    kept = table(d.groupBy("near_group").agg(F.min(place).alias("first")).select(F.col("first.row").alias("_row")), "kept")
    return d.join(kept.hint("merge"), F.col("row") == F.col("_row"), "left_semi").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; a null source is one of its own, rows that repeat are drawn apart (see mixing.mix)."""
    return mixing.repeated(docs.select(*COLUMNS))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text is its end mark alone; repeats take places of their own; an empty table gives no row."""
    return packing.pack(table(packing.token_pieces(docs), "pieces"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("simhash near-dedup", near_dedup), ("mixing", mix_sources), ("packing", best_fit_packing)]

#: No SQL gives these rows (Golay keys, seeded draws and best-fit packing); tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents. Each stage's rows are written; the work tables behind them and the rows of the stage before are then deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, since = docs, len(made)
        docs = table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        delete_made(spark, since, docs)
        drop(before)
        free_shuffles(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
