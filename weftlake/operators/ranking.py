"""Fused rankings, seeds, de-duplication and tier memory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import constants as C, text as T, urls as U


def rrf(hits: DataFrame, k: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """hits(by..., engine, engine_no, rank from 0, title, url, snippet): one row a normalised url with score, engines, title, url, snippet.

    Each hit adds 1 / (60 + rank + 1). Engines stand in the order of their first hit; the longest title wins, the
    earlier of equals; the first snippet that isn't empty. Top k by score, then first hit.
    """
    h = hits.withColumn("key", U.search_key(F.col("url"))).withColumn("ord", F.struct("engine_no", "rank"))
    g = h.groupBy(*by, "key").agg(
        F.round(F.sum(1.0 / (C.RRF_K + 1 + F.col("rank"))), 4).alias("score"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "engine"))), lambda x: x["engine"]), ",").alias("all"),
        F.max_by("title", F.struct(F.length("title"), -F.col("engine_no"), -F.col("rank"))).alias("title"),
        F.min_by("url", "ord").alias("url"),
        F.coalesce(F.min_by(F.when(F.col("snippet") != "", F.col("snippet")), F.when(F.col("snippet") != "", F.col("ord"))), F.lit("")).alias("snippet"),
        F.min("ord").alias("first"),
    )
    g = g.withColumn("engines", F.array_distinct(F.split("all", ","))).drop("all")
    if k is not None:
        g = g.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "first"))).where(F.col("place") <= k).drop("place") if by else g.orderBy(F.desc("score"), "first").limit(k)
    return g.drop("first")


def seeds(hits: DataFrame, max_seeds: int = 3) -> DataFrame:
    """hits(ord, url): no aggregators, at most the first homepage, no navigation pages; the first max_seeds."""
    h = hits.where(~F.rlike("url", F.lit(C.AGGREGATOR))).withColumn("home", F.rlike("url", F.lit(C.HOMEPAGE)))
    h = h.where(F.col("home") | ~F.rlike("url", F.lit(C.NAV)))
    pages, homes = h.where(~F.col("home")), h.where("home").orderBy("ord").limit(1)
    return pages.union(homes).orderBy("ord").limit(max_seeds).select("ord", "url")


def exact_dedup(df: DataFrame, text: str, order: str, keep: Sequence[str] | None = None) -> DataFrame:
    """The first row (by order) of each normalised text: order and the columns of keep (all, where None).

    Texts are told apart by 256 bits, whatever their number. One pass: the first row is picked before the shuffle and after it,
    with no window over a hot text. Null texts are one text; an empty table gives an empty result.
    """
    rest = [c for c in (df.columns if keep is None else keep) if c != order]
    first = df.groupBy(T.content_key(F.col(text)).alias("_key")).agg(F.min_by(F.struct(order, *rest), order).alias("_first"))
    return first.select("_first.*").select(*[c for c in df.columns if c == order or c in rest])


def tier_memory(outcomes: DataFrame) -> DataFrame:
    """outcomes(host, tier, ts, success): the tier that last succeeded for each host."""
    return outcomes.where("success").groupBy("host").agg(F.max_by("tier", "ts").alias("tier"))


def glob_filter(df: DataFrame, url: str, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """Rows whose url some include glob matches (all, without any) and no exclude glob does."""
    if include:
        df = df.where(F.rlike(url, F.lit("|".join(map(U.glob_regex, include)))))
    return df.where(~F.rlike(url, F.lit("|".join(map(U.glob_regex, exclude))))) if exclude else df
