"""Which rendering tier's snapshot stands for a url: learned or scored, escalated by what the page shows, climbed where one is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scoring as S, urls as U

TIERS = ("http", "jsdom", "browser")
#: How sure a host's learned tier is, and the score that it stands for.
LEARNED, LEARNED_SCORE = 0.9, {"http": 0.0, "jsdom": 0.4, "browser": 0.9}


def predict(requests: DataFrame, memory: DataFrame | None = None) -> DataFrame:
    """requests(url, ...): adds predicted, confidence and score; a host that memory(host, tier) knows is not scored again.

    memory has a row a host; the join is left to the optimizer, which broadcasts it only while it is small.
    """
    d = requests.withColumn("_t", S.tier_before(F.col("url")))
    if memory is None:
        return d.select(*requests.columns, F.col("_t.tier").alias("predicted"), "_t.confidence", "_t.score")
    m = memory.select(F.col("host").alias("_h"), F.col("tier").alias("_learned"))
    d = d.join(m, U.host(F.col("url")) == F.col("_h"), "left")
    known = F.col("_learned").isNotNull()
    scores = F.create_map(*[F.lit(x) for kv in LEARNED_SCORE.items() for x in kv])
    return d.select(*requests.columns, F.coalesce("_learned", "_t.tier").alias("predicted"), F.when(known, F.lit(LEARNED)).otherwise(F.col("_t.confidence")).alias("confidence"), F.when(known, scores[F.col("_learned")]).otherwise(F.col("_t.score")).alias("score"))


def _at(tier: Column | str) -> Column:
    return F.col("_by")[tier if isinstance(tier, Column) else F.lit(tier)]


def adaptive(requests: DataFrame, snapshots: DataFrame, memory: DataFrame | None = None, forced: str | None = None) -> DataFrame:
    """requests(url, ...) read from snapshots(url, tier, html; content_type if there): adds predicted, tier, html, escalated.

    The predicted (or forced) tier's snapshot is read. Where it is plain http and its html asks for more, the tier that it asks
    for is read instead, if it is there. A missing snapshot is a failed fetch: the next tiers above are tried in turn (not
    for a forced one), and a url that none has keeps a null tier. Of several snapshots of a url and tier one is taken, the
    greatest html. One row a request; snapshots nobody asks for are not kept.
    """
    d = predict(requests, memory) if forced is None else requests.withColumn("predicted", F.lit(forced))
    typed = "content_type" in snapshots.columns
    page = F.struct("html", F.col("content_type") if typed else F.lit(None).cast("string").alias("content_type"))
    one = snapshots.where(F.col("tier").isin(*TIERS)).groupBy("url", "tier").agg(F.max(page).alias("page"))
    by = one.groupBy(F.col("url").alias("_u")).agg(F.map_from_entries(F.collect_list(F.struct("tier", "page"))).alias("_by"))  # three tiers at most
    d = d.join(by, F.col("url") == F.col("_u"), "left").withColumn("_by", F.coalesce("_by", F.create_map().cast(by.schema["_by"].dataType)))
    here = F.map_contains_key("_by", F.col("predicted"))
    d = d.withColumn("_here", here)
    asks = F.when((F.col("predicted") == "http") & F.col("_here"), _at("http")["html"])  # only a page that was read by http can ask for more
    d = S.with_tier_after(d.withColumn("_html", asks).withColumn("_type", F.coalesce(_at("http")["content_type"], F.lit(""))), "_after", F.col("_html"), F.col("_type"))
    here, wanted = F.col("_here"), F.when(F.col("_html").isNotNull(), F.col("_after.tier"))
    climbed = F.lit(None).cast("string")
    for k in range(len(TIERS) - 1, -1, -1):
        higher = F.coalesce(*[F.when(F.map_contains_key("_by", F.lit(t)), t) for t in TIERS[k + 1 :]], F.lit(None).cast("string"))
        climbed = F.when(F.col("predicted") == TIERS[k], higher).otherwise(climbed)
    if forced is None:
        d = d.withColumn("_wanted", wanted)
        up = F.coalesce((F.col("_wanted") != "http") & F.map_contains_key("_by", F.col("_wanted")), F.lit(False))
        tier = F.when(up, F.col("_wanted")).when(here, F.col("predicted")).otherwise(climbed)
    else:
        tier = F.when(here, F.col("predicted"))
    d = d.withColumn("_tier", tier)
    return d.select(*requests.columns, "predicted", F.col("_tier").alias("tier"), _at(F.col("_tier"))["html"].alias("html"), F.coalesce(F.col("_tier") != F.col("predicted"), F.lit(False)).alias("escalated"))


def outcomes(fetched: DataFrame, ts: Column) -> DataFrame:
    """adaptive's rows as (host, tier, ts, success), from which ranking.tier_memory learns."""
    return fetched.select(U.host(F.col("url")).alias("host"), "tier", ts.alias("ts"), F.col("tier").isNotNull().alias("success"))
