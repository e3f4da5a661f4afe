"""Incremental tracking of a watchlist, the reach ladder, and the digest."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import constants as C, urls as U
from ..functions.scoring import parse_date
from ..sources.state import append_log, read_state, settle, write_state
from . import watch as W

#: Names and aliases up to which a watchlist is matched by patterns in the plan.
PATTERNS = 64


def pattern(terms: Sequence[str]) -> str:
    """Any of the terms, whole (ASCII word boundaries), whatever the case."""
    def one(t: str) -> str:
        word = lambda ch: ch.isascii() and (ch.isalnum() or ch == "_")
        before = r"(?<![A-Za-z0-9_])" if word(t[0]) else r"(?<=[A-Za-z0-9_])"
        after = r"(?![A-Za-z0-9_])" if word(t[-1]) else r"(?=[A-Za-z0-9_])"
        return before + re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", t) + after

    return "(?i)" + "|".join(map(one, filter(None, terms)))


def mentions(items: DataFrame, watchlist: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """items(title, snippet, url, ord, ...): a row for each entity (name, aliases) that the title or snippet names.

    One pass with the entities' patterns as literals: no join of items with patterns. All patterns in one first leave the
    items that name anyone, and only those are held against each. A list of more than PATTERNS names is an automaton's (watch.mentions).
    """
    if sum(1 + len(a) for _, a in watchlist) > PATTERNS:
        return W.mentions(items, watchlist)
    hay = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("snippet", F.lit("")))
    anyone = "|".join(f"(?:{pattern([n, *a])})" for n, a in watchlist)
    hit = F.array_compact(F.array(*[F.when(F.rlike(hay, F.lit(pattern([n, *a]))), F.lit(n)) for n, a in watchlist]))
    return items.where(F.rlike(hay, F.lit(anyone or "(?!)"))).withColumn("entity", F.explode(hit)).withColumn("url_key", U.mention_key(F.col("url")))


def new_mentions(found: DataFrame, known: DataFrame) -> DataFrame:
    """found(entity, url_key, ord, ...) that known(entity, url_key) doesn't hold; of equal ones the first by ord, picked before the shuffle."""
    rest = [c for c in found.columns if c not in ("entity", "url_key")]
    first = found.groupBy("entity", "url_key").agg(F.min_by(F.struct(*rest), "ord").alias("_x"))
    return first.select("entity", "url_key", "_x.*").select(*found.columns).join(known.select("entity", "url_key"), ["entity", "url_key"], "left_anti")


def prune(state: DataFrame, as_of, days: int = C.PRUNE_DAYS) -> DataFrame:
    """state(first_seen string, ...) without what is older than days; what has no readable date stays."""
    t = parse_date(F.col("first_seen"))
    return state.where(t.isNull() | (t >= as_of - F.expr(f"interval {days} days")))


def digest(watchlist: Sequence[tuple[str, Sequence[str]]], new: DataFrame, state: DataFrame) -> DataFrame:
    """(entity, n_new, total_known), entities without any included."""
    w = state.sparkSession.createDataFrame([(n,) for n, _ in watchlist], "entity string")
    a = new.groupBy("entity").agg(F.count("*").alias("n_new"))
    b = state.groupBy("entity").agg(F.count("*").alias("total_known"))
    return w.join(a, "entity", "left").join(b, "entity", "left").na.fill(0)


def render(new: DataFrame, per_entity: int = 8) -> DataFrame:
    """(entity, section): a heading and a line for each of the first mentions."""
    d = new.withColumn("n", F.row_number().over(Window.partitionBy("entity").orderBy("ord"))).where(F.col("n") <= per_entity)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n", "title", "url"))), lambda x: F.concat(F.lit("- ["), x["title"], F.lit("]("), x["url"], F.lit(")")))
    return d.groupBy("entity").agg(F.concat(F.lit("## "), F.first("entity"), F.lit("\n"), F.array_join(lines, "\n")).alias("section"))


def track(spark: SparkSession, entities: Sequence[tuple[str, Sequence[str], Sequence[str]]], sweeps: DataFrame, feed_items: DataFrame | None, state_path: str, now: str, log_path: str | None = None) -> DataFrame:
    """One run of the tracker: reads the state, matches what searches and feeds gave, adds what is new, prunes, writes, reports.

    entities are (name, aliases, domains). sweeps(entity, rank, title, url, snippet) are results of the entities' own searches;
    feed_items(domain, feed, ord, title, url, date; snippet if there) count where an entity watches their domain (all, where
    none watches any). Sweeps come before feeds, and of an entity's equal urls the first counts. Returns (entity, n_new,
    total_known, section): new mentions of this run, what the state holds after pruning, and the digest's lines; a row an entity.
    The new state is a version beside the old one, so a run that fails leaves the old one whole.
    """
    watch = [(n, list(a)) for n, a, _ in entities]
    place = F.create_map(*[F.lit(x) for i, (n, _) in enumerate(watch) for x in (n, i)])
    text = lambda df: F.col("snippet") if "snippet" in df.columns else F.lit(None).cast("string")
    at = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.cast("string").alias("a"), b.cast("long").alias("b")).alias("ord")
    none = F.lit(None).cast("string")
    items = sweeps.select("title", "url", text(sweeps).alias("snippet"), F.concat(F.lit("sweep:"), "entity").alias("source"), none.alias("date"), at(0, F.lpad(F.coalesce(place[F.col("entity")], F.lit(len(watch))).cast("string"), 9, "0"), F.col("rank")))
    if feed_items is not None:
        domains = sorted({d for *_, ds in entities for d in ds})
        own = feed_items.where(F.col("domain").isin(*domains)) if domains else feed_items
        items = items.union(own.select("title", "url", text(own), F.col("feed"), F.col("date").cast("string"), at(1, F.col("feed"), F.col("ord"))))
    state = read_state(spark, state_path)
    new = new_mentions(mentions(items, watch), state)
    new = new.select(*[F.col(c) for c in ("entity", "url_key", "title", "url", "source", "date", "ord")])
    new = settle(new, "new-mentions")
    added = new.select("entity", "url_key", "title", "url", "source", F.lit(now).alias("first_seen"))
    write_state(prune(state.unionByName(added), F.lit(now).cast("timestamp")), state_path)
    out = digest(watch, new, read_state(spark, state_path)).join(render(new), "entity", "left")
    if log_path:
        line = out.agg(F.lit(now).alias("ran_at"), F.sum("n_new").alias("new_mentions"), F.map_from_entries(F.collect_list(F.struct("entity", "n_new"))).alias("by_entity"))
        append_log(line, log_path)
    return out


def digest_text(out: DataFrame, now: str) -> DataFrame:
    """(markdown): the digest of a run as one text, a section for each entity that has something new."""
    total = F.sum("n_new")
    head = F.concat(F.lit(f"# New developments\n_ran {now} · "), F.count("*").cast("string"), F.lit(" entities · "), total.cast("string"), F.lit(" new_\n\n"))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n_new") > 0, F.struct("entity", "section")))), lambda x: x["section"]), "\n\n")
    return out.agg(F.concat(head, F.when(total > 0, parts).otherwise(F.lit("_nothing new since last run._"))).alias("markdown"))


def reach(snapshots: DataFrame, ladder: Sequence[str] = C.LADDER) -> DataFrame:
    """snapshots(url, strategy, page_class): url, ok, via, reason, needs_human, tried.

    Up the ladder: good or softly walled pages succeed; a captcha or hard wall on a live tier stops for a human; else the
    next tier; nothing left: blocked. `tried` is the tiers up to the one that decided."""
    step = F.array_position(F.array(*map(F.lit, ladder)), F.col("strategy"))
    live = F.col("strategy").isin("direct", "stealth-retry", "logged-in")
    ends = F.when(F.col("page_class").isin("good", "paywall-soft"), "ok").when(live & F.col("page_class").isin("captcha", "paywall-hard"), "human")
    d = snapshots.withColumn("step", step).withColumn("ends", ends).where("step > 0")
    g = d.groupBy("url").agg(F.min_by(F.struct("strategy", "page_class", "ends", "step"), F.when(F.col("ends").isNotNull(), F.col("step"))).alias("x"), F.array_sort(F.collect_list(F.struct("step", "strategy"))).alias("all"))
    tried = F.transform(F.filter("all", lambda a: F.coalesce(a["step"] <= F.col("x.step"), F.lit(True))), lambda a: a["strategy"])
    ok = F.coalesce(F.col("x.ends") == "ok", F.lit(False))
    return g.select("url", ok.alias("ok"), F.when(ok, F.col("x.strategy")).alias("via"), F.when(~ok, F.coalesce("x.page_class", F.lit("blocked"))).alias("reason"), F.coalesce(F.col("x.ends") == "human", F.lit(False)).alias("needs_human"), tried.alias("tried"))
