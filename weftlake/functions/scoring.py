"""Relevance, links, recency, rendering tiers and page classes as native columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from . import constants as C
from .text import left16, len16, prose, squeeze


def tokenize(c: Column) -> Column:
    words = F.regexp_extract_all(F.lower(c), F.lit(r"[0-9]+\.[0-9]+|[a-z][a-z0-9]+"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*C.STOP_WORDS))


def _is(term: str):
    return lambda w: w == term


def relevance(terms: Sequence[str], doc: Column, title: Column | None = None) -> Column:
    """Saturating term frequencies over the distinct query terms, half as much again for a title hit, by the best possible sum."""
    terms = list(dict.fromkeys(terms))
    if not terms:
        return F.lit(0.0)
    tokens, heads = tokenize(doc), tokenize(title) if title is not None else F.array().cast("array<string>")

    def score(pair):
        s = F.lit(0.0)
        for t in terms:
            f = F.size(F.filter(pair["d"], _is(t))).cast("double")
            s = s + F.when(f > 0, f * 2.5 / (f + 1.5) * F.when(F.array_contains(pair["t"], t), 1.5).otherwise(1.0)).otherwise(0.0)
        return s / F.lit(len(terms) * 2.5)

    return F.get(F.transform(F.array(F.struct(tokens.alias("d"), heads.alias("t"))), score), F.lit(0))


def parse_date(c: Column) -> Column:
    """ISO dates and times, RFC 822, and "Month d, yyyy", in UTC; else null."""
    formats = ("yyyy-MM-dd'T'HH:mm:ss[.SSS][XXX]", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MMMM d, yyyy", "MMMM d yyyy", "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z")
    bare = F.regexp_replace(c, "^[A-Za-z]{3}, ", "")
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in formats])


def age_days(t: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(t)) / F.lit(86.4e9)


def recency(days: Column, half_life: float = 30.0) -> Column:
    return F.when(days.isNull(), 0.5).when(days <= 0, 1.0).otherwise(F.pow(F.lit(0.5), days / half_life))


def link_score(href: Column, text: Column, terms: Sequence[str]) -> Column:
    path = F.lower(F.regexp_extract(href, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1))
    s = relevance(terms, text) * 4
    for t in terms:
        s = s + F.when(F.contains(path, F.lit(t)), 1.0).otherwise(0.0)
    s = s + F.when(F.rlike(path, F.lit("/20[0-9][0-9]/")), 2.0).otherwise(0.0) + F.when(F.regexp_count(path, F.lit("-")) >= 2, 1.0).otherwise(0.0)
    s = s + F.when(F.regexp_count(path, F.lit("[^/]+")) >= 2, 1.0).otherwise(0.0)
    s = s - F.when(F.rlike(href, F.lit(C.NAV)), 6.0).otherwise(0.0) - F.when(F.rlike(href, F.lit(C.AGGREGATOR)), 8.0).otherwise(0.0)
    return F.when(F.rlike(href, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+")), s).otherwise(F.lit(-100.0))


def _tier(score: Column) -> Column:
    tier = F.when(score > 0.5, "browser").when(score > 0.2, "jsdom").otherwise("http")
    sure = F.when(score > 0.5, F.least(score, F.lit(1.0))).when(score > 0.2, score).otherwise(1 - score)
    return F.struct(tier.alias("tier"), sure.alias("confidence"), score.alias("score"))


def tier_before(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    s = F.when(F.contains(url, F.lit("#/")) | F.contains(url, F.lit("#!/")), 0.3).otherwise(0.0)
    s = s + F.when(F.rlike(url, F.lit(C.APP_PATH)), 0.1).otherwise(0.0)
    starts = F.lit(False)
    for p in C.APP_HOSTS:
        starts = starts | F.startswith(host, F.lit(p))
    return _tier(s + F.when(starts, 0.2).otherwise(0.0))


def shown(html: Column) -> Column:
    """The length of what a page shows without its scripts and marks, blanks counted once."""
    return len16(squeeze(F.regexp_replace(F.regexp_replace(html, r"(?is)<script.*?</script>", ""), "<[^>]+>", " ")))


def after_score(html: Column, n: Column, content_type: Column | None = None) -> Column:
    """The score of a fetched page, of which n characters are shown, for a tier that renders."""
    yes = lambda pattern: F.rlike(html, F.lit(pattern))
    plus = lambda cond, n: F.when(cond, n).otherwise(0.0)
    scripts, inline = F.regexp_count(html, F.lit("(?i)<script")), yes(C.INLINE_LOGIC)
    s = plus(yes(C.EMPTY_ROOT), 0.35) + plus(yes(C.NOSCRIPT), 0.3) + plus(yes(C.FRAMEWORKS), 0.2)
    s = s + F.when((n < 200) & ((scripts >= 1) | inline), 0.6).when((n < 600) & ((scripts > 2) | inline), 0.3).otherwise(0.0)
    s = s - plus(yes(C.SUBSTANTIAL), 0.4) - plus(n > 2000, 0.4) - plus(n > 500, 0.2)
    if content_type is not None:
        s = s - plus(F.contains(content_type, F.lit("text/html")) & (n > 1000), 0.2)
    return F.greatest(s, F.lit(0.0))


def tier_after(html: Column, content_type: Column | None = None) -> Column:
    return _tier(after_score(html, shown(html), content_type))


def with_tier_after(d: DataFrame, name: str, html: Column, content_type: Column | None = None) -> DataFrame:
    """d with tier_after as a column. Length and score are columns of their own on the way: each is read several times, and one expression of all would outgrow a method's code."""
    d = d.withColumn("_shown", shown(html))
    d = d.withColumn("_score", after_score(html, F.col("_shown"), content_type)).drop("_shown")
    return d.withColumn(name, _tier(F.col("_score"))).drop("_score")


def page_class(title: Column, markdown: Column, captcha: Column | None = None, min_prose: int = 200) -> Column:
    head = F.concat(title, F.lit(" "), left16(markdown, 4000))
    n = len16(prose(markdown))
    c = F.when(F.rlike(head, F.lit(C.PAYWALL)), F.when(n >= 600, "paywall-soft").otherwise("paywall-hard")).when(F.rlike(head, F.lit(C.BLOCKED)) & (n < 800), "blocked").when(n < min_prose, "thin").otherwise("good")
    return c if captcha is None else F.when(captcha, "captcha").otherwise(c)
