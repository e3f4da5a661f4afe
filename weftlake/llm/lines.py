"""Line dedup: a suffix array over line ids by prefix doubling, its longest earlier matches, and what they repeat deleted. DataFrame functions only.

Lines get ids by 128-bit hashes; texts that are equal as a whole are one from the start, as a copy repeats its first one from
end to end. Prefix doubling then names the runs of 1, 2, 4 ... lines at every place, each from two names of half the length,
until no run is left that stands twice; a name is the first place of its run, which is what a rank in a suffix array is to its
prefix, and only places whose run repeats go on. A run of any length between two powers is named by the runs of the lower power
at its start and at its end.

From the names follows, for every place, the longest run from there that also starts at an earlier place (the common prefix with
its earlier neighbour in suffix order): the largest power that repeats bounds it, the bounds of neighbouring places tighten it
(its end never falls from a place to the next), and what stays open is settled by asking for lengths between the bounds. Runs
that no earlier place's run contains are the maximal repeated ones.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import WORD, drop, table


def _named(names: DataFrame, by: list[str], tag: str) -> DataFrame:
    """The places (doc, i) whose run repeats, with the first place of that run (fd, fi). Minima are combined before the shuffle.

    Joins here and below are merges at every size: a work table's files are a small part of what its rows take in memory, so one
    that looks small enough to broadcast by its files could fill the driver.
    """
    firsts = names.groupBy(*by).agg(F.min(F.struct("doc", "i")).alias("first"), F.count("*").alias("n")).where("n > 1").select(*[F.col(c).alias(f"_{c}") for c in by], "first")
    firsts = table(firsts, f"{tag}-first")
    on = functools.reduce(lambda a, b: a & b, [names[c] == firsts[f"_{c}"] for c in by])
    keep = [c for c in names.columns if c in ("k", "length", "words")]
    out = table(names.join(firsts.hint("merge"), on).select("doc", "i", *keep, F.col("first.doc").alias("fd"), F.col("first.i").alias("fi")), tag)
    drop(firsts)
    return out


def _later() -> Column:
    return (F.col("fd") != F.col("doc")) | (F.col("fi") != F.col("i"))


def _tightened(bounds: DataFrame) -> DataFrame:
    """bounds(doc, i, k, low, high) of the ends of the longest runs: neither falls from a place to the next."""
    w = Window.partitionBy("doc").orderBy("i")
    low = F.max("low").over(w.rowsBetween(Window.unboundedPreceding, 0))
    high = F.min("high").over(w.rowsBetween(0, Window.unboundedFollowing))
    return bounds.select("doc", "i", "k", low.alias("low"), high.alias("high"))


def longest_earlier(lines: DataFrame) -> DataFrame:
    """lines(doc, i, h1, h2, words): for every line that also stands earlier (doc, then i): doc, i, end, words.

    i to end is the longest run from i that also starts at an earlier place.
    """
    levels = [_named(lines, ["h1", "h2"], "run1")]
    while True:
        step = 1 << (len(levels) - 1)
        ahead = Window.partitionBy("doc").orderBy("i").rangeBetween(step, step)
        pairs = levels[-1].select("doc", "i", "fd", "fi", F.first("fd").over(ahead).alias("fd2"), F.first("fi").over(ahead).alias("fi2")).where("fd2 is not null")
        named = _named(pairs, ["fd", "fi", "fd2", "fi2"], f"run{2 * step}")
        if named.isEmpty():
            drop(named)
            break
        levels.append(named)
    every = functools.reduce(DataFrame.unionByName, [x.select("doc", "i", F.lit(k).alias("k"), "fd", "fi") for k, x in enumerate(levels)])
    best = every.where(_later()).groupBy("doc", "i").agg(F.max("k").alias("k"))
    bounds = table(_tightened(best.select("doc", "i", "k", (F.col("i") + F.expr("shiftleft(1, k)")).alias("low"), (F.col("i") + F.expr("shiftleft(2, k)") - 1).alias("high"))), "bounds")
    first = True
    while True:
        # the highest length in doubt first, which mostly holds; then halves
        end = F.col("high") if first else F.ceil((F.col("low") + F.col("high")) / 2).cast("int")
        asks = bounds.where("low < high").select(F.col("doc").alias("d"), F.col("i").alias("p"), F.col("k").alias("ak"), (end - F.col("i")).alias("length"))
        if asks.isEmpty():
            break
        named = every.join(asks.hint("merge"), (every.doc == asks.d) & (every.i == asks.p) & (every.k == asks.ak))
        asked = named.select(F.col("k").alias("ak"), F.col("fd").alias("ad"), F.col("fi").alias("ai"), "length").distinct()
        heads = every.join(asked.hint("merge"), (every.k == asked.ak) & (every.fd == asked.ad) & (every.fi == asked.ai)).select("doc", "i", "k", "length", "fd", "fi")
        heads = heads.withColumn("at", F.col("i") + F.col("length") - F.expr("shiftleft(1, k)"))
        tails = every.select(F.col("doc").alias("d2"), F.col("i").alias("i2"), F.col("k").alias("k2"), F.col("fd").alias("fd2"), F.col("fi").alias("fi2"))
        runs = heads.join(tails.hint("merge"), (F.col("doc") == F.col("d2")) & (F.col("at") == F.col("i2")) & (F.col("k") == F.col("k2"))).select("doc", "i", "k", "length", "fd", "fi", "fd2", "fi2")
        runs = table(runs, "asked-runs")
        found = _named(runs, ["k", "length", "fd", "fi", "fd2", "fi2"], "asked")
        yes = found.where(_later()).select(F.col("doc").alias("d"), F.col("i").alias("p"), F.col("length").alias("holds"))
        # only what is open meets the answers
        told = bounds.where("low < high").withColumn("asked", end - F.col("i"))
        told = told.join(yes.hint("merge"), (told.doc == yes.d) & (told.i == yes.p) & (told.asked == yes.holds), "left")
        low = F.when(F.col("holds").isNotNull(), F.col("i") + F.col("holds")).otherwise(F.col("low"))
        high = F.when(F.col("holds").isNull(), F.col("i") + F.col("asked") - 1).otherwise(F.col("high"))
        told = told.select("doc", "i", "k", low.alias("low"), high.alias("high")).union(bounds.where("low >= high").select("doc", "i", "k", "low", "high"))
        new = table(_tightened(told), "bounds")
        drop(runs, found, bounds)
        bounds, first = new, False
    words = levels[0].select(F.col("doc").alias("d"), F.col("i").alias("p"), "words")
    out = table(bounds.join(words.hint("merge"), (bounds.doc == words.d) & (bounds.i == words.p)).select("doc", "i", F.col("low").alias("end"), "words"), "longest")
    drop(bounds, *levels)
    return out


def maximal_runs(longest: DataFrame, min_lines: int, min_words: int) -> DataFrame:
    """longest_earlier's rows: for each doc that loses lines: doc, gone (lines, sorted), n_runs, longest_run.

    A maximal run goes whole if it has min_lines lines; elsewhere a line of min_words words goes alone, as a run of one.
    """
    w = Window.partitionBy("doc").orderBy("i")
    before = F.lag(F.struct("i", "end")).over(w)
    head = F.coalesce((before["i"] < F.col("i") - 1) | (before["end"] < F.col("end")), F.lit(True))
    d = longest.withColumn("head", head)
    long = F.col("head") & (F.col("end") - F.col("i") >= min_lines)
    # where the last long run up to here ends
    d = d.withColumn("long", long).withColumn("covered", F.coalesce(F.max(F.when(long, F.col("end"))).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    alone = (F.col("covered") <= F.col("i")) & (F.col("words") >= min_words)
    d = d.withColumn("alone", alone).where((F.col("covered") > F.col("i")) | F.col("alone"))
    return d.groupBy("doc").agg(F.sort_array(F.collect_list("i")).alias("gone"), F.count_if(F.col("long") | F.col("alone")).alias("n_runs"), F.max(F.when(F.col("long"), F.col("end") - F.col("i")).when(F.col("alone"), 1)).cast("long").alias("longest_run"))


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def _worded(x: Column) -> Column:
    return F.rlike(x, F.lit(WORD))


def dedup_lines(docs: DataFrame, min_lines: int = 2, min_words: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs' columns, the text without repeated runs, and n_lines, n_removed_lines, n_runs, longest_run.

    A maximal run of lines with a word that also stands earlier (by key, then place) is deleted if it has min_lines lines;
    elsewhere a line of min_words words that also stands earlier is. Lines without a word belong to no run and stay. A text
    that another row with a smaller key has too is one such run. Null texts stay null and have no lines; rows without a key come
    after all others; rows that repeat key and text count as one document and lose the same lines, rows of one key with
    different texts are different documents, in the order of their hashes; an empty table gives an empty result; columns
    of docs that have the name of an added one are replaced by it.
    """
    added = ("n_lines", "n_removed_lines", "n_runs", "longest_run")
    docs = docs.drop(*added)
    columns = docs.columns
    docs = docs.toDF(*[f"c{i}" for i in range(len(columns))])  # whatever they are called
    key, text = f"c{columns.index(key)}", f"c{columns.index(text)}"
    lines = F.filter(_lines(text), _worded)
    hashed = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), lines.alias("lines")).where(F.size("lines") > 0)
    hashed = hashed.select("key", "t1", "t2", F.transform("lines", lambda x: F.xxhash64(x)).alias("h1"), F.transform("lines", lambda x: F.xxhash64(F.lit(1), x)).alias("h2"), F.transform("lines", lambda x: F.regexp_count(x, F.lit(WORD))).alias("words"))
    hashed = table(hashed, "hashed")
    place = F.struct(F.col("key").isNull().alias("none"), "key")
    texts = hashed.groupBy("t1", "t2").agg(F.min(place).alias("place"), F.first("h1").alias("h1"), F.first("h2").alias("h2"), F.first("words").alias("words"), F.count("*").alias("n"))
    # numbers in the order of the keys
    texts = table(texts.orderBy("place", "t1", "t2").withColumn("doc", F.monotonically_increasing_id()), "line-texts")
    rows = texts.select("doc", F.posexplode(F.arrays_zip("h1", "h2", "words")).alias("i", "x")).select("doc", "i", "x.*")
    longest = longest_earlier(rows)
    gone = table(maximal_runs(longest, min_lines, min_words).withColumnRenamed("doc", "d"), "gone-lines")
    told = texts.select("doc", "t1", "t2", "place", "n").join(gone.hint("merge"), F.col("doc") == F.col("d"), "left").where("gone is not null or n > 1")
    told = table(told.select(F.col("t1").alias("u1"), F.col("t2").alias("u2"), "place", "gone", "n_runs", "longest_run"), "told-texts")
    # by row: narrow rows meet what their text loses, so that whole texts are joined by key
    mine = hashed.select("key", "t1", "t2").join(told.hint("merge"), (F.col("t1") == F.col("u1")) & (F.col("t2") == F.col("u2")))
    mine = mine.withColumn("_copy", ~F.col("key").eqNullSafe(F.col("place.key")))
    mine = mine.where("_copy or gone is not null").select(F.col("key").alias("_key"), F.col("t1").alias("_t1"), "_copy", *[F.when(~F.col("_copy"), F.col(c)).alias(f"_{c}") for c in ("gone", "n_runs", "longest_run")])
    mine = table(mine.groupBy("_key", "_t1").agg(*[F.first(c).alias(c) for c in ("_copy", "_gone", "_n_runs", "_longest_run")]), "row-lines")
    drop(hashed, texts, longest, gone, told)
    # what is deleted grows with the corpus: merged at every size, never broadcast
    d = docs.withColumn("_h", F.xxhash64(text)).join(mine.hint("merge"), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_h") == F.col("_t1")), "left")
    none = F.array().cast("array<int>")
    n_lines = F.coalesce(F.size(F.filter(_lines(text), _worded)), F.lit(0))
    d = d.withColumn("_n", F.greatest(n_lines, F.lit(0))).withColumn("_whole", F.coalesce(F.col("_copy") & (F.col("_n") >= min_lines), F.lit(False)))
    # places among all lines, and what is left of them; a short copy loses its lines of min_words words
    places = F.filter(F.transform(_lines(text), lambda x, r: F.when(_worded(x), r)), lambda r: r.isNotNull())
    heavy = F.filter(F.transform(F.filter(_lines(text), _worded), lambda x, r: F.when(F.regexp_count(x, F.lit(WORD)) >= min_words, r)), lambda r: r.isNotNull())
    every = F.sequence(F.lit(0), F.col("_n") - 1)
    d = d.withColumn("_gone", F.when(F.col("_whole"), every).when(F.col("_copy"), heavy).otherwise(F.coalesce("_gone", none)))
    d = d.withColumn("_places", F.when(F.size("_gone") > 0, places))
    d = d.withColumn("_left", F.when(F.size("_gone") > 0, F.array_except(F.sequence(F.lit(0), F.size(_lines(text)) - 1), F.transform("_gone", lambda i: F.get(F.col("_places"), i)))))
    cut = F.array_join(F.transform("_left", lambda r: F.get(_lines(text), r)), "\n")
    alone = F.size("_gone").cast("long")
    d = d.withColumn("n_lines", F.col("_n").cast("long")).withColumn("n_removed_lines", F.size("_gone").cast("long"))
    d = d.withColumn("n_runs", F.when(F.col("_whole"), 1).when(F.col("_copy"), alone).otherwise(F.coalesce("_n_runs", F.lit(0))).cast("long"))
    d = d.withColumn("longest_run", F.when(F.col("_whole"), F.col("_n")).when(F.col("_copy"), F.least(alone, F.lit(1))).otherwise(F.coalesce("_longest_run", F.lit(0))).cast("long"))
    d = d.withColumn(text, F.when(F.size("_gone") > 0, cut).otherwise(F.col(text)))
    return d.select(*docs.columns, *added).toDF(*columns, *added)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines, removed lines and maximal runs, and the hash of what is left (see dedup_lines; null texts: empty)."""
    d = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return d.select("doc_id", "n_lines", "n_removed_lines", "n_runs", "longest_run", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
