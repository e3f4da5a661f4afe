"""Secret scans: patterns with their places, and a battery of randomness tests on what else looks like a key. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import let as _let, prefix_sums, table

#: Fixed: the base patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # the same matches as AKIA[A-Z0-9]+ of 18 characters or more
HEX = r"[0-9a-f]{16,}"  # a maximal run, so the same matches as [0-9a-f]+ of 16 or more
KINDS = ("assign", "access", "hex", "random")
#: Candidates of the battery (a letter and a digit), their decoys (ordinary long words: no digit), and the alphabets an encoding is inferred from (first that fits).
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}={0,2}"
ALPHABETS = (("^[0-9a-f]+$", "0123456789abcdef"), ("^[0-9A-F]+$", "0123456789ABCDEF"), ("^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), ("^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), ("_|-", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"), ("", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"))
#: Share of truly random strings among those that the battery clears, and of ordinary ones among those it reports; strata by length.
ALPHA, STRATA = 0.05, (20, 24, 32, 64, 128)
BINS = 400
SPAN = "array<struct<start:int,kind:int,end:int,hit:string>>"


def _spans(text: Column, hits: Column, pattern: str, kind: int) -> Column:
    """The places, in code points, of the leftmost non-overlapping matches: hits and the gaps between them alternate."""
    pairs = F.zip_with(F.split(text, pattern, -1), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    starts = lambda ps: prefix_sums(F.transform(ps, lambda p: (F.length(p["gap"]) + F.length(p["hit"])).cast("long")))

    def span(p, at):
        s = (at + F.length(p["gap"])).cast("int")
        return F.struct(s.alias("start"), F.lit(kind).alias("kind"), (s + F.length(p["hit"])).alias("end"), p["hit"].alias("hit"))

    placed = _let(F.filter(pairs, lambda p: p["hit"].isNotNull()), lambda ps: F.zip_with(ps, starts(ps), span))
    return F.when(F.size(hits) > 0, placed).otherwise(F.array().cast(SPAN))


def _tail(z: Column) -> Column:
    """The upper tail of the normal distribution (an approximation good to 1e-3 of itself near the middle, and never 0)."""
    x = F.abs(z)
    t = F.exp(-x * x / 2) / (1.64 * x + F.sqrt(0.76 * x * x + 4.0))
    return F.greatest(F.when(z >= 0, t).otherwise(1 - t), F.lit(1e-300))


def battery(token: Column) -> Column:
    """A p-value for "drawn at random from its alphabet": the least of three tests, times three.

    Chi-squared against uniform use of the inferred alphabet (upper tail: text repeats its letters), the number of runs
    above and below the alphabet's middle, and the correlation of neighbouring characters (both two-sided).
    """
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, v: a + v)
    but_last = lambda xs: F.slice(xs, 1, F.greatest(F.size(xs) - 1, F.lit(0)))
    but_first = lambda xs: F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0)))

    def alphabet_of(core):
        a = F.lit(ALPHABETS[-1][1])
        for shape, letters in reversed(ALPHABETS[:-1]):
            a = F.when(F.rlike(core, F.lit(shape)), F.lit(letters)).otherwise(a)
        return F.struct(core.alias("core"), a.alias("alphabet"), F.filter(F.split(core, "", -1), lambda c: c != "").alias("chars"))

    def coded(t):
        k = F.length(t["alphabet"]).cast("double")
        counts = F.transform(F.array_distinct(t["chars"]), lambda c: F.pow((F.length(t["core"]) - F.length(F.replace(t["core"], c, F.lit("")))).cast("double"), F.lit(2.0)))
        code = F.transform(t["chars"], lambda c: F.instr(t["alphabet"], c).cast("double"))
        return F.struct(F.size(t["chars"]).cast("double").alias("n"), k.alias("k"), total(counts).alias("squares"), code.alias("code"))

    def summed(t):
        high = F.transform(t["code"], lambda v: F.when(v > t["k"] / 2, 1.0).otherwise(0.0))
        return F.struct(t["n"].alias("n"), t["k"].alias("k"), t["squares"].alias("squares"), t["code"].alias("code"), (total(t["code"]) / t["n"]).alias("mid"), high.alias("high"), total(high).alias("n1"))

    def scored(t):
        n, k, mid, n1 = t["n"], t["k"], t["mid"], t["n1"]
        n2 = n - n1
        # Wilson and Hilferty's cube root, with the degrees of freedom that give the statistic's own variance
        free = (k - 1) * n / (n - 1)
        z_chi = (F.pow((k / n * t["squares"] - n) / (k - 1), F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
        turns = total(F.zip_with(but_last(t["high"]), but_first(t["high"]), lambda a, b: F.abs(a - b))) + 1
        mean = 2 * n1 * n2 / n + 1
        z_runs = F.when(n1 * n2 > 0, (turns - mean) / F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9)))).otherwise(F.lit(9.0))
        var = total(F.transform(t["code"], lambda v: (v - mid) * (v - mid)))
        lag = total(F.zip_with(but_last(t["code"]), but_first(t["code"]), lambda a, b: (a - mid) * (b - mid)))
        z_lag = F.when(var > 0, lag / var * F.sqrt(n)).otherwise(F.lit(9.0))
        return F.struct(z_chi.alias("chi"), F.abs(z_runs).alias("runs"), F.abs(z_lag).alias("lag"))

    scores = _let(_let(_let(_let(F.rtrim(token, F.lit("=")), alphabet_of), coded), summed), scored)
    return _let(scores, lambda z: F.least(3 * F.least(_tail(z["chi"]), 2 * _tail(z["runs"]), 2 * _tail(z["lag"])), F.lit(1.0)))


def _render(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _cuts(bins: list, alpha: float) -> list[int]:
    """bins(stratum, bin, decoy, n): for each stratum the bin below which a candidate is reported.

    Two error rates bound it. From the top: Benjamini and Hochberg's rule over the p-values rejects "random", so at most
    alpha of what is cleared is expected to be random. From below: ordinary words of the corpus are scored alike, and the
    cut lies where the candidates' number, times the share of these decoys that pass, is at most alpha of the candidates
    that pass. Decoys of a stratum are those up to its length, as a longer ordinary string passes more rarely.
    """
    out = []
    for s in range(len(STRATA) + 1):
        own = [0] * BINS
        decoys = [0] * BINS
        for r in bins:
            if r["decoy"] and r["stratum"] <= s:
                decoys[r["bin"]] += r["n"]
            elif not r["decoy"] and r["stratum"] == s:
                own[r["bin"]] += r["n"]
        m, cut, cleared = sum(own), BINS, 0
        for b in range(BINS - 1, -1, -1):
            cleared += own[b]
            if own[b] and 2.0 ** (-b / 4) * m <= alpha * cleared:
                cut = b
        all_decoys, best, passed, false = max(sum(decoys), 1), 0, 0, 0
        for b in range(cut):
            passed, false = passed + own[b], false + decoys[b]
            if m * false / all_decoys <= alpha * passed:
                best = b + 1
        out.append(best)
    return out


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", alpha: float = ALPHA) -> DataFrame:
    """key, base and spans array<struct<start, kind, end, hit>> of every whole text (null: none), by start, then kind.

    Kinds 0 to 2 are the base patterns. Kind 3: strings of 16 or more key characters with a letter and a digit that the
    battery finds random, wherever they stand (within a base span it confirms that). What is reported and what is cleared
    are both controlled, within strata of length over all documents (_cuts). That needs a histogram of p-values (BINS
    a stratum, candidates and decoys), so only that reaches the driver. Repeated rows are scanned alike; an empty table
    gives an empty result; other columns are ignored.
    """
    value = lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 2)) >= 12
    digit = lambda x: F.rlike(x, F.lit("[0-9]"))
    letter = lambda x: F.rlike(x, F.lit("[A-Za-z]"))
    patterns = (ASSIGN, ACCESS, HEX, CANDIDATE)
    d = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    d = d.select(key, "_t", *[F.regexp_extract_all("_t", F.lit(p), F.lit(0)).alias(f"_hits{k}") for k, p in enumerate(patterns)])
    d = d.select(key, *[_spans(F.col("_t"), F.col(f"_hits{k}"), p, k).alias(f"_spans{k}") for k, p in enumerate(patterns)])
    stratum = lambda n: F.coalesce(*[F.when(n < limit, k) for k, limit in enumerate(STRATA)], F.lit(len(STRATA)))
    scored = lambda m: F.struct(m.alias("span"), stratum(m["end"] - m["start"]).alias("stratum"), F.least(F.floor(-4 * F.log2(battery(m["hit"]))), F.lit(BINS - 1)).cast("int").alias("bin"), (~digit(m["hit"])).alias("decoy"))
    d = d.select(key, F.concat(F.filter("_spans0", value), "_spans1", "_spans2").alias("base"), F.transform(F.filter("_spans3", lambda s: letter(s["hit"])), scored).alias("tested"))
    d = table(d, "scanned")
    bins = d.where(F.size("tested") > 0).select(F.explode("tested").alias("x")).groupBy("x.stratum", "x.bin", "x.decoy").agg(F.count("*").alias("n")).collect()  # 2 * 6 strata of 400 bins at most
    cuts = F.array(*[F.lit(c) for c in _cuts(bins, alpha)])
    found = F.transform(F.filter("tested", lambda x: ~x["decoy"] & (x["bin"] < F.get(cuts, x["stratum"]))), lambda x: x["span"])
    return d.select(key, F.sort_array("base").alias("base"), F.sort_array(F.concat("base", found)).alias("spans"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets; null and empty texts have none, repeated rows are scanned alike (see scan)."""
    d = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return d.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_render(F.col("base")), 256).alias("base_sha256"), _render(F.col("spans")).alias("spans"))
