"""Quality rules with host verdicts: failures by host, rates shrunk by an empirical beta prior, verdicts joined back."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table, trimmed, unused

#: Rules of a document beside the base ones: symbols by word and repeated lines by line.
SOFT_SYMBOLS, SOFT_LINES = 0.1, 0.3
#: A host is bad if the odds of failing there are so many times the prior's, even at so many standard deviations below its rate.
HOST_ODDS, DEVIATIONS = 3.0, 3.0
#: Documents from which on a host's weight in the prior hardly grows: a host with a third of all documents counts as about one host.
FULL_WEIGHT = 20
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
_SYMBOLS = b"#*$%&|<>"


def measure(text: str | None, window: int = 8) -> tuple[int, int, int, int, int, int]:
    """Words, their code points, symbols, repeated lines, words in windows found twice or more, lines with a word."""
    import numpy as np

    if not text:
        return 0, 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # ASCII white space: the space and \x09-\x0D
    n = len(words)
    flat = np.frombuffer(b"".join(words), "u1")
    chars = int(np.count_nonzero((flat & 0xC0) != 0x80))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    dup = len(lines) - len(set(lines))
    repeat = 0
    if n > window:
        names: dict[bytes, int] = {}
        ids = np.fromiter((names.setdefault(w, len(names)) for w in words), "u8", n)
        h = np.zeros(n - window + 1, "u8")
        with np.errstate(over="ignore"):
            ids = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            ids ^= ids >> np.uint64(29)
            for k in range(window):
                h = h * np.uint64(0xD6E8FEB86659FD93) + ids[k : n - window + 1 + k]
        _, back, count = np.unique(h, return_inverse=True, return_counts=True)
        twice = count[back] > 1
        if twice.any():
            cover = np.zeros(n + 1, "i8")
            at = np.nonzero(twice)[0]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + window, -1)
            repeat = int(np.count_nonzero(np.cumsum(cover[:n]) > 0))
    return n, chars, symbols, dup, repeat, len(lines)


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs' columns and MEASURES of the whole text (null: none)."""
    out = docs.select(*[c for c in docs.columns if c not in {x.split()[0] for x in MEASURES.split(", ")}])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [x.split()[0] for x in MEASURES.split(", ")]
        for batch in batches:
            rows = [measure(t.as_py()) for t in batch.column(text)]
            cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, *names])

    return out.mapInArrow(lambda batches: trimmed(run(batches)), f"{fields}, {MEASURES}")


def host_rates(flags: DataFrame, host: str = "source") -> DataFrame:
    """flags(host, failed boolean): host, n, failed, rate, low, prior_mean; rates shrunk by a beta prior that the hosts' own rates give (moments).

    In the prior a host weighs n/(n + FULL_WEIGHT), so that neither a host of one document nor the largest one rules it.
    low lies DEVIATIONS standard deviations of the posterior below rate. Sums are combined before the shuffle, and what
    is left has a row for each host. Where the rates don't vary the prior is their mean with the weight of 1e6 documents.
    """
    h = flags.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), F.count_if("failed").alias("failed"))
    h = table(h, "hosts")
    n, rate = F.col("n"), F.col("failed") / F.col("n")
    w = n / (n + FULL_WEIGHT)
    m = h.agg(F.sum(w).alias("w"), F.sum(w * rate).alias("wr"), F.sum(w * rate * rate).alias("wrr"), F.sum(w / n).alias("wn")).first()  # four sums
    mean = m["wr"] / m["w"] if m["w"] else 0.0
    # the variance of the rates, without what sampling alone gives
    var = max((m["wrr"] - mean * m["wr"]) / m["w"] - mean * (1 - mean) * m["wn"] / m["w"], 0.0) if m["w"] else 0.0
    weight = max(min(mean * (1 - mean) / var - 1, 1e6), 1.0) if var > 0 else 1e6
    h = h.withColumn("rate", (F.col("failed") + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))).withColumn("prior_mean", F.lit(float(mean)))
    return h.withColumn("low", F.greatest(F.col("rate") - DEVIATIONS * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.lit(weight + 1))), F.lit(0.0)))


def bad_hosts(rates: DataFrame, odds: float = HOST_ODDS) -> DataFrame:
    """Of host_rates' rows the hosts whose documents fail far more often than the corpus leads to expect."""
    mean = F.least(F.greatest("prior_mean", F.lit(1e-6)), F.lit(1 - 1e-6))
    return rates.where(F.col("low") * (1 - mean) >= odds * mean * (1 - F.col("low")))


def judge(docs: DataFrame, min_words: int = 20, max_repeat_percent: int = 30, host: str = "source", text: str = "text", odds: float = HOST_ODDS, with_text: bool = True) -> DataFrame:
    """docs' columns (text only if with_text) with MEASURES, base_failed, soft_failed, host_bad and kept.

    base_failed: fewer than min_words, or more than max_repeat_percent of the words in repeated windows. soft_failed:
    base_failed, or many symbols, or many repeated lines. A host is bad by its shrunk rate of soft failures against the
    corpus (bad_hosts), and a bad host's documents must pass the soft rules too; elsewhere the base rules alone decide,
    so a clean document is kept wherever it stands. Null texts have no words and fail; null hosts are a host of their
    own; repeated rows are judged alike; an empty table gives an empty result; columns of docs that have the name of an
    added one are replaced by it. Texts are measured once: the measures are written and read twice.
    """
    added = {"base_failed", "soft_failed", "host_bad", "kept"}
    d = with_measures(docs.select(*[c for c in docs.columns if c not in added]), text)
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    soft = base | (F.col("n_symbols") > SOFT_SYMBOLS * F.col("n_words")) | (F.col("n_dup_lines") > SOFT_LINES * F.col("n_lines"))
    d = d.withColumn("base_failed", base).withColumn("soft_failed", soft)
    d = table(d if with_text else d.drop(text), "measured")
    bad = bad_hosts(host_rates(d.select(F.col(host).alias("_host"), F.col("soft_failed").alias("failed")), "_host"), odds)
    named, is_bad = unused(d.columns, "_bad_host", "_bad")
    bad = table(bad.select(F.col("host").alias(named), F.lit(True).alias(is_bad)), "bad-hosts")
    d = d.join(bad, d[host].eqNullSafe(bad[named]), "left").withColumn("host_bad", F.coalesce(is_bad, F.lit(False))).drop(named, is_bad)
    return d.withColumn("kept", ~F.col("base_failed") & ~(F.col("host_bad") & F.col("soft_failed")))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measures and verdict (see judge): null and empty texts fail by their words, repeated rows are judged alike."""
    d = judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"), with_text=False)
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "soft_failed", "host_bad")
