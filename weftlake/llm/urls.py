"""URL filters: a sorted array of 64-bit digests, memory-mapped, probed by binary search and confirmed on the strings.

The array is built once, by the driver; Spark ships its file to each executor, whose workers map it, so that they share its pages.
"""

from __future__ import annotations

import atexit
import functools
import hashlib
import os
import shutil
import tempfile
from collections.abc import Iterator, Sequence

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import unused

#: The rules of the query: (host, path, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Beyond this many bytes of rules the array isn't sent to the executors; the rules are joined instead, with the same result.
MAX_RULE_BYTES = 256 << 20
_opened: dict[str, DigestArray] = {}


def split_url(c):
    """(host, path) columns: host after the first ://, A-Z lowered; path up to ? or #. Null or without ://: both empty."""
    tail = F.when(F.instr(c, "://") > 0, F.substring(c, F.instr(c, "://") + 3, F.length(c))).otherwise(F.lit(""))
    host = F.regexp_extract(tail, r"^[^/?#]*", 0)
    path = F.regexp_extract(tail, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")), F.coalesce(path, F.lit(""))


@functools.cache
def _folder() -> str:
    """The driver's own folder for the arrays that it serves; it goes when the driver ends."""
    path = tempfile.mkdtemp(prefix="rules-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


class DigestArray:
    """Sorted xxhash64 keys of strings with the strings behind them, in one mapped file; equal keys stand side by side, so collisions are resolved on the strings.

    File, in unsigned little-endian numbers: how many (8 bytes), the keys (8 each), the end of each string (8 each), a
    number that belongs to it (4 each), the strings in UTF-8.
    """

    def __init__(self, path: str):
        import numpy as np

        with open(path, "rb") as f:
            n = int.from_bytes(f.read(8), "little")
        whole = np.memmap(path, dtype="u1", mode="r")
        self.keys, self.ends, self.values = whole[8 : 8 + 8 * n].view("<u8"), whole[8 + 8 * n : 8 + 16 * n].view("<u8"), whole[8 + 16 * n : 8 + 20 * n].view("<u4")
        self.strings = whole[8 + 20 * n :]

    @staticmethod
    def write(path: str, names: Sequence[str], values: Sequence[int]) -> None:
        import numpy as np
        import xxhash

        raw = [x.encode("utf-8", "surrogatepass") for x in names]
        keys = np.fromiter(map(xxhash.xxh64_intdigest, raw), "<u8", len(raw))
        order = np.argsort(keys, kind="stable")
        with open(path, "wb") as f:
            f.write(len(raw).to_bytes(8, "little"))
            f.write(keys[order].tobytes())
            f.write(np.cumsum([len(raw[i]) for i in order], dtype="<u8").tobytes())
            f.write(np.asarray(values, "<u4")[order].tobytes())
            for i in order:
                f.write(raw[i])

    def name(self, i: int) -> bytes:
        return self.strings[int(self.ends[i - 1]) if i else 0 : int(self.ends[i])].tobytes()

    def find(self, probes: Sequence[bytes]):
        """The place of each probe in the array, or -1."""
        import numpy as np
        import xxhash

        out = np.full(len(probes), -1, "i8")
        if not len(self.keys):
            return out
        h = np.fromiter(map(xxhash.xxh64_intdigest, probes), "u8", len(probes))
        at = np.searchsorted(self.keys, h, side="left")
        for i in np.nonzero(np.take(self.keys, at, mode="clip") == h)[0]:
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == h[i]:
                if self.name(j) == probes[i]:
                    out[i] = j
                    break
                j += 1
        return out


def match_rules(urls: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, default: str = "allow") -> DataFrame:
    """urls(any columns, host, path): adds rule and verdict.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest rule string wins, of equally
    long ones that with the longer host, and a url that no rule fits gets the default. Probes are the host's suffixes at
    dots, each with the prefixes of the path that have the length of some rule's path. A repeated (host, path) rule has
    the greatest of its verdicts as strings (block before allow). Empty and null hosts fit nothing; repeated rows are
    judged alike; an empty table gives an empty result; columns named rule or verdict are replaced.
    """
    urls = urls.drop("rule", "verdict")
    if sum(len(h) + len(p) for h, p, _ in rules) > MAX_RULE_BYTES:
        return match_rules_joined(urls, urls.sparkSession.createDataFrame(list(rules), "rule_host string, rule_path string, rule_verdict string"), default)
    chosen: dict[str, str] = {}
    for h, p, v in rules:
        chosen[h + p] = max(v, chosen.get(h + p, v))
    kinds = sorted(set(chosen.values()))
    lengths = sorted({len(p) for _, p, _ in rules})
    file = f"rules-{hashlib.sha256(repr(sorted(chosen.items())).encode('utf-8', 'surrogatepass')).hexdigest()[:32]}.digests"
    at = os.path.join(_folder(), file)
    if not os.path.exists(at):
        DigestArray.write(at, list(chosen), [kinds.index(v) for v in chosen.values()])
    urls.sparkSession.sparkContext.addFile(at)  # executors fetch it from the driver, which therefore keeps it
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema.fields)

    def probe(batches: Iterator) -> Iterator:
        import pyarrow as pa

        array = _opened.get(file) or _opened.setdefault(file, DigestArray(SparkFiles.get(file)))
        for batch in batches:
            probes, owner = [], []
            for i, (host, path) in enumerate(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)):
                heads = [(path or "")[:n] for n in lengths if n <= len(path or "")]
                labels = host.split(".") if host else []
                for k in range(len(labels)):
                    suffix = ".".join(labels[k:])
                    probes.extend((suffix + x).encode("utf-8", "surrogatepass") for x in heads)
                    owner.extend([i] * len(heads))
            best: list[tuple[int, str, int] | None] = [None] * batch.num_rows
            # longer hosts come first, so of equally long rules the first found stays
            for i, j in zip(owner, array.find(probes).tolist(), strict=True):
                if j >= 0:
                    name = array.name(j).decode("utf-8", "surrogatepass")
                    if best[i] is None or len(name) > best[i][0]:
                        best[i] = (len(name), name, j)
            rule = pa.array([b and b[1] for b in best], pa.string())
            verdict = pa.array([kinds[array.values[b[2]]] if b else default for b in best], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], [*batch.schema.names, "rule", "verdict"])

    return urls.mapInArrow(probe, f"{fields}, rule string, verdict string")


def match_rules_joined(urls: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """As match_rules, for rules(rule_host, rule_path, rule_verdict) of any number: the same probes, joined on their digest and string.

    Each distinct (host, path) is probed once, and only its best hit comes back: a hot host costs rows, not pairs.
    """
    urls = urls.drop("rule", "verdict")
    r = rules.groupBy(F.concat("rule_host", "rule_path").alias("_rule")).agg(F.max("rule_verdict").alias("_v")).withColumn("_h", F.xxhash64("_rule"))
    lengths = rules.agg(F.sort_array(F.collect_set(F.length("rule_path"))).alias("n")).first()["n"]  # path lengths: a few hundred at most
    labels = F.split("_host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat_ws(".", F.slice(labels, k, F.size(labels))))
    p = urls.where("host <> '' and path is not null").select(F.col("host").alias("_host"), F.col("path").alias("_path")).distinct()
    fit = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("_path"))
    p = p.select("_host", "_path", F.explode(suffixes).alias("_suffix"), fit.alias("_fit")).select("_host", "_path", "_suffix", F.explode("_fit").alias("_n"))
    p = p.select("_host", "_path", F.length("_suffix").alias("_s"), F.expr("concat(_suffix, left(_path, _n))").alias("_probe")).withColumn("_g", F.xxhash64("_probe"))
    hits = p.join(r, (p["_g"] == r["_h"]) & (p["_probe"] == r["_rule"])).groupBy("_host", "_path").agg(F.max_by(F.struct("_rule", "_v"), F.struct(F.length("_rule"), "_s")).alias("_x"))
    host, path, best = unused(urls.columns, "_host", "_path", "_x")
    hits = hits.toDF(host, path, best)
    out = urls.join(hits, (urls["host"] == hits[host]) & (urls["path"] == hits[path]), "left")
    return out.withColumn("rule", F.col(best)["_rule"]).withColumn("verdict", F.coalesce(F.col(best)["_v"], F.lit(default))).drop(best, host, path)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict; a null url has neither host nor rule and is allowed (see match_rules)."""
    host, path = split_url(F.col("url"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", host.alias("host"), path.alias("path"))
    return match_rules(pages).select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = r"""
WITH r(rh, rp, v) AS (VALUES ('com','/','allow'), ('example.com','/en/','block'), ('www.example.com','/en/','allow'), ('net','/es/','block'), ('net','/fr/','block')),
t AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS tail FROM pages),
u AS (SELECT page_id, translate(regexp_extract(tail, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(tail, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM t),
m AS (SELECT u.page_id, max_by(rh || rp, length(rh || rp)) AS rule, max_by(v, length(rh || rp)) AS v
      FROM u JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY 1)
SELECT u.page_id, host, path, m.rule AS rule, coalesce(m.v, 'allow') AS verdict FROM u LEFT JOIN m USING (page_id)
"""
