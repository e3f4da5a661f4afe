"""Best-fit packing: items above a third of the capacity are matched in pairs, smaller ones fill the tightest gaps.

Lengths are small whole numbers, so the packing is worked out on their histogram (capacity numbers, whatever the
corpus holds) and gives patterns with multiplicities; every piece then finds its place from its rank among the
pieces of its length, which needs counts by task and length and no global sort.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import table, trimmed

END_ID = 2
SPECIAL = "<|endoftext|>"


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """counts: pieces by length (1..capacity). Patterns (bins, [(length, pieces of it in each bin)])."""
    left = {n: c for n, c in counts.items() if c > 0}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError("lengths must lie in 1..capacity")
    third = capacity // 3
    gaps: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}  # gap: (bins, pattern)
    large = sorted(n for n in left if n > third)

    def put(bins: int, pattern: list[tuple[int, int]], gap: int) -> None:
        gaps.setdefault(gap, []).append((bins, pattern))

    while large:
        n = large[-1]
        at = bisect_left(large, capacity - n + 1) - 1  # the largest partner that fits
        if at < 0:
            put(left[n], [(n, 1)], capacity - n)
            large.pop()
            continue
        p = large[at]
        k = left[n] // 2 if p == n else min(left[n], left[p])
        if k:
            put(k, [(n, 2)] if p == n else [(n, 1), (p, 1)], capacity - n - p)
        left[n] -= k
        left[p] -= k
        if p == n and left[n]:
            # an odd one over: its partner is the next smaller
            if at > 0:
                q = large[at - 1]
                put(1, [(n, 1), (q, 1)], capacity - n - q)
                left[q] -= 1
                if not left[q]:
                    large.pop(at - 1)
            else:
                put(1, [(n, 1)], capacity - n)
            left[n] = 0
        large = [x for x in large if left[x]]
    order = sorted(gaps)
    for s in sorted((n for n in left if n <= third), reverse=True):
        c = left[s]
        while c:
            at = bisect_left(order, s)
            if at == len(order):
                m = capacity // s
                bins, over = divmod(c, m)
                fresh = [(bins, m)] * bool(bins) + [(1, over)] * bool(over)
                for b, each in fresh:
                    g = capacity - each * s
                    put(b, [(s, each)], g)
                    if g not in order:
                        insort(order, g)
                break
            g = order[at]
            bins, pattern = gaps[g].pop()
            if not gaps[g]:
                del gaps[g]
                order.pop(at)
            m = g // s
            full = min(bins, c // m)
            parts = [(full, m)] * bool(full)
            c -= full * m
            bins -= full
            if bins and c:  # fewer than m pieces left: the last bin takes them
                parts.append((1, c))
                bins -= 1
                c = 0
            if bins:
                parts.append((bins, 0))
            for b, each in parts:
                h = g - each * s
                put(b, pattern + [(s, each)] * bool(each), h)
                if h not in order:
                    insort(order, h)
    return [x for g in sorted(gaps) for x in gaps[g]]


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """pieces(..., length, task, nth): adds sequence_id and offset.

    task and nth number the pieces of one length within the task that made them, and must be read from a written
    table. Equal lengths are interchangeable, so ties and repeated rows just take the next place. An empty table gives
    an empty result. To the driver go at most capacity counts; back go the patterns, a few for each length.
    """
    spark = pieces.sparkSession
    by_task = table(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    starts: list[tuple[int, int, int, int, int]] = []  # length, first rank, first sequence, pieces a bin, first offset
    seen: dict[int, int] = {}
    base = 0
    for bins, pattern in plan_bins(counts, capacity):
        at = 0
        for n, each in pattern:
            starts.append((n, seen.get(n, 0), base, each, at))
            seen[n] = seen.get(n, 0) + bins * each
            at += n * each
        base += bins
    starts.sort()
    sent = spark.sparkContext.broadcast(starts)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = table(by_task.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select(F.col("task").alias("t"), F.col("length").alias("l"), "before"), "ranks")
    # ranks grow with the tasks: merged at every size, never broadcast
    ranked = pieces.join(first.hint("merge"), (pieces.task == first.t) & (pieces.length == first.l)).withColumn("rank", F.col("before") + F.col("nth")).drop("t", "l", "before", "task", "nth")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name != "rank")

    def place(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        a = np.array(sent.value, dtype="i8").reshape(-1, 5)
        for batch in batches:
            n, r = batch.column("length").to_numpy(zero_copy_only=False), batch.column("rank").to_numpy(zero_copy_only=False)
            i = np.zeros(len(n), "i8")
            for size in np.unique(n):
                of = n == size
                lo, hi = np.searchsorted(a[:, 0], size, "left"), np.searchsorted(a[:, 0], size, "right")
                i[of] = lo + np.searchsorted(a[lo:hi, 1], r[of], "right") - 1
            k = r - a[i, 1]
            keep = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(a[i, 2] + k // a[i, 3]), pa.array(a[i, 4] + k % a[i, 3] * n)], [*keep, "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


class Encoder:
    """Ids of the byte-level vocabulary. The rank form of the same vocabulary is five times as fast and gives the same
    ids; a text that holds the special token's string goes to the tokenizers library, which reads it as that token."""

    def __init__(self, folder: str | None = None):
        import base64

        import public_tokenizers as P
        import tiktoken

        at = (lambda name: f"{folder}/{name}") if folder else P.path
        with open(at("byte_bpe_50k.tiktoken")) as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
        self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.json, self.slow = at("byte_bpe_50k.json"), None

    def ids(self, text: str):
        import numpy as np

        if SPECIAL not in text:
            return self.fast.encode_to_numpy(text, disallowed_special=())
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.json)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")


def token_pieces(docs: DataFrame, capacity: int = 1024, key: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """docs(key, text) cut into pieces of at most capacity ids: key, piece, start, length, ids_crc32, task, nth.

    A document is its ids and END_ID (null text: END_ID alone). Only a longer one is cut, its first piece being the
    shorter. folder holds the vocabulary files (default: the installed ones).
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        task, nth, enc = TaskContext.get().partitionId(), {}, Encoder(folder)
        for batch in batches:
            out: list[tuple] = []
            keys = batch.column(key)
            for k, t in enumerate(batch.column(text)):
                t = t.as_py()
                ids = np.append(enc.ids(t) if t else np.empty(0, "<u4"), np.uint32(END_ID)).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                start = 0
                for piece, end in enumerate(range(first, len(ids) + 1, capacity)):
                    n = end - start
                    seen = nth.get(n, 0)
                    nth[n] = seen + 1
                    out.append((k, piece, start, n, zlib.crc32(ids[start:end].tobytes()), task, seen))
                    start = end
            cols = list(zip(*out, strict=True)) if out else [()] * 7
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(cols[0], pa.int64())), *(pa.array(c, t) for c, t in zip(cols[1:], types, strict=True))], ["key", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return docs.select(key, text).mapInArrow(lambda batches: trimmed(run(batches)), f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, task int, nth long")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(table(token_pieces(docs), "pieces"))
