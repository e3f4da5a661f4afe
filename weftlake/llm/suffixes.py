"""Suffix-array dedup of bytes by prefix-free parsing, in exchanges that each carry a dictionary and not the corpus.

Triggers: a rolling hash of 20 bytes is taken at every place, and the least one in a 50-byte string is that string's
trigger. Every 50-byte string holds one, and equal strings hold equal ones. A phrase is a maximal stretch whose 50-byte
strings share a trigger (cut after 256 of them); neighbouring phrases overlap by 49 bytes, so each 50-byte prefix of a
suffix lies in one phrase, and the order of the corpus's suffixes, to 50 bytes, follows from the parse (which phrase
stands where) and the dictionary (the order of the suffixes of its phrases):

1. the parse, by trigger: only triggers of two or more documents go on (a hash that meets another by chance lets more
   through, and decides nothing);
2. the dictionary, by phrase (128-bit names of their bytes): the first document of each distinct phrase. All copies of
   a phrase are settled by it, and so is a phrase whose trigger has no other phrase;
3. the other phrases of the dictionary, each once, as bytes, triggers together: a suffix array of these phrases by prefix
   doubling (ranks of 8, 16, 32 and then 50 bytes), in which equal ranks are an interval whose common prefix is 50 bytes
   or longer. Its first document keeps the string, every other one loses it.

A trigger that stands at very many places (a short stretch that a third of all documents hold, each among other words) would
put as many phrases into one task. Its strings are named one by one instead (128 bits) and dealt by their names.

An exchange holds each name once for each batch of documents, so a passage that a third of all documents share costs a
third of the batches, not of the rows, and no task gathers its places. Batches are of 8 MB and a task's share of the names
is that of 16 MB of text, so an exchange has a row for each pair of them: 20 million rows for 50 GB, of 170 names each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import drop, free_shuffles, table, trimmed

TRIGGER, RUN = 20, 256
BATCH, SEGMENT, SHARE = 8 << 20, 1 << 18, 16 << 20
#: Places (about) from which on a trigger's strings are dealt one by one, and bytes of the dictionary that are sorted together.
HOT, SORTED = 1 << 13, 1 << 20
NO_ID = (1 << 63) - 1  # stands for a null doc_id: no document is later
_B = 0x9E3779B97F4A7C15 | 1
_tables: dict[int, tuple] = {}


def _powers(n: int):
    """(hash of each byte, B^j, B^-j) for j < n, modulo 2^64."""
    import numpy as np

    if not _tables or next(iter(_tables)) < n:
        inverse = pow(_B, -1, 1 << 64)
        with np.errstate(over="ignore"):
            up, down = np.full(n, _B, "u8"), np.full(n, inverse, "u8")
            up[0] = down[0] = 1
            up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        _tables.clear()
        _tables[n] = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype="u8"), up, down
    return next(iter(_tables.values()))


def _mix(x):
    import numpy as np

    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _segments(data, ends, length: int):
    """(first place, bytes, prefix sums, B^-j, for each place whether length bytes of its document start there) in pieces of bounded size."""
    import numpy as np

    n = len(data)
    for lo in range(0, n, SEGMENT):
        hi = min(lo + SEGMENT, n)
        part = data[lo : min(hi + RUN + length, n)]
        byte, up, down = _powers(SEGMENT + RUN + length + 1)
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(byte[part] * up[: len(part)], dtype="u8")])
        end = ends[np.searchsorted(ends, np.arange(lo, hi), "right")]
        yield lo, part, sums, down, end - np.arange(lo, hi) >= length, end


def phrases(data, ends, length: int):
    """Of documents joined (ends: where each ends): of each phrase its first place, number of strings and trigger."""
    import numpy as np

    out = []
    for lo, part, sums, down, fits, end in _segments(data, ends, length):
        n = len(fits)
        with np.errstate(over="ignore"):
            k = len(part) - TRIGGER + 1
            if k < 1 or not fits.any():
                continue
            low = _mix((sums[TRIGGER : TRIGGER + k] - sums[:k]) * down[:k])
            width, span = length - TRIGGER + 1, 1
            while span < width:
                step = min(span, width - span)
                low = np.minimum(low[:-step], low[step:])
                span += step
            low = low[:n]
            fits = fits[: len(low)]
            new = np.ones(len(low), bool)
            new[1:] = (low[1:] != low[:-1]) | (end[1 : len(low)] != end[: len(low) - 1]) | (fits[1:] != fits[:-1])
            start = np.nonzero(new)[0]
            size = np.diff(np.append(start, len(low)))
            keep = fits[start]
            start, size = start[keep], size[keep]
            pieces = -(-size // RUN)
            nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start, size = np.repeat(start, pieces) + nth * RUN, np.minimum(np.repeat(size, pieces) - nth * RUN, RUN)
            out.append((start + lo, size, _mix(low[start] + np.uint64(1))))
    if not out:
        return np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0, "u8")
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def triggers(data, start, length: int):
    """phrases' trigger of the string at each start."""
    import numpy as np

    byte, up, down = _powers(SEGMENT + RUN + length + 1)
    out, width = np.empty(len(start), "u8"), length - TRIGGER + 1
    with np.errstate(over="ignore"):
        for lo in range(0, len(start), 1 << 13):
            at = start[lo : lo + (1 << 13)]
            sums = np.zeros((len(at), length + 1), "u8")
            np.cumsum(byte[data[at[:, None] + np.arange(length)[None, :]]] * up[:length], axis=1, out=sums[:, 1:])
            out[lo : lo + len(at)] = _mix(_mix((sums[:, TRIGGER:] - sums[:, :width]) * down[:width]).min(axis=1) + np.uint64(1))
    return out


def digests(data, start, stop):
    """128-bit names of the bytes from start to stop: [n, 2]."""
    import numpy as np
    import xxhash

    f, m = xxhash.xxh3_128_digest, memoryview(data)
    return np.frombuffer(b"".join(f(m[a:b]) for a, b in zip(start.tolist(), stop.tolist(), strict=True)), "u8").reshape(-1, 2).copy()


def ranks(data, begin, length: int):
    """Of phrases joined (begin: where each begins, the end of all last): for every place the rank of the `length` bytes that
    start there among all such strings, by prefix doubling; -1 where the phrase holds fewer."""
    import numpy as np

    n = len(data)
    left = np.repeat(begin[1:], np.diff(begin)) - np.arange(n)
    key, have = np.zeros(n, "u8"), min(8, length)
    for k in range(have):  # big-endian, so that ranks are in the order of the bytes
        key[: n - k] = key[: n - k] << np.uint64(8) | data[k:]
        if k:
            key[n - k :] <<= np.uint64(8)
    while True:
        fits = np.nonzero(left >= have)[0]
        _, back = np.unique(key[fits], return_inverse=True)
        rank = np.full(n, -1)
        rank[fits] = back
        if have == length:
            return rank
        step = min(have, length - have)
        have += step
        fits = np.nonzero(left >= have)[0]
        key = np.zeros(n, "u8")
        key[fits] = rank[fits].astype("u8") * np.uint64(len(rank) + 1) + rank[fits + step].astype("u8")


def _u8(x, kind="u8"):
    import numpy as np

    return np.frombuffer(x, kind)


def _unpack(row: dict):
    """(ids, ends, bytes) of a work row."""
    import numpy as np
    import pyarrow as pa

    ids, lens = _u8(row["ids"], "i8"), _u8(row["lens"], "i8")
    data = pa.decompress(row["text"], int(lens.sum()), codec="zstd", asbytes=True) if lens.sum() else b""
    return ids, np.cumsum(lens), np.frombuffer(data, "u1")


def _packed(batch_id, ids, texts) -> dict:
    import numpy as np
    import pyarrow as pa

    whole = b"".join(texts)
    return {"batch": batch_id, "ids": np.array(ids, "i8").tobytes(), "lens": np.fromiter(map(len, texts), "i8", len(texts)).tobytes(), "text": pa.compress(whole, codec="zstd", asbytes=True) if whole else b""}


def _rows(batches: Iterator) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield {n: b.column(k)[i].as_py() for k, n in enumerate(b.schema.names)}


def _emit(rows: Iterator[dict], schema) -> Iterator:
    import pyarrow as pa

    part, size = [], 0
    for r in rows:
        part.append(r)
        size += sum(len(v) for v in r.values() if isinstance(v, bytes))
        if size > 16 << 20 or len(part) >= 4096:
            yield pa.RecordBatch.from_pylist(part, schema=schema)
            part, size = [], 0
    if part:
        yield pa.RecordBatch.from_pylist(part, schema=schema)


def _map(df: DataFrame, f, fields: str) -> DataFrame:
    """mapInArrow for a function from a work row (dict) to rows (dicts)."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "done": pa.list_(pa.struct([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary()), ("kept_sha256", pa.string())]))}
        schema = pa.schema([(x.split()[0], kinds[x.split()[1] if not x.split()[1].startswith("array") else "done"]) for x in fields.split(", ")])
        yield from _emit((y for x in _rows(batches) for y in f(x)), schema)

    return df.mapInArrow(lambda batches: trimmed(run(batches)), fields.replace("array", DONE))


def _deal(df: DataFrame, f) -> DataFrame:
    """mapInArrow for a function from a work row to tables of the rows of an exchange."""
    def run(batches: Iterator) -> Iterator:
        yield from (y for x in _rows(batches) for y in f(x))

    return df.mapInArrow(lambda batches: trimmed(run(batches)), EXCHANGE)


#: A row of an exchange: names (and their second halves, or texts with lengths) of a batch for a bucket, with first documents.
EXCHANGE = "kind int, bucket int, batch long, names binary, more binary, lens binary, firsts binary"
DONE = "array<struct<doc_id:long,n_bytes:long,n_removed:long,spans:array<struct<start:long,end:long>>,kept:binary,kept_sha256:string>>"


def _narrow(x) -> bytes:
    """Document ids in 4 bytes each where they fit, else in 8."""
    return x.astype("u4" if len(x) and 0 <= x.min() and x.max() < 1 << 32 else "i8").tobytes()


def _wide(x: bytes, n: int):
    return _u8(x, "u4" if len(x) == 4 * n else "i8").astype("i8")


def _buckets(names, buckets: int):
    """The bucket of each name, by its high bits (in the order of the names)."""
    import numpy as np

    return ((names >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _binary(data, width):
    """A binary array of consecutive pieces of data (widths in bytes)."""
    import numpy as np
    import pyarrow as pa

    at = np.concatenate([[0], np.cumsum(width)]).astype("i4")
    return pa.Array.from_buffers(pa.binary(), len(width), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data)])


def _dealt(kind: int, batch_id: int, bucket, names, more=None, lens=None, firsts=None, texts=None):
    """The rows of one batch for one exchange: entries (ordered by bucket) cut where the bucket changes."""
    import numpy as np
    import pyarrow as pa

    if not len(names):
        return
    edge = np.concatenate([[0], np.nonzero(bucket[1:] != bucket[:-1])[0] + 1, [len(bucket)]])
    n = np.diff(edge)
    empty = _binary(b"", np.zeros(len(n), "i8"))
    if texts is not None:
        size = np.add.reduceat(texts[1], edge[:-1])
        more_col = _binary(texts[0], size)
    else:
        more_col = empty if more is None else _binary(more.tobytes(), n * 8)
    first_col = empty
    if firsts is not None:
        raw = _narrow(firsts)
        first_col = _binary(raw, n * (len(raw) // len(firsts)))
    cols = [pa.array(np.full(len(n), kind, "i4")), pa.array(bucket[edge[:-1]].astype("i4")), pa.array(np.full(len(n), batch_id, "i8")), _binary(names.tobytes(), n * names.itemsize), more_col, empty if lens is None else _binary(lens.tobytes(), n * lens.itemsize), first_col]
    yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in EXCHANGE.split(", ")])


def _groups(*keys):
    """Of entries by their keys (most significant last): the number of each one's group, groups by order, and how many there are."""
    import numpy as np

    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    group = np.empty(len(order), "i8")
    group[order] = np.cumsum(new)
    return group, int(new.sum()) + 1 if len(order) else 0


def _gather(key, t, length: int, hot: int, together: int):
    """What an exchange answers to each of its rows, in the row's order.

    kind 0, the parse, by 32 bits within the bucket: for each trigger the batches that hold it, 0 if only one document does, and HOT_BIT if it stands
    at very many places. Kind 1, names of phrases: a bit, whether an earlier document than the row's has the name, and for
    the others the batches in which the phrase is its trigger's only one. Kind 2, names of strings: the bit alone. Kind 3,
    phrases as bytes: the bit for each string in them.
    """
    import numpy as np
    import pyarrow as pa

    t = t.combine_chunks()
    kind, rows = key[0].as_py(), t.num_rows
    col = lambda c: [x.as_buffer() for x in t.column(c)]
    wide = "u8" if kind in (1, 2) else "u4"
    names = [_u8(x, wide) for x in col("names")]
    sizes = np.array([len(x) for x in names])
    at = np.append(0, np.cumsum(sizes))
    every = np.concatenate(names)
    out = []
    if kind == 0:
        code = np.concatenate([_u8(x, "u1") for x in col("lens")]).astype("i8")
        u, back = np.unique(every, return_inverse=True)
        many = np.bincount(back, minlength=len(u))
        shared = (many > 1) | (np.bincount(back, weights=code & 1, minlength=len(u)) > 0)
        places = np.bincount(back, weights=1 << (code >> 1), minlength=len(u))
        count = np.where(shared, many | np.where(places > hot, HOT_BIT, 0), 0).astype("u4")[back]
        for a, b in zip(at[:-1], at[1:], strict=True):
            c = count[a:b]
            out.append(np.packbits(c > 0).tobytes() + c[c > 0].tobytes())
    else:
        docs = np.concatenate([_wide(x.to_pybytes(), k) for x, k in zip(col("firsts"), sizes, strict=True)])
        if kind == 3:
            lens = np.concatenate([_u8(x, "u2") for x in col("lens")]).astype("i8")
            text = np.concatenate([_u8(x, "u1") for x in col("more")])
            start = np.append(0, np.cumsum(lens + length - 1))
            later = np.zeros(int(lens.sum()), bool)
            place = np.append(0, np.cumsum(lens))
            order = np.argsort(every, kind="stable")
            trigger = every[order]
            # blocks of whole triggers, of about so many bytes
            edge = np.append(np.nonzero(np.concatenate([[True], trigger[1:] != trigger[:-1]]))[0], len(order))
            filled = np.append(0, np.cumsum((lens + length - 1)[order]))[edge]
            cut = np.unique(np.searchsorted(filled, np.arange(0, filled[-1] + together, together)).clip(max=len(edge) - 1))
            for lo, hi in zip(edge[cut[:-1]], edge[cut[1:]], strict=True):
                of = order[lo:hi]
                begin = np.append(0, np.cumsum((lens + length - 1)[of]))
                piece = np.concatenate([text[start[i] : start[i + 1]] for i in of])
                rank = ranks(piece, begin, length)
                own = np.repeat(np.arange(len(of)), np.diff(begin))[rank >= 0]
                rank = rank[rank >= 0]
                least = np.full(rank.max() + 1, NO_ID)
                np.minimum.at(least, rank, docs[of][own])
                to = np.repeat(place[of] - np.append(0, np.cumsum(lens[of]))[:-1], lens[of]) + np.arange(len(rank))
                later[to] = least[rank] < docs[of][own]
            at = place[at]
        else:
            more = np.concatenate([_u8(x) for x in col("more")])
            flag = (more & np.uint64(1)).astype("i8")
            back, n = _groups(more >> np.uint64(1), every)
            least = np.full(n, NO_ID)
            np.minimum.at(least, back, docs)
            later = least[back] < docs
        for a, b in zip(at[:-1], at[1:], strict=True):
            out.append(np.packbits(later[a:b]).tobytes())
        if kind == 1:
            sole = np.bincount(back, weights=flag, minlength=n).astype("u4")[back]
            out = [x + sole[a:b][~later[a:b]].tobytes() for x, a, b in zip(out, at[:-1], at[1:], strict=True)]
    return pa.table({"kind": t.column("kind"), "bucket": t.column("bucket"), "to": t.column("batch"), "size": pa.array(np.diff(at).astype("i4")), "answer": pa.array(out, pa.binary())})


def _exchange(rows: DataFrame, length: int, hot: int = HOT, together: int = SORTED) -> DataFrame:
    """(to: the batch, answers: those to its rows, in their order)."""
    def gather(key, t):
        return _gather(key, t, length, hot, together)

    told = rows.groupBy("kind", "bucket").applyInArrow(gather, "kind int, bucket int, to long, size int, answer binary")
    out = table(told.groupBy("to").agg(F.sort_array(F.collect_list(F.struct("kind", "bucket", "size", "answer"))).alias("answers")), "answers", 8)
    free_shuffles(rows.sparkSession)  # the exchange itself, before its answers are joined
    return out


def _bits(row, kind: int):
    """The bits of the answers of a kind, one after another, and for kinds 0 and 1 the numbers that follow them."""
    import numpy as np

    bits, numbers = [np.zeros(0, bool)], [np.zeros(0, "u4")]
    for a in row["answers"] or []:
        if a["kind"] == kind:
            n = a["size"]
            x = np.unpackbits(_u8(a["answer"][: (n + 7) // 8], "u1"))[:n] > 0
            bits.append(x)
            if kind < 2:
                c = np.zeros(n, "u4")
                c[x if kind == 0 else ~x] = _u8(a["answer"][(n + 7) // 8 :], "u4")
                numbers.append(c)
    return np.concatenate(bits), np.concatenate(numbers)


HOT_BIT = 1 << 31


def remove_repeats(docs: DataFrame, length: int = 50, key: str = "doc_id", text: str = "text", with_kept: bool = True, batch: int = BATCH, share: int = SHARE, hot: int = HOT, together: int = SORTED) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, spans (the maximal removed runs: start, end), kept (the bytes left;
    null unless with_kept) and kept_sha256. Bytes covered by a string of `length` bytes that also starts in a document with a smaller key go.

    Null texts are empty, and texts shorter than length lose nothing. Rows without a key come back with a null key and
    count as later than all; rows of one key count as one document; an empty table gives an empty result; other columns
    are ignored. Phrases are equal by 128-bit names (n distinct ones meet by chance with odds n*n/2^128), strings by their
    bytes, but for those of hot triggers, which go by 128-bit names too.
    """
    spark = docs.sparkSession

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        def rows():
            ids, texts, size, seq, task = [], [], 0, 0, TaskContext.get().partitionId()
            for b in batches:
                for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                    ids.append(NO_ID if i is None else i)
                    texts.append(raw)
                    size += len(raw)
                    if size >= batch:
                        yield _packed(task << 32 | seq, ids, texts) | {"bytes": size}
                        ids, texts, size, seq = [], [], 0, seq + 1
            if ids:
                yield _packed(task << 32 | seq, ids, texts) | {"bytes": size}

        yield from _emit(rows(), pa.schema([("batch", pa.int64()), ("ids", pa.binary()), ("lens", pa.binary()), ("text", pa.binary()), ("bytes", pa.int64())]))

    w = table(docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(work, "batch long, ids binary, lens binary, text binary, bytes long"), "work")
    total = w.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(16, total // share)

    def doc_of(ids, ends, start):
        import numpy as np

        return ids[np.searchsorted(ends, start, "right")]

    def level1(row):
        import numpy as np

        ids, ends, data = _unpack(row)
        start, _, trigger = phrases(data, ends, length)
        if not len(start):
            return
        docs = doc_of(ids, ends, start)
        name = trigger >> np.uint64(5)
        order = np.argsort(name, kind="stable")
        n, d = name[order], docs[order]
        first = np.concatenate([[True], n[1:] != n[:-1]])
        at = np.nonzero(first)[0]
        places = np.diff(np.append(at, len(n)))
        several = np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at)
        code = np.minimum(np.ceil(np.log2(places)).astype("u1"), 15) << 1 | several.astype("u1")
        yield from _dealt(0, row["batch"], _buckets(n[at] << np.uint64(5), buckets), n[at].astype("u4"), None, code.astype("u1"))

    answers = _exchange(_deal(w.select("batch", "ids", "lens", "text"), level1), length, hot)

    def level1_told(row):
        import numpy as np

        ids, ends, data = _unpack(row)
        start, size, trigger = phrases(data, ends, length)
        trigger = trigger >> np.uint64(5) << np.uint64(5)
        count = _bits(row, 0)[1][np.unique(trigger, return_inverse=True)[1]] if len(start) else np.zeros(0, "u4")
        live = count > 0
        start, size, trigger, count = (x[live] for x in (start, size, trigger, count))
        # is a phrase the only one of its trigger in this batch
        phrase = digests(data, start, start + size - 1 + length)
        number, n = _groups(phrase[:, 1], phrase[:, 0])
        sole = np.zeros(len(start), bool)
        if n:
            u, t = np.unique(trigger, return_inverse=True)
            least, most = np.full(len(u), n), np.full(len(u), -1)
            np.minimum.at(least, t, number)
            np.maximum.at(most, t, number)
            sole = (least == most)[t]
        doc = np.searchsorted(ends, start, "right")
        pending = np.zeros(len(ids), bool)
        pending[doc] = True
        begin = np.append(0, ends[:-1])
        raw = data.tobytes()
        texts = [raw[begin[i] : ends[i]] for i in range(len(ids))]
        done = [{"doc_id": None if ids[i] == NO_ID else int(ids[i]), "n_bytes": len(texts[i]), "n_removed": 0, "spans": [], "kept": texts[i] if with_kept else None, "kept_sha256": hashlib.sha256(texts[i]).hexdigest()} for i in np.nonzero(~pending)[0]]
        shift = np.cumsum(np.where(pending, 0, ends - begin))  # what goes before a pending document
        start = start - shift[doc]
        some = np.nonzero(pending)[0]
        yield _packed(row["batch"], ids[some], [texts[i] for i in some]) | {"gap": np.diff(start, prepend=0).astype("u4").tobytes(), "size": size.astype("u2").tobytes(), "sole": np.packbits(sole).tobytes(), "count": count.tobytes(), "done": done}

    kept = "batch long, ids binary, lens binary, text binary"
    v = table(_map(w.drop("bytes").join(answers, F.col("batch") == F.col("to"), "left").drop("to"), level1_told, f"{kept}, gap binary, size binary, sole binary, count binary, done array"), "parse", 8)
    drop(w, answers)
    free_shuffles(spark)

    def distinct(row):
        """Of a parse row: (high, low) names of the distinct phrases in order, the number of each place's phrase, the first document of each distinct one, the first place of each, each place's document and start, the bytes."""
        import numpy as np

        ids, ends, data = _unpack(row)
        start = np.cumsum(_u8(row["gap"], "u4").astype("i8"))
        phrase = digests(data, start, start + _u8(row["size"], "u2") - 1 + length)
        docs = doc_of(ids, ends, start)
        high, low = phrase[:, 0], phrase[:, 1] | np.uint64(1)
        number, n = _groups(low, high)
        at = np.empty(n, "i8")
        at[number] = np.arange(len(number))
        first = np.full(n, NO_ID)
        np.minimum.at(first, number, docs)
        return high[at], low[at], number, first, at, docs, start, data

    def level2(row):
        import numpy as np

        if len(row["gap"]):
            high, low, number, first, at, *_ = distinct(row)
            sole = np.unpackbits(_u8(row["sole"], "u1"))[: len(number)][at] > 0
            yield from _dealt(1, row["batch"], _buckets(high, buckets), high, low - (~sole).astype("u8"), None, first)

    answers2 = _exchange(_deal(v.select("batch", "ids", "lens", "text", "gap", "size", "sole"), level2), length)

    def level2_told(row):
        import numpy as np

        size, count = _u8(row["size"], "u2"), _u8(row["count"], "u4")
        start = np.zeros(len(size), "i8")
        later, ask = np.zeros(len(start), bool), np.zeros(len(start), bool)
        number, one = np.zeros(len(start), "i8"), np.zeros(0, "i8")
        if len(start):
            _, _, number, first, _, docs, start, data = distinct(row)
            earlier, sole = _bits(row, 1)
            later = earlier[number] | (first[number] < docs)
            ask = ~later & (sole[number] != count & (HOT_BIT - 1))
            # of the asked places of a phrase, all of one document, the first stands for them
            asked = np.nonzero(ask)[0]
            u, one, back = np.unique(number[asked], return_index=True, return_inverse=True)
            one, number = asked[one], back
        hot = count[one] >= HOT_BIT
        trigger = triggers(data, start[one], length) >> np.uint64(5) << np.uint64(5) if len(one) else np.zeros(0, "u8")
        # what the phrases with an earlier copy cover, as runs
        a, b = start[later], start[later] + size[later] - 1 + length
        head = np.ones(len(a), bool)
        head[1:] = a[1:] > b[:-1]
        a, b = a[head], b[np.append(np.nonzero(head)[0][1:] - 1, len(b) - 1)] if len(b) else b
        yield {c: row[c] for c in ("batch", "ids", "lens", "text")} | {"gone_start": a.tobytes(), "gone_end": b.tobytes(), "ask_start": start[ask].tobytes(), "ask_number": number.astype("u4").tobytes() if len(one) else b"", "one_start": start[one].tobytes(), "one_size": size[one].tobytes(), "one_trigger": trigger.tobytes(), "one_hot": hot.astype("u1").tobytes()}

    asks = "ask_start binary, ask_number binary, one_start binary, one_size binary, one_trigger binary, one_hot binary"
    u = table(_map(v.drop("done", "sole").join(answers2, F.col("batch") == F.col("to"), "left").drop("to"), level2_told, f"{kept}, gone_start binary, gone_end binary, {asks}"), "dictionary", 8)
    done = table(v.select(F.explode("done").alias("x")).select("x.*"), "done")
    drop(v, answers2)
    free_shuffles(spark)

    def asked(row):
        """Of a dictionary row: for the hot phrases and the others, in the order in which they are dealt: numbers, starts, sizes, triggers."""
        import numpy as np

        start, size, trigger, hot = _u8(row["one_start"], "i8"), _u8(row["one_size"], "u2").astype("i8"), _u8(row["one_trigger"]), _u8(row["one_hot"], "u1") > 0
        h = np.nonzero(hot)[0]
        c = np.nonzero(~hot)[0]
        c = c[np.argsort(trigger[c], kind="stable")]
        return (h, start[h], size[h]), (c, start[c], size[c], trigger[c])

    def spread(start, size):
        """The places start, start + 1, ... (size of them) of each entry."""
        import numpy as np

        return np.repeat(start - np.append(0, np.cumsum(size))[:-1], size) + np.arange(size.sum())

    def hot_strings(data, ids, ends, start, size):
        """Of the strings of the hot phrases: the number of each one's distinct name, and the names in order with their first documents."""
        import numpy as np

        p = spread(start, size)
        names = digests(data, p, p + length)
        high, low = names[:, 0], names[:, 1] | np.uint64(1)
        number, n = _groups(low, high)
        at = np.empty(n, "i8")
        at[number] = np.arange(len(number))
        docs, first = doc_of(ids, ends, p), np.full(n, NO_ID)
        np.minimum.at(first, number, docs)
        return number, high[at], low[at], first, docs

    def level3(row):
        import numpy as np

        if not len(row["one_start"]):
            return
        ids, ends, data = _unpack(row)
        (_, hot_start, hot_size), (_, start, size, trigger) = asked(row)
        if len(hot_start):
            _, high, low, first, _ = hot_strings(data, ids, ends, hot_start, hot_size)
            yield from _dealt(2, row["batch"], _buckets(high, buckets), high, low, None, first)
        if len(start):
            raw = data.tobytes()
            text = b"".join([raw[a:b] for a, b in zip(start.tolist(), (start + size + length - 1).tolist(), strict=True)])
            yield from _dealt(3, row["batch"], _buckets(trigger, buckets), (trigger >> np.uint64(5)).astype("u4"), None, size.astype("u2"), doc_of(ids, ends, start), (text, size + length - 1))

    answers3 = _exchange(_deal(u.select("batch", "ids", "lens", "text", *[x.split()[0] for x in asks.split(", ")]), level3), length, hot, together)

    def level3_told(row):
        import numpy as np

        ids, ends, data = _unpack(row)
        cover = np.zeros(len(data) + 1, "i8")

        def cut(a, b):
            np.add.at(cover, a, 1)
            np.add.at(cover, b, -1)

        cut(_u8(row["gone_start"], "i8"), _u8(row["gone_end"], "i8"))
        if len(row["one_start"]):
            (hot, hot_start, hot_size), (cold, _, cold_size, _) = asked(row)
            size = _u8(row["one_size"], "u2").astype("i8")
            at = np.append(0, np.cumsum(size))
            later = np.zeros(at[-1], bool)  # for each string of each phrase that was asked for
            if len(hot):
                number, _, _, first, docs = hot_strings(data, ids, ends, hot_start, hot_size)
                later[spread(at[hot], hot_size)] = _bits(row, 2)[0][number] | (first[number] < docs)
            if len(cold):
                later[spread(at[cold], cold_size)] = _bits(row, 3)[0]
            number = _u8(row["ask_number"], "u4")
            of, p = spread(at[number], size[number]), spread(_u8(row["ask_start"], "i8"), size[number])
            p = p[later[of]]
            cut(p, p + length)
        gone = np.cumsum(cover[:-1]) > 0
        out, begin = [], 0
        for i, end in zip(ids, ends, strict=True):
            g = gone[begin:end]
            turns = np.nonzero(np.diff(np.concatenate([[0], g.astype("i1"), [0]])))[0].reshape(-1, 2)
            left = data[begin:end][~g].tobytes()
            out.append({"doc_id": None if i == NO_ID else int(i), "n_bytes": int(end - begin), "n_removed": int(np.count_nonzero(g)), "spans": [{"start": int(a), "end": int(b)} for a, b in turns], "kept": left if with_kept else None, "kept_sha256": hashlib.sha256(left).hexdigest()})
            begin = end
        yield {"done": out}

    last = _map(u.join(answers3, F.col("batch") == F.col("to"), "left").drop("to"), level3_told, "done array")
    free_shuffles(spark)
    return done.union(last.select(F.explode("done").alias("x")).select("x.*"))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes, removed bytes and runs, and the hash of what is left (see remove_repeats for nulls, ties and repeats)."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_kept=False)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
