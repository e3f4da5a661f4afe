"""SimHash near-dedup: 64-bit fingerprints linked at 2 or fewer differing bits through Golay-code keys.

A fingerprint is cut into three segments of at most 22 bits. Two fingerprints that differ in at most 2 bits agree in
one segment wholly, and differ in the segment after it (cyclically) in at most 1 bit: errors (2,0,0), (0,2,0), (0,0,2),
(1,1,0), (1,0,1), (0,1,1) each leave such a neighbouring pair. So a key is the exact segment with the index of a Golay
codeword near the next one: the [23,12,7] code is perfect, every 23-bit word decodes to one codeword within 3 bits, and
a word's keys are those of itself and of the words 1 bit away (5 on average), so that two words 1 bit apart share one.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import minhash
from .common import components, delete_made, drop, free_shuffles, made, table, trimmed

SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, bits
GENERATOR = 0xAE3  # fixed: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
BITS = 2
#: Groups of one key up to this size are compared in one task; larger ones by words between (see below).
GROUP = 1024


def fingerprint(text: str | None) -> int:
    """Of a whole text: A-Z lowered, words joined by a space, three-word shingles with repeats, XXH64 with seed 42."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= 3:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    f, n = xxhash.xxh64_intdigest, len(words) - 2
    whole = memoryview(b" ".join(words))
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    return majority(np.fromiter((f(whole[a:b], 42) for a, b in zip(starts, ends[2:], strict=False)), "<u8", n))


def majority(h) -> int:
    """The bits that are set in over half of the hashes (none: 0)."""
    import numpy as np

    total = np.zeros(64, "i8")
    for lo in range(0, len(h), 1 << 16):
        part = np.ascontiguousarray(h[lo : lo + (1 << 16)])
        total += np.unpackbits(part.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
    return int(np.packbits(total * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and fp (the fingerprint's bits as a signed long)."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py()) for t in batch.column(text)), "u8", batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(fp.view("i8"))], [key, "fp"])

    return docs.select(key, text).mapInArrow(lambda batches: trimmed(run(batches)), f"`{key}` {kind}, fp long")


def _golay():
    """(syndromes of the low 12 bits, of the high 11 bits, error of each syndrome) of 23-bit words."""
    import itertools

    import numpy as np

    def rest(v: int) -> int:
        for i in range(22, 10, -1):
            if v >> i & 1:
                v ^= GENERATOR << (i - 11)
        return v

    error = np.zeros(2048, "i8")
    for weight in range(4):
        for bits in itertools.combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            error[rest(e)] = e
    return np.array([rest(v) for v in range(4096)], "i8"), np.array([rest(v << 12) for v in range(2048)], "i8"), error


def keys_of(fp):
    """Of an array of fingerprints: the arrays (place in fp, key), each pair once."""
    import numpy as np

    low, high, error = _golay()
    fp = fp.view("u8")
    seg = [((fp >> np.uint64(a)) & np.uint64((1 << n) - 1)).view("i8") for a, n in SEGMENTS]
    who, keys = [], []
    for a in range(3):
        b = (a + 1) % 3
        v = seg[b][:, None] ^ np.array([0, *(1 << i for i in range(SEGMENTS[b][1]))], "i8")[None, :]
        codeword = (v ^ error[low[v & 4095] ^ high[v >> 12]]) >> 11
        key = np.sort((np.int64(a) << 40) | (seg[a] << 12)[:, None] | codeword, axis=1)
        once = np.ones(key.shape, bool)
        once[:, 1:] = key[:, 1:] != key[:, :-1]
        i, _ = np.nonzero(once)
        who.append(i)
        keys.append(key[once])
    return np.concatenate(who), np.concatenate(keys)


def _forest(fp, rep):
    """Of one key's fingerprints: for those linked within the group, (rep, smallest rep of its part)."""
    import numpy as np

    n = len(fp)
    near = np.bitwise_count(fp.view("u8")[:, None] ^ fp.view("u8")[None, :]) <= BITS
    label = np.arange(n)
    while True:
        new = np.where(near, label[None, :], n).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    least = np.full(n, np.iinfo("i8").max)
    np.minimum.at(least, label, rep)
    return rep, least[label]


def links(prints: DataFrame, group: int = GROUP) -> DataFrame:
    """prints(fp, rep; one row a fingerprint): edges (a, b) of reps, enough to connect whatever is linked; never all pairs.

    Keys that two or more fingerprints share make groups. A group of up to `group` is compared in one task, and gives
    the edges of a forest. A larger one, as thousands of near copies make, is spread out again: two words differ in at
    most 2 bits exactly if some word differs in at most 1 bit from both, so each fingerprint gives itself and its 64
    neighbours, and an edge to the smallest rep that gave the same word. That is exact, and 65 rows each at any size.
    """
    def explode(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            fp, rep = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "rep"))
            who, key = keys_of(np.ascontiguousarray(fp))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[who]), pa.array(rep[who])], ["key", "fp", "rep"])

    def compare(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = [np.empty((2, 0), "i8")]
            for members in batch.column("members"):
                m = members.values
                a, b = _forest(*(np.ascontiguousarray(m.field(c).to_numpy(zero_copy_only=False)) for c in ("fp", "rep")))
                out.append(np.stack([a, b])[:, a != b])
            a, b = np.concatenate(out, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def between(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        flips = np.array([0, *(1 << i for i in range(64))], "u8")
        for batch in batches:
            fp, rep = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "rep"))
            words = (np.ascontiguousarray(fp).view("u8")[:, None] ^ flips[None, :]).ravel().view("i8")
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(np.repeat(rep, 65))], ["word", "rep"])

    keys = table(prints.mapInArrow(explode, "key long, fp long, rep long"), "keys")
    shared = table(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumnRenamed("key", "k"), "shared")
    near = table(keys.join(shared, keys.key == shared.k).select("key", "fp", "rep", "n"), "near")
    small = near.where(F.col("n") <= group).groupBy("key").agg(F.collect_list(F.struct("fp", "rep")).alias("members")).select("members").mapInArrow(compare, "a long, b long")
    words = table(near.where(F.col("n") > group).select("fp", "rep").distinct().mapInArrow(between, "word long, rep long"), "words")
    # only minima are shuffled and joined: a word that a whole group gave is one row on that side
    least = table(words.groupBy("word").agg(F.min("rep").alias("least"), F.count("*").alias("n")).where("n > 1").select(F.col("word").alias("w"), "least"), "least")
    large = words.join(least, words.word == least.w).where("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b"))
    return small.union(large).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """key, fp, component_id: the smallest key reachable over links of at most 2 bits, itself included.

    Equal fingerprints are one row from the start (copies are never paired). Null and wordless texts have fingerprint
    0 and are linked like any other; repeated keys share a class; null keys give a null class unless another row of
    the class has a key; an empty table gives an empty result; other columns are ignored.
    """
    since = len(made)
    d = table(fingerprints(docs, key, text), "fingerprints")
    prints = table(d.groupBy("fp").agg(F.min(key).alias("rep")).where("rep is not null"), "prints")
    found = components(links(prints, group))
    named = table(prints.join(found, prints.rep == found.node, "left").select(F.col("fp").alias("f"), F.coalesce("component", "rep").alias("component_id")), "classes")
    delete_made(docs.sparkSession, since, d, named)
    free_shuffles(docs.sparkSession)
    return d.join(named, d.fp == named.f, "left").select(F.col(key), "fp", "component_id")


def near_groups(docs: DataFrame, text: str = "text", words: int = minhash.WORDS, similarity: float = minhash.SIMILARITY, block: int = minhash.BLOCK, group: int = GROUP) -> DataFrame:
    """docs with row (long, one value a row) and near_group: equal where texts are joined by links of at least that Jaccard similarity of their sets of word shingles.

    Rows of equal shingle sets are one node from the start. Golay keys propose the nodes whose fingerprints (of the sets, as above) are linked at 2
    bits. At a similarity of 0.8 a bit differs with odds of about 0.15, so fingerprints of 64 bits differ in 10, out of reach of any
    such key; those pairs are proposed by MinHash bands: a node's 120 minima make 24 keys, and two sets of similarity J share one with odds
    1-(1-J^5)^24, 0.9999 at 0.8 and more above. Whole sets decide what is linked, key by key: first each node of a key against its least
    one; then, in keys whose nodes are not all in one group by that, those outside the key's largest group against all of the key, in blocks of
    nodes. So nodes that keys only chain together are never compared, copies of one text cost a comparison a key, and no pair is
    ever a row but that of a node with a key's least. Null and wordless texts are one group; repeated rows are in one
    group; an empty table gives an empty result; columns of docs named row or near_group are replaced.
    """
    columns = [c for c in docs.columns if c not in ("row", "near_group")]
    docs = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])  # whatever they are called
    text = f"c{columns.index(text)}"

    def sign(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        r = np.random.default_rng(17)
        flip, times = r.integers(0, 1 << 64, (2, minhash.BANDS * minhash.PER_BAND), "u8")
        times |= np.uint64(1)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                nodes, keys, prints = [], [], []
                for t in part.column(text):
                    s = minhash.shingles(t.as_py(), words)
                    nodes.append(xxhash.xxh64_intdigest(s.tobytes(), 7))
                    keys.append(np.array(minhash.band_keys(s, flip, times), "u8").view("i8"))
                    prints.append(majority(s))
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(np.array(nodes, "u8").view("i8")), pa.array(keys, pa.list_(pa.int64())), pa.array(np.array(prints, "u8").view("i8"))], ["row", "node", "keys", "fp"])

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = [minhash.shingles(t.as_py(), words).view("i8") for t in part.column(text)]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    def compare(pdf):
        import numpy as np
        import pyarrow as pa

        t = pdf.combine_chunks()
        nodes, at = np.unique(t.column("node").to_numpy(), return_index=True)  # rows come in any order; a node may ask and be asked
        shingles = t.column("shingles")
        link = minhash.near([shingles[int(i)].values.to_numpy().view("u8") for i in at], similarity)
        asks = np.isin(nodes, t.column("node").filter(t.column("asks")).to_numpy())
        a, b = np.nonzero(link & asks[:, None] & (nodes[:, None] != nodes[None, :]))
        least = np.arange(len(nodes))  # enough links to connect what is linked
        while True:
            new = least.copy()
            np.minimum.at(new, a, least[b])
            np.minimum.at(new, b, least[a])
            new = np.minimum(new, new[new])
            if (new == least).all():
                break
            least = new
        of = np.nonzero(least != np.arange(len(nodes)))[0]
        return pa.table({"a": nodes[of], "b": nodes[least[of]]})

    # written once, so that row is settled; later steps read only the columns they need
    rows = table(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    signed = table(rows.select("row", text).mapInArrow(lambda batches: trimmed(sign(batches)), "row long, node long, keys array<long>, fp long"), "signed")
    prints = table(signed.groupBy("fp").agg(F.min("node").alias("rep")), "prints")
    linked = components(links(prints, group)).withColumnsRenamed({"node": "l_node", "component": "l"})
    prints = table(prints.join(linked, F.col("rep") == F.col("l_node"), "left").select(F.col("fp").alias("f"), F.xxhash64(F.lit("fp"), F.coalesce("l", "rep")).alias("key")), "print-keys")
    keys = signed.select("node", F.explode("keys").alias("key")).union(signed.select("node", "fp").join(prints, F.col("fp") == F.col("f")).select("node", "key"))
    keys = table(keys.distinct(), "keys-of-nodes")
    shared = table(keys.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1").withColumnRenamed("key", "k"), "shared-keys")
    members = table(keys.join(shared.hint("merge"), keys.key == shared.k).select("key", "node", "least", "n"), "members")
    drop(keys, prints, shared)
    first = signed.groupBy("node").agg(F.min("row").alias("first")).join(members.select(F.col("node").alias("m_node")).distinct(), F.col("node") == F.col("m_node"), "left_semi")
    first = table(first, "candidate-rows")
    texts = rows.select("row", text).join(first.hint("merge"), F.col("row") == F.col("first")).select("node", text)
    sets = table(texts.mapInArrow(lambda batches: trimmed(cut(batches)), "node long, shingles array<long>"), "shingle-sets")
    drop(first)
    free_shuffles(docs.sparkSession)
    # each node against the least one of its keys
    pairs = table(members.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct(), "pairs")
    of = lambda c: sets.select(F.col("node").alias(f"{c}_node"), F.col("shingles").alias(f"s{c}"))
    pairs = pairs.join(of("a").hint("merge"), F.col("a") == F.col("a_node")).join(of("b").hint("merge"), F.col("b") == F.col("b_node"))
    both, common = F.size("sa") + F.size("sb"), F.size(F.array_intersect("sa", "sb"))
    close = F.least(F.size("sa"), F.size("sb")) >= F.greatest(F.size("sa"), F.size("sb")) * similarity - 1e-9  # else no intersection is large enough
    star = table(pairs.where(close & (common >= similarity * (both - common) - 1e-9)).select("a", "b"), "linked-to-least")
    free_shuffles(docs.sparkSession)
    # keys of several groups: those outside the largest one against all of the key
    joined = components(star).select(F.col("node").alias("j_node"), F.col("component").alias("j"))
    several = members.where("n > 2").join(joined.hint("merge"), F.col("node") == F.col("j_node"), "left").select("key", "node", "n", F.coalesce("j", "node").alias("j"))
    several = table(several, "members-joined")
    most = several.groupBy("key", "j").agg(F.count("*").alias("m")).groupBy("key").agg(F.count("*").alias("parts"), F.max_by("j", F.struct("m", "j")).alias("most"), F.sum("m").alias("n"), F.max("m").alias("m"))
    most = most.where("parts > 1").select(F.col("key").alias("k"), "most", F.ceil(F.col("n") / block).cast("int").alias("bn"), F.ceil((F.col("n") - F.col("m")) / block).cast("int").alias("br"))
    open_ = several.join(table(most, "open-keys").hint("merge"), F.col("key") == F.col("k")).select("key", "node", (F.col("j") != F.col("most")).alias("outside"), "bn", "br")
    i, j = (F.pmod(F.xxhash64(F.lit(n), "node"), F.col(c)).cast("int") for n, c in ((1, "bn"), (2, "br")))
    span = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    spread = open_.select("key", "node", i.alias("i"), F.explode(span("br")).alias("j"), F.lit(False).alias("asks"))
    spread = spread.union(open_.where("outside").select("key", "node", F.explode(span("bn")).alias("i"), j.alias("j"), F.lit(True)))
    tasks = sets.join(spread.withColumnRenamed("node", "s_node").hint("merge"), F.col("node") == F.col("s_node")).select("key", "i", "j", "asks", "node", "shingles")
    more = table(tasks.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long"), "linked-in-keys")
    found = components(star.union(more))
    drop(members, sets, star, several, more)
    free_shuffles(docs.sparkSession)
    found = table(found.select(F.col("node").alias("f_node"), "component"), "near-groups")
    out = signed.select("row", "node").join(found.hint("merge"), F.col("node") == F.col("f_node"), "left")
    out = table(out.select(F.col("row").alias("r"), F.coalesce("component", "node").alias("near_group")), "grouped")
    drop(signed, found)
    return rows.join(out.hint("merge"), F.col("row") == F.col("r")).drop("r").toDF(*columns, "row", "near_group")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and class (see near_duplicates for nulls, ties and repeats)."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
