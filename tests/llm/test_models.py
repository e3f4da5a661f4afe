"""Lattice scores, hard negatives and sort-means against brute force, on given tables and on odd rows."""

import collections
import hashlib
import itertools
import math
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_contracts import DATA, ODD

from weftlake.llm import lattice, negatives, points, queries as Q, sortmeans

SCHEMA = "doc_id long, text string, held long, word string"


def lattice_truth(docs, held):
    """doc -> (n_tokens, n_known, train_tokens, base, score), docs being (id, text)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=lattice.vocabulary())
    words = [(t or "").encode().lower().split() for _, t in docs]
    train = [w for (i, _), w in zip(docs, words, strict=True) if not held(i)]
    c = collections.Counter(x for w in train for x in w)
    n, v = sum(c.values()) + len(train), len(c) + bool(train)
    pieces = collections.Counter({sp.eos_id(): len(train)})
    for w, k in c.items():
        for p in sp.encode(w.decode()):
            pieces[p] += k
    arcs, end = lattice.arcs(lattice.vocabulary(), pieces)
    known = {}

    def word(w):
        if w not in known:
            b = "▁".encode() + w
            a = [0.0]  # by the end of an arc, where the operator goes by the start
            for j in range(1, len(b) + 1):
                ways = [a[i] + p for i in range(max(0, j - 48), j) if (p := arcs.get(b[i:j])) is not None]
                a.append(max(ways) + math.log(math.fsum(math.exp(x - max(ways)) for x in ways)))
            known[w] = a[-1] / math.log(10)
        return known[w]

    out = []
    for w in words:
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w) + math.log10((len(train) + 0.5) / (n + 0.5 * (v + 1)))
        out.append((len(w) + 1, sum(c[x] > 0 for x in w) + bool(train), n, base, sum(map(word, w)) + end / math.log(10)))
    return out


def close(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:-2] == w[:-2]
        assert g[-2:] == pytest.approx(w[-2:], rel=1e-9, abs=1e-9)


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def test_op11(spark, tmp_path):
    d = pq.read_table(f"{DATA}/documents.parquet").select(["doc_id", "text"])
    odd = [(i, t) for i, t in ODD if t is None or len(t) < 5000]
    d = pa.concat_tables([d, pa.table({"doc_id": pa.array([i for i, _ in odd], pa.int64()), "text": pa.array([t for _, t in odd])})])
    d = d.append_column("word", pa.array(["x"] * d.num_rows))
    pq.write_table(d, tmp_path / "documents.parquet")
    df = Q.queries()["op11_lattice_score"](spark, f"file://{tmp_path}")
    assert df.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("n_tokens", "bigint"), ("n_known", "bigint"), ("train_tokens", "bigint"), ("base_score", "double"), ("score", "double")]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    docs = list(zip(d["doc_id"].to_pylist(), d["text"].to_pylist(), strict=True))
    truth = [(i, held(i), *w) for (i, _), w in zip(docs, lattice_truth(docs, held), strict=True)]
    close(by_id([tuple(r) for r in df.collect()]), by_id(truth))


def test_lattice_sums_all_segmentations():
    arcs = {b"a": math.log(0.2), b"b": math.log(0.1), b"ab": math.log(0.05), b"ba": math.log(0.3), b"abab": math.log(0.01), b"aba": None}
    for word in (b"a", b"ab", b"abab", b"bababab"):
        total = 0.0
        for cuts in itertools.product((0, 1), repeat=len(word) - 1):
            at = [0, *[i + 1 for i, x in enumerate(cuts) if x], len(word)]
            parts = [arcs.get(word[i:j]) for i, j in itertools.pairwise(at)]
            total += math.exp(sum(parts)) if None not in parts else 0
        assert lattice.marginal(word, arcs) == pytest.approx(math.log(total))


def test_lattice_rare_words_join(spark):
    """With no word shipped, and with few, the scores are those with all of them; text of any bytes and of a very long word has one."""
    docs = [(1, "A b a\tB c"), (2, "a b"), (3, None), (3, ""), (None, "zz Zz a"), (5, "é中" + "x" * 50_000), (5, "a b")]
    df = spark.createDataFrame([(i, t, 1, "w") for i, t in docs], SCHEMA).repartition(3)
    held = lambda i: i == 2
    truth = by_id([(i, held(i), *w) for (i, _), w in zip([x for x in docs if x[0] != 5], lattice_truth([x for x in docs if x[0] != 5], held), strict=True)])
    few = [x for x in docs if x[0] != 5]
    for most in (0, 2, 1000):
        got = lattice.lattice_scores(spark.createDataFrame([(i, t, 1, "w") for i, t in few], SCHEMA), F.col("doc_id") == 2, shipped=most).collect()
        close(by_id([tuple(r) for r in got]), truth)
    got = [r for r in lattice.lattice_scores(df, F.col("doc_id") == 2, shipped=2).collect() if r["doc_id"] == 5]
    assert len(got) == 2 and all(math.isfinite(r["score"]) and r["score"] < 0 for r in got) and min(r["score"] for r in got) < -5_000
    nothing = spark.createDataFrame([], SCHEMA)
    assert lattice.lattice_scores(nothing, F.lit(False)).collect() == []
    only = lattice.lattice_scores(df, F.lit(True)).collect()
    assert len(only) == len(docs) and all((r["train_tokens"], r["n_known"]) == (0, 0) and abs(r["base_score"]) < 1e-9 and r["score"] < 0 for r in only)


def test_lattice_likes_what_it_learned(spark):
    """Held-out texts of the training documents' words are likelier, word by word, than the same letters shuffled."""
    d = spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) > 200").select("doc_id", "text")
    mixed = d.select((-F.col("doc_id") - 1).alias("doc_id"), F.array_join(F.shuffle(F.split("text", ""), F.lit(3)), "").alias("text"))
    got = {r["doc_id"]: r["score"] / r["n_tokens"] for r in lattice.lattice_scores(d.union(mixed), (F.col("doc_id") < 0) | (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1)).collect() if r["held_out"]}
    pairs = [(x, got[-i - 1]) for i, x in got.items() if i >= 0]
    assert len(pairs) > 20 and np.mean([a > b for a, b in pairs]) > 0.95


VECTORS = "vec_id long, embedding array<float>, label int, v int, n int, cluster int, start int"


def odd_vectors(rng, n, dim=64, labels=4):
    """Rows with near and exact copies, ties, odd vectors and repeated and null ids."""
    rows = []
    for i in range(n):
        x = (np.round(rng.normal(size=dim) * 4) / 16).astype("f4") if i % 5 else np.full(dim, 0.25, "f4")
        rows.append((i, x.tolist(), int(rng.integers(labels))))
    rows[7:9] = [(7, rows[3][1], rows[3][2]), (8, rows[3][1], 1)]
    rows += [(3, rows[3][1], rows[3][2]), (n, None, 1), (n + 1, rows[1][1], None), (n + 2, [float("nan")] * dim, 1), (n + 3, [None] * dim, 1), (n + 4, [float("inf")] + [0.0] * (dim - 1), 1), (n + 5, [3e38] * dim, 1)]
    return rows


def negatives_truth(rows, positives=5, negatives=10):
    v = [(i, lab, [math.floor(256 * float(np.float32(c))) for c in x]) for i, x, lab in rows if i is not None and lab is not None and x is not None and all(c is not None and math.isfinite(c) and abs(c) < 1e4 for c in x)]
    out = []
    for k, (i, lab, x) in enumerate(v):
        if i % 100:
            continue
        s = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), j, m != lab) for h, (j, m, y) in enumerate(v) if h != k and len(y) == len(x))
        for p, pos, _ in [t for t in s if not t[2]][:positives]:
            fit = [(n, j) for n, j, other in s if other and 30 * -p <= 100 * -n <= 90 * -p][:negatives]
            out += [(i, pos, r + 1, j, -p, -n) for r, (n, j) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("part,block", [(65536, 4096), (37, 2)])
def test_hard_negatives(spark, part, block, monkeypatch):
    monkeypatch.setattr(negatives, "LEAST_PART", 16)
    monkeypatch.setattr(negatives, "LEAF", 8)
    rows = odd_vectors(np.random.default_rng(5), 640) + [(None, [0.5] * 64, 1), (900, [1.0, 2.0], 1), (1000, [1.0, 1.0], 1), (1001, [1.0, 1.0], 2), (1100, [], 1)]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], VECTORS).repartition(5)
    got = negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, F.col("label"), part=part, block=block)
    assert sorted(map(tuple, got.collect())) == negatives_truth(rows)
    assert negatives.hard_negatives(df.limit(0), F.col("vec_id") % 100 == 0, F.col("label")).collect() == []


def test_op12(spark):
    df = Q.queries()["op12_hard_negatives"](spark, DATA)
    assert df.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    t = pq.read_table(f"{DATA}/embeddings.parquet").to_pylist()
    rows = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in t]
    assert sorted(map(tuple, df.collect())) == negatives_truth(rows)


def test_ball_search_prunes_and_keeps_ties():
    """On clusters far apart most leaves are left unread, and what is found is what all rows give."""
    rng = np.random.default_rng(1)
    far = rng.normal(size=(32, 16)) * 400
    x = np.floor(far[rng.integers(32, size=4000)] + rng.normal(size=(4000, 16)) * 4)
    labels, rank = rng.integers(3, size=4000), np.arange(4000)
    order, nodes = negatives.ball_tree(x, labels)
    q, own = x[:20], labels[:20]
    lo, hi = np.full((20, 1), -np.inf), np.full((20, 1), np.inf)
    best = negatives.search(x, labels, rank, (order, nodes), q, own, np.arange(20), lo, hi, 5, True)
    for i in range(20):
        key = ((x @ q[i]).astype("i8") * (1 << 18) - rank)[(labels == own[i]) & (rank != i)]
        assert best[i, 0].tolist() == sorted(key.tolist())[-5:][::-1]
    read = []
    plain = np.matmul
    class Counted(np.ndarray):
        def __array_ufunc__(self, f, method, *args, **kw):
            args = [a.view(np.ndarray) if isinstance(a, Counted) else a for a in args]
            if f is plain:
                read.append(args[1].shape[1])
            return getattr(f, method)(*args, **kw)
    negatives.search(x, labels, rank, (order, nodes), q[:1].view(Counted), own[:1], np.arange(1), lo[:1], hi[:1], 5, True)
    assert 0 < sum(read) < 1000


def means_truth(rows, start, k=40, rounds=5):
    v = [(i, [math.floor(256 * float(np.float32(c))) for c in x]) for i, x in rows if x is not None and len(x) == 64 and all(c is not None and math.isfinite(c) and abs(c) < 1e4 for c in x)]
    c = [x for _, x in sorted(v, key=lambda r: (r[0] is None, start(r[0]) if r[0] is not None else "", r[1]))[:k]]
    dist = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    for i in range(rounds + 1):
        at = [min((dist(x, y), j) for j, y in enumerate(c)) for _, x in v]
        if i < rounds:
            for j in range(len(c)):
                mine = [x for (_, x), (_, a) in zip(v, at, strict=True) if a == j]
                if mine:
                    c[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    per = collections.Counter()
    for d, j in at:
        per[j] += d
    return [(i, j, d, per[j], sum(per.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(v, at, strict=True)]


def start(i):
    return hashlib.sha256(f"2:{i}".encode()).hexdigest()


def test_sort_means(spark):
    rows = odd_vectors(np.random.default_rng(3), 300) + [(None, [0.5] * 64, 1), (900, [1.0, 2.0], 1), (1100, [], 1)]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], VECTORS).repartition(4)
    by = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    got = sortmeans.cluster(df, by)
    assert by_id(map(tuple, got.collect())) == by_id(means_truth([r[:2] for r in rows], start))
    assert by_id(map(tuple, sortmeans.cluster(df.limit(0), by).collect())) == []
    few = sortmeans.cluster(df.where("vec_id < 3"), by)
    assert by_id(map(tuple, few.collect())) == by_id(means_truth([r[:2] for r in rows if r[0] is not None and r[0] < 3], start))


def test_op13(spark):
    df = Q.queries()["op13_sort_means"](spark, DATA)
    assert df.dtypes == [("vec_id", "bigint"), ("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string")]
    t = pq.read_table(f"{DATA}/embeddings.parquet").to_pylist()
    assert by_id(map(tuple, df.collect())) == by_id(means_truth([(r["vec_id"], r["embedding"]) for r in t], start))


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_sort_means"])
def test_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{DATA}/embeddings.parquet'")
    want = con.sql(Q.oracle_sql()[name])
    df = Q.queries()[name](spark, DATA).select(*want.columns)
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())


def test_whole(spark):
    rows = [(1, [0.5, -0.001]), (2, [5e7, 0.0]), (3, [1e4, 1.0]), (4, [2e4, 1.0]), (5, [None, 1.0]), (6, None), (7, [])]
    got = {r["i"]: r["v"] for r in spark.createDataFrame(rows, "i int, e array<double>").select("i", points.whole("e").alias("v")).collect()}
    assert got == {1: [128, -1], 2: None, 3: [2560000, 256], 4: None, 5: None, 6: None, 7: []}
