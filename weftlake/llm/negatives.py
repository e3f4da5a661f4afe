"""Hard negatives by ball trees: branch and bound on inner products, from above and from below.

Rows are dealt to parts by number, evenly whatever their labels, and each part has a tree: nodes are split at a label as long as they
hold several, then by distance from two far rows, down to leaves of LEAF rows. A node's ball (integer centre c, radius r) bounds the inner product of
its rows with an anchor q by qc - |q|r and qc + |q|r. A node is left aside for an anchor if its label can't serve, if its bounds lie outside
the window of scores (both ends), or if the upper one lies strictly beneath the k-th best score so far; what ties may still come
first by its id. An anchor takes its best node first, one at a time down to the leaves, then more and more of them.

The first search finds positives (same label, no window); the second one negatives (another label, a window for each positive). Each
anchor is held against every part, in blocks of anchors, in two rounds: about the square root of the parts give it a k-th best score, below
which the other parts need not answer (a round in one would give k rows for each of them). What parts give is cut by a window over anchor and positive.
Rows of equal label and vector differ by their ids only, so all but the smallest ids of such a group are left out of the trees: no search could return them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import drop, table
from .points import matrix, whole

#: Rows of a part at most (and at least, as far as there are so many), anchors of a block, rows of a leaf, anchors searched at once.
PART, LEAST_PART, ANCHORS, LEAF, AT_ONCE = 65536, 1024, 4096, 128, 512
#: Parts that a corpus of fewer than PART * PARTS rows is dealt to.
PARTS = 48


def ball_tree(x, labels, leaf: int = LEAF):
    """(order of the rows, nodes): nodes as arrays first, last (places in the order), left, right (-1: a leaf), label (-1: several), radius, and centre [nodes, dim]."""
    import numpy as np

    order = np.lexsort((np.arange(len(x)), labels))
    first, last, left, right, pure, radius, centre = [], [], [], [], [], [], []

    def node(lo: int, hi: int) -> int:
        y, own = x[order[lo:hi]], labels[order[lo:hi]]
        c = np.floor(y.mean(axis=0))
        first.append(lo)
        last.append(hi)
        left.append(-1)
        right.append(-1)
        pure.append(int(own[0]) if own[0] == own[-1] else -1)
        radius.append(float(np.sqrt(((y - c) ** 2).sum(axis=1).max())))
        centre.append(c)
        return len(first) - 1

    todo = [node(0, len(x))] if len(x) else []
    while todo:
        k = todo.pop()
        lo, hi = first[k], last[k]
        if hi - lo <= leaf:
            continue
        if pure[k] < 0:  # the rows are still in the order of their labels: the bound between two of them that is nearest to the middle
            own = labels[order[lo:hi]]
            bounds = np.nonzero(np.diff(own))[0] + 1
            mid = lo + int(bounds[np.abs(bounds - (hi - lo) / 2).argmin()])
        else:
            of = order[lo:hi]
            y = x[of]
            a = y[((y - centre[k]) ** 2).sum(axis=1).argmax()]
            b = y[((y - a) ** 2).sum(axis=1).argmax()]
            side = np.argsort(y @ (b - a), kind="stable")
            order[lo:hi] = of[side]
            mid = (lo + hi) // 2
        left[k], right[k] = node(lo, mid), node(mid, hi)
        todo += [left[k], right[k]]
    ints = [np.array(v, "i8") for v in (first, last, left, right, pure)]
    return order, (*ints, np.array(radius), np.array(centre).reshape(len(first), x.shape[1]))


def search(x, labels, rank, tree, q, q_label, self_rank, lo, hi, k: int, same: bool):
    """Of each anchor and window the best k rows: keys [anchors, windows, k], score * 2**18 - rank, falling; the least long where there are fewer.

    lo and hi [anchors, windows] bound the scores (lo > hi: no window). rank numbers rows by id; self_rank is an anchor's own, or -1.
    Scores stay below 2**44, so that the keys are exact and ties go by id.
    """
    import numpy as np

    order, (first, last, left, right, pure, radius, centre) = tree
    none = np.iinfo("i8").min
    best = np.full((len(q), lo.shape[1], k), none)
    if not len(x):
        return best
    xs, xl, xr = x[order], labels[order], rank[order]
    norm = np.sqrt((q**2).sum(axis=1))

    def bounds(a, n):
        mid = np.einsum("ij,ij->i", q[a], centre[n])
        wide = norm[a] * radius[n] * (1 + 1e-9) + 1e-6
        return mid - wide, mid + wide

    def alive(a, n, low, high):
        kth = best[a, :, -1]
        kth = np.where(kth == none, -np.inf, (kth + (1 << 18) - 1) // (1 << 18))  # the score in the key
        fits = (high[:, None] >= np.maximum(lo[a], kth)) & (low[:, None] <= hi[a])
        serves = (pure[n] < 0) | ((pure[n] == q_label[a]) == same)
        return fits.any(axis=1) & serves

    a, n = np.arange(len(q)), np.zeros(len(q), "i8")
    low, high = bounds(a, n)
    turn, depth = 0, len(first).bit_length()
    while True:
        live = alive(a, n, low, high)
        a, n, low, high = a[live], n[live], low[live], high[live]
        if not len(a):
            return best
        by = np.lexsort((-high, a))
        a, n, low, high = a[by], n[by], low[by], high[by]
        start = np.searchsorted(a, a)  # where an anchor's nodes begin
        now = np.arange(len(a)) - start < 1 << min(max(0, turn - depth) // 2, 20)
        turn += 1
        ga, gn = a[now], n[now]
        a, n, low, high = a[~now], n[~now], low[~now], high[~now]
        inner = left[gn] >= 0
        ca, cn = np.concatenate([ga[inner]] * 2), np.concatenate([left[gn[inner]], right[gn[inner]]])
        clow, chigh = bounds(ca, cn)
        a, n, low, high = np.concatenate([a, ca]), np.concatenate([n, cn]), np.concatenate([low, clow]), np.concatenate([high, chigh])
        for leaf in np.unique(gn[~inner]):
            of = ga[~inner & (gn == leaf)]
            at = slice(first[leaf], last[leaf])
            score = q[of] @ xs[at].T
            fine = ((xl[at][None, :] == q_label[of][:, None]) == same) & (xr[at][None, :] != self_rank[of][:, None])
            keys = score.astype("i8") * (1 << 18) - xr[at][None, :]
            for w in range(lo.shape[1]):
                kept = np.where(fine & (score >= lo[of, w, None]) & (score <= hi[of, w, None]), keys, none)
                both = np.concatenate([best[of, w], kept], axis=1)
                best[of, w] = -np.sort(-np.partition(both, both.shape[1] - k, axis=1)[:, -k:], axis=1)


def _answers(rows: DataFrame, anchors: DataFrame, parts: tuple[int, int], blocks: int, k: int, same: bool, at_once: int = AT_ONCE) -> DataFrame:
    """rows(uid, id, label, dim, v, part) and anchors(uid, id, label, dim, v, block, lows, highs array<long>): (anchor, slot, uid, id, score), the best k of each part in a range of parts.

    A slot is a place in lows and highs, the window of scores there. A task holds one part and one block.
    """
    none = F.array().cast("array<long>")
    left = rows.where(F.col("part").between(parts[0], parts[1] - 1)).select("dim", "part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(False).alias("asks"), "uid", "id", "label", "v", none.alias("lows"), none.alias("highs"))
    right = anchors.select("dim", F.explode(F.sequence(F.lit(parts[0]), F.lit(parts[1] - 1))).alias("part"), "block", F.lit(True).alias("asks"), "uid", "id", "label", "v", "lows", "highs")

    def run(t):
        import numpy as np
        import pyarrow as pa

        t = t.combine_chunks()
        asks = t.column("asks").to_numpy(zero_copy_only=False)
        label = np.unique(np.array(t.column("label").to_pylist(), dtype=object).astype(str), return_inverse=True)[1].reshape(-1)
        uid, ids, v = t.column("uid").to_numpy(), t.column("id").to_numpy(), matrix(t.column("v"))
        of = np.nonzero(~asks)[0]
        of = of[np.lexsort((uid[of], ids[of]))]  # by id: ties come to the smaller
        x, own, rank = v[of], label[of], np.arange(len(of))
        tree = ball_tree(x, own)
        place = {u: i for i, u in enumerate(uid[of].tolist())}
        out = [[], [], [], []]
        who = np.nonzero(asks)[0]
        given = [t.column(c).take(pa.array(who)).to_pylist() for c in ("lows", "highs")]
        for begin in range(0, len(who), at_once):
            some = who[begin : begin + at_once]
            lows, highs = (g[begin : begin + at_once] for g in given)
            lo, hi = np.full((len(some), max(map(len, lows))), 1.0), np.full((len(some), max(map(len, lows))), 0.0)
            for i, (x_lo, x_hi) in enumerate(zip(lows, highs, strict=True)):
                lo[i, : len(x_lo)], hi[i, : len(x_hi)] = x_lo, x_hi
            mine = np.array([place.get(u, -1) for u in uid[some].tolist()])
            best = search(x, own, rank, tree, v[some], label[some], mine, lo, hi, k, same)
            i, w, j = np.nonzero(best != np.iinfo("i8").min)
            key = best[i, w, j]
            score = -(-key // (1 << 18))
            at = of[score * (1 << 18) - key]
            for o, y in zip(out, (uid[some][i], w, at, score), strict=True):
                o.append(y)
        a, w, at, score = (np.concatenate(o) if o else np.array([], "i8") for o in out)
        return pa.table({"anchor": pa.array(a, pa.int64()), "slot": pa.array(w, pa.int32()), "uid": pa.array(uid[at], pa.int64()), "id": pa.array(ids[at], pa.int64()), "score": pa.array(score, pa.int64())})

    return left.unionByName(right).groupBy("dim", "part", "block").applyInArrow(run, "anchor long, slot int, uid long, id long, score long")


def _best(rows: DataFrame, anchors: DataFrame, parts: int, blocks: int, k: int, same: bool) -> DataFrame:
    """The best k of all parts: (anchor, slot, uid, id, score, rank from 1). Two rounds; the second one's windows begin at the k-th best score of the first."""
    best = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "id", "uid")
    cut = lambda d: d.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    first = math.isqrt(parts - 1) + 1
    found = table(cut(_answers(rows, anchors, (0, first), blocks, k, same)), "first-answers")
    if first < parts:
        floor = found.where(F.col("rank") == k).groupBy(F.col("anchor").alias("of")).agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("floor"))  # a slot each
        asked = anchors.join(floor, F.col("uid") == F.col("of"), "left").withColumn("lows", F.transform("lows", lambda x, i: F.greatest(x, F.coalesce(F.col("floor")[i], x)))).drop("of", "floor")
        before = found
        found = table(cut(before.drop("rank").unionByName(_answers(rows, asked, (first, parts), blocks, k, same))), "answers")
        drop(before)
    return found


def hard_negatives(vectors: DataFrame, anchor: Column, label: Column, positives: int = 5, negatives: int = 10, key: str = "vec_id", vector: str = "embedding", part: int = PART, block: int = ANCHORS) -> DataFrame:
    """A row an anchor, positive and negative: anchor_id, positive_id long, rank int, negative_id, positive_score, negative_score long.

    anchor (boolean) and label are columns over vectors. Rows with a null id or label, a null vector, a null or non-finite component, or a length of 16,384
    or more (scores are exact below, see points.whole) take no part; vectors of different sizes are not compared. Scores are inner
    products of the components times 256, floored. Higher scores come first, ties by smaller id. The positives of an anchor are
    the first other rows of its label; each one's negatives the first rows of other labels scoring 0.3 to 0.9 times as high.
    Rows that repeat, ids included, are rows of their own; an anchor without another row of its label gives none; an empty table gives an
    empty result; other columns are ignored.
    """
    v = vectors.select(F.col(key).cast("long").alias("id"), label.cast("string").alias("label"), whole(vector).alias("v"), F.coalesce(anchor, F.lit(False)).alias("asks"))
    v = v.where("id is not null and label is not null and v is not null").withColumn("uid", F.monotonically_increasing_id()).withColumn("dim", F.size("v"))
    v = table(v, "vectors")
    # of rows of equal label and vector no search returns more than the first few ids, and each positive is another row than its anchor
    equal = Window.partitionBy(F.xxhash64("label", "v"), "label", "v").orderBy("id", "uid")
    rows = table(v.withColumn("n", F.row_number().over(equal)).where(F.col("n") <= max(positives + 1, negatives)).drop("n", "asks"), "distinct")
    n = rows.count()
    asked = v.where("asks")
    parts = max(1, -(-n // min(part, max(LEAST_PART, n // PARTS))))
    blocks = max(1, -(-asked.count() // block))
    rows = rows.withColumn("part", F.pmod(F.xxhash64(F.lit(1), "uid"), F.lit(parts)).cast("int"))
    limit = F.lit(1 << 45)
    asked = asked.withColumn("block", F.pmod(F.xxhash64(F.lit(2), "uid"), F.lit(blocks)).cast("int")).withColumns({"lows": F.array(-limit), "highs": F.array(limit)})
    found = _best(rows, asked, parts, blocks, positives, True)
    of = found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("p"))  # at most `positives`
    # 30 p <= 100 n <= 90 p, in whole numbers
    windows = {"lows": F.transform("p", lambda x: F.ceil(x["score"] * 3 / F.lit(10.0))), "highs": F.transform("p", lambda x: F.floor(x["score"] * 9 / F.lit(10.0)))}
    asked = table(asked.drop("lows", "highs").join(of, F.col("uid") == F.col("anchor")).drop("anchor").withColumns(windows), "anchors")
    drop(found)
    best = _best(rows, asked, parts, blocks, negatives, False)
    out = best.select("anchor", "slot", "rank", F.col("id").alias("negative_id"), "score").join(asked.select("uid", F.col("id").alias("anchor_id"), "p"), F.col("anchor") == F.col("uid"))
    p = F.get("p", F.col("slot"))
    return out.select("anchor_id", p["id"].alias("positive_id"), F.col("rank").cast("int").alias("rank"), "negative_id", p["score"].alias("positive_score"), F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the rows whose id is divisible by 100; labels of ids divisible by 7 move on by one (see hard_negatives for nulls, ties and repeats)."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(e, F.col("vec_id") % 100 == 0, label)


OP12_SQL = """
with v as materialized (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
    from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
s as materialized (
    select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, cast(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) as bigint) as score
    from v a, v b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as materialized (select anchor_id, other as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, other) <= 5)
select p.anchor_id, positive_id, cast(row_number() over w as integer) as rank, other as negative_id, positive_score, score as negative_score
from p join s on p.anchor_id = s.anchor_id and not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
window w as (partition by p.anchor_id, positive_id order by score desc, other)
qualify row_number() over w <= 10
"""
