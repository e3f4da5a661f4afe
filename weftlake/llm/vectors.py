"""Embedding near-dedup: robust-pruned graphs of overlapping shards, their union searched from medoids within a range.

Vectors of a label make cells of at most about CELL rows (one, for a smaller label; overlapping ones by nearest
pivots beyond). In a cell, overlapping shards of about SHARD rows each give a pruned graph; a row's lists are united;
blocks of queries then search the cell's graph: greedily from the shards' medoids and the query's own place, then from
hit to hit as long as the similarity stays in range. The own place matters: the lists of a large group of near copies
stay within it, and a search that starts there from a medoid would never leave it.

Recall is held against brute force twice. In each task some queries are compared with their whole cell; across cells, a sample of
rows is compared with every row of its label, as two linked rows may share no cell (a group of near copies that is larger than
a cell, above all). Labels that miss RECALL there are compared whole, a pair of blocks a task.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import components, delete_made, made, table

CELL, SHARD, BLOCK = 16384, 1024, 4096
#: Lists' length, candidates of the pruning, its slack, the beam, and the hits from which a query's range is read off the cell whole.
DEGREE, CANDIDATES, SLACK, BEAM, DENSE = 24, 64, 1.2, 32, 128
#: Bytes of pivots that driver and broadcast hold at most (float32); queries that each task holds against brute force; what they must reach.
PIVOT_BYTES, AUDIT, RECALL = 64 << 20, 64, 0.97
#: The widest beam; a task that doesn't reach RECALL with it reads all its ranges off the cell.
MAX_BEAM = 256


def _unit(batch, name: str):
    import numpy as np

    col = batch.column(name)
    col = col.combine_chunks() if hasattr(col, "combine_chunks") else col
    x = col.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(batch.num_rows, -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def pruned_graph(x, degree: int = DEGREE, candidates: int = CANDIDATES, slack: float = SLACK):
    """Neighbour places [n, degree] (-1: none): of each row's nearest candidates, the nearest goes in and drops those that lie
    nearer to it by the slack than to the row, again and again (angles' chords are the distances)."""
    import numpy as np

    n, c = len(x), min(candidates, len(x) - 1)
    out = np.full((n, degree), -1, "i4")
    if c < 1:
        return out
    for lo in range(0, n, 512):
        hi = min(lo + 512, n)
        sim = x[lo:hi] @ x.T
        sim[np.arange(hi - lo), np.arange(lo, hi)] = -9
        near = np.argpartition(-sim, c - 1, axis=1)[:, :c]
        d = np.take_along_axis(sim, near, 1)
        order = np.argsort(-d, axis=1, kind="stable")
        near, d = np.take_along_axis(near, order, 1), np.sqrt(np.maximum(2 - 2 * np.take_along_axis(d, order, 1), 0))
        y = x[near]
        alive = np.ones(near.shape, bool)
        rows = np.arange(hi - lo)
        for k in range(degree):
            first = alive.argmax(axis=1)
            some = alive[rows, first]
            if not some.any():
                break
            out[lo:hi, k] = np.where(some, near[rows, first], -1)
            to_first = np.sqrt(np.maximum(2 - 2 * np.einsum("qd,qcd->qc", y[rows, first], y), 0))
            alive &= slack * to_first > d
            alive[rows, first] = False
    return out


def search(x, adj, queries, entries, limit: float, beam: int = BEAM):
    """Hits bool [len(queries), len(x)]: places whose cosine with the query, found on the graph, is at least limit."""
    import numpy as np

    n, out = len(x), np.zeros((len(queries), len(x)), bool)
    adj = np.concatenate([adj, np.full((1, adj.shape[1]), -1, adj.dtype)])
    for lo in range(0, len(queries), 256):
        q = x[queries[lo : lo + 256]]
        m = len(q)
        rows = np.arange(m)[:, None]
        seen = np.zeros((m, n + 1), bool)
        seen[:, n] = True
        hit = np.zeros((m, n + 1), bool)
        b = min(beam, n)
        ids = np.full((m, b), n)
        sims = np.full((m, b), -9.0)
        done = np.ones((m, b), bool)

        def look(who, new, q=q, seen=seen, hit=hit):
            """Cosines of nodes new [len(who), k] not seen before, else -9."""
            new = np.where(new < 0, n, new)
            fresh = ~seen[who[:, None], new]
            # a node that stands twice in a row counts once
            order = np.argsort(new, axis=1, kind="stable")
            s = np.take_along_axis(new, order, 1)
            twice = np.zeros(new.shape, bool)
            twice[:, 1:] = s[:, 1:] == s[:, :-1]
            back = np.zeros(new.shape, bool)
            np.put_along_axis(back, order, twice, 1)
            fresh &= ~back
            r, k = np.nonzero(fresh)
            v = np.full(new.shape, -9.0)
            v[r, k] = np.einsum("ij,ij->i", q[who[r]], x[new[r, k]])
            seen[who[r], new[r, k]] = True
            ok = v[r, k] >= limit
            hit[who[r[ok]], new[r[ok], k[ok]]] = True
            return new, v

        def merge(who, new, v):
            all_ids, all_sims = np.concatenate([ids[who], new], 1), np.concatenate([sims[who], v], 1)
            all_done = np.concatenate([done[who], v < -8], 1)
            top = np.argpartition(-all_sims, b - 1, axis=1)[:, :b]
            ids[who], sims[who], done[who] = (np.take_along_axis(a, top, 1) for a in (all_ids, all_sims, all_done))

        who = np.arange(m)
        merge(who, *look(who, np.concatenate([np.repeat(entries[None, :], m, 0), queries[lo : lo + m, None]], 1)))
        while True:
            best = np.where(done, -9.0, sims).argmax(axis=1)
            who = np.nonzero(~done[np.arange(m), best])[0]
            if not len(who):
                break
            node = ids[who, best[who]]
            done[who, best[who]] = True
            merge(who, *look(who, adj[node]))
        # from hit to hit; a query with very many hits has its range read off the cell
        opened = np.zeros((m, n + 1), bool)
        whole = np.zeros(m, bool)
        while True:
            dense = np.nonzero(~whole & (hit.sum(axis=1) > DENSE))[0]
            if len(dense):
                hit[dense, :n] |= q[dense] @ x.T >= limit
                opened[dense] = whole[dense] = True
            todo = hit & ~opened
            who = np.nonzero(todo.any(axis=1))[0]
            if not len(who):
                break
            node = todo[who].argmax(axis=1)
            opened[who, node] = True
            look(who, adj[node])
        out[lo : lo + 256] = hit[:, :n]
    out[np.arange(len(queries)), queries] = False
    return out


def _drawn(rows: DataFrame, seed: int, most: int) -> dict[str, list]:
    """rows(grp, rep, embedding, share: to be taken): about that many of each group's rows by a hash of rep, thinned alike to `most` bytes in all; (reps, float32 units) by group."""
    import numpy as np

    due = rows.agg(F.sum(F.col("share") * F.size("embedding") * 4).alias("b")).first()["b"] or 0.0
    thin = min(1.0, 0.9 * most / due) if due else 1.0
    draw = F.pmod(F.xxhash64(F.lit(seed), "rep"), F.lit(1 << 30)) < (F.col("share") * F.lit(thin * (1 << 30))).cast("long")
    found: dict[str, list] = {}
    for r in rows.where(draw).select("grp", "rep", F.transform("embedding", lambda x: x.cast("float")).alias("e")).orderBy("rep").toLocalIterator():  # at most so many bytes
        found.setdefault(r["grp"], []).append((r["rep"], np.array(r["e"], "f4")))
    return {g: (np.array([x[0] for x in v]), np.stack([x[1] for x in v])) for g, v in found.items()}


def _assign(rows: DataFrame, cell: int, overlap: int) -> DataFrame:
    """rows(grp string, rep, embedding, ...): adds cells, the numbers of the nearest pivots of the row's group ([0] where it has none).

    A group of more than cell // 2 rows has a pivot for each so many. Past PIVOT_BYTES of pivots all groups have fewer, larger
    cells, and those past 4 * cell rows are assigned once more, to pivots of their own.
    """
    n = table(rows.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") > cell // 2).select(F.col("grp").alias("g"), "n"), "group-sizes")
    found = _drawn(rows.join(n, F.col("grp") == F.col("g")).withColumn("share", F.lit(2.0 / cell)), 11, PIVOT_BYTES)
    sent = rows.sparkSession.sparkContext.broadcast(found)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        units = {g: p / np.linalg.norm(p.astype("f8"), axis=1, keepdims=True) for g, (_, p) in sent.value.items()}
        for batch in batches:
            groups = np.array(batch.column("grp").to_pylist(), dtype=object)
            out: list = [[0]] * batch.num_rows
            for g in set(groups):
                if g in units:
                    of = np.nonzero(groups == g)[0]
                    k = min(overlap, len(units[g]))
                    near = np.argpartition(-(_unit(batch.take(pa.array(of)), "embedding") @ units[g].T), k - 1, axis=1)[:, :k]
                    for i, v in zip(of, np.sort(near, axis=1), strict=True):
                        out[i] = v.tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int64()))], [*batch.schema.names, "cells"])

    return rows.mapInArrow(run, f"{fields}, cells array<long>")


def _assign_again(cells: DataFrame, cell: int, overlap: int, block: int) -> DataFrame:
    """cells(grp string, rep, n, embedding, cells array<long>, own, cell long): cells past 4 * cell rows split by pivots of their own, cell * 2**20 + 1 and up; `cells` follows.

    A task holds a block of a large cell's rows and that cell's pivots, one for each cell // 2 rows: no pivots are collected. A split cell of more than 2**20 - 1 pivots has that many.
    """
    n = table(cells.groupBy("own", "cell").agg(F.count("*").alias("many")).where(F.col("many") > 4 * cell).select(F.col("own").alias("o"), F.col("cell").alias("c"), "many"), "large-cells")
    if n.isEmpty():
        return cells
    named = (F.col("own") == F.col("o")) & (F.col("cell") == F.col("c"))
    large = cells.join(n, named).drop("o", "c").withColumn("blocks", F.ceil(F.col("many") / block).cast("int"))
    drawn = F.pmod(F.xxhash64(F.lit(12), "rep"), F.lit(1 << 30)) < F.least(F.lit(2.0 / cell), F.lit(float(1 << 19)) / F.col("many")) * (1 << 30)
    pivots = large.where(drawn).select("own", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "rep", "embedding", F.lit(True).alias("pivot"))
    every = large.select("own", "cell", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"), "rep", "embedding", F.lit(False).alias("pivot"))

    def place(t):
        import numpy as np
        import pyarrow as pa

        t = t.combine_chunks()
        x, reps, pivot = _unit(t, "embedding"), t.column("rep").to_numpy(), t.column("pivot").to_numpy(zero_copy_only=False)
        p, of = np.nonzero(pivot)[0], np.nonzero(~pivot)[0]
        p = p[np.argsort(reps[p])]  # the same numbers in each block
        k = min(overlap, len(p))
        near = [np.argpartition(-(x[of[lo : lo + 4096]] @ x[p].T), k - 1, axis=1)[:, :k] for lo in range(0, len(of), 4096)] if k else []
        near = np.concatenate(near) + 1 if near else np.zeros((len(of), 1), "i8")
        cell = t.column("cell")[0].as_py()
        new = (near.astype("i8") + (cell << 20)).tolist()
        return pa.table({"o": pa.array([t.column("own")[0].as_py()] * len(of), pa.string()), "c": pa.array([cell] * len(of), pa.int64()), "r": pa.array(reps[of]), "new": pa.array(new, pa.list_(pa.int64()))})

    new = table(every.unionByName(pivots).groupBy("own", "cell", "block").applyInArrow(place, "o string, c long, r long, new array<long>"), "second-cells")
    # of a row: all its cells, those that were split by what they were split to
    of = new.groupBy("o", "r").agg(F.flatten(F.collect_list("new")).alias("fresh"), F.collect_set("c").alias("old"))
    mine = cells.select("own", "rep", "cells").distinct().join(of, (F.col("own") == F.col("o")) & (F.col("rep") == F.col("r")))
    mine = table(mine.select(F.col("own").alias("o"), F.col("rep").alias("r"), F.array_sort(F.concat(F.array_except("cells", "old"), "fresh")).alias("all")), "all-cells")
    out = cells.join(mine, (F.col("own") == F.col("o")) & (F.col("rep") == F.col("r")), "left").withColumn("cells", F.coalesce("all", "cells")).drop("o", "r", "all")
    out = out.dropDuplicates(["own", "rep"]).withColumn("cell", F.explode("cells"))
    return out.withColumn("grp", F.concat_ws("/", "own", F.col("cell").cast("string")))


def _shards(x, shard: int, overlap: int = 2):
    """Of a cell's rows: overlapping shards by the nearest of its own pivots, places in each."""
    import numpy as np

    n = max(1, -(-2 * len(x) // shard)) if len(x) > shard else 1
    if n == 1:
        return [np.arange(len(x))]
    pivots = x[np.random.default_rng(len(x)).choice(len(x), n, replace=False)]
    near = np.concatenate([np.argpartition(-(x[lo : lo + 4096] @ pivots.T), overlap - 1, axis=1)[:, :overlap] for lo in range(0, len(x), 4096)])
    out = []
    for k in range(n):
        of = np.nonzero((near == k).any(axis=1))[0]
        # a group of copies may crowd about one pivot: more shards, of rows in turn
        parts = -(-len(of) // (2 * shard))
        out += [of[j::parts] for j in range(parts)]
    return out


def _across(rows: DataFrame, links: DataFrame, cell: int, limit: float, block: int) -> tuple[list[str], DataFrame]:
    """rows(grp, rep, n, embedding) and what was found (r, links): the groups of several cells that miss RECALL against brute force, and (grp, asked, found, there).

    Every such group is measured, by 4 * AUDIT of its rows on average (all, where it has fewer) against the whole group: a task holds a block of a
    group's rows and the group's sample, so nothing is collected or broadcast however many groups there are.
    """
    n = table(rows.groupBy("grp").agg(F.count("*").alias("many")).where(F.col("many") > cell // 2).select(F.col("grp").alias("g"), "many"), "split-groups")
    split = rows.join(n, F.col("grp") == F.col("g")).drop("g").withColumn("blocks", F.ceil(F.col("many") / block).cast("int"))
    drawn = F.pmod(F.xxhash64(F.lit(13), "rep"), F.lit(1 << 30)) < F.least(F.lit(4.0 * AUDIT) / F.col("many"), F.lit(1.0)) * (1 << 30)
    asks = split.where(drawn).select("grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "rep", "n", "embedding", F.lit(True).alias("asks"))
    every = split.select("grp", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"), "rep", "n", "embedding", F.lit(False).alias("asks"))

    def compare(t):
        import numpy as np
        import pyarrow as pa

        t = t.combine_chunks()
        x, reps, weight, asks = _unit(t, "embedding"), t.column("rep").to_numpy(), t.column("n").to_numpy(), t.column("asks").to_numpy(zero_copy_only=False)
        q, of = np.nonzero(asks)[0], np.nonzero(~asks)[0]
        there = np.zeros(len(q), "i8")
        for lo in range(0, len(q), 512):
            some = q[lo : lo + 512]
            there[lo : lo + 512] = ((x[some] @ x[of].T >= limit) & (reps[some][:, None] != reps[of][None, :])) @ weight[of]
        return pa.table({"grp": pa.array([t.column("grp")[0].as_py()] * len(q), pa.string()), "rep": pa.array(reps[q]), "there": pa.array(there)})

    there = every.unionByName(asks).groupBy("grp", "block").applyInArrow(compare, "grp string, rep long, there long").groupBy("grp", "rep").agg(F.sum("there").alias("there"))
    told = there.join(links, F.col("rep") == F.col("r"), "left").groupBy("grp").agg(F.count("*").alias("asked"), F.sum(F.least(F.coalesce("links", F.lit(0)), F.col("there"))).alias("found"), F.sum("there").alias("there"))
    told = table(told, "across")
    return [r["grp"] for r in told.where(F.col("found") < RECALL * F.col("there")).select("grp").collect()], told  # groups of more than half a cell that missed it


def _whole(rows: DataFrame, block: int, limit: float) -> DataFrame:
    """rows(grp, rep, n, embedding): every link of every group, as (kind, a, b, c) rows like hunt's: links' numbers and edges enough to connect them.

    A group's rows are dealt to blocks; a task compares two of them, so its memory is bounded whatever the group, and no pair is a row.
    """
    n = table(rows.groupBy("grp").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).select(F.col("grp").alias("g"), "blocks"), "whole-groups")
    d = rows.join(n, F.col("grp") == F.col("g")).drop("g").withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    d = d.select("grp", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "rep", "n", "embedding")

    def compare(t):
        import numpy as np
        import pyarrow as pa

        t = t.combine_chunks()
        t = t.take(pa.array(np.argsort(t.column("rep").to_numpy())))
        x, reps, weight, mine = _unit(t, "embedding"), t.column("rep").to_numpy(), t.column("n").to_numpy(), t.column("mine").to_numpy()
        a, b = (np.nonzero(mine == t.column(c)[0].as_py())[0] for c in ("i", "j"))
        parts = range(0, len(a), 512)
        near = np.empty((len(a), len(b)), bool)
        for lo in parts:
            near[lo : lo + 512] = (x[a[lo : lo + 512]] @ x[b].T >= limit) & (a[lo : lo + 512, None] != b[None, :])
        count = np.zeros(len(x), "i8")
        count[a] = near @ weight[b]
        if a[0] != b[0]:
            count[b] = weight[a] @ near
        # enough edges to connect what is linked here: the least place that each reaches
        least = np.arange(len(x))
        while True:
            new = least.copy()
            for lo in parts:
                h, at = near[lo : lo + 512], a[lo : lo + 512]
                new[at] = np.minimum(new[at], np.where(h, new[b][None, :], len(x)).min(axis=1))
                new[b] = np.minimum(new[b], np.where(h, new[at][:, None], len(x)).min(axis=0))
            new = np.minimum(new, new[new])
            if (new == least).all():
                break
            least = new
        told, edge = np.nonzero(count)[0], np.nonzero(least != np.arange(len(x)))[0]
        kind = ["links"] * len(told) + ["edge"] * len(edge)
        return pa.table({"kind": pa.array(kind, pa.string()), "a": pa.array(np.concatenate([reps[told], reps[edge]])), "b": pa.array(np.concatenate([count[told], reps[least[edge]]])), "c": pa.array(np.zeros(len(kind), "i8"))})

    return d.groupBy("grp", "i", "j").applyInArrow(compare, "kind string, a long, b long, c long")


def near_vectors(vectors: DataFrame, limit: float = 0.98, key: str = "vec_id", label: str = "label", vector: str = "embedding", cell: int = CELL, shard: int = SHARD, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(one row a vector: key, n_links, component_id, kept; audit: scope, asked, found, there).

    Links join vectors of equal, non-null labels and equal lengths whose cosine in double precision is at least limit.
    Null vectors, zero vectors and those that hold nulls or non-finite numbers have no links. Equal vectors are one row
    from the start and count as linked to each other. In each task up to AUDIT queries are held against brute force; below
    RECALL the task searches again with twice the beam, up to MAX_BEAM, and then reads its ranges off the cell. Groups of several
    cells that miss RECALL across them are compared whole. Rows that repeat key and vector count as two vectors; null keys have
    no links; an empty table gives an empty result; other columns are ignored. The audit has a row a task and a split group.
    """
    v = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("embedding"))
    fine = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    fine = fine & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    v = v.withColumn("grp", F.when(fine, F.concat_ws("/", F.col("label").cast("string"), F.size("embedding").cast("string")))).withColumn("h", F.when(fine, F.xxhash64("grp", "embedding")))
    since = len(made)
    v = table(v.drop("label"), "vectors")
    uniq = table(v.where("grp is not null and id is not null").groupBy("grp", "h", "embedding").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "unique")
    rows = uniq.select("grp", "rep", "n", "embedding")
    cells = _assign(rows, cell, 3).withColumn("cell", F.explode("cells"))
    cells = table(cells.withColumn("own", F.col("grp")).withColumn("grp", F.concat_ws("/", "grp", F.col("cell").cast("string"))), "cells")
    cells = table(_assign_again(cells, cell, 3, block).drop("cell"), "all-cells")
    size = table(cells.groupBy("grp").agg(F.ceil(F.count("*") / (4 * cell)).cast("int").alias("parts")).where("parts > 1").select(F.col("grp").alias("g"), "parts"), "crowded-cells")
    part = F.pmod(F.xxhash64(F.lit(14), "rep"), F.col("parts")).cast("int")
    cells = cells.join(size, F.col("grp") == F.col("g"), "left").withColumn("part", F.coalesce(part, F.lit(0))).drop("g", "parts")

    def build(pdf):
        import numpy as np
        import pyarrow as pa

        t = pdf.combine_chunks()
        t = t.take(pa.array(np.argsort(t.column("rep").to_numpy())))
        x, reps = _unit(t, "embedding"), t.column("rep").to_numpy()
        lists: list[set] = [set() for _ in reps]
        medoid = np.zeros(len(reps), bool)
        for of in _shards(x, shard):
            if not len(of):
                continue
            y = x[of]
            medoid[of[int((y @ y.mean(axis=0)).argmax())]] = True
            for i, a in zip(of, pruned_graph(y), strict=True):
                lists[i].update(reps[of[a[a >= 0]]].tolist())  # the union of a row's lists, one from each shard that it lies in
        return pa.table({"g": t.column("grp"), "p": t.column("part"), "r": t.column("rep"), "near": pa.array([sorted(a) for a in lists], pa.list_(pa.int64())), "medoid": pa.array(medoid)})

    lists = table(cells.select("grp", "part", "rep", "embedding").groupBy("grp", "part").applyInArrow(build, "g string, p int, r long, near array<long>, medoid boolean"), "lists")
    graph = cells.join(lists, (F.col("grp") == F.col("g")) & (F.col("part") == F.col("p")) & (F.col("rep") == F.col("r"))).drop("g", "p", "r")
    blocks = table(cells.groupBy("grp", "part").agg(F.greatest(F.ceil(F.count("*") / block), F.lit(1)).cast("int").alias("blocks")).select(F.col("grp").alias("g"), F.col("part").alias("p"), "blocks"), "blocks")
    graph = graph.join(blocks, (F.col("grp") == F.col("g")) & (F.col("part") == F.col("p"))).drop("g", "p").withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    graph = table(graph, "graph").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("ask", F.col("block") == F.col("mine"))

    def hunt(key, pdf):
        import numpy as np
        import pyarrow as pa

        t = pdf.combine_chunks()
        x, reps, weight = _unit(t, "embedding"), t.column("rep").to_numpy(), t.column("n").to_numpy()
        order = np.argsort(reps)
        x, reps, weight = x[order], reps[order], weight[order]
        t = t.take(pa.array(order))
        near = t.column("near").to_pylist()
        adj = np.full((len(x), max([1, *map(len, near)])), -1, "i4")
        for i, a in enumerate(near):
            adj[i, : len(a)] = np.searchsorted(reps, a)
        queries = np.nonzero(t.column("ask").to_numpy(zero_copy_only=False))[0]
        entries = np.nonzero(t.column("medoid").to_numpy(zero_copy_only=False))[0]
        if not len(queries):
            return pa.table({c: pa.array([], k) for c, k in zip(("own", "kind", "a", "b", "c"), (pa.string(), pa.string(), *[pa.int64()] * 3), strict=True)})
        asked = queries[:: max(1, len(queries) // AUDIT)][:AUDIT]
        truth = x[asked] @ x.T >= limit
        truth[np.arange(len(asked)), asked] = False
        beam = BEAM
        while True:
            hit = search(x, adj, queries, entries, limit, beam)
            found = int((hit[np.searchsorted(queries, asked)] & truth).sum())
            if found >= RECALL * truth.sum():
                break
            beam *= 2
            if beam > MAX_BEAM:
                for lo in range(0, len(queries), 256):
                    hit[lo : lo + 256] |= x[queries[lo : lo + 256]] @ x.T >= limit
                hit[np.arange(len(queries)), queries] = False
                found = int(truth.sum())
                break
        # a pair that stands together in several cells counts in the first of them
        here = int(t.column("grp")[0].as_py().rpartition("/")[2])
        cells_of = t.column("cells").to_pylist()
        lower = [[c for c in own if c < here] for own in cells_of]
        width = max(map(len, lower))
        earlier = np.array([c + [-1] * (width - len(c)) for c in lower], "i8").reshape(len(x), width)
        count = np.zeros(len(queries), "i8")
        # enough edges to connect what is linked: the least place that each reaches over this task's hits
        least = np.arange(len(x))
        blocks = range(0, len(queries), 256)
        for lo in blocks:
            counted = hit[lo : lo + 256].copy()
            for i in range(width):
                mine = earlier[queries[lo : lo + 256], i][:, None]
                for j in range(width):
                    counted &= (mine != earlier[None, :, j]) | (mine < 0)
            count[lo : lo + 256] = counted @ weight
        while True:
            new = least.copy()
            for lo in blocks:
                h, at = hit[lo : lo + 256], queries[lo : lo + 256]
                new[at] = np.minimum(new[at], np.where(h, new[None, :], len(x)).min(axis=1))
                np.minimum(new, np.where(h, new[at][:, None], len(x)).min(axis=0), out=new)
            new = np.minimum(new, new[new])
            if (new == least).all():
                break
            least = new
        touched = np.nonzero(least != np.arange(len(x)))[0]
        kind = ["links"] * len(queries) + ["edge"] * len(touched) + ["audit"]
        a = np.concatenate([reps[queries], reps[touched], [len(asked)]])
        b = np.concatenate([count, reps[least[touched]], [found]])
        c = np.concatenate([np.zeros(len(queries) + len(touched), "i8"), [int(truth.sum())]])
        return pa.table({"own": pa.array([t.column("own")[0].as_py()] * len(kind), pa.string()), "kind": pa.array(kind), "a": pa.array(a.astype("i8")), "b": pa.array(b.astype("i8")), "c": pa.array(c.astype("i8"))})

    found = table(graph.groupBy("grp", "part", "block").applyInArrow(hunt, "own string, kind string, a long, b long, c long"), "found")
    counts = found.where("kind = 'links'").groupBy(F.col("a").alias("r")).agg(F.sum("b").alias("links"))
    missed, across = _across(rows, counts, cell, limit, block)
    audit = found.where("kind = 'audit'").select(F.lit("cell").alias("scope"), F.col("a").alias("asked"), F.col("b").alias("found"), F.col("c").alias("there"))
    audit = table(audit.union(across.select(F.lit("label"), "asked", "found", "there")), "audit")
    if missed:
        again = table(_whole(rows.where(F.col("grp").isin(missed)), block, limit), "whole")
        found = found.where(~F.col("own").isin(missed)).drop("own").unionByName(again)
    links = found.where("kind = 'links'").groupBy(F.col("a").alias("r")).agg(F.sum("b").alias("links"))
    parts = components(found.where("kind = 'edge'").select("a", "b"))
    judged = uniq.join(links, F.col("rep") == F.col("r"), "left").join(parts, F.col("rep") == F.col("node"), "left")
    judged = table(judged.select(F.col("grp").alias("g2"), F.col("h").alias("h2"), F.col("embedding").alias("e2"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component")), "judged")
    delete_made(vectors.sparkSession, since, v, judged, audit)
    out = v.join(judged, (F.col("h") == F.col("h2")) & (F.col("grp") == F.col("g2")) & (F.col("embedding") == F.col("e2")), "left")
    out = out.select(F.col("id").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.col(key) == F.col("component_id")), audit


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links and component (see near_vectors for nulls, ties and repeats)."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))[0]
