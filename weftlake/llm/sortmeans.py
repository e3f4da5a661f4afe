"""Centroid clustering by sort-means, in exact integers.

In each round the other centroids are sorted by their distance from each centroid. A vector starts at the centroid of its last
assignment, at distance d, and reads the others in that order until one lies strictly beyond 2d: neither it nor a later one can be
as near (by the triangle inequality), nor as near with a smaller number. All distances are integers below 2**53, so ties are real ties.

A round is one pass over the vectors: each task writes their new assignments and the sums of its clusters, and only the sums (a row a
cluster and task) are shuffled. Centroids, k of them, are all that the driver holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import drop, table
from .points import matrix, whole

#: Rows of an Arrow batch: many vectors share a cluster then, and are compared together.
BATCH = 16384


def assign(x, last, centroids):
    """(numbers of the nearest centroids, squared distances): x [n, dim] and centroids [k, dim] hold integers as float64, last is where each row starts."""
    import numpy as np

    apart = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    order = np.argsort(apart, axis=1, kind="stable")
    best, dist = last.copy(), np.zeros(len(x))
    for c in np.unique(last):
        of = np.nonzero(last == c)[0]
        d = ((x[of] - centroids[c]) ** 2).sum(axis=1)
        by = np.argsort(-d, kind="stable")  # who reads furthest comes first, so that readers are always a prefix
        of, d = of[by], d[by]
        y, least, number = x[of], d.copy(), np.full(len(of), c)
        for j in order[c]:
            if j == c:
                continue
            m = int(np.searchsorted(-4 * d, -apart[c, j], side="right"))  # strictly beyond twice the distance: d2(c, j) > 4 d2
            if not m:
                break
            new = ((y[:m] - centroids[j]) ** 2).sum(axis=1)
            nearer = (new < least[:m]) | ((new == least[:m]) & (j < number[:m]))
            least[:m][nearer], number[:m][nearer] = new[nearer], j
        best[of], dist[of] = number, least
    return best, dist


def _round(rows: DataFrame, centroids: list[list[int]], kind: str, last: bool) -> DataFrame:
    """rows(id, v, cluster): each with its new cluster and distance; unless last, also a row a cluster that a task has met: n, and the sums of its vectors as v."""
    sent = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        c = np.array(sent.value, "f8")
        sums, n = np.zeros(c.shape, "i8"), np.zeros(len(c), "i8")

        def out(ids, v, cluster, distance, count):
            return pa.RecordBatch.from_arrays([ids, v, pa.array(cluster, pa.int32()), pa.array(distance, pa.int64()), pa.array(count, pa.int64())], ["id", "v", "cluster", "distance", "n"])

        known = None
        for batch in batches:
            known = batch.schema.field("id").type
            x = matrix(batch.column("v"))
            best, d = assign(x, batch.column("cluster").to_numpy(zero_copy_only=False), c)
            if not last:
                for k in np.unique(best):
                    sums[k] += x[best == k].astype("i8").sum(axis=0)
                n += np.bincount(best, minlength=len(c))
            yield out(batch.column("id"), batch.column("v").cast(pa.list_(pa.int64())), best, d.astype("i8"), np.zeros(len(best), "i8"))
        of = np.nonzero(n)[0]
        if len(of):
            yield out(pa.nulls(len(of), known), pa.array(sums[of].tolist(), pa.list_(pa.int64())), of, np.zeros(len(of), "i8"), n[of])

    return rows.mapInArrow(run, f"id {kind}, v array<long>, cluster int, distance long, n long")


def cluster(vectors: DataFrame, start: Column, k: int = 40, rounds: int = 5, dim: int = 64, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row a kept vector: key, cluster int, distance, cluster_inertia, inertia long, centroid_sha256 string.

    Kept are vectors of dim components, none null or non-finite, as integers floor(256 * x) (see points.whole for the length,
    16,384 here, from which float64 would not hold their distances exactly; longer vectors are not kept). The first centroids are the k
    vectors with the smallest `start`, a column over key (ties: the smaller components; a null comes last); fewer where fewer are kept.
    Each round assigns every vector and replaces centroids by the floored means of their vectors; empty ones stay. Then
    vectors are assigned once more. Repeated rows and null keys are vectors of their own; an empty table gives an empty result;
    other columns are ignored. Sums of distances past a long are null.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    v = vectors.select(F.col(key), whole(vector).alias("v")).where(F.size("v") == dim)
    v = v.select(F.col(key).alias("id"), start.alias("start"), F.col("v").cast("array<long>").alias("v"))
    rows = table(v.select("id", "v", F.lit(0).cast("int").alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).cast("long").alias("n"), "start"), "vectors", BATCH)
    centroids = [list(r["v"]) for r in rows.orderBy(F.col("start").asc_nulls_last(), "v").limit(k).select("v").collect()]  # k vectors
    rows = rows.drop("start")
    if not centroids:
        return rows.select(F.col("id").alias(key), "cluster", "distance", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    first = rows
    for i in range(rounds + 1):
        done = table(_round(rows.where("n = 0").select("id", "v", "cluster"), centroids, kind, i == rounds), "assigned", BATCH)
        drop(first)
        first = rows = done
        if i < rounds:
            sums = rows.where("n > 0").select("cluster", "n", F.posexplode("v").alias("at", "x"))
            for r in sums.groupBy("cluster", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect():  # k * dim rows
                centroids[r["cluster"]][r["at"]] = r["x"] // r["n"]
    per = rows.groupBy("cluster").agg(F.try_sum("distance").alias("s")).collect()  # k rows
    inertia = {r["cluster"]: r["s"] for r in per}
    total = sum(inertia.values()) if None not in inertia.values() else None
    total = total if total is not None and total < 1 << 63 else None
    names = [(c, inertia[c], total, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c in sorted(inertia)]
    told = spark.createDataFrame(names, "c int, cluster_inertia long, inertia long, centroid_sha256 string")  # a row a cluster
    return rows.join(F.broadcast(told), F.col("cluster") == F.col("c")).select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kept vector's cluster (see cluster for nulls, ties, repeats and empty tables)."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return cluster(e, F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256))


def _sql(k: int = 40, rounds: int = 5, dim: int = 64) -> str:
    """The same in SQL, its rounds one after the other."""
    parts = [
        f"""v as materialized (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
        where len(embedding) = {dim} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {dim})""",
        f"c0 as materialized (select row_number() over (order by h, v) - 1 as c, v as m from (select sha256('2:' || vec_id) as h, v from v order by h, v limit {k}))",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} as materialized (select vec_id, v, arg_min(c, d * 1000 + c) as c, min(d) as d from (
            select vec_id, v, c, cast(list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as bigint) as d from v, c{i}) group by vec_id, v)""")
        if i < rounds:
            parts.append(f"""m{i} as (select c, list(f order by pos) as m from (select c, pos, cast(floor(cast(sum(x) as double) / count(*)) as bigint) as f from (select c, unnest(v) as x, unnest(range({dim})) as pos from a{i}) group by c, pos) group by c)""")
            parts.append(f"c{i + 1} as materialized (select c{i}.c as c, coalesce(m{i}.m, c{i}.m) as m from c{i} left join m{i} on c{i}.c = m{i}.c)")
    return f"""with {", ".join(parts)}
    select vec_id, cast(a.c as integer) as cluster, d as distance, cast(sum(d) over (partition by a.c) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia,
           sha256(array_to_string(m, ',')) as centroid_sha256
    from a{rounds} a join c{rounds} c on a.c = c.c"""


OP13_SQL = _sql()
