"""Centroid clustering (Lloyd's rounds on integers) by Shallot search: bounds spare most vectors a search, and a search scans few centroids."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, table
from .vectors import finite, integers

#: Room for rounding in bounds, which are doubles; what they leave open is compared in integers.
EPS = 1e-9

STATE = "vec_id long, v array<int>, cluster int, second int, upper double, lower double, was int"


class Centroids:
    """Centroids of one round with their distances, each one's others by distance, and how far they moved since the last round."""

    def __init__(self, c: np.ndarray, before: np.ndarray | None = None):
        self.c, k = c, len(c)
        gap = np.sqrt(((c[:, None] - c[None]).astype(float) ** 2).sum(2))
        self.between = gap
        np.fill_diagonal(gap, np.inf)
        self.order = np.argsort(gap, axis=1, kind="stable")[:, : k - 1]
        self.half = gap.min(1) / 2
        moved = np.zeros(k) if before is None else np.sqrt(((c - before).astype(float) ** 2).sum(1))
        self.moved = moved
        self.others = np.array([np.delete(moved, j).max(initial=0) for j in range(k)])


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return (d * d).sum(1)


def search(x: np.ndarray, cluster: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray, at: Centroids) -> tuple[np.ndarray, ...]:
    """cluster, second, upper and lower of one round. ``upper`` bounds a vector's distance from its centroid, ``lower`` its distance from all others.

    A vector whose upper bound is below its lower bound, or below half the way to the nearest other centroid, stays. The others' two remembered
    centroids are measured, and the centroids near the closer one are scanned by distance from it until the triangle inequality leaves
    out the rest; the ball shrinks whenever a nearer second one is found. Ties go to the smaller number.
    """
    cluster, second = cluster.copy(), second.copy()
    upper = (upper + at.moved[cluster]) * (1 + EPS)
    lower = lower - at.others[cluster] * (1 + EPS)
    bound = np.maximum(lower, at.half[cluster] * (1 - EPS))
    rows = np.flatnonzero(~(upper < bound))
    d = squared(x[rows], at.c[cluster[rows]])
    upper[rows] = np.sqrt(d) * (1 + EPS)
    still = ~(upper[rows] < bound[rows])
    rows, d = rows[still], d[still]
    if not len(rows):
        return cluster, second, upper, lower
    a, b = cluster[rows], second[rows]
    if len(at.c) == 1:
        lower[rows] = np.inf
        return cluster, second, upper, lower
    e = squared(x[rows], at.c[b])
    swap = (e < d) | ((e == d) & (b < a))
    a, b, d, e = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, e, d), np.where(swap, d, e)
    centre, other, reach = a.copy(), b.copy(), np.sqrt(d)
    live = np.arange(len(rows))
    for place in range(at.order.shape[1]):
        j = at.order[centre[live], place]
        inside = at.between[centre[live], j] * (1 - EPS) <= (reach[live] + np.sqrt(e[live])) * (1 + EPS)
        live, j = live[inside], j[inside]
        new = j != other[live]
        k, j = live[new], j[new]
        f = squared(x[rows[k]], at.c[j])
        first = (f < d[k]) | ((f == d[k]) & (j < a[k]))
        b[k], e[k] = np.where(first, a[k], b[k]), np.where(first, d[k], e[k])
        a[k], d[k] = np.where(first, j, a[k]), np.where(first, f, d[k])
        nearer = ~first & ((f < e[k]) | ((f == e[k]) & (j < b[k])))
        b[k], e[k] = np.where(nearer, j, b[k]), np.where(nearer, f, e[k])
    cluster[rows], second[rows] = a, b
    upper[rows], lower[rows] = np.sqrt(d) * (1 + EPS), np.sqrt(e) * (1 - EPS)
    return cluster, second, upper, lower


def matrix(v: pa.Array, d: int) -> np.ndarray:
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(v), d)


def assigned(state: DataFrame, at: Centroids) -> DataFrame:
    """``state`` after one round's search; ``was`` is the cluster before."""
    d = at.c.shape[1]

    def run(batches):
        for b in batches:
            if b.num_rows:
                cluster, second, upper, lower = (b.column(k).to_numpy(zero_copy_only=False) for k in range(2, 6))
                new = search(matrix(b.column(1), d), cluster, second, upper, lower, at)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x) for x in new), pa.array(cluster)], schema=b.schema)

    return state.mapInArrow(run, STATE)


def shifts(state: DataFrame, k: int, d: int) -> np.ndarray:
    """k x (d + 1) exact changes of the clusters' sums and counts, as Python integers; only vectors that changed their cluster are read into tasks."""

    def run(batches):
        for b in batches:
            x = np.column_stack([matrix(b.column(2), d), np.ones(b.num_rows, np.int64)])
            for column, sign in ((0, 1), (1, -1)):
                c = b.column(column).to_numpy()
                for j in np.unique(c[c >= 0]).tolist():
                    yield pa.RecordBatch.from_pydict({"cluster": pa.array([j], pa.int32()), "total": pa.array([(sign * x[c == j].sum(0)).tolist()], pa.list_(pa.int64()))})

    part = state.where("cluster <> was or was is null").select("cluster", "was", "v").mapInArrow(run, "cluster int, total array<long>")
    part = part.select("cluster", F.posexplode("total").alias("place", "total")).groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out = np.zeros((k, d + 1), object)
    for r in part.collect():  # at most k * (d + 1) numbers
        out[r.cluster, r.place] = int(r.total)
    return out


def cluster(embeddings: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, scale: int = 1024, d: int = 64) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of each kept row of ``embeddings`` (vec_id, embedding), a written table, and the final centroids.

    Kept are vectors of exactly ``d`` components, none null or non-finite, as integers floor(scale * x). The first centroids are the ``k`` kept rows
    with the smallest SHA-256 of "seed:vec_id" in ascending order; null ids come last, equal ids follow their components. With fewer rows
    there are fewer centroids, and with none no rows. Repeated rows count each. Means are exact, rounded down. A component of 2^27 or more
    as an integer fails with a message, since its distances would not fit a long. Other columns are not read.

    Every round reads the last round's table and writes its own; a lost executor only redoes its part of a round. The driver holds the centroids alone.
    """
    kept = embeddings.where((F.size("embedding") == d) & finite("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), integers("embedding", scale).alias("v"))
    start = kept.select("vec_id", "v", F.lit(0).alias("cluster"), F.lit(1).alias("second"), F.lit(float("inf")).alias("upper"), F.lit(float("-inf")).alias("lower"), F.lit(-1).alias("was"))
    state = table(start)
    by = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    seeds = state.orderBy(by.asc_nulls_last(), "v").select("v").limit(k).collect()
    if not seeds:
        return state.selectExpr("vec_id", "cluster", "0L as distance"), []
    c, before = np.array([r.v for r in seeds], np.int64), None
    sums = np.zeros((len(c), d + 1), object)
    for turn in range(rounds + 1):
        new = assigned(state, Centroids(c, before)).withColumn("was", F.lit(-1) if turn == 0 else F.col("was"))
        new = table(new)
        drop(state)
        state = new
        if turn < rounds:
            sums = sums + shifts(state, len(c), d)
            before = c
            c = np.array([[t // s[d] for t in s[:d]] if s[d] else old.tolist() for s, old in zip(sums, c, strict=True)], np.int64)

    def measured(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(squared(matrix(b.column(2), d), c[b.column(1).to_numpy()]))], names=["vec_id", "cluster", "distance"])

    out = table(state.select("vec_id", "cluster", "v").mapInArrow(measured, "vec_id long, cluster int, distance long"))
    drop(state)
    return out, c.tolist()


def digest(embeddings: DataFrame) -> DataFrame:
    """``cluster`` with production parameters: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256. An empty table gives no rows."""
    out, centroids = cluster(embeddings)
    sums = {r.cluster: int(r.total) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # one row a cluster
    known = [(j, sums.get(j, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids)]
    known = embeddings.sparkSession.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 8, rounds: int = 10, seed: int = 3, scale: int = 1024, d: int = 64) -> str:
    """The same rows for DuckDB, where vec_id is unique: one query a round."""
    near = "SELECT v.vec_id, arg_min(c.cluster, struct_pack(s := s, c := c.cluster)) AS cluster, min(s) AS distance FROM v, c{r} c, LATERAL (SELECT list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS s) GROUP BY v.vec_id"
    out = f"""WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {d} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS INTEGER) AS cluster, x FROM v ORDER BY sha256('{seed}:' || vec_id) LIMIT {k}),
"""
    for r in range(rounds):
        out += f"""a{r} AS MATERIALIZED ({near.format(r=r)}),
m{r} AS (SELECT cluster, list(m ORDER BY i) AS x FROM (SELECT cluster, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS m FROM a{r} JOIN v USING (vec_id), (SELECT unnest(range(1, {d + 1})) AS i) GROUP BY cluster, i) GROUP BY cluster),
c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (cluster)),
"""
    return out + f"""a AS MATERIALIZED ({near.format(r=rounds)})
SELECT a.vec_id, a.cluster, CAST(a.distance AS BIGINT) AS distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(a.distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a JOIN c{rounds} c USING (cluster)"""


DIGEST_SQL = _sql()
