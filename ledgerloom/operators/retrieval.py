"""Exact filtered vector search for one or many queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cosine
from ..sources import scan

K = 10
#: Queries and stored vectors that one task compares.
QUERY_BLOCK, CHUNK = 4096, 8192


def topk(spark, sf_dir: str, query: int = 0, label: int = 3, k: int = K) -> DataFrame:
    """The ``k`` vectors (1 to 100) of a label nearest to one vector; the label filter reaches the scan, and one row is broadcast."""
    if not 1 <= k <= 100:
        raise ValueError("k must be between 1 and 100")
    e = scan(spark, sf_dir, "embeddings")
    one = e.where(F.col("vec_id") == query).select(F.col("embedding").alias("q")).limit(1)
    scored = e.where(F.col("label") == label).join(F.broadcast(one)).select("vec_id", F.round(cosine(F.col("embedding"), F.col("q")), 9).alias("score"))
    return scored.where("score is not null").orderBy(F.desc("score"), "vec_id").limit(k)


def nearest(queries: DataFrame, store: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank): the ``k`` nearest others of each query (query_id, embedding, label) among the stored vectors (vec_id, embedding, label) of its label, by exact cosines.

    A label's queries are dealt into blocks and its vectors into chunks by hash; each block meets each chunk in one task, which
    keeps ``k`` of a query, so a large label is many tasks and only these are ranked. Null, empty and zero vectors are near to nothing.
    """
    double = F.col("embedding").cast("array<double>")
    solid = lambda d: d.select("*", double.alias("v")).where(F.coalesce((F.size("v") > 0) & F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: x.isNotNull()), F.lit(False))).withColumn("width", F.size("v")).drop("embedding")
    q, s = solid(queries), solid(store)
    by = ["label", "width"]
    blocks = q.groupBy(*by).agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
    chunks = s.groupBy(*by).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    sizes = blocks.join(chunks, by)
    deal = lambda d, key, own, other, n_own, n_other: d.join(sizes, by).select(*by, F.pmod(F.xxhash64(key), n_own).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(n_other) - 1)).alias(other), F.col(key).alias("id"), "v", F.lit(key == "query_id").alias("asks"))
    both = deal(q, "query_id", "block", "chunk", "blocks", "chunks").unionByName(deal(s, "vec_id", "chunk", "block", "chunks", "blocks"))

    def meet(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        v = group.column("v").combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1)
        v = v / np.sqrt((v * v).sum(1, keepdims=True))
        asks, ids = group.column("asks").to_numpy(zero_copy_only=False), group.column("id").to_numpy()
        stored = np.flatnonzero(~asks)[np.argsort(ids[~asks], kind="stable")]
        out = []
        for rows in np.array_split(np.flatnonzero(asks), max(1, int(asks.sum()) // 256)):
            score = np.round(v[rows] @ v[stored].T, 9)
            score[ids[rows][:, None] == ids[stored][None, :]] = -9
            order = np.argsort(-score, axis=1, kind="stable")[:, :k]
            best = np.take_along_axis(score, order, 1)
            kept = best > -9
            out.append((np.repeat(ids[rows], kept.sum(1)), ids[stored][order][kept], best[kept]))
        return pa.table({n: np.concatenate([x[c] for x in out]) for c, n in enumerate(("query_id", "vec_id", "score"))})

    met = both.groupBy(*by, "block", "chunk").applyInArrow(meet, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k)


def ranked(spark, sf_dir: str) -> DataFrame:
    """Ten nearest others of each query vector (vec_id divisible by 20) among its own label."""
    e = scan(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return nearest(e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), e, K)


COS = "round(list_cosine_similarity(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[])), 9)"
RANKED = f"""SELECT * FROM (SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM
  (SELECT q.vec_id AS query_id, e.vec_id, {COS.format("e.embedding", "q.embedding")} AS score FROM embeddings e JOIN embeddings q ON e.label = q.label AND q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id)) WHERE rank <= 10"""
QUERIES = {"r1_topk_cosine_filtered": topk, "r2_batched_knn": ranked}
ORACLE_SQL = {
    "r1_topk_cosine_filtered": f"SELECT e.vec_id, {COS.format('e.embedding', 'q.embedding')} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label = 3 ORDER BY score DESC, vec_id LIMIT 10",
    "r2_batched_knn": RANKED,
}
