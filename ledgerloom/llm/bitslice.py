"""Exact top-k by inner product on a bit-sliced index: scores are added by bitmap arithmetic, and the top rows are read off from the most significant slice downward."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import table
from .vectors import finite, integers

#: Rows of an index block and queries of a query block, on average: what one task compares at a time.
ROWS, QUERIES = 16384, 512
#: Partitions that pairs of blocks are dealt into, at most.
PARTS = 20000

INDEX = "d int, block int, at array<long>, ids array<long>, low array<int>, bits array<int>, slices binary"


def numbered(vectors: DataFrame, scale: int) -> DataFrame:
    """at (a number of the row), vec_id, d, v of the rows that take part, written once so that the numbers stay."""
    rows = vectors.where(finite("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("d"), integers("embedding", scale).alias("v"))
    return table(rows.select(F.monotonically_increasing_id().alias("at"), "vec_id", "d", "v"))


def dealt(rows: DataFrame, size: int, name: str) -> DataFrame:
    """``rows`` with a block number by the hash of at, about ``size`` rows of one length a block, and the number of that length's blocks."""
    blocks = rows.groupBy("d").agg(F.ceil(F.count("*") / size).cast("int").alias(f"{name}s"))
    return rows.join(F.broadcast(blocks), "d").withColumn(name, F.pmod(F.xxhash64("at"), F.col(f"{name}s")).cast("int"))  # one row a length of vectors


def sliced(group: pa.Table) -> pa.Table:
    """One row of the index: the block's rows by vec_id (nulls last) and at, and of each component, less its smallest value, one bitmap a bit."""
    d, block = group.column("d")[0].as_py(), group.column("block")[0].as_py()
    group = group.sort_by([("vec_id", "ascending"), ("at", "ascending")]).combine_chunks()
    n = group.num_rows
    v = group.column("v").combine_chunks().flatten().to_numpy().astype(np.int64).reshape(n, d)
    low = v.min(0)
    x = v - low
    bits = [int(m).bit_length() for m in x.max(0)]
    planes = [np.packbits((x[:, j] >> s & 1).astype(bool), bitorder="little") for j in range(d) for s in range(bits[j])]
    out = np.zeros((len(planes), -(-n // 64) * 8), np.uint8)
    for k, p in enumerate(planes):
        out[k, : len(p)] = p
    ids, at = group.column("vec_id").to_pylist(), group.column("at").to_pylist()
    return pa.table({"d": pa.array([d], pa.int32()), "block": pa.array([block], pa.int32()), "at": [at], "ids": pa.array([ids], pa.list_(pa.int64())), "low": pa.array([low.tolist()], pa.list_(pa.int32())), "bits": pa.array([bits], pa.list_(pa.int32())), "slices": [out.tobytes()]})


def build(rows: DataFrame) -> DataFrame:
    """The index of ``numbered`` rows: one row a block, a written table."""
    return table(dealt(rows, ROWS, "block").select("d", "block", "at", "vec_id", "v").groupBy("d", "block").applyInArrow(sliced, INDEX))


def digits(w: int) -> list[tuple[int, int]]:
    """(place, sign) of the signed binary digits of ``w`` without neighbours, the fewest possible."""
    out, place = [], 0
    while w:
        if w & 1:
            sign = 2 - (w & 3)
            out.append((place, sign))
            w -= sign
        w >>= 1
        place += 1
    return out


def added(column_of: np.ndarray, rows_of: np.ndarray, slices: np.ndarray) -> list[np.ndarray]:
    """Slices, least significant first, of the sum of bitmaps ``slices[rows_of]``, each at its column's power of two: full adders take three
    bitmaps of a column to one there and one in the next."""
    out, carried = [], np.zeros((0, slices.shape[1]), np.uint64)
    column, last = 0, int(column_of.max(initial=-1))
    while column <= last or len(carried):
        x, carry = np.concatenate([slices[rows_of[column_of == column]], carried]), []
        while len(x) > 2:
            m = len(x) // 3
            a, b, c = x[:m], x[m : 2 * m], x[2 * m : 3 * m]
            half = a ^ b
            carry.append((a & b) | (half & c))
            x = np.concatenate([half ^ c, x[3 * m :]])
        if len(x) == 2:
            carry.append((x[0] & x[1])[None])
            x = (x[0] ^ x[1])[None]
        out.append(x[0] if len(x) else np.zeros(slices.shape[1], np.uint64))
        carried = np.concatenate(carry) if carry else carried[:0]
        column += 1
    return out


def members(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def top(score: list[np.ndarray], among: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` rows with the greatest scores among those of the bitmap ``among``; of equal scores at the boundary those that come first."""
    sure, tied, n = np.zeros_like(among), among, 0
    for s in reversed(score):
        both = tied & s
        more = int(np.bitwise_count(both).sum())
        if n + more > k:
            tied = both
        else:
            sure, n, tied = sure | both, n + more, tied & ~s
            if n == k:
                break
    return np.concatenate([members(sure), members(tied)[: k - n]])


def compared(index: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """(q, query_id, vec_id, at, score): the ``k`` best rows of one index block for each query of one query block; exact scores of these rows come from their bits."""
    out = {c: [] for c in ("q", "query_id", "vec_id", "at", "score")}
    if index.num_rows and queries.num_rows:
        block = index.slice(0, 1).to_pylist()[0]
        at, ids, low, bits = np.array(block["at"]), block["ids"], np.array(block["low"], np.int64), block["bits"]
        n, d = len(at), len(low)
        words = -(-n // 64)
        plain = np.frombuffer(block["slices"], np.uint64).reshape(-1, words)
        begin = np.concatenate([[0], np.cumsum(bits)]).astype(np.int64)
        slices = np.concatenate([plain, ~plain])  # the second half: for negative digits, 2^bits - 1 - x
        everyone = np.zeros(words * 64, bool)
        everyone[:n] = True
        place_of = {a: p for p, a in enumerate(block["at"])}
        for q, query_id, w in zip(*(queries.column(c).to_pylist() for c in ("q", "query_id", "v")), strict=True):
            column_of, rows_of = [], []
            for j, x in enumerate(w):
                for place, sign in digits(x):
                    own = np.arange(bits[j])
                    column_of.append(own + place)
                    rows_of.append(own + begin[j] + (len(plain) if sign < 0 else 0))
            column_of, rows_of = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (column_of, rows_of))
            among = everyone.copy()
            if q in place_of:
                among[place_of[q]] = False
            best = top(added(column_of, rows_of, slices), np.packbits(among, bitorder="little").view(np.uint64), k)
            bit = (plain[:, best >> 6] >> (best & 63).astype(np.uint64)) & np.uint64(1)
            x = np.array([(bit[begin[j] : begin[j + 1]].astype(np.int64) << np.arange(bits[j])[:, None]).sum(0) + low[j] for j in range(d)]).reshape(d, len(best))
            score = np.array(w, np.int64) @ x if d else np.zeros(len(best), np.int64)
            out["q"] += [q] * len(best)
            out["query_id"] += [query_id] * len(best)
            out["vec_id"] += [ids[p] for p in best.tolist()]
            out["at"] += at[best].tolist()
            out["score"] += score.tolist()
    return pa.table({c: pa.array(x, pa.int64()) for c, x in out.items()})


def search(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, q, rank (from 1), vec_id, at, score: the ``k`` rows of ``index`` with the greatest inner products with each of ``queries`` (q, query_id, d, v), but the row
    whose number is q. Ties go to the smaller vec_id (nulls last), then the smaller at.

    Each block of queries meets each block of the index of the same length of vectors in a task of its own; both are bounded. Per query and
    block k rows leave the task, and the best of these are ranked.
    """
    packed = dealt(queries.withColumnRenamed("q", "at"), QUERIES, "part").withColumnRenamed("at", "q")
    packed = packed.groupBy("d", "part").agg(F.collect_list(F.struct("q", "query_id", "v")).alias("queries"), F.first("parts").alias("parts"))
    packed = table(packed)
    blocks = index.groupBy("d").agg(F.count("*").cast("int").alias("blocks"))
    parts = packed.groupBy("d").agg(F.first("parts").alias("parts"))
    pairs = blocks.join(parts, "d").agg(F.sum(F.col("blocks").cast("long") * F.col("parts"))).first()[0] or 1
    deal = min(4 * pairs, PARTS)
    keys = ["d", "block", "part"]
    left = index.join(F.broadcast(parts), "d").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts").repartition(deal, *keys)
    right = packed.drop("parts").join(F.broadcast(blocks), "d").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks").repartition(deal, *keys)
    unpacked = lambda r: pa.Table.from_pylist([x for rows in r.column("queries").to_pylist() for x in rows], pa.schema([("q", pa.int64()), ("query_id", pa.int64()), ("v", pa.list_(pa.int32()))]))
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: compared(a, unpacked(b), k), "q long, query_id long, vec_id long, at long, score long")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "at"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "q", "rank", "vec_id", "at", "score")


def top_products(embeddings: DataFrame, divisor: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: each row whose vec_id is divisible by ``divisor`` against every other row of ``embeddings`` (vec_id, embedding).

    Components are floor(scale * x). Vectors that are null or hold null or non-finite components take no part; vectors of different lengths don't
    meet, and empty ones score 0 with each other. A null vec_id is no query and comes last among equals. Rows that repeat a vec_id are rows of their own:
    each is a query, and each is a candidate for the other. With fewer candidates there are fewer ranks; an empty table gives no rows. A component
    of 2^27 or more as an integer fails with a message. Other columns are not read.
    """
    rows = numbered(embeddings, scale)
    queries = rows.where(F.col("vec_id") % divisor == 0).select(F.col("at").alias("q"), F.col("vec_id").alias("query_id"), "d", "v")
    return search(build(rows), queries, k).select("query_id", "rank", "vec_id", "score")


#: The same rows for DuckDB, where vec_id is unique and all vectors have one length.
TOP_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 5
"""
