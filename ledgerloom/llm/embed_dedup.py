"""Embedding near-duplicates within a label by NN-descent: a neighbour graph refined through neighbours of neighbours, its edges at the threshold."""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .neighbours import block_pairs, components, meet
from .scratch import drop, table

THRESHOLD = 0.98
#: Neighbours a list starts with. A list that is full of links is saturated and doubles, up to LONGEST.
NEIGHBOURS, LONGEST = 8, 32
#: Nodes of a cell of the start graph, and how many random cuts into cells a pass adds.
CELL, CUTS = 256, 4
#: Rounds go on while they change more than this share of all list entries.
SETTLED = 0.001
#: The audit compares about this many nodes with all of their label, and as many of those with a neighbour at NEAR or more, which are where links are; passes go on
#: while fewer than RECALL of their links are found. STALLED passes that find no more end it, with an error below LEAST.
AUDIT, RECALL, NEAR, STALLED, LEAST = 1000, 0.99, 0.9, 3, 0.9
#: Vectors and numbers of a block of a crowd.
BLOCK_VECTORS, BLOCK_NUMBERS = 8192, 1 << 20

log = logging.getLogger(__name__)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of one length as a matrix of unit vectors; each is first scaled by its largest number, so no square over- or underflows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    v = column.flatten().to_numpy().reshape(len(column), -1)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def best(a: np.ndarray, b: np.ndarray, cos: np.ndarray, k: int) -> pa.RecordBatch:
    """The ``k`` greatest of each a, as a record batch."""
    order = np.lexsort((b, -cos, a))
    a, b, cos = a[order], b[order], cos[order]
    first = np.flatnonzero(np.diff(a, prepend=a[:1] - 1)) if len(a) else np.zeros(0, np.int64)
    place = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
    return pa.RecordBatch.from_arrays([pa.array(x[place < k]) for x in (a, b, cos)], names=["a", "b", "cos"])


def start(nodes: DataFrame, seed: int) -> DataFrame:
    """(a, b, cos): each node's nearest in its cells. A cell holds the nodes of a label on the same sides of random planes, as many planes as keep cells at about
    ``CELL`` nodes; a fuller cell is dealt into chunks by hash."""
    sizes = nodes.groupBy("kind").agg(F.count("*").alias("size"))
    planes = F.greatest(F.ceil(F.log2(F.col("size") / CELL)), F.lit(0)).cast("int")

    def coded(batches):
        for batch in batches:
            if batch.num_rows:
                v, out = batch.column(3), np.zeros((batch.num_rows, CUTS), np.int64)
                lengths, bits = np.diff(v.offsets.to_numpy()), batch.column(2).to_numpy()
                for d in np.unique(lengths).tolist():
                    rows = np.flatnonzero(lengths == d)
                    m = matrix(v.take(pa.array(rows)))
                    for cut in range(CUTS):
                        sides = m @ np.random.default_rng([seed, cut, d]).normal(size=(d, 48)) > 0
                        used = np.arange(48) < bits[rows, None]
                        out[rows, cut] = ((sides & used).astype(np.int64) << np.arange(48)).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), CUTS).cast(pa.list_(pa.int64())), v], names=["id", "kind", "codes", "v"])

    cells = nodes.join(sizes, "kind").select("id", "kind", planes.alias("planes"), "v").mapInArrow(coded, "id long, kind long, codes array<long>, v array<double>")
    cells = cells.select("id", "kind", "v", F.posexplode("codes").alias("cut", "code"))
    chunks = cells.groupBy("kind", "cut", "code").agg(F.ceil(F.count("*") / (2 * CELL)).alias("chunks"))
    cells = cells.join(chunks, ["kind", "cut", "code"]).withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(seed)), F.col("chunks")))

    def nearest(group: pa.Table) -> pa.Table:
        ids, v = group.column("id").to_numpy(), matrix(group.column("v"))
        cos = v @ v.T
        np.fill_diagonal(cos, -2)
        k = min(NEIGHBOURS, len(ids) - 1)
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(ids), 0), np.int64)
        return pa.table({"a": np.repeat(ids, max(k, 0)), "b": ids[near.ravel()], "cos": np.take_along_axis(cos, near, 1).ravel()})

    return cells.groupBy("kind", "cut", "code", "chunk").applyInArrow(nearest, "a long, b long, cos double").dropDuplicates(["a", "b"])


def trimmed(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """The nearest of each node's different ``edges`` (a, b, cos, fresh), as many as ``wanted`` (id, k) says; written as a table.

    An edge that was there before is not fresh.
    """
    one = edges.groupBy("a", "b").agg(F.max("cos").alias("cos"), F.min("fresh").alias("fresh"))
    one = one.join(wanted.withColumnRenamed("id", "a"), "a")
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cos"), "b"))
    return table(one.withColumn("place", place).where("place <= k").select("a", "b", "cos", "fresh"))


def nearer(lists: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(a, b, cos) from comparing each node and its neighbours with each other: pairs that would enter the list of a. Pairs that met before are left out."""
    held = lists.groupBy("a").agg(F.count("*").alias("n"), F.min("cos").alias("worst")).join(wanted.withColumnRenamed("id", "a"), "a")
    least = held.select(F.col("a").alias("c"), F.when(F.col("n") < F.col("k"), -2.0).otherwise(F.col("worst")).alias("least"))
    member = lists.select(F.col("a").alias("at"), F.col("b").alias("c"), "fresh").union(lists.select("a", "a").distinct().select("a", "a", F.lit(False)))
    sides = nodes.select(F.col("id").alias("c"), "v").join(least, "c")
    dealt = member.join(sides, "c").select("at", "c", "fresh", "least", "v").repartition("at").sortWithinPartitions("at")

    def meetings(at, c, fresh, least, column):
        """Groups of equal ``at`` of one vector length."""
        first = np.flatnonzero(np.diff(at, prepend=at[0] - 1))
        size = np.diff(np.append(first, len(at)))
        wide, v = int(size.max()), matrix(column)
        place = np.arange(len(at)) - np.repeat(first, size)
        group = np.repeat(np.arange(len(size)), size)
        cube = np.zeros((len(size), wide, v.shape[1]))
        cube[group, place] = v
        padded = lambda x, fill: (lambda out: (out.__setitem__((group, place), x), out)[1])(np.full((len(size), wide), fill, x.dtype))
        who, new, floor = padded(c, -1), padded(fresh, False), padded(least, 3.0)
        cos = np.matmul(cube, cube.transpose(0, 2, 1))
        good = (cos > floor[:, :, None]) & (new[:, :, None] | new[:, None, :]) & (who[:, :, None] != who[:, None, :]) & (padded(np.ones(len(at), bool), False)[:, None, :])
        g, i, j = np.nonzero(good)
        return best(who[g, i], who[g, j], cos[g, i, j], LONGEST)

    def run(batches):
        rest = None
        for batch in batches:
            whole = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            at = whole.column("at").to_numpy()
            cut = int(np.searchsorted(at, at[-1])) if len(at) else 0
            ready, rest = whole.slice(0, cut), whole.slice(cut)
            if cut:
                yield from by_length(ready)
        if rest is not None and rest.num_rows:
            yield from by_length(rest)

    def by_length(rows: pa.Table):
        rows = rows.combine_chunks()
        lengths = np.diff(rows.column("v").combine_chunks().offsets.to_numpy())
        for d in np.unique(lengths).tolist():
            part = rows.take(pa.array(np.flatnonzero(lengths == d))).combine_chunks()
            at, c, fresh, least = (part.column(x).to_numpy() for x in ("at", "c", "fresh", "least"))
            step = max(1, BLOCK_NUMBERS // d)
            begin = 0
            while begin < len(at):
                stop = int(np.searchsorted(at, at[min(begin + step, len(at)) - 1], "right"))
                yield meetings(*(x[begin:stop] for x in (at, c, fresh, least)), part.column("v").slice(begin, stop - begin))
                begin = stop

    return dealt.mapInArrow(run, "a long, b long, cos double")


def descend(lists: DataFrame, nodes: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``lists`` refined until they settle, with the lengths that they have then: saturated lists are enlarged and refined again."""
    while True:
        found = nearer(lists, nodes, wanted).withColumn("fresh", F.lit(True))
        new = trimmed(lists.withColumn("fresh", F.lit(False)).unionByName(found), wanted)
        entries, changed = new.agg(F.count("*"), F.count_if("fresh")).first()
        drop(lists)
        lists = new
        if changed > SETTLED * entries:
            continue
        full = lists.join(wanted.withColumnRenamed("id", "a"), "a").groupBy("a").agg(F.count("*").alias("n"), F.min("cos").alias("worst"), F.first("k").alias("k"))
        full = table(full.where((F.col("n") == F.col("k")) & (F.col("worst") >= THRESHOLD) & (F.col("k") < LONGEST)).select(F.col("a").alias("id"), F.lit(True).alias("saturated")))
        if full.isEmpty():
            return lists, wanted
        wanted = table(wanted.join(full, "id", "left").select("id", F.when(F.col("saturated"), F.col("k") * 2).otherwise(F.col("k")).alias("k"), "saturated"))
        lists = table(lists.join(wanted.withColumnRenamed("id", "a"), "a").select("a", "b", "cos", F.coalesce("saturated", F.lit(False)).alias("fresh")))
        wanted = wanted.drop("saturated")


def compared(group: pa.Table) -> pa.Table:
    """``meet`` of one block with itself or of two blocks of vectors of one length; cosines in double precision."""
    group = group.sort_by("own").combine_chunks()
    v = matrix(group.column("v"))
    return meet(*(group.column(c).to_numpy() for c in ("id", "n", "own")), lambda x, y: v[x] @ v[y].T >= THRESHOLD)


def links(lists: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b) whose components are the classes, and (a, others): the rows that each node links with.

    Where a list is full of links at its longest, the node's whole component is a crowd: its nodes are compared exactly, block by block, in
    tasks that emit counts and components.
    """
    near = table(lists.where(F.col("cos") >= THRESHOLD).select("a", "b"))
    both = table(near.union(near.select("b", "a")).distinct())
    full = near.groupBy("a").count().where(F.col("count") >= LONGEST).select("a")
    if full.isEmpty():
        return both, both.join(nodes.select(F.col("id").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("others"))
    part = components(both)
    crowds = part.join(full.withColumnRenamed("a", "id"), "id", "left_semi").select("component").distinct()
    crowd = table(part.join(crowds, "component").join(nodes, "id").select("id", "n", "v", "component"))
    dealt = block_pairs(crowd, ["component"], F.greatest(F.count("*") / BLOCK_VECTORS, F.sum(F.size("v")) / BLOCK_NUMBERS))
    within = table(dealt.select("component", "i", "j", "own", "id", "n", "v").groupBy("component", "i", "j").applyInArrow(compared, "a long, b long, others long"))
    rest = both.join(crowd.select(F.col("id").alias("a")), "a", "left_anti").join(nodes.select(F.col("id").alias("b"), "n"), "b").select("a", F.col("n").alias("others"))
    return both.union(within.where("a <> b").select("a", "b")), rest.union(within.select("a", "others")).groupBy("a").agg(F.sum("others").alias("others"))


def audit(nodes: DataFrame, lists: DataFrame, others: DataFrame) -> float:
    """Share of the links of a bounded sample of ``nodes`` that ``others`` (a, others) counts; the sample is compared with all of its label. One half of it is chosen
    by hash from all nodes, one from those with a near neighbour in ``lists``, since links may be so rare that the first holds none."""
    count, numbers = nodes.agg(F.count("*"), F.sum(F.size("v"))).first()
    if not count:
        return 1.0
    size, by = min(AUDIT, BLOCK_NUMBERS * 2 * count / numbers), F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    near = table(lists.where(F.col("cos") >= NEAR).select(F.col("a").alias("id")).distinct())
    some = near.where(by < int(min(1.0, size / max(1, near.count())) * (1 << 30))).withColumn("near", F.lit(True))
    chosen = nodes.join(some, "id", "left").where((by < int(min(1.0, size / count) * (1 << 30))) | F.col("near")).drop("near")
    sample = chosen.select("id", "kind", "v").toArrow().combine_chunks()
    if not sample.num_rows:
        return 1.0
    kinds = {k: np.flatnonzero(sample.column("kind").to_numpy() == k) for k in np.unique(sample.column("kind").to_numpy()).tolist()}
    sides = {k: (sample.column("id").to_numpy()[rows], matrix(sample.column("v").combine_chunks().take(pa.array(rows)))) for k, rows in kinds.items()}

    def run(batches):
        for batch in batches:
            kind = batch.column(1).to_numpy()
            for k in np.unique(kind).tolist():
                if k in sides:
                    ids, v = sides[k]
                    n = np.zeros(len(ids))
                    own = np.flatnonzero(kind == k)
                    for rows in np.array_split(own, -(-len(own) // 1024)):
                        near = v @ matrix(batch.column(3).take(pa.array(rows))).T >= THRESHOLD
                        n += (near & (ids[:, None] != batch.column(0).to_numpy()[rows][None, :])) @ batch.column(2).to_numpy()[rows]
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n.astype(np.int64))], names=["a", "there"])

    there = nodes.select("id", "kind", "n", "v").mapInArrow(run, "a long, there long").groupBy("a").agg(F.sum("there").alias("there"))
    total, found = there.join(others, "a", "left").agg(F.sum("there"), F.sum("others")).first()
    return 1.0 if not total else (found or 0) / total


def graph(nodes: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """``links`` of the neighbour graph of ``nodes`` (id, kind, n, v), and the share of links that the audit finds in it. While that is too low, a pass with other
    random cells is added to the lists. It ends in any case, and fails rather than return a graph below ``LEAST``."""
    wanted = table(nodes.select("id", F.lit(NEIGHBOURS).alias("k")))
    lists, seed, before, stalled = None, 1, -1.0, 0
    while True:
        more = start(nodes, seed).withColumn("fresh", F.lit(True))
        lists, wanted = descend(trimmed(more if lists is None else lists.withColumn("fresh", F.lit(False)).unionByName(more), wanted), nodes, wanted)
        edges, others = links(lists, nodes)
        others = table(others)
        recall = audit(nodes, lists, others)
        log.info("pass %d of the neighbour graph finds %.4f of the sample's links", seed, recall)
        stalled = 0 if recall > before else stalled + 1
        if recall >= RECALL or stalled >= STALLED:
            if recall < LEAST:
                raise RuntimeError(f"the neighbour graph holds {recall:.3f} of a sample's links after {seed} passes")
            return edges, others, recall
        before, seed = max(before, recall), seed + 1


def near_duplicates(embeddings: DataFrame) -> DataFrame:
    """One row per row of ``embeddings`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors that are null, empty or zero or hold null or non-finite components, and those with a null label, link with nothing. Equal vectors of a
    label are one node and link with each other. Vectors of different lengths never link. Repeated rows are other vectors. A null vec_id counts
    as a link, and its component is the smallest id there. All links are checked by exact cosines, so none is false; recall is audited. Other
    columns are not read; an empty table gives no rows.
    """
    e = embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    good = F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    good = F.coalesce(good, F.lit(False))
    rows = e.where(good).withColumn("node", F.xxhash64("label", "v"))
    sets = table(rows.groupBy("node").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("v").alias("v")))
    edges, others, _ = graph(sets.select(F.col("node").alias("id"), F.xxhash64("label", F.size("v")).alias("kind"), "n", "v"))
    part = components(edges.where("a <> b").distinct())
    known = sets.join(part, sets.node == part.id, "left").join(others, sets.node == others.a, "left").select("node", "low", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("part"))
    lowest = known.groupBy("part").agg(F.min("low").alias("component_id"))
    known = known.join(lowest, "part").select("node", "n_links", "component_id")
    out = e.select("vec_id", F.when(good, F.xxhash64("label", "v")).alias("own")).join(known, F.col("own") == F.col("node"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
