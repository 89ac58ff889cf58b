"""N-gram Jaccard join: MinHash bands propose pairs, Bayesian pruning drops hopeless ones, exact Jaccard decides."""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neighbours import components, meet
from .scratch import BROADCAST_ROWS, table
from .words import Words, grams, mix, slices

N, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 4
#: A pair goes when the posterior chance of reaching the threshold is below this.
TOLERANCE = 1e-6
STEP = 16
#: Sets and shingles of a block of a bucket, and pairs that are compared at once.
BLOCK_SETS, BLOCK_SHINGLES, PAIRS = 1024, 1 << 21, 1 << 18
#: Shingles of a tile that one product takes.
COLUMNS = 1 << 14
#: Odd factors; the top bits of a product with a scrambled shingle are its hash.
_SEEDS = np.random.default_rng(7).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least_matches() -> list[int]:
    """For STEP, 2 STEP, ... compared values, the fewest matches whose posterior (uniform prior) isn't hopeless."""
    out = []
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        # P(J >= t | m of n) under Beta(m + 1, n - m + 1) is a binomial sum
        chance = lambda m, n=n: sum(comb(n + 1, k) * THRESHOLD**k * (1 - THRESHOLD) ** (n + 1 - k) for k in range(m + 1))
        out.append(next(m for m in range(n + 1) if chance(m) >= TOLERANCE))
    return out


def shingled(docs: DataFrame) -> DataFrame:
    """doc_id, set_id (hash of the distinct shingles, null without words), shingles and MinHash signature of each row: a long for each band, four values of 16 bits that tell the least shingles apart."""

    def run(batches):
        for batch, data, offsets in slices(batches):
            w = Words(data, offsets)
            h, begin = grams(w.hashes(), w.first, N)
            ids, sets, sigs = [], [], []
            for a, b in zip(begin[:-1], begin[1:], strict=True):
                own = np.unique(h[a:b])
                sets.append(own.view(np.int64))
                if not len(own):
                    ids.append(None)
                    sigs.append(None)
                    continue
                ids.append(int(mix(np.array([mix(own).sum(dtype=np.uint64) + np.uint64(len(own))]))[:1].view(np.int64)[0]))
                sigs.append(np.array([int((own * s).min()) >> 20 & 0xFFFF for s in _SEEDS], np.uint16).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64())), pa.array(sigs, pa.list_(pa.int64()))], names=["doc_id", "set_id", "shingles", "sig"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, set_id long, shingles array<long>, sig array<long>")


def members(sets: DataFrame) -> DataFrame:
    """(band, key, i, j, own, id): the sets of every bucket of two or more, dealt into blocks by hash, each block sent to all pairs of blocks (i <= j) that it is in; written as a table.

    A bucket with the very members of one of a lower band is left out: its pairs all agree there first, where they are compared.
    """
    keyed = sets.select("id", "size", F.posexplode("sig").alias("band", "key"))
    print_ = (F.expr("bit_xor(xxhash64(id))"), F.expr("bit_xor(xxhash64(1, id))"))
    shared = keyed.groupBy("band", "key").agg(F.count("*").alias("n"), F.sum("size").alias("total"), *(x.alias(f"f{k}") for k, x in enumerate(print_))).where("n > 1")
    own = shared.groupBy("n", "f0", "f1").agg(F.min(F.struct("band", "key", "total")).alias("b"))
    m = F.ceil(F.greatest(F.col("n") / BLOCK_SETS, F.col("b.total") / BLOCK_SHINGLES)).cast("int")
    dealt = keyed.drop("size").join(own.select("b.band", "b.key", m.alias("m")), ["band", "key"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("m")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    return table(dealt.select("band", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("own"), "id"))


def hopeful(sig: np.ndarray, band: np.ndarray, a: np.ndarray, b: np.ndarray, floor: list[int]) -> np.ndarray:
    """Which pairs of rows ``a`` and ``b`` of ``sig`` survive: MinHash values are compared ``STEP`` at a time, and a pair goes once its matches make the threshold hopeless. Each pair counts
    in the first band that it agrees in, and nowhere else."""
    values = sig.view(np.uint16)
    live, matches = np.arange(len(a)), np.zeros(len(a), np.int32)
    for k, least in enumerate(floor):
        part = slice(k * STEP, (k + 1) * STEP)
        matches[live] += (values[a[live], part] == values[b[live], part]).sum(1, dtype=np.int32)
        live = live[matches[live] >= least]
    for k in range(int(band.max(initial=0))):
        live = live[~((band[a[live]] > k) & (sig[a[live], k] == sig[b[live], k]))]
    out = np.zeros(len(a), bool)
    out[live] = True
    return out


def survivors(dealt: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of ``members`` that have a surviving partner in their pair of blocks, written as a table. Pairs themselves never leave a task."""
    names = ["band", "key", "i", "j", "own", "id"]
    floor = least_matches()

    def compared(rows: pa.Table):
        rows = rows.combine_chunks()
        band, key, i, j, own = (rows.column(c).to_numpy() for c in names[:5])
        sig = np.ascontiguousarray(rows.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, BANDS))
        new = np.ones(len(band), bool)
        new[1:] = (np.diff(band) != 0) | (np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)
        group = np.cumsum(new) - 1
        start = np.flatnonzero(new)[group]
        count = np.where(i == j, np.arange(len(band)) - start, np.where(own == 1, np.bincount(group, own == 0).astype(np.int64)[group], 0))
        ends = np.cumsum(count)
        mark, begin = np.zeros(len(band), bool), 0
        while begin < len(band):
            before = ends[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(ends, before + PAIRS, "right")))
            a = np.repeat(np.arange(begin, stop), count[begin:stop])
            b = start[a] + np.arange(len(a)) - (ends[a] - count[a] - before)
            held = hopeful(sig, band, a, b, floor)
            mark[a[held]] = mark[b[held]] = True
            begin = stop
        yield from rows.select(names).filter(pa.array(mark)).to_batches()

    def run(batches):
        rest = None
        for batch in batches:
            whole = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if whole.num_rows:
                last = [whole.column(c).to_numpy() for c in names[:4]]
                other = np.flatnonzero(np.logical_or.reduce([x != x[-1] for x in last]))
                cut = int(other[-1]) + 1 if len(other) else 0
                if cut:
                    yield from compared(whole.slice(0, cut))
                rest = whole.slice(cut)
        if rest is not None and rest.num_rows:
            yield from compared(rest)

    full = dealt.join(sets.select("id", "sig"), "id").select(*names, "sig").repartition("band", "key", "i", "j").sortWithinPartitions(*names)
    return table(full.mapInArrow(run, "band int, key long, i int, j int, own int, id long"))


def linked(rows: np.ndarray, other: np.ndarray, at: np.ndarray, values: np.ndarray, own: list[np.ndarray]) -> np.ndarray:
    """Which sets of tile ``rows`` reach the threshold with which of tile ``other``: exact sizes of intersections by products of 0/1 rows.

    ``values`` has shingle numbers, ``at`` where each set's begin, ``own`` the distinct numbers of both tiles.
    """
    common = np.zeros((len(rows), len(other)))
    both = np.intersect1d(*own, assume_unique=True)
    for k in range(0, len(both), COLUMNS):
        part = both[k : k + COLUMNS]
        sides = []
        for tile in (rows, other):
            v = values[at[tile[0]] : at[tile[-1] + 1]]
            place = np.minimum(np.searchsorted(part, v), len(part) - 1)
            held = part[place] == v
            side = np.zeros((len(tile), len(part)), np.float32)
            side[np.repeat(np.arange(len(tile)), np.diff(at[tile[0] : tile[-1] + 2]))[held], place[held]] = 1
            sides.append(side)
        common += sides[0] @ sides[1].T
    n = np.diff(at)
    return common >= THRESHOLD * (n[rows][:, None] + n[other][None, :] - common)


def compared(group: pa.Table) -> pa.Table:
    """``meet`` of one block of a bucket with itself or of two blocks: pairs that survive the comparison of MinHash values are decided by exact intersections."""
    group = group.sort_by("own").combine_chunks()
    ids, n, own, band = (group.column(c).to_numpy() for c in ("id", "n", "own", "band"))
    sig = np.ascontiguousarray(group.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, BANDS))
    lists = group.column("shingles").combine_chunks()
    at = lists.offsets.to_numpy().astype(np.int64)
    values = np.unique(lists.values.to_numpy()[at[0] : at[-1]], return_inverse=True)[1]
    at -= at[0]
    seen: dict[int, np.ndarray] = {}
    floor = least_matches()

    def link_of(rows, cols):
        live = hopeful(sig, band, np.repeat(rows, len(cols)), np.tile(cols, len(rows)), floor).reshape(len(rows), len(cols))
        if not live.any():
            return live
        for t in (rows, cols):
            if t[0] not in seen:
                seen[t[0]] = np.unique(values[at[t[0]] : at[t[-1] + 1]])
        return live & linked(rows, cols, at, values, [seen[rows[0]], seen[cols[0]]])

    return meet(ids, n, own, link_of)


def links(sets: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the ``sets`` (id, low, sig, size, n): (a, b) whose components are the classes, and (a, others) with each set's linked rows.

    ``low`` is the smallest doc_id that has the set. Only sets with a surviving pair are shingled again for the exact check, so shingles of all
    documents are never stored. Every bucket is compared alike, block by block, whatever its size: links are counted where
    two blocks meet, and only counts and components leave the tasks.
    """
    alive = survivors(members(sets), sets)
    lows = table(sets.join(alive.select("id").distinct(), "id", "left_semi").select("low").distinct())
    lows = F.broadcast(lows) if lows.count() <= BROADCAST_ROWS else lows
    again = shingled(docs.join(lows, F.col("doc_id").eqNullSafe(F.col("low")), "left_semi"))
    again = table(again.where("set_id is not null").select(F.col("set_id").alias("id"), "shingles").dropDuplicates(["id"]))
    full = alive.join(sets.select("id", "n", "sig"), "id").join(again, "id").select("band", "key", "i", "j", "own", "id", "n", "sig", "shingles")
    within = table(full.groupBy("band", "key", "i", "j").applyInArrow(compared, "a long, b long, others long"))
    return within.where("a <> b").select("a", "b").distinct(), within.groupBy("a").agg(F.sum("others").alias("others"))


def classes(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (its class's smallest doc_id), n_links (other rows linked), kept.

    Texts with the same shingle set are one representative and link with each other. A text without
    words (null and empty ones too) has no link and is its own class. A text of one to four words has
    all its words as its shingle. Kept: the row of the smallest (doc_id, set) of its class; of exact repeats of a doc_id all have
    the same result. Rows with a null doc_id count as links and are never kept in a class that has an id.
    """
    rows = table(shingled(docs).withColumn("size", F.size("shingles")).drop("shingles"))
    sets = table(rows.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")))
    unique = table(rows.where("set_id is not null").groupBy(F.col("set_id").alias("id")).agg(F.min("doc_id").alias("low"), F.first("sig").alias("sig"), F.first("size").alias("size"), F.count("*").alias("n")))
    found, near = links(unique, docs)
    part = components(found)
    known = sets.join(part, sets.set_id == part.id, "left").join(near, sets.set_id == near.a, "left")
    known = known.select("set_id", "low", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "set_id").alias("component"))
    lowest = known.groupBy("component").agg(F.min("low").alias("class_low"))
    known = known.join(lowest, "component").select(F.col("set_id").alias("of_set"), "n_links", "class_low")
    out = rows.select("doc_id", "set_id").join(known, F.col("set_id") == F.col("of_set"), "left")
    class_id = F.coalesce("class_low", "doc_id")
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), class_id.eqNullSafe(F.col("doc_id")).alias("kept"))
