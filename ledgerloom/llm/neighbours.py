"""Steps that the pair operators share: all pairs of groups block by block, and components of links."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import drop, table


#: Members of a tile within a block.
TILE = 256


def block_pairs(groups: DataFrame, by: list[str], m: Column) -> DataFrame:
    """``groups`` (with id) dealt into as many blocks a group as the aggregate ``m`` says, and each block sent to every pair (i <= j) that it is in; ``own`` is 1 for the rows of j."""
    dealt = groups.join(groups.groupBy(*by).agg(F.ceil(m).cast("int").alias("m")), by).withColumn("block", F.pmod(F.xxhash64("id"), F.col("m")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    return dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other"), "own": (F.col("block") > F.col("other")).cast("int")}).drop("m", "block", "other")


def meet(ids: np.ndarray, n: np.ndarray, own: np.ndarray, link_of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> pa.Table:
    """(a, b, others) of one block with itself or of two blocks (``own`` 0, then 1): each linked id, one of its component here, and its linked rows here.

    ``link_of`` gives which members of one tile link with which of another.
    """
    cut = int(np.searchsorted(own, 1))
    tiles = [np.arange(k, min(k + TILE, stop)) for start, stop in ((0, cut), (cut, len(ids))) for k in range(start, stop, TILE)]
    others, parent = np.zeros(len(ids), np.int64), np.arange(len(ids))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, rows in enumerate(tiles):
        for cols in tiles[x:]:
            if cut < len(ids) and not rows[0] < cut <= cols[0]:
                continue
            link = link_of(rows, cols)
            if rows[0] == cols[0]:
                np.fill_diagonal(link, False)
            else:
                others[cols] += n[rows] @ link
            others[rows] += link @ n[cols]
            a, b = (t[k] for t, k in zip((rows, cols), np.nonzero(link), strict=True))
            while len(a):  # first one link of each member, then those between what is still apart
                some = np.union1d(np.unique(a, return_index=True)[1], np.unique(b, return_index=True)[1])
                for i, j in zip(a[some].tolist(), b[some].tolist(), strict=True):
                    i, j = root(i), root(j)
                    parent[max(i, j)] = min(i, j)
                top = parent
                while (top[top] != top).any():
                    top = top[top]
                apart = top[a] != top[b]
                a, b = a[apart], b[apart]
    found = np.flatnonzero(others)
    return pa.table({"a": ids[found], "b": ids[[root(i) for i in found.tolist()]], "others": others[found]})


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b): the smallest id that it reaches.

    Each round joins an id to its neighbours' smallest label and then to that label's own label, so the
    rounds grow with the logarithm of a component's width; every round is a written table.
    """
    both = table(links.select("a", "b").union(links.select("b", "a")))
    labels = table(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("component").alias("low"))
        step = labels.join(near, labels.id == near.a).select("id", F.col("component").alias("old"), F.least("component", "low").alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("component").alias("far"))
        new = table(step.join(jump, "low", "left").select("id", "old", F.least("low", F.coalesce("far", "low")).alias("component")))
        moved = new.where("component <> old").limit(1).count()
        drop(labels)
        labels = new
        if not moved:
            return labels.select("id", "component")
