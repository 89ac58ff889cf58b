"""Benchmark decontamination with spaced seeds, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import BROADCAST_ROWS, table

#: Word places that a seed reads; the others may differ. A run of ``SPAN`` words has a seed of each mask.
MASKS = ((0, 1, 2, 4, 7, 8), (0, 2, 3, 6, 7, 8), (0, 1, 3, 5, 6, 8))
SPAN = 9
#: Words of the shortest item that is looked for.
SHORTEST = 3
#: An overlap is a run of at least so many words of an item, or the whole of a shorter item, that agrees in ``SIMILARITY`` of its words.
RUN = 15
SIMILARITY = 0.8
#: Hits of an item whose diagonals lie this near are read together, so a few words put in or left out don't end a run.
DRIFT = 2
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(F.regexp_extract_all(low, F.lit(WORDS), F.lit(0)), F.array().cast("array<string>"))


def seeds(text: Column, lengths: list[int], whole: bool) -> Column:
    """Structs (p, seed) of every place and mask of a text's words, and of every run of each of ``lengths`` words; if ``whole``, of that run alone that is the text.

    The words are bound by a lambda, so they are split and hashed once for the text.
    """
    run = lambda h, n: lambda p: F.struct(p.alias("p"), F.xxhash64(F.lit(-n), *(F.get(h, p + i) for i in range(n))).alias("seed"))

    def of(h: Column) -> Column:
        nothing = F.array().cast("array<int>")
        places = lambda n: F.when(F.size(h) >= n, F.sequence(F.lit(0), F.size(h) - n)).otherwise(nothing)
        spaced = F.flatten(F.transform(places(SPAN), lambda p: F.array(*(F.struct(p.alias("p"), F.xxhash64(F.lit(k), *(F.get(h, p + i) for i in mask)).alias("seed")) for k, mask in enumerate(MASKS)))))
        if whole:
            short = [F.transform(F.when(F.size(h) == n, F.array(F.lit(0))).otherwise(nothing), run(h, n)) for n in lengths]
        else:
            short = [F.transform(places(n), run(h, n)) for n in lengths]
        return F.concat(spaced, *short) if short else spaced

    return F.get(F.transform(F.array(F.transform(words(text), lambda w: F.xxhash64(w))), of), F.lit(0))


def best_run(equal: Column) -> Column:
    """The best share of equal words in a run that is long enough and, unless it is the whole item, begins and ends with equal words; null if none."""
    n = F.size(equal)
    least = F.least(n, F.lit(RUN))
    sums = F.aggregate(equal, F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))

    def of(p: Column) -> Column:
        ends = lambda i: (F.get(equal, i) == 1) | (n <= RUN)
        share = lambda a: F.array_max(F.transform(F.sequence(a + least, n), lambda b: F.when(ends(b - 1), (F.get(p, b) - F.get(p, a)) / (b - a))))
        return F.array_max(F.transform(F.sequence(F.lit(0), n - least), lambda a: F.when(ends(a), share(a))))

    return F.get(F.transform(F.array(sums), of), F.lit(0))


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, overlap) of items of which a run around hits agrees in ``SIMILARITY`` of its words.

    Each hit gives a diagonal, on which the whole item is laid beside the text; near diagonals count together.
    Items of fewer words than ``SPAN`` have no spaced seed: those of at least ``SHORTEST`` words are found by the hash of all their words, shorter
    ones match nothing, since such words stand in clean texts too.
    """
    items = table(benchmark.select(words(F.col("text")).alias("item"), "item_id", "text").withColumn("i_id", F.xxhash64("item")))
    lengths = sorted(r[0] for r in items.select(F.size("item")).distinct().where(F.size("item").between(SHORTEST, SPAN - 1)).collect())
    small = table(items.select("i_id", F.explode(seeds(F.col("text"), lengths, True)).alias("s")).select("i_id", F.col("s.p").alias("j"), "s.seed").distinct())
    if small.count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    d = docs.select("doc_id", F.explode(seeds(F.col("text"), lengths, False)).alias("s")).select("doc_id", F.col("s.p").alias("p"), "s.seed")
    hit = d.join(small, "seed").select("doc_id", "i_id", (F.col("p") - F.col("j")).alias("from")).groupBy("doc_id", "i_id").agg(F.collect_set("from").alias("from"))
    by_doc = hit.join(items.select("i_id", "item_id", "item"), "i_id").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "from", "item")).alias("hits")).withColumnRenamed("doc_id", "hit_id")
    full = docs.select("doc_id", "text").join(by_doc, F.col("doc_id").eqNullSafe(F.col("hit_id")))

    def matched(w: Column, h: Column, sorted_: Column) -> Column:
        def beside(start: Column, k: Column) -> Column:
            # diagonals differ, so those near one stand within DRIFT places of it
            near = F.filter(F.slice(sorted_, F.greatest(k + 1 - DRIFT, F.lit(1)), F.lit(2 * DRIFT + 1)), lambda x: F.abs(x - start) <= DRIFT)
            equal = F.transform(h["item"], lambda word, i: F.exists(near, lambda x: F.coalesce(F.get(w, x + i) == word, F.lit(False))).cast("int"))
            return F.get(F.transform(F.array(equal), best_run), F.lit(0))

        return F.array_max(F.transform(sorted_, beside))

    checked = F.get(F.transform(F.array(words(F.col("text"))), lambda w: F.transform(F.col("hits"), lambda h: F.struct(h["item_id"].alias("item_id"), F.get(F.transform(F.array(F.array_sort(h["from"])), lambda s: matched(w, h, s)), F.lit(0)).alias("overlap")))), F.lit(0))
    return full.select("doc_id", F.inline(F.filter(checked, lambda x: x["overlap"] >= SIMILARITY)))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, contaminated, n_items (benchmark items overlapped), overlap (best share of equal words of a run, else null).

    Null and empty texts are clean, and so is every text without a benchmark; empty tables give no rows. Items of equal words are one text with
    several numbers, each counted. The work on a hit doesn't grow with the number of hits. Repeated rows each appear; rows that share a doc_id share the verdict,
    and so do those with a null doc_id. Other columns are not read.
    """
    found = overlaps(docs, benchmark).groupBy(F.col("doc_id").alias("hit_id")).agg(F.count_distinct("item_id").alias("n_items"), F.max("overlap").alias("overlap")).withColumn("hit", F.lit(True))
    out = docs.select("doc_id").join(found, F.col("doc_id").eqNullSafe(F.col("hit_id")), "left")
    return out.select("doc_id", F.coalesce("hit", F.lit(False)).alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.round("overlap", 6).alias("overlap"))
