"""Cross-entropy difference: bigram models of a target and of a background with exact counts over one vocabulary.

A model gives word w after v the chance (n(vw) + a) / (n(v) + a * V), V being the number of different words of all texts and a being ADDED times the model's
share of the larger model's characters: both models are smoothed at one rate, so the smaller one doesn't lose by its size. So the loss of a text is a sum of one term for each of its bigrams and one for each of its contexts, and each
term needs a single count. Every text is scored out of sample: its own counts are first taken out of the models it is in.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import BROADCAST_ROWS, table
from .words import Words, mix, slices

#: What each bigram's count is raised by in the larger model; in the smaller one it is less by the ratio of their sizes.
ADDED = 0.01
#: The previous word at a text's start; words are 64-bit hashes.
START = np.uint64(0)
#: Bits of a text's number in its slice, and of a key; the last bit of a key tells contexts from bigrams.
ROW_BITS, KEY_BITS = 12, 52
#: Keys in at least this share of a sample of about SAMPLE texts are common: their counts are broadcast and no list of their texts is
#: sent. At most (keys of a text) / COMMON keys are so, whatever the corpus. Which keys these are doesn't change a score.
SAMPLE, COMMON = 2000, 1 / 128
#: Text of a slice.
SLICE_BYTES = 1 << 20
#: Relative error of V.
VOCABULARY_ERROR = 0.01


def small_slices(batches, text: int):
    """``slices`` of no more than 2**ROW_BITS rows."""
    for batch, data, offsets in slices(batches, text, SLICE_BYTES):
        for row in range(0, batch.num_rows, 1 << ROW_BITS):
            stop = min(batch.num_rows, row + (1 << ROW_BITS))
            yield batch.slice(row, stop - row), data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]


def entries(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row, n), sorted: how often each text has each of its bigrams and contexts."""
    h = w.hashes()
    before = np.concatenate(([START], h[:-1])) if len(h) else h
    before[w.first[:-1][w.counts > 0]] = START
    row = np.repeat(np.arange(len(w.counts), dtype=np.uint64), w.counts)
    drop, cut = np.uint64(64 - KEY_BITS), np.uint64(ROW_BITS)
    pair = (mix(mix(before) * np.uint64(3) + h) >> drop) & ~np.uint64(1)
    context = (mix(before ^ np.uint64(0x5851F42D4C957F2D)) >> drop) | np.uint64(1)
    both = np.sort(np.concatenate(((pair << cut) | row, (context << cut) | row)))
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    at = np.flatnonzero(new)
    return both[at] >> cut, (both[at] & np.uint64((1 << ROW_BITS) - 1)).astype(np.int64), np.diff(np.append(at, len(both)))


def losses(keys: np.ndarray, n: np.ndarray, left: np.ndarray, vocabulary: int, added: float) -> np.ndarray:
    """Nats of ``n`` occurrences of each key when ``left`` of them are in the model."""
    context = (keys & np.uint64(1)) > 0
    return n * np.where(context, 1, -1) * np.log(left + np.where(context, added * max(vocabulary, 1), added))


def flags(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Whether each row is in the target and in the background."""
    return [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("target", "background")]


def common_keys(docs: DataFrame, n_rows: int) -> np.ndarray:
    """Keys that many texts of a sample have; the sample is of bounded size."""
    sample = docs.select("text").sample(fraction=min(1.0, SAMPLE / max(n_rows, 1)), seed=1).repartition(8)

    def run(batches):
        for _, data, offsets in small_slices(batches, 0):
            keys, n = np.unique(entries(Words(data, offsets))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys[n > 1].astype(np.int64)), pa.array(n[n > 1].astype(np.int64))], names=["key", "n"])

    least = max(2.0, COMMON * min(SAMPLE, n_rows))
    found = sample.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("key").toArrow()
    return np.sort(found.column(0).to_numpy().astype(np.uint64))


def counts_of(docs: DataFrame, keys: np.ndarray) -> np.ndarray:
    """Counts of ``keys`` in the target and the background, over all ``docs``."""

    def run(batches):
        total = np.zeros((2, len(keys)), np.int64)
        for batch, data, offsets in small_slices(batches, 0):
            key, row, n = entries(Words(data, offsets))
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            held = keys[at] == key
            for k, flag in enumerate(flags(batch)):
                total[k] += np.bincount(at[held], (n * flag[row])[held], len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(keys))), pa.array(total[0]), pa.array(total[1])], names=["at", "t", "b"])

    out = np.zeros((2, len(keys)), np.int64)
    if len(keys):
        got = docs.select("text", "target", "background").mapInArrow(run, "at long, t long, b long").groupBy("at").agg(F.sum("t").alias("t"), F.sum("b").alias("b")).toArrow()
        at = got.column(0).to_numpy()
        out[0, at], out[1, at] = got.column(1).to_numpy(), got.column(2).to_numpy()
    return out


def vocabulary(docs: DataFrame) -> int:
    """About how many different words all texts have."""

    def run(batches):
        for _, data, offsets in slices(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(Words(data, offsets).hashes()).view(np.int64))], names=["word"])

    return docs.select("text").mapInArrow(run, "word long").agg(F.approx_count_distinct("word", VOCABULARY_ERROR)).first()[0]


BINARY = ("high", "low", "sizes", "texts", "n")
PACKED = "bucket long, slice long, " + ", ".join(f"{c} binary" for c in BINARY) + ", doc_id array<long>, tokens array<long>, t array<double>, b array<double>"


def packed(docs: DataFrame, common: np.ndarray, counts: np.ndarray, words: int, added: tuple[float, float], bits: int) -> DataFrame:
    """Each slice's keys by bucket (their first ``bits``), with the texts that have them; and once a slice its texts with the losses of their common keys."""
    shift = np.uint64(KEY_BITS - bits)

    def run(batches):
        for batch, data, offsets in small_slices(batches, 2):
            w = Words(data, offsets)
            key, row, n = entries(w)
            target, background = flags(batch)
            rest, base = np.ones(len(key), bool), np.zeros((2, batch.num_rows))
            if len(common) and len(key):
                at = np.minimum(np.searchsorted(common, key), len(common) - 1)
                held = common[at] == key
                rest = ~held
                for k, flag in enumerate((target, background)):
                    own, r = n[held], row[held]
                    base[k] = np.bincount(r, losses(key[held], own, counts[k][at[held]] - own * flag[r], words, added[k]), batch.num_rows)
            key, row, n = key[rest], row[rest], n[rest]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(key)))
            own = key[first]
            bucket = (own >> shift).astype(np.int64)
            text = (row | target[row] << ROW_BITS | background[row] << (ROW_BITS + 1)).astype(np.uint16)
            starts = np.flatnonzero(np.diff(bucket, prepend=-1))
            stops = np.append(starts[1:], len(bucket))[: len(starts)]
            ends = np.append(first, len(key))
            name = batch.column(0)[0].as_py()
            out: dict[str, list] = {c: [] for c in ("bucket", *BINARY)}
            for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
                part = slice(ends[a], ends[b])
                values = (int(bucket[a]), (own[a:b] >> np.uint64(16)).astype(np.uint32), own[a:b].astype(np.uint16), size[a:b].astype(np.uint16), text[part], n[part].astype(np.uint32))
                for c, v in zip(out, values, strict=True):
                    out[c].append(v if isinstance(v, int) else v.tobytes())
            lists = lambda v, kind: pa.array([None] * len(starts) + [v], pa.list_(kind))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*out["bucket"], name % (1 << bits)], pa.int64()),
                    pa.array([name] * (len(starts) + 1), pa.int64()),
                    *(pa.array([*out[c], b""], pa.binary()) for c in BINARY),
                    lists(batch.column(1).cast(pa.int64()), pa.int64()),
                    *(lists(v, kind) for v, kind in ((w.counts.astype(np.int64), pa.int64()), (base[0], pa.float64()), (base[1], pa.float64()))),
                ],
                schema=pa.schema([("bucket", pa.int64()), ("slice", pa.int64()), *((c, pa.binary()) for c in BINARY), ("doc_id", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64())), ("t", pa.list_(pa.float64())), ("b", pa.list_(pa.float64()))]),
            )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "target", "background")
    return rows.mapInArrow(run, PACKED)


def bucket_sums(rows: list[dict], words: int, added: tuple[float, float], bits: int):
    """For each slice of a bucket's ``rows``: its name, the numbers of its texts there, and what the bucket's keys add to their two losses."""
    whole = lambda c, kind: np.frombuffer(b"".join(r[c] for r in rows), kind)
    keys = (whole("high", np.uint32).astype(np.uint64) << np.uint64(16)) | whole("low", np.uint16)
    keys = keys & np.uint64((1 << (KEY_BITS - bits)) - 1) | np.uint64(rows[0]["bucket"] << (KEY_BITS - bits))
    sizes = whole("sizes", np.uint16)
    of_key, keys = np.repeat(np.unique(keys, return_inverse=True)[1], sizes), np.repeat(keys, sizes)
    text, n = whole("texts", np.uint16), whole("n", np.uint32).astype(np.int64)
    ends = np.cumsum([0] + [len(r["texts"]) // 2 for r in rows])
    terms = []
    for k in range(2):
        own = n * ((text >> np.uint16(ROW_BITS + k)) & np.uint16(1))
        terms.append(losses(keys, n, np.bincount(of_key, own)[of_key] - own if len(own) else own, words, added[k]))
    row = (text & np.uint16((1 << ROW_BITS) - 1)).astype(np.int64)
    for r, a, b in zip(rows, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if a < b:
            yield r["slice"], row[a:b], terms[0][a:b], terms[1][a:b]


#: Texts whose sums one task holds before it hands them on.
HELD_TEXTS = 1 << 21
SUMS = "slice long, texts binary, t binary, b binary, doc_id array<long>, tokens array<long>, t0 array<double>, b0 array<double>"


def summed(words: int, added: tuple[float, float], bits: int):
    """Over rows sorted by bucket: a row for each slice with what all buckets here add to its texts' losses, as the texts' numbers and two lists of floats."""
    texts = 1 << ROW_BITS

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        rows: list[dict] = []

        def close():
            for name, row, t, b in bucket_sums(rows, words, added, bits) if rows else ():
                own = sums.setdefault(name, np.zeros((3, int(row.max()) + 1)))
                if own.shape[1] <= row.max():
                    own = sums[name] = np.pad(own, ((0, 0), (0, int(row.max()) + 1 - own.shape[1])))
                for k, v in enumerate((t, b, np.ones(len(row)))):
                    own[k, : int(row.max()) + 1] += np.bincount(row, v)
            rows.clear()

        def handed():
            names, lists = [], []
            for name, own in sums.items():
                at = np.flatnonzero(own[2])
                names.append(name)
                lists.append([at.astype(np.uint16).tobytes(), own[0, at].astype(np.float32).tobytes(), own[1, at].astype(np.float32).tobytes()])
            sums.clear()
            nothing = pa.nulls(len(names))
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), *(pa.array([x[k] for x in lists], pa.binary()) for k in range(3)), *(nothing.cast(pa.list_(k)) for k in (pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=["slice", "texts", "t", "b", "doc_id", "tokens", "t0", "b0"])

        for batch in batches:
            whole = batch.column(batch.schema.get_field_index("doc_id")).is_valid()
            meta = batch.filter(whole)
            if meta.num_rows:
                empty = pa.array([b""] * meta.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays([meta.column(1), empty, empty, empty, *(meta.column(k) for k in range(7, 11))], names=["slice", "texts", "t", "b", "doc_id", "tokens", "t0", "b0"])
            columns = batch.schema.names[:7]
            for r in zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True):
                if rows and rows[-1]["bucket"] != r[0]:
                    close()
                    if len(sums) * texts > HELD_TEXTS and sum(x.shape[1] for x in sums.values()) > HELD_TEXTS:
                        yield handed()
                rows.append(dict(zip(columns, r, strict=True)))
        close()
        if sums:
            yield handed()

    return run


def gathered(group: pa.Table) -> pa.Table:
    """The texts of one slice: doc_id, tokens, and both losses, from what buckets add and what common keys gave."""
    rows = group.to_pylist()
    meta = next(r for r in rows if r["doc_id"] is not None)
    total = np.array([meta["t0"], meta["b0"]])
    for r in rows:
        at = np.frombuffer(r["texts"], np.uint16)
        for k, c in enumerate(("t", "b")):
            total[k, at] += np.frombuffer(r[c], np.float32)
    return pa.table({"doc_id": pa.array(meta["doc_id"], pa.int64()), "tokens": pa.array(meta["tokens"], pa.int64()), "t": total[0], "b": total[1]})


def score(docs: DataFrame, target: Column, background: Column | None = None, added: float = ADDED) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, target_loss, background_loss, difference (all nats per token).

    The rows where ``target`` holds are the target's texts, those where ``background`` holds (without it: all) the background's. The
    shared vocabulary is all words of ``docs``. Null texts are empty; a text without words has losses and difference null. Repeated rows are
    each scored and count as each other's surroundings; a null doc_id is kept. Lower differences are more like the target. Other columns are
    not read; an empty table gives no rows.

    Each slice of texts sends each of its keys once, with the numbers of its texts that have it, to the key's bucket; there counts meet
    and each text's terms are added up and sent back to its slice. Keys of many texts are counted beforehand instead. A task holds one bucket,
    the sums of ``HELD_TEXTS`` texts, or one slice.
    """
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    docs = docs.select("doc_id", "text", flag(target).alias("target"), flag(F.lit(True) if background is None else background).alias("background"))
    size = lambda c: F.coalesce(F.sum(F.length("text") * F.col(c)), F.lit(0))
    n_rows, *sizes = docs.agg(F.count("*"), size("target"), size("background")).first()
    added = tuple(added * max(n, 1) / max(*sizes, 1) for n in sizes)
    common = common_keys(docs, n_rows)
    counts, words = counts_of(docs, common), vocabulary(docs)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = max(4, min(16, (4 * parts - 1).bit_length()))
    dealt = packed(docs, common, counts, words, added, bits).repartition("bucket").sortWithinPartitions("bucket")
    by = dealt.mapInArrow(summed(words, added, bits), SUMS).groupBy("slice").applyInArrow(gathered, "doc_id long, tokens long, t double, b double").withColumnRenamed("tokens", "n_tokens")
    mean = lambda x: F.when(F.col("n_tokens") > 0, x / F.col("n_tokens"))
    return by.select("doc_id", "n_tokens", mean(F.col("t")).alias("target_loss"), mean(F.col("b")).alias("background_loss"), mean(F.col("t") - F.col("b")).alias("difference"))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Target: texts labelled quality 1; background: all texts. A null doc_id is never a target, a null label is none, and an empty table gives no rows."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().withColumn("good", F.lit(True))
    docs = docs.select("doc_id", "text")
    if good.count() <= BROADCAST_ROWS:
        return score(docs.join(F.broadcast(good), "doc_id", "left"), F.col("good"))
    # rows of a shuffle have no lasting order, which slices of texts need
    return score(table(docs.join(good, "doc_id", "left")), F.col("good"))
