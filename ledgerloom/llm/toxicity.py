"""Toxicity: a linear classifier over binary character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import table
from .words import mix, slices

#: Feature bins; a weight per bin is the whole model, so its size doesn't follow the data.
BINS = 1 << 18
#: Characters of an n-gram.
SIZES = (3, 4, 5)
#: The bound of the training sample: about this many labelled rows, those whose doc_ids hash lowest, train ratios and weights.
TRAIN_ROWS = 6000
THRESHOLD = 0.3


class Model(NamedTuple):
    weights: np.ndarray
    bias: float


def features(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct bins of each text (null: empty): n-grams of its lower-cased characters, ASCII that is neither letter nor digit taken as a space."""
    low = [(t or "").lower() for t in texts.to_pylist()]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in low]))).astype(np.int64)
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    keep = (codes >= 128) | ((codes >= 48) & (codes < 58)) | ((codes >= 97) & (codes < 123))
    word = np.where(keep, codes, 32).astype(np.uint64)
    bins = []
    for n in SIZES:
        h = np.full(max(0, len(word) - n + 1), n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x10FFFF) + word[k : len(h) + k]
        bins.append((mix(h) >> np.uint64(64 - 18)).astype(np.int32))
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        own = [x[a : max(a, b - n + 1)] for n, x in zip(SIZES, bins, strict=True)]
        if b - a > 7000:
            seen = np.zeros(BINS, bool)
            for x in own:
                seen[x] = True
            out.append(np.flatnonzero(seen).astype(np.int32))
        else:
            out.append(np.unique(np.concatenate(own)))
    return out


def featured(rows: DataFrame) -> DataFrame:
    """(f, label, n) of ``rows`` (text, label, n): the bins of each text."""

    def run(batches):
        for batch, _, _ in slices(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array(features(batch.column(0)), pa.list_(pa.int32())), batch.column(1), batch.column(2)], names=["f", "label", "n"])

    return rows.select("text", F.col("label").cast("int").alias("label"), F.col("n").cast("long").alias("n")).mapInArrow(run, "f array<int>, label int, n long")


def train(rows: DataFrame) -> Model:
    """Fit on ``rows`` (text, label 0/1, n: how often the row stands for), a bounded sample.

    Log-count ratios are counted in tasks; the weights are fitted on the driver from the bins whose ratio isn't 0.
    Without rows of both labels all scores are that of the one label there is, or 0.
    """
    rows = table(featured(rows.where("label in (0, 1)")))

    def count(batches):
        total, docs = np.zeros((2, BINS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for f, y, n in zip(*batch.columns, strict=True):
                total[y.as_py(), f.values.to_numpy()] += n.as_py()
                docs[y.as_py()] += n.as_py()
        used = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, BINS)), pa.array(np.append(total[0, used], docs[0])), pa.array(np.append(total[1, used], docs[1]))], names=["bin", "n0", "n1"])

    got = rows.mapInArrow(count, "bin long, n0 long, n1 long").groupBy("bin").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow().to_pandas()
    n = np.zeros((2, BINS + 1))
    n[0, got["bin"]], n[1, got["bin"]] = got["n0"], got["n1"]
    docs = n[:, BINS]
    if not docs.all():
        return Model(np.zeros((2, BINS)), -30.0 if not docs[1] else 30.0)
    rate = (n[:, :BINS] + 1) / (docs + 2)[:, None]
    ratio = np.log(rate[1] / rate[0])
    ratio[n[:, :BINS].sum(0) < 3] = 0
    ratio[np.abs(ratio) < 0.3] = 0

    def telling(batches):
        for batch in batches:
            bins = [f.values.to_numpy() for f in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([f[ratio[f] != 0] for f in bins], pa.list_(pa.int32())), batch.column(1), batch.column(2)], names=["f", "label", "n"])

    sample = rows.mapInArrow(telling, "f array<int>, label int, n long").toArrow()
    lists = sample.column(0).combine_chunks()
    at = lists.offsets.to_numpy()
    return fit(lists.values.to_numpy()[at[0] : at[-1]], np.diff(at), sample.column(1).to_numpy().astype(float), sample.column(2).to_numpy().astype(float), ratio)


def fit(bins: np.ndarray, sizes: np.ndarray, y: np.ndarray, n: np.ndarray, ratio: np.ndarray, steps: int = 300) -> Model:
    """L2-regularised logistic regression on features of value ratio / text norm, rows weighted by ``n``; full-batch Adam.

    Each feature row has unit norm, so a long text does not outweigh a short one.
    """
    row = np.repeat(np.arange(len(sizes)), sizes)
    x = ratio[bins]
    norm = np.sqrt(np.bincount(row, x * x, len(sizes))) + 1e-9
    x = x / norm[row]
    w, bias, m, v, mb, vb = np.zeros(BINS), 0.0, np.zeros(BINS), np.zeros(BINS), 0.0, 0.0
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, x * w[bins], len(sizes)) + bias, -30, 30)))
        off = (p - y) * n / n.sum()
        g = np.bincount(bins, x * off[row], BINS) + 1e-7 * w
        gb = off.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, b = 1 - 0.9**t, 1 - 0.999**t
        w -= 0.05 * (m / a) / (np.sqrt(v / b) + 1e-8)
        bias -= 0.05 * (mb / a) / (np.sqrt(vb / b) + 1e-8)
    return Model(np.stack([ratio * w, ratio * ratio]), float(bias))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score in 0..1 of each row's whole text; null and empty texts get the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        weights, bias = shared.value
        for batch, _, _ in slices(batches):
            out = [bias + weights[0, f].sum() / (np.sqrt(weights[1, f].sum()) + 1e-9) for f in features(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(1 / (1 + np.exp(-np.clip(np.array(out), -30, 30))))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def below(column: Column, share: float) -> Column:
    """Whether the hash of ``column`` lies in the lowest ``share`` of all."""
    return F.pmod(F.xxhash64(column), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, label, n): a bounded sample of the labelled texts whose crc32(doc_id as text) mod 4 is not 2.

    Labels are chosen by the hash of their doc_id, so the ids are few enough to broadcast and texts are read
    once and not shuffled. Equal rows are one with its count. Where many rows share a chosen id, their
    different texts are thinned by their own hash to twice the bound.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).where("label in (0, 1) and crc32(cast(doc_id as string)) % 4 <> 2").distinct()
    chosen = known.where(below(F.col("doc_id"), TRAIN_ROWS / max(known.count(), 1)))
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = table(found.groupBy(F.xxhash64("text").alias("hash"), "label").agg(F.first("text").alias("text"), F.count("*").alias("n")))
    return rows.where(below(F.col("hash"), 2 * TRAIN_ROWS / max(rows.count(), 1))).select("text", "label", "n")


def classify(docs: DataFrame, labels: DataFrame, train_docs: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``.

    A null doc_id matches no label and has held_out false. Null and empty texts get the score of no features. Repeated rows are scored each,
    alike; a doc_id with both labels trains with both. Without labels all scores are near 0. Other columns are not read. An empty table gives no rows.
    """
    model = train(training_rows(docs if train_docs is None else train_docs, labels))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
