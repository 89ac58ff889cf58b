"""The classifier against a plain fit over strings, and operators on very long texts, ties and clashing columns."""

import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, lm_score, pieces, suffix_dedup, toxicity


def grams(text):
    t = re.sub(r"[^a-z0-9\u0080-\U0010ffff]", " ", (text or "").lower())
    return {t[k : k + n] for n in (3, 4, 5) for k in range(len(t) - n + 1)}


def plain_fit(rows, steps=300):
    """Ratios and weights over n-grams as strings, in dense arrays."""
    held = [(grams(t), y) for t, y in rows]
    docs = [sum(y == k for _, y in held) for k in (0, 1)]
    seen = sorted(set().union(*(g for g, _ in held)))
    n = {g: [sum(g in s for s, y in held if y == k) for k in (0, 1)] for g in seen}
    ratio = {g: math.log((n[g][1] + 1) / (docs[1] + 2)) - math.log((n[g][0] + 1) / (docs[0] + 2)) for g in seen}
    used = [g for g in seen if sum(n[g]) >= 3 and abs(ratio[g]) >= 0.3]
    r = np.array([ratio[g] for g in used])
    x = np.array([[ratio[g] if g in s else 0.0 for g in used] for s, _ in held])
    x /= np.sqrt((x * x).sum(1, keepdims=True)) + 1e-9
    y = np.array([y for _, y in held], float)
    w, b = np.zeros(len(used)), 0.0
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for t in range(1, steps + 1):
        off = (1 / (1 + np.exp(-(x @ w + b))) - y) / len(y)
        g, gb = x.T @ off + 1e-7 * w, off.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= 0.05 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)

    def score(text):
        s = grams(text)
        own = np.array([g in s for g in used])
        z = b + ((r * w)[own].sum() / (np.sqrt((r[own] ** 2).sum()) + 1e-9) if own.any() else 0.0)
        return 1 / (1 + math.exp(-z))

    return score


def test_classifier_equals_a_plain_fit(spark):
    draw = random.Random(1)
    bad, good = ["awful", "stupid", "hate", "ugly"], ["lovely", "thanks", "kind", "sunny"]
    text = lambda y: " ".join(draw.choice((bad if y else good) + ["the", "a", "of", "and"]) for _ in range(12))
    rows = [(text(k % 2), k % 2) for k in range(120)]
    frame = spark.createDataFrame([(t, y, 1) for t, y in rows], "text string, label int, n int")
    model, want = toxicity.train(frame), plain_fit(rows)
    new = [text(k % 2) for k in range(40)] + ["", None, "!!!", "Straße AWFUL"]
    got = toxicity.score(spark.createDataFrame(list(enumerate(new)), "doc_id long, text string"), model).collect()
    assert max(abs(r.score - want(new[r.doc_id])) for r in got) < 0.02


def test_very_long_texts(spark):
    long = " ".join(f"w{k * k % 7919}" for k in range(120_000))
    item = " ".join(long.split()[60_000:60_040])
    rows = [(1, long, "clash", 3), (2, long + " tail", "clash", 3), (3, "", "clash", 3), (4, None, "clash", 3), (1, "tie", "clash", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, n int").repartition(2)
    labels = spark.createDataFrame([(1, 1, 1, "x"), (3, 0, 0, "x")], "doc_id long, quality int, toxic int, text string")
    assert toxicity.classify(docs, labels).count() == 5
    found = decontaminate.decontaminate(docs, spark.createDataFrame([(9, item, 1)], "item_id long, text string, doc_id int")).collect()
    assert {(r.doc_id, r.contaminated) for r in found} == {(1, True), (2, True), (3, False), (4, False)}
    assert pieces.round_trip(docs).count() == 5
    removed = {(r.doc_id, r.n_bytes): r.n_removed for r in suffix_dedup.digest(docs).collect()}
    # the words repeat after 7919, so the blank before the tail is covered too
    assert removed[1, len(long)] == len(long) and removed[2, len(long) + 5] == len(long) + 1 and removed[3, 0] == removed[4, 0] == removed[1, 3] == 0
    tokens = sorted(r.n_tokens for r in lm_score.score(docs, F.col("doc_id") == 1).collect())
    assert tokens == [0, 0, 1, 120_000, 120_001]


def test_operators_on_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.classify(none, labels).collect() == []
    assert lm_score.score_quality(none, labels).collect() == []
    assert suffix_dedup.digest(none).collect() == []
