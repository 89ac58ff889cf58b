"""Licence scan: ordered signatures behind a keyword gate; overlaps resolved by priority and containment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .license_rules import Rule, rules
from .words import Words, slices

#: Base phrases and their labels (fixed values of the contract).
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_detections long"


def word_hash(word: str) -> np.uint64:
    data = np.frombuffer(word.encode(), np.uint8)
    return Words(data, np.array([0, len(data)])).hashes()[0]


def phrase_starts(h: np.ndarray, first: np.ndarray, phrase: list[np.uint64]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and word positions where the phrase's words stand consecutively in one text."""
    n = len(phrase)
    if len(h) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(h[: len(h) - n + 1] == phrase[0])
    for k in range(1, n):
        at = at[h[at + k] == phrase[k]]
    row = np.searchsorted(first, at, "right") - 1
    inside = at + n <= first[row + 1]
    return row[inside], (at - first[row])[inside]


def resolve(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Keep the detections (start, end, -priority, rule) that no detection before them in priority order contains.

    The order is priority, then length, then the rule's place; one running maximum of ends per priority suffices.
    """
    kept, last = [], {}
    for start, end, low, rule in sorted(set(found), key=lambda x: (x[0], -x[1], x[2], x[3])):
        if not any(reach >= end for p, reach in last.items() if p <= low):
            kept.append((start, end, low, rule))
        last[low] = max(last.get(low, -1), end)
    return kept


def detections(text: str, active: list[tuple[int, Rule]]) -> list[tuple[int, int, int, int]]:
    found = []
    for k, rule in active:
        found += [(m.start(), m.end(), -rule.priority, k) for m in rule.pattern.finditer(text)]
    return resolve(found)


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text) with base phrases and resolved labels.

    Null and empty texts have no words, null positions, empty labels and score 0. Repeated rows are
    scanned each; other columns are not read. Work is per row, so hot sources need no shuffle.
    """

    def run(batches):
        table = rules()
        gates = sorted({g for r in table for g in r.gates})
        gate_hash = np.array([word_hash(g) for g in gates])
        order = np.argsort(gate_hash)
        by_gate: dict[int, set[int]] = {}
        for k, r in enumerate(table):
            for g in r.gates:
                by_gate.setdefault(gates.index(g), set()).add(k)
        phrases = [([word_hash(w) for w in p.split()], label) for p, label in BASE]
        for batch, data, offsets in slices(batches):
            w = Words(data, offsets)
            h = w.hashes()
            n = batch.num_rows
            count, lo, hi = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            base: list[set[str]] = [set() for _ in range(n)]
            for phrase, label in phrases:
                row, at = phrase_starts(h, w.first, phrase)
                np.add.at(count, row, 1)
                np.minimum.at(lo, row, at)
                np.maximum.at(hi, row, at)
                for r in np.unique(row):
                    base[r].add(label)
            place = np.minimum(np.searchsorted(gate_hash[order], h), len(gates) - 1)
            hit = np.flatnonzero(gate_hash[order][place] == h)
            rows = np.searchsorted(w.first, hit, "right") - 1
            pairs = np.unique(rows * len(gates) + order[place[hit]])
            open_: dict[int, set[int]] = {}
            for r, g in zip(pairs // len(gates), pairs % len(gates), strict=True):
                open_.setdefault(int(r), set()).update(by_gate[int(g)])
            labels, score, n_found = [set(b) for b in base], [0.95 if b else 0.0 for b in base], np.zeros(n, np.int64)
            for r, which in open_.items():
                kept = detections(w.text(r), [(k, table[k]) for k in sorted(which)])
                labels[r] |= {table[k].label for *_, k in kept}
                score[r] = max([score[r], *(table[k].confidence for *_, k in kept)])
                n_found[r] = len(kept)
            none = count == 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()), pa.array(w.counts.astype(np.int64)), pa.array(count), pa.array(lo, mask=none), pa.array(hi, mask=none),
                    pa.array([",".join(sorted(b)) for b in base], pa.string()), pa.array([",".join(sorted(x)) for x in labels], pa.string()), pa.array(score, pa.float64()), pa.array(n_found),
                ],
                names=[c.split()[0] for c in SCHEMA.split(", ")],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
