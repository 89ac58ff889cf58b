"""Chunks by tokens against their definition, with a counter of words and with the real tokenizer."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import splitting


def words(text):
    return len(text.split())


def plain(text, count, size, overlap):
    """Chunks by lists: pieces first, then greedy packing with a tail of at most ``overlap`` carried on."""

    def cut(t, limit, separators):
        if count(t) <= limit or len(t) == 1 or not separators:
            return [t]
        s = separators[0]
        parts = list(t) if s == "" else [t.split(s)[0]] + [s + x for x in t.split(s)[1:]]
        return [y for x in parts if x for y in cut(x, limit, separators[1:])]

    fine = []
    for x in cut(text, size, splitting.SEPARATORS):
        fine += cut(x, max(1, overlap), splitting.SEPARATORS) if count(x) > overlap else [x]
    out, held = [], []
    for x in fine:
        total = sum(map(count, held))
        if held and total + count(x) > size:
            out.append("".join(held))
            while held and (sum(map(count, held)) > overlap or sum(map(count, held)) + count(x) > size):
                held = held[1:]
        held.append(x)
    return [c.strip() for c in [*out, "".join(held)] if c.strip()]


def test_chunks_equal_plain_packing():
    draw = random.Random(2)
    for _ in range(300):
        text = "".join(draw.choice(["a", "bb", "ccc", " ", " ", "\n", "\n\n", "é"]) for _ in range(draw.randrange(120)))
        size = draw.randrange(2, 20)
        overlap = draw.randrange(size)
        got = splitting.packed(text, words, size, overlap)
        assert [c for c, *_ in got] == plain(text, words, size, overlap)
        assert all(text[a:b].strip() == c for c, a, b in got)
        covered = set().union(*(range(a, b) for _, a, b in got)) if got else set()
        assert all(k in covered for k, c in enumerate(text) if not c.isspace())


def test_documents_in_chunks_of_tokens(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", F.lit(1).alias("first"))
    got = splitting.chunked(docs, ["doc_id"]).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == {i for i, t in texts.items() if t.strip()}
    for i, rows in by.items():
        rows.sort(key=lambda r: r.piece)
        assert [r.piece for r in rows] == list(range(len(rows)))
        assert all(r.n_tokens <= splitting.SIZE + 4 and texts[i][r.first : r.end].strip() == r.chunk for r in rows)
        assert all(a.end >= b.first or not texts[i][a.end : b.first].strip() for a, b in zip(rows, rows[1:], strict=False))
    assert max(map(len, by.values())) > 5


def test_odd_texts_and_parameters(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "x" * 5000), (5, "one")]
    got = splitting.chunked(spark.createDataFrame(rows, "k int, text string"), ["k"], size=64, overlap=0).collect()
    assert {r.k for r in got} == {4, 5} and "".join(r.chunk for r in sorted(got, key=lambda r: r.piece) if r.k == 4) == "x" * 5000
    with pytest.raises(ValueError, match="overlap"):
        splitting.chunked(spark.createDataFrame(rows, "k int, text string"), ["k"], size=5, overlap=5)
