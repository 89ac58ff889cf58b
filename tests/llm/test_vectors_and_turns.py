"""Centroid clustering, exact top-k and conversation repair against plain versions, with nulls, ties, repeats and empty tables."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from ledgerloom.llm import bitslice, shallot, turns

VECTORS = "vec_id long, embedding array<float>, label int, v string, cluster string, at string"


def embeddings(spark, rows):
    return spark.createDataFrame([(i, v, 0, "clash", "clash", "clash") for i, v in rows], VECTORS)


def floors(v, scale):
    return [math.floor(scale * x) for x in v]


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def lloyd(rows, k, rounds, seed, scale, d):
    kept = [(i, floors(np.float32(v).tolist(), scale)) for i, v in rows if good(v) and len(v) == d]
    by = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    c = [r[1] for r in sorted(kept, key=by)[:k]]
    away = lambda v, m: sum((a - b) ** 2 for a, b in zip(v, m, strict=True))
    near = lambda v: min((away(v, m), j) for j, m in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        c = [[sum(x) // len(x) for x in zip(*(v for (_, v), o in zip(kept, own, strict=True) if o == j), strict=True)] or m for j, m in enumerate(c)]
    return c, sorted(((i is None, i, near(v)[1], near(v)[0]) for i, v in kept), key=str)


def test_clusters_equal_plain_rounds(spark):
    random.seed(4)
    middle = [[random.uniform(-1, 1) for _ in range(6)] for _ in range(9)]
    rows = [(i, [m + random.gauss(0, 0.3) for m in random.choice(middle)]) for i in range(600)]
    rows += [(700, [0.5] * 6), (700, [0.5] * 6), (701, [0.5] * 6), (None, [0.1] * 6), (None, [0.2] * 6), (702, None), (703, []), (704, [0.1] * 5), (705, [0.1] * 5 + [None]), (706, [float("nan")] * 6), (707, [float("inf")] + [0.0] * 5)]
    for k, rounds in ((8, 10), (40, 3), (1, 2), (900, 1)):
        out, c = shallot.cluster(embeddings(spark, rows).repartition(3), k, rounds, 3, 1024, 6)
        want_c, want = lloyd(rows, k, rounds, 3, 1024, 6)
        assert c == want_c
        assert sorted(((r.vec_id is None, r.vec_id, r.cluster, r.distance) for r in out.collect()), key=str) == want


def test_equal_vectors_and_tied_centroids(spark):
    rows = [(i, [0.0, 0.0] if i % 2 else [1.0, 0.0]) for i in range(40)]
    out, c = shallot.cluster(embeddings(spark, rows), 4, 5, 3, 8, 2)
    want_c, want = lloyd(rows, 4, 5, 3, 8, 2)
    assert c == want_c and sorted(((False, r.vec_id, r.cluster, r.distance) for r in out.collect()), key=str) == want


def test_search_leaves_out_centroids_but_no_answer():
    rng = np.random.default_rng(5)
    c = rng.integers(-500, 500, (30, 4))
    x = rng.integers(-600, 600, (3000, 4))
    n = len(x)
    state = np.zeros(n, np.int32), np.ones(n, np.int32), np.full(n, np.inf), np.full(n, -np.inf)
    before = None
    for _ in range(4):
        state = shallot.search(x, *state, shallot.Centroids(c, before))
        d = ((x[:, None].astype(np.int64) - c[None]) ** 2).sum(2)
        assert (state[0] == d.argmin(1)).all()
        assert (state[2] >= np.sqrt(d.min(1))).all() and (state[3] <= np.sqrt(np.sort(d, 1)[:, 1])).all()
        before, c = c, c + rng.integers(-20, 20, c.shape)


def test_clusters_of_nothing_and_too_large_numbers(spark):
    assert shallot.digest(embeddings(spark, [])).collect() == []
    assert shallot.digest(embeddings(spark, [(1, [0.5])])).collect() == []
    one = shallot.digest(embeddings(spark, [(1, [0.5] * 64)])).collect()
    assert [(r.vec_id, r.cluster, r.distance, r.inertia) for r in one] == [(1, 0, 0, 0)]
    assert one[0].centroid_sha256 == hashlib.sha256(",".join(["512"] * 64).encode()).hexdigest()
    with pytest.raises(Exception, match="too large for exact integers"):
        shallot.digest(embeddings(spark, [(1, [1e30] * 64)])).collect()


def products(rows, divisor, k, scale):
    kept = [(n, i, floors(np.float32(v).tolist(), scale)) for n, (i, v) in enumerate(rows) if good(v)]
    out = []
    for n, i, w in kept:
        if i is not None and i % divisor == 0:
            scored = sorted((-sum(a * b for a, b in zip(w, v, strict=True)), j is None, j, m) for m, j, v in kept if m != n and len(v) == len(w))
            out += [(i, rank, j, -s) for rank, (s, _, j, _) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("rows_per_block", [40, 16384])
def test_top_products_equal_all_pairs(spark, monkeypatch, rows_per_block):
    monkeypatch.setattr(bitslice, "ROWS", rows_per_block)
    monkeypatch.setattr(bitslice, "QUERIES", 3)
    random.seed(6)
    rows = [(i, [random.gauss(0, 0.2) for _ in range(7)]) for i in range(200)]
    rows += [(300 + i, [0.25] * 7) for i in range(90)]  # ties and one very common vector
    rows += [(500, [0.9] * 7), (500, [0.9] * 7), (None, [0.9] * 7), (550, None), (600, []), (610, []), (650, [0.1, None]), (700, [float("nan")] * 7), (750, [1.0, -3.0]), (751, [-1.0, 2.0]), (800, [0.0] * 7), (850, [5000.0] * 7)]
    got = bitslice.top_products(embeddings(spark, rows).repartition(3), 50, 5, 256).collect()
    assert sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in got), key=str) == products(rows, 50, 5, 256)


def test_top_products_of_nothing(spark):
    assert bitslice.top_products(embeddings(spark, [])).collect() == []
    assert bitslice.top_products(embeddings(spark, [(50, [0.5] * 3)])).collect() == []


def test_signed_digits():
    for w in range(-600, 600):
        d = bitslice.digits(w)
        assert sum(s << p for p, s in d) == w and all(b[0] - a[0] > 1 for a, b in zip(d, d[1:], strict=False))


def repaired(rows):
    """(audit, cost, counts, text) of one conversation: cheapest edits up to each place of the grammar, turn by turn."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\v\f\r")
        faults.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "-")
        seen.add((role, text))
    best = {"": (0, "", ())}
    wants = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    def inserted(best):
        out = dict(best)
        for _ in range(2):
            for p, (cost, audit, body) in list(out.items()):
                q = wants[p]
                new = (cost + 2, audit + "I", body + (f"{name[q]}:",))
                if q not in out or new[:2] < out[q][:2]:
                    out[q] = new
        return out

    for (_, role, text), fault in zip(rows, faults, strict=True):
        new = {}

        def offer(q, x):
            if q not in new or x[:2] < new[q][:2]:
                new[q] = x

        for p, (cost, audit, body) in inserted(best).items():
            offer(p, (cost + 3, audit + "D", body))
            if fault in "-t":
                cut, q = fault == "t", role[:1]
                if q == wants[p] or (q == "s" and p == ""):
                    offer(q, (cost + cut, audit + "K", body + (f"{role}:{text}",)))
                offer(wants[p], (cost + 2 + cut, audit + "R", body + (f"{name[wants[p]]}:{text}",)))
        best = new
    cost, audit, body = min(v for q, v in inserted(best).items() if q in ("", "a"))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    n = [t for t, *_ in rows if t is not None]
    gaps = max(n) - min(n) + 1 - len(set(n)) if n else 0
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(body).encode()).hexdigest()


def conversations():
    random.seed(7)
    roles, texts = ["user", "assistant", "user", "assistant", "system", "tool", "", None], ["Yes.", "No!", "why?", "cut off", "", " \t\n", None, "é ☃.", "Yes.  ", " ", "long " * 4000 + "end."]
    out = [(c, random.choice([None, *range(n)]), random.choice(roles), random.choice(texts)) for c, n in enumerate([0, 1, 2, 3, 5, 8, 20, 40] * 5) for _ in range(n)]
    long = [(1000, t, ("user", "assistant")[t % 2] if random.random() < 0.9 else "user", f"{t}.") for t in range(400) if random.random() < 0.9]
    return out + long + [(None, 1, "user", "Hi."), (None, None, "assistant", "Hi."), (2000, 0, None, None), (2001, 0, "umbrella", "x."), (2001, 1, "assistant", "y.")] + [(2002, 0, "user", "same.")] * 50


@pytest.mark.parametrize("size", [1024, 7, 1])
def test_repair_equals_plain_search(spark, monkeypatch, size):
    monkeypatch.setattr(turns, "SEGMENT", size)
    rows = conversations()
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, at string, slice int").repartition(3)
    left, per = turns.repair(frame)
    want = {}
    for c in {r[0] for r in rows}:
        want[c] = repaired([(t, " " if role is None else role, " " if text is None else text) for i, t, role, text in rows if i == c])
    sha = {r.conv_id: r.repaired_sha256 for r in turns.hashed(left).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, sha.get(r.conv_id, empty)) for r in per.collect()}
    assert got == want


def test_damage_and_digest(spark):
    rows = [(c, t, r, x) for c in range(40) for t, r, x in ((0, "user", "a. b!"), (1, "assistant", "c?"), (None, "user", None))] + [(None, 0, None, "z.")]
    hurt = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if k == 4 else r, "" if k == 1 else x.translate(str.maketrans("", "", ".!?")) if k == 2 else x)
        hurt += [] if k == 0 else [row] * (2 if k == 3 else 1)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(str, (tuple(r) for r in turns.damaged(frame).collect()))) == sorted(map(str, hurt))
    got = {r.conv_id: tuple(r)[1:] for r in turns.digest(frame).collect()}
    for c in {r[0] for r in rows}:
        left = [r[1:] for r in hurt if r[0] == c]
        assert got[c] == (repaired(left) if left else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()))


def test_repair_of_nothing(spark):
    assert turns.digest(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_band_is_wide_enough():
    random.seed(8)
    for _ in range(300):
        n = random.randrange(14)
        row = {"initials": "".join(random.choice("suaau?") for _ in range(n)), "faults": "".join(random.choice("---tbd") for _ in range(n)), "copies": [1] * n, "last": True}
        cost, audit, exit = turns.alignment(row).solve(0, turns.END)
        wide = turns.alignment(row)
        wide.half = 2 * n + 8
        wide.fill(wide.half, "a")
        assert (cost, audit, exit) == wide.solve(0, turns.END) and len(turns.woven(row, audit).replace("I", "")) == n
