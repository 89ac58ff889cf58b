"""The whole pipeline against a brute-force version of its stages; the classifier's verdicts are taken as they are."""

import hashlib
import random
import re

import corpus_pipeline
from ledgerloom.llm import decontaminate, pieces, toxicity

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(t):
    return re.findall(WORD, re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))


def shingles(t):
    w = words(t)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def copied(text, item):
    """Whether a run of the item, of RUN words or all of it, stands in the text with 80 % of its words on one diagonal or near ones."""
    t, n = words(text), words(item)
    if len(n) < decontaminate.SHORTEST:
        return False
    for start in range(-len(n), len(t)):
        equal = [0 <= start + k < len(t) and t[start + k] == w for k, w in enumerate(n)]
        least = min(len(n), decontaminate.RUN)
        if any(sum(equal[a:b]) >= 0.8 * (b - a) for a in range(len(n) - least + 1) for b in range(a + least, len(n) + 1)):
            return True
    return False


def test_chain_matches_brute_force(spark, tmp_path):
    draw = random.Random(8)
    vocabulary = [f"w{k}" for k in range(3000)]
    fresh = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    rude = lambda n: " ".join(draw.choice(["vile", "idiot", "hateful", "scum", "trash"]) if draw.random() < 0.5 else draw.choice(vocabulary) for _ in range(n))
    item = fresh(30)
    passage = [fresh(9) for _ in range(3)]
    texts = [fresh(60) for _ in range(60)] + [rude(60) for _ in range(40)]
    near = texts[0].split(" ")
    near[30] = "changed"
    texts += [texts[0], " ".join(near), f"so {item} and more {fresh(20)}", "\n".join([fresh(8), *passage, fresh(8)]), "\n".join([fresh(7), *passage, fresh(9)]), "", None, "x"]
    rows = [(k if k % 9 else 7, t, "en", "s", len(t or ""), "extra") for k, t in enumerate(texts)] + [(None, texts[1], "de", None, None, "extra"), (None, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row_id_of string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 0, int(60 <= k < 100)) for k in range(len(texts)) if k % 9], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = corpus_pipeline.numbered(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.row_id: r.text for r in docs.collect()}
    toxic = {r.doc_id for r in toxicity.classify(corpus_pipeline.by_row(docs), labels, docs).where("predicted = 1").collect()}
    assert 30 <= len(toxic) <= 50
    left = {i: t for i, t in kept.items() if i not in toxic}
    seen, cut = set(), {}
    for i in sorted(left):
        lines, gone = (left[i] or "").split("\n"), set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            gone |= {p, p + 1, p + 2} if w in seen else set()
            seen.add(w)
        cut[i] = left[i] if not gone else "\n".join(x for p, x in enumerate(lines) if p not in gone)
    sets = {i: shingles(t) for i, t in cut.items()}
    group = {i: i for i in cut}
    for a in sorted(cut):
        for b in sorted(cut):
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    one = {i: cut[i] for i in cut if group[i] == i}
    clean = {i: t for i, t in one.items() if not copied(t, item)}
    assert len(clean) < len(one) < len(cut) < len(kept)
    encoder = pieces.Encoder()
    want = sorted(hashlib.sha256(" ".join(map(str, encoder.texts([(t or "").encode()])[0].tolist())).encode()).hexdigest() for t in clean.values())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.ids_sha256 for r in got) == want and all(r.restored for r in got)


def test_chain_over_nothing(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
