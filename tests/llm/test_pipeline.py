"""Stages of the pipeline on repeated and null ids: each row is kept, dropped or replaced by itself."""

import corpus_pipeline

CLEAN = "one two three four five six seven eight nine ten"
NEAR = "the quick brown fox jumps over the lazy dog near the old river bank"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def rows(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_lines_are_replaced_by_row(spark):
    given = [(1, "a\nb\nc\nd"), (1, "q\na\nb\nc"), (None, "x\ny\nz"), (None, "k\nx\ny\nz"), (None, None), (5, "own")]
    got = rows(corpus_pipeline.dedup_lines(spark, docs(spark, given), ""))
    seen, want = set(), []
    order = [r.row_id for r in corpus_pipeline.numbered(docs(spark, given)).orderBy("row_id").collect()]
    assert len(set(order)) == len(given)
    for i, t in [(r.doc_id, r.text) for r in corpus_pipeline.numbered(docs(spark, given)).orderBy("row_id").collect()]:
        lines, gone = (t or "").split("\n"), set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            gone |= {p, p + 1, p + 2} if w in seen else set()
            seen.add(w)
        want.append((i, t if not gone else "\n".join(x for p, x in enumerate(lines) if p not in gone)))
    assert got == sorted(want, key=str)


def test_one_of_each_group_stays(spark):
    given = [(1, NEAR), (1, NEAR), (1, CLEAN), (None, NEAR), (None, CLEAN + " other words"), (None, None), (7, "alone here")]
    got = rows(corpus_pipeline.one_of_each_group(spark, docs(spark, given), ""))
    assert got == sorted([(1, NEAR), (1, CLEAN), (None, CLEAN + " other words"), (None, None), (7, "alone here")], key=str)


def test_contaminated_rows_go_alone(spark, tmp_path):
    item = " ".join(f"w{i}" for i in range(30))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    given = [(1, CLEAN), (1, "so " + item), (None, item), (None, CLEAN), (2, item), (3, CLEAN), (3, CLEAN)]
    got = rows(corpus_pipeline.drop_benchmark(spark, docs(spark, given), str(tmp_path)))
    assert got == sorted([(1, CLEAN), (None, CLEAN), (3, CLEAN), (3, CLEAN)], key=str)
