"""Every query with SQL gives DuckDB's rows on the small tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = [f.removesuffix(".parquet") for f in os.listdir(DIR)]


def rows(frame):
    columns = sorted(frame.columns)
    clean = lambda x: None if pd.isna(x) else round(float(x), 7) if isinstance(x, float) or hasattr(x, "dtype") else str(x)[:10] if hasattr(x, "year") else float(x) if isinstance(x, int) and not isinstance(x, bool) else x
    return columns, sorted((tuple(clean(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, name):
    with duckdb.connect() as db:
        for t in TABLES:
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
        want = db.sql(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, DIR).toPandas()
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 10


def test_point_ids_of_every_chunk(spark):
    import uuid

    got = {(r.doc_id, r.chunk_index): (r.point_id, r.marker_id) for r in entry.queries()["c5_point_ids"](spark, DIR).collect()}
    want = {}
    for d in pd.read_parquet(f"{DIR}/documents.parquet").itertuples():
        for k in range(max(1, -(-(len(d.text.split(" ")) - 50) // 462))):
            want[d.doc_id, k] = tuple(str(uuid.uuid5(uuid.NAMESPACE_DNS, f"{d.source}:{d.doc_id}:{last}")) for last in (k, "_status"))
    assert got == want and any(k for _, k in want)
