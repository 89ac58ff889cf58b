"""Audited writes: counters observed while a job runs, and a log row whether it succeeds or fails; trusted results by domain suffix; stores whose keys meet without a shuffle."""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import bucketed, save, scan
from ..streaming.sessions import folder

LOG = "run_id string, pipeline string, target string, started_at timestamp, finished_at timestamp, status string, error_class string, error_message string, rows_written long, metadata string"


def tracked(rows: DataFrame, write: Callable[[DataFrame], None], log: str, pipeline: str, target: str, counters: dict[str, Column] | None = None, metadata: dict | None = None) -> dict:
    """Run ``write(rows)`` and append one row to the table ``log``; an error is logged and raised again.

    Rows and ``counters`` (aggregates) are observed in the write's own job, so nothing is read twice. After an error they are unknown: rows are 0, as nothing was
    committed, and counters are left out. The log is one small file a run; appending never reads it.
    """
    spark, seen = rows.sparkSession, Observation()
    row = {"run_id": str(uuid.uuid4()), "pipeline": pipeline, "target": target, "started_at": datetime.datetime.now(), "status": "success", "error_class": None, "error_message": None, "rows_written": 0}
    told = dict(metadata or {})
    try:
        write(rows.observe(seen, F.count(F.lit(1)).alias("rows_written"), *(c.alias(n) for n, c in (counters or {}).items())))
        found = dict(seen.get)
        row["rows_written"] = found.pop("rows_written")
        told |= found
    except Exception as error:
        row |= {"status": "error", "error_class": type(error).__name__, "error_message": str(error)[:2000]}
        raise
    finally:
        row |= {"finished_at": datetime.datetime.now(), "metadata": json.dumps(told, default=str, sort_keys=True)}
        spark.createDataFrame([row], LOG).coalesce(1).write.mode("append").parquet(log)
    return row


def tracked_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log after two loads of all orders into a keyed store, of which the second fails on its first order over 400,000."""
    path = folder(spark)
    orders = scan(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.year("o_orderdate").alias("year"))
    counters = {"n_open": F.count_if(F.col("o_orderstatus") == "O"), "last_key": F.max("o_orderkey")}
    tracked(orders, lambda rows: save(rows, f"{path}/store", ["year"]), f"{path}/log", "orders", "all", counters)
    dear = F.when(F.col("o_totalprice") > 400_000, F.raise_error(F.lit("order is too dear"))).otherwise(F.col("o_totalprice"))
    try:
        tracked(orders.withColumn("o_totalprice", dear.cast("double")), lambda rows: save(rows, f"{path}/store", ["year"]), f"{path}/log", "orders", "cheap", counters, {"limit": 400_000})
    except Exception as error:
        if "order is too dear" not in str(error):
            raise
    log = spark.read.schema(LOG).parquet(f"{path}/log")
    return log.select("pipeline", "target", "status", "rows_written", F.col("error_message").contains("order is too dear").alias("told"), "metadata")


def isolated(rows: DataFrame, key: str, value: str, f: Callable) -> DataFrame:
    """(key, status, error, result): ``f`` of each row's ``value`` as text; a row for which it raises is an ``error`` with its class and message and stops no other."""

    def run(batches):
        for batch in batches:
            out = {"status": [], "error": [], "result": []}
            for x in batch.column(1).to_pylist():
                try:
                    told = ("success", None, str(f(x)))
                except Exception as error:  # the row's own failure is its result
                    told = ("error", f"{type(error).__name__}: {error}", None)
                for c, v in zip(out, told, strict=True):
                    out[c].append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, pa.string()) for v in out.values())], names=[key, *out])

    return rows.select(key, value).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, status string, error string, result string")


def batch(rows: DataFrame, key: str, value: str, f: Callable, store: str) -> DataFrame:
    """(key, status, error, result, from_cache) of every row: what the table ``store`` holds is taken from there, the rest is done by ``isolated``, and its successes are added to the store, so errors are tried again next time."""
    spark = rows.sparkSession
    try:
        done = spark.read.parquet(store)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        done = isolated(rows.limit(0), key, value, f).select(key, "result")
    have = rows.join(done, key).select(key, F.lit("success").alias("status"), F.lit(None).cast("string").alias("error"), "result", F.lit(True).alias("from_cache"))
    path = f"{store}-run-{uuid.uuid4().hex}"
    have.unionByName(isolated(rows.join(done, key, "left_anti"), key, value, f).withColumn("from_cache", F.lit(False))).write.parquet(path)
    out = spark.read.parquet(path)
    out.where("status = 'success' and not from_cache").select(key, "result").write.mode("append").parquet(store)
    return out


def counted_sentences(text: str) -> int:
    if "." not in text:
        raise ValueError("no sentence")
    return text.count(".")


def isolated_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches over the documents, the first of every fourth one alone: texts without a full stop are errors, and only what the first one finished comes from the cache of the second."""
    store, docs = f"{folder(spark)}/results", scan(spark, sf_dir, "documents").select("doc_id", "text")
    batch(docs.where("doc_id % 4 = 0"), "doc_id", "text", counted_sentences, store)
    return batch(docs, "doc_id", "text", counted_sentences, store)


def suffixes(host: Column) -> Column:
    """``a.b.c`` -> a.b.c, b.c, c; in small letters, without a port."""
    labels = F.split(F.lower(F.regexp_replace(host, r":\d+$", "")), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def trusted(results: DataFrame, domains: DataFrame, k: int = 5) -> DataFrame:
    """(query, rank, url, place): of each query's ``results`` (query, rank, url) the first ``k`` whose host is a domain of ``domains`` (domain) or stands under one. Host suffixes meet domains by equality; a url without a host is under none."""
    host = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)
    under = results.select("query", "rank", "url", F.explode(suffixes(host)).alias("domain")).join(domains.select(F.lower("domain").alias("domain")).distinct(), "domain", "left_semi")
    one = under.select("query", "rank", "url").distinct()
    place = F.row_number().over(Window.partitionBy("query").orderBy("rank", "url"))
    return one.withColumn("place", place).where(F.col("place") <= k)


def trusted_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a result of one of 50 queries; trusted are two domains and one deeper one."""
    pages = scan(spark, sf_dir, "pages").select((F.col("page_id") % 50).alias("query"), F.col("page_id").alias("rank"), "url")
    return trusted(pages, spark.createDataFrame([("example.org",), ("Example.com",), ("blog.therst.example.net",)], "domain string"))


def colocated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and their labels in two stores bucketed by doc_id, joined and counted without a shuffle of either."""
    docs = bucketed(scan(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("n")), ["doc_id"])
    labels = bucketed(scan(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), ["doc_id"])
    return docs.hint("merge").join(labels, "doc_id").groupBy("doc_id").agg(F.max("source").alias("source"), F.sum("n").alias("n_chars"), F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))


QUERIES = {"t20_isolated_batch": isolated_batch, "f5_tracked_loads": tracked_orders, "s13_trusted_results": trusted_results, "r5_colocated": colocated}
ORACLE_SQL = {
    "t20_isolated_batch": """SELECT doc_id, CASE WHEN contains(text, '.') THEN 'success' ELSE 'error' END AS status, CASE WHEN NOT contains(text, '.') THEN 'ValueError: no sentence' END AS error, CASE WHEN contains(text, '.') THEN CAST(length(text) - length(replace(text, '.', '')) AS VARCHAR) END AS result,
      contains(text, '.') AND doc_id % 4 = 0 AS from_cache FROM documents""",
    "f5_tracked_loads": """SELECT 'orders' AS pipeline, 'all' AS target, 'success' AS status, count(*) AS rows_written, CAST(NULL AS BOOLEAN) AS told, '{"last_key": ' || max(o_orderkey) || ', "n_open": ' || count(*) FILTER (WHERE o_orderstatus = 'O') || '}' AS metadata FROM orders
      UNION ALL SELECT 'orders', 'cheap', CASE WHEN max(o_totalprice) > 400000 THEN 'error' ELSE 'success' END, CASE WHEN max(o_totalprice) > 400000 THEN 0 ELSE count(*) END, CASE WHEN max(o_totalprice) > 400000 THEN true END,
        CASE WHEN max(o_totalprice) > 400000 THEN '{"limit": 400000}' ELSE '{"last_key": ' || max(o_orderkey) || ', "limit": 400000, "n_open": ' || count(*) FILTER (WHERE o_orderstatus = 'O') || '}' END FROM orders""",
    "s13_trusted_results": """SELECT query, rank, url, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank, url) AS place FROM (SELECT page_id % 50 AS query, page_id AS rank, url, lower(regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1), ':[0-9]+$', '')) AS h FROM pages)
      WHERE h IN ('example.org', 'example.com', 'blog.therst.example.net') OR h LIKE '%.example.org' OR h LIKE '%.example.com' OR h LIKE '%.blog.therst.example.net') WHERE place <= 5""",
    "r5_colocated": "SELECT doc_id, max(source) AS source, CAST(sum(length(text)) AS BIGINT) AS n_chars, max(quality) AS quality, max(toxic) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY doc_id",
}
