"""Event streams: windowed counts and per-session usage, kept in state and written as updates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How late an event may be before its window's state is dropped. Within one run over a finished table nothing is late.
LATENESS = "1 day"


def folder(spark: SparkSession) -> str:
    """A new folder in the cluster's shared one; a temporary one only in local mode, where none need be set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # as a pattern, the path may be a file as well as a folder
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def settled(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Run ``updates`` (a streaming aggregate) over all there is; the last written state of each key.

    Batches append to a table, so a repeated batch after a failure writes equal rows again; the greatest batch
    wins. The query's checkpoint lies beside the table.
    """
    spark, path = updates.sparkSession, folder(updates.sparkSession)
    write = lambda rows, batch: rows.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{path}/rows")
    query = updates.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    names = [c for c in updates.columns if c not in keys]
    last = spark.read.parquet(f"{path}/rows").groupBy(*keys).agg(F.max_by(F.struct(*names), "batch").alias("s"))
    return last.select(*keys, *(F.col("s")[c].alias(c) for c in names))


def hourly(events: DataFrame) -> DataFrame:
    """Events and errors by hour and type of a stream (or a table) with ``ts``; late ones count while their window is kept."""
    by = events.withWatermark("ts", LATENESS).groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    out = by.agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n", "first_id", "last_id")


def stream_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(hourly(events_stream(spark, sf_dir)), ["hour", "event_type"])


def stream_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage by user and day: calls and hundredths of value, summed in state."""
    e = events_stream(spark, sf_dir).withWatermark("ts", LATENESS)
    by = e.groupBy("user_id", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n_calls"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("units"))
    return settled(by.select("user_id", F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n_calls", "units"), ["user_id", "day"])


QUERIES = {"v1_stream_hours": stream_hours, "v2_stream_usage": stream_usage}
ORACLE_SQL = {
    "v1_stream_hours": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY 1, 2",
    "v2_stream_usage": "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n_calls, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS units FROM events GROUP BY 1, 2",
}
