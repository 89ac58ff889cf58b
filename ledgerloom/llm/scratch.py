"""Tables that cut lineage, in the shared folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows a table may have to be broadcast; its rows here are a few longs or short arrays.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one is set only in local mode and where there is none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Tables of this driver that are not deleted yet.
WRITTEN: list[str] = []


def table(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet and return it reread: later steps start from files, not from a lineage.

    Results read such tables when an action runs, so they stay until :func:`clear`.
    """
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    WRITTEN.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
    if path in WRITTEN:
        WRITTEN.remove(path)


def drop(*tables: DataFrame) -> None:
    """Delete tables made by :func:`table` that no later step reads."""
    for t in tables:
        delete(t.sparkSession, t.scratch_path)


def clear(spark: SparkSession) -> None:
    """Delete all tables that operators of this driver wrote; to be called once their results are stored."""
    for path in list(WRITTEN):
        delete(spark, path)
