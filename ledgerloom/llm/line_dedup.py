"""Line dedup: windows of three consecutive lines that occurred before, anywhere, lose their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3


def dedup(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, kept_text, n_lines, n_removed.

    Lines are split at "\\n". The first occurrence of a window is the one with the smallest
    (doc_id, text hash, place), null ids first; lines of every other occurrence go, overlaps merged. Texts of fewer than three
    lines have no window and stay. Null and empty texts stay as they are. Exact repeats of a whole row are
    one document and come out alike. Windows are counted map-side first, so a window that a third of
    all lines share is no hot group; its occurrences join to one row by a join that Spark can split.
    """
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    lines = rows.where("text is not null").select("doc_id", "key", F.split("text", "\n", -1).alias("lines")).where(F.size("lines") >= WINDOW)
    at = lines.select("doc_id", "key", "lines", F.explode(F.sequence(F.lit(0), F.size("lines") - WINDOW)).alias("p"))
    own = [F.get(F.col("lines"), F.col("p") + k) for k in range(WINDOW)]
    at = at.select("doc_id", "key", "p", F.xxhash64(*own).alias("h"), F.xxhash64(F.lit(1), *reversed(own)).alias("g"))
    first = at.groupBy("h", "g").agg(F.min(F.struct("doc_id", "key", "p")).alias("first"), F.max(F.struct("doc_id", "key", "p")).alias("last"))
    first = first.where(~F.col("first").eqNullSafe(F.col("last")))
    later = at.join(first, ["h", "g"]).where(~F.struct("doc_id", "key", "p").eqNullSafe(F.col("first")))
    gone = later.groupBy("doc_id", "key").agg(F.collect_set("p").alias("starts")).select(F.col("doc_id").alias("r_id"), F.col("key").alias("r_key"), "starts")
    out = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("key") == F.col("r_key")), "left")
    out = out.withColumn("lines", F.split("text", "\n", -1)).withColumn("marks", F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + WINDOW - 1)))))
    number = F.sequence(F.lit(0), F.size("lines") - 1)
    left = F.when(F.col("marks").isNull(), F.col("lines")).otherwise(F.transform(F.array_except(number, "marks"), lambda i: F.get(F.col("lines"), i)))
    return out.select(
        "doc_id",
        F.when(F.col("marks").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("kept_text"),
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("marks").isNull(), 0).otherwise(F.size("marks")).cast("long").alias("n_removed"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the SHA-256 of the kept text (null: of the empty text)."""
    return dedup(docs).select("doc_id", F.greatest("n_lines", F.lit(0)).alias("n_lines"), "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


#: The same rows for DuckDB, where doc_id is unique.
DIGEST_SQL = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, p, lines[p + 1] || chr(10) || lines[p + 2] || chr(10) || lines[p + 3] AS s
      FROM (SELECT doc_id, lines, unnest(range(0, len(lines) - 2)) AS p FROM l WHERE len(lines) >= 3)),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS n FROM w) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, p + k AS i FROM later, (SELECT unnest([0, 1, 2]) AS k)),
each AS (SELECT doc_id, lines[i + 1] AS line, i FROM (SELECT doc_id, lines, unnest(range(0, len(lines))) AS i FROM l)),
kept AS (SELECT e.doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
                coalesce(string_agg(e.line, chr(10) ORDER BY e.i) FILTER (WHERE g.i IS NULL), '') AS t
         FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""
