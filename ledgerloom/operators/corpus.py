"""Chunks of documents and turns of conversations and event sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cjk_ratio, contains_cjk, uuid5_dns
from ..sources import scan

SIZE, OVERLAP = 512, 50


def cut(spark, sf_dir: str) -> DataFrame:
    """(doc_id, source, chunk_index, c): pieces of 512 words that overlap by 50, with a gapless index by document; row-local, no shuffle."""
    d = scan(spark, sf_dir, "documents").select("doc_id", "source", F.split("text", " ").alias("w"))
    last = F.greatest(F.ceil((F.size("w") - OVERLAP) / (SIZE - OVERLAP)) - 1, F.lit(0)).cast("int")
    return d.select("doc_id", "source", F.posexplode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("w", i * (SIZE - OVERLAP) + 1, SIZE))).alias("chunk_index", "c"))


def chunks(spark, sf_dir: str) -> DataFrame:
    """The pieces' sizes and digests."""
    return cut(spark, sf_dir).select("doc_id", "chunk_index", F.size("c").alias("n_words"), F.md5(F.array_join("c", " ")).alias("digest"))


def chunk_ids(spark, sf_dir: str) -> DataFrame:
    """Deterministic point ids of every chunk, and its document's marker."""
    own = lambda last: uuid5_dns(F.concat_ws(":", "source", F.col("doc_id").cast("string"), last))
    return cut(spark, sf_dir).select("doc_id", "chunk_index", own(F.col("chunk_index").cast("string")).alias("point_id"), own(F.lit("_status")).alias("marker_id"))


def language_bounds(spark, sf_dir: str) -> DataFrame:
    """CJK share of each turn, and whether it lies in the bounds 0 to 0.05."""
    c = scan(spark, sf_dir, "conversations")
    ratio = F.round(cjk_ratio(F.col("text")), 9)
    return c.select("conv_id", "turn", ratio.alias("ratio"), ratio.between(0, 0.05).alias("in_bounds"))


def cjk_texts(spark, sf_dir: str) -> DataFrame:
    """CJK share of each turn to which every fifth one has some added, whether it has any, and whether the share lies in the conversation's bounds; without bounds that is an error, here null."""
    extra = F.when(F.col("turn") % 5 == 0, F.lit(" 中文 字")).otherwise("")
    c = scan(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("text", extra).alias("text"), F.when(F.col("conv_id") % 4 > 0, F.lit(0.01)).alias("low"))
    ratio = F.round(cjk_ratio(F.col("text")), 9)
    return c.select("conv_id", "turn", ratio.alias("ratio"), contains_cjk(F.col("text")).alias("has_cjk"), (ratio >= F.col("low")).alias("in_bounds"))


def last_user_text(spark, sf_dir: str) -> DataFrame:
    c = scan(spark, sf_dir, "conversations").where("role = 'user' and trim(text) <> ''")
    return c.groupBy("conv_id").agg(F.max_by(F.md5("text"), "turn").alias("text_md5"))


def call_budget(spark, sf_dir: str) -> DataFrame:
    """Calls (purchases) of each user a day beyond the third, as blocked."""
    e = scan(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    n = F.row_number().over(Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id"))
    return e.select("event_id", n.alias("call_no"), (n > 3).alias("blocked"))


def first_latency(spark, sf_dir: str) -> DataFrame:
    """Microseconds from each user's first event to the first click."""
    by = scan(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("start"), F.min(F.when(F.col("event_type") == "click", F.col("ts"))).alias("click"))
    return by.where("click is not null").select("user_id", (F.unix_micros(F.col("click").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))).alias("latency_us"))


def _sql_uuid5(name: str) -> str:
    h = f"sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode({name}))"
    return f"concat_ws('-', substr({h}, 1, 8), substr({h}, 9, 4), '5' || substr({h}, 14, 3), substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr({h}, 17, 1)), 1) || substr({h}, 18, 3), substr({h}, 21, 12))"


IDS_SQL = f"""SELECT doc_id, chunk_index, {_sql_uuid5("source || ':' || doc_id || ':' || chunk_index")} AS point_id, {_sql_uuid5("source || ':' || doc_id || ':_status'")} AS marker_id FROM
  (SELECT doc_id, source, CAST(unnest(range(0, CAST(greatest(ceil((len(string_split(text, ' ')) - 50) / 462.0), 1) AS BIGINT))) AS INTEGER) AS chunk_index FROM documents)"""
QUERIES = {"c2_word_chunks": chunks, "c5_point_ids": chunk_ids, "e9_language_bounds": language_bounds, "e8_cjk_texts": cjk_texts, "v10_last_user_text": last_user_text, "v6_call_budget": call_budget, "v12_first_latency": first_latency}
ORACLE_SQL = {
    "c5_point_ids": IDS_SQL,
    "c2_word_chunks": """WITH d AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents),
      p AS (SELECT doc_id, w, unnest(range(0, CAST(greatest(ceil((len(w) - 50) / 462.0), 1) AS BIGINT))) AS i FROM d)
      SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, CAST(len(w[i * 462 + 1 : i * 462 + 512]) AS INTEGER) AS n_words, md5(array_to_string(w[i * 462 + 1 : i * 462 + 512], ' ')) AS digest FROM p""",
    "e9_language_bounds": """SELECT conv_id, turn, ratio, ratio BETWEEN 0 AND 0.05 AS in_bounds FROM (SELECT conv_id, turn,
      CASE WHEN length(s) > 0 THEN round(length(regexp_replace(s, '[^\\x{4e00}-\\x{9fff}\\x{3400}-\\x{4dbf}]', '', 'g')) / length(s), 9) ELSE 0.0 END AS ratio FROM (SELECT conv_id, turn, regexp_replace(text, '\\s', '', 'g') AS s FROM conversations))""",
    "e8_cjk_texts": """SELECT conv_id, turn, ratio, ratio > 0 AS has_cjk, CASE WHEN conv_id % 4 > 0 THEN ratio >= 0.01 END AS in_bounds FROM (SELECT conv_id, turn, CASE WHEN length(s) > 0 THEN round(length(regexp_replace(s, '[^\\x{4e00}-\\x{9fff}\\x{3400}-\\x{4dbf}]', '', 'g')) / length(s), 9) ELSE 0.0 END AS ratio
      FROM (SELECT conv_id, turn, regexp_replace(text || CASE WHEN turn % 5 = 0 THEN ' 中文 字' ELSE '' END, '\\s', '', 'g') AS s FROM conversations))""",
    "v10_last_user_text": "SELECT conv_id, arg_max(md5(text), turn) AS text_md5 FROM conversations WHERE role = 'user' AND trim(text) <> '' GROUP BY 1",
    "v6_call_budget": """SELECT event_id, CAST(n AS INTEGER) AS call_no, n > 3 AS blocked FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'purchase')""",
    "v12_first_latency": "SELECT user_id, epoch_us(c) - epoch_us(s) AS latency_us FROM (SELECT user_id, min(ts) AS s, min(CASE WHEN event_type = 'click' THEN ts END) AS c FROM events GROUP BY 1) WHERE c IS NOT NULL",
}
