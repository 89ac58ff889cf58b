"""Runs, conversations and filings: collapses, pairings, redaction, latest states, reconciliation, text clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import latest_per_key, scan

TRUSTED = ("example.com", "example.org")
#: Redactions in order: (pattern, replacement); patterns hold in Java and RE2 syntax alike.
REDACTIONS = (
    (r"[a-z]+://[^ @/]+:[^ @/]+@[^ ]+", "[connection]"),
    (r"[A-Za-z0-9._]+@[A-Za-z0-9.]+", "[address]"),
    (r"[A-Za-z0-9_]{24,}", "[key]"),
    (r"[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+", "[host]"),
    (r"(/[a-z0-9_.]+){2,}", "[path]"),
    (r"[ \n\t]+", " "),
)


def redact(text: Column) -> Column:
    for pattern, put in REDACTIONS:
        text = F.regexp_replace(text, pattern, put)
    return text


def collapsed(spark, sf_dir: str) -> DataFrame:
    """Each conversation as one text in turn order, its turns by role, and whether it finished with an assistant's turn."""
    c = scan(spark, sf_dir, "conversations")
    by = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"), F.max_by("role", "turn").alias("last"), F.sum((F.col("role") == "user").cast("long")).alias("n_user"), F.sum(F.length("text").cast("long")).alias("n_chars"))
    return by.select("conv_id", F.md5(F.array_join(F.transform("t", lambda x: x["text"]), "\n")).alias("text_md5"), "n_user", "n_chars", (F.col("last") == "assistant").alias("finished"))


def final_answer(spark, sf_dir: str) -> DataFrame:
    c = scan(spark, sf_dir, "conversations").where("role = 'assistant'")
    return latest_per_key(c.select("conv_id", "turn", "text"), ["conv_id"], ["turn"]).select("conv_id", "turn", F.md5("text").alias("answer_md5"))


def redacted(spark, sf_dir: str) -> DataFrame:
    """Documents with secrets and places taken out, as a digest and how many characters went; row-local."""
    d = scan(spark, sf_dir, "documents").select("doc_id", "text", redact(F.col("text")).alias("clean"))
    return d.select("doc_id", F.md5("clean").alias("clean_md5"), (F.length("text") - F.length("clean")).cast("long").alias("n_gone"))


def call_pairs(spark, sf_dir: str) -> DataFrame:
    """Each click (call) with the same user's next event as its result, if that is a purchase or an error."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = scan(spark, sf_dir, "events").select("event_id", "event_type", F.lead("event_id").over(w).alias("next_id"), F.lead("event_type").over(w).alias("next_type")).where("event_type = 'click'")
    known = F.col("next_type").isin("purchase", "error")
    return e.select(F.col("event_id").alias("call_id"), F.when(known, F.col("next_id")).alias("result_id"), F.when(known, F.col("next_type")).otherwise("pending").alias("status"))


def run_audit(spark, sf_dir: str) -> DataFrame:
    """One row per run (day): events, errors and the status; counters stay on error."""
    by = scan(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("run_day")).agg(F.count("*").alias("n_rows"), F.sum((F.col("event_type") == "error").cast("long")).alias("n_errors"), F.count_distinct("user_id").alias("n_users"))
    return by.withColumn("status", F.when(F.col("n_errors") * 4 > F.col("n_rows"), "error").otherwise("success"))


def latest_runs(spark, sf_dir: str) -> DataFrame:
    e = scan(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    return latest_per_key(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


def reconciliation(spark, sf_dir: str) -> DataFrame:
    """Orders whose total differs by over 1 % from the sum of their lines; both sides are grouped or keyed by the order."""
    cents = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")) * 100).cast("long")
    lines = scan(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(cents).alias("line_cents"))
    o = scan(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("total_cents"))
    off = F.abs(F.col("total_cents") - F.col("line_cents"))
    return o.join(lines, o.o_orderkey == lines.l_orderkey).where(off * 100 > F.col("total_cents")).select("o_orderkey", off.alias("off_cents"))


def visible(spark, sf_dir: str) -> DataFrame:
    """Orders of customers whose latest order is complete (status F): the marker check, then a semi-join."""
    o = scan(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    marker = o.groupBy("o_custkey").agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("s")).where("s = 'F'")
    return o.join(marker, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


def noise_lines(spark, sf_dir: str) -> DataFrame:
    """Lines of 3 to 50 characters that occur at least four times in a document."""
    lines = scan(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.length("line").between(3, 50))
    return lines.groupBy("doc_id", "line").agg(F.count("*").alias("n")).where("n >= 4")


def previews(spark, sf_dir: str) -> DataFrame:
    """First and last 300 characters, and whether the text is a stub (under 80 characters)."""
    d = scan(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(F.substring("text", 1, 300)).alias("head_md5"), F.md5(F.right("text", F.lit(300))).alias("tail_md5"), (F.length("text") < 80).alias("is_stub"))


def inspection(spark, sf_dir: str) -> DataFrame:
    """Documents, characters and stubs by source and language."""
    d = scan(spark, sf_dir, "documents").select("source", "lang", F.length("text").alias("n"))
    return d.groupBy("source", "lang").agg(F.count("*").alias("n_docs"), F.sum("n").cast("long").alias("n_chars"), F.sum((F.col("n") < 80).cast("long")).alias("n_stubs"))


def trusted_pages(spark, sf_dir: str) -> DataFrame:
    """At most five pages of each host under a trusted domain, lowest ids first (the feature is the limit)."""
    host = F.regexp_extract("url", "^https?://([^/?#]*)", 1)
    p = scan(spark, sf_dir, "pages").select("page_id", host.alias("host"), F.regexp_extract(host, "[^.]+[.][^.]+$", 0).alias("domain")).where(F.col("domain").isin(*TRUSTED))
    return p.withColumn("place", F.row_number().over(Window.partitionBy("host").orderBy("page_id"))).where("place <= 5").select("page_id", "host", "place")


def event_matrix(spark, sf_dir: str) -> DataFrame:
    """Result sink shape: one row per user, one column per event type."""
    kinds = ["click", "error", "purchase", "signup", "view"]
    by = scan(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", kinds).agg(F.count("event_id"))
    return by.select("user_id", *(F.coalesce(k, F.lit(0)).cast("long").alias(f"score_{k}") for k in kinds))


def store_years(spark, sf_dir: str) -> DataFrame:
    """Sorted years that each customer has orders of."""
    by = scan(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set(F.year("o_orderdate").cast("string"))).alias("y"))
    return by.select("o_custkey", F.array_join("y", ",").alias("years"))


def _sql_redact() -> str:
    out = "text"
    for pattern, put in REDACTIONS:
        out = f"regexp_replace({out}, '{pattern}', '{put}', 'g')".replace("\\n", "' || chr(10) || '").replace("\\t", "' || chr(9) || '")
    return out


QUERIES = {
    "v4_run_collapse": collapsed, "v11_final_answer": final_answer, "v7_redaction": redacted, "v3_call_pairs": call_pairs, "f5_run_audit": run_audit, "f6_latest_runs": latest_runs, "f8_reconciliation": reconciliation,
    "c9_visible_snapshot": visible, "h11_noise_lines": noise_lines, "t17_previews": previews, "t16_inspection": inspection, "s13_trusted_pages": trusted_pages, "s10_result_matrix": event_matrix, "s6_store_years": store_years,
}
HOST = "regexp_extract(url, '^https?://([^/?#]*)', 1)"
ORACLE_SQL = {
    "v4_run_collapse": """SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn)) AS text_md5, count(*) FILTER (WHERE role = 'user') AS n_user, CAST(sum(length(text)) AS BIGINT) AS n_chars, arg_max(role, turn) = 'assistant' AS finished FROM conversations GROUP BY 1""",
    "v11_final_answer": "SELECT conv_id, max(turn) AS turn, md5(arg_max(text, turn)) AS answer_md5 FROM conversations WHERE role = 'assistant' GROUP BY 1",
    "v7_redaction": f"SELECT doc_id, md5(c) AS clean_md5, length(text) - length(c) AS n_gone FROM (SELECT doc_id, text, {_sql_redact()} AS c FROM documents)",
    "v3_call_pairs": """SELECT event_id AS call_id, CASE WHEN k IN ('purchase', 'error') THEN n END AS result_id, CASE WHEN k IN ('purchase', 'error') THEN k ELSE 'pending' END AS status
      FROM (SELECT event_id, event_type, lead(event_id) OVER w AS n, lead(event_type) OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_type = 'click'""",
    "f5_run_audit": """SELECT *, CASE WHEN n_errors * 4 > n_rows THEN 'error' ELSE 'success' END AS status FROM (SELECT CAST(ts AS DATE) AS run_day, count(*) AS n_rows, count(*) FILTER (WHERE event_type = 'error') AS n_errors, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1)""",
    "f6_latest_runs": "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "f8_reconciliation": """SELECT o_orderkey, CAST(abs(t - l) AS BIGINT) AS off_cents FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS t FROM orders)
      JOIN (SELECT l_orderkey, sum(CAST(round(l_extendedprice * (1 - l_discount) * (1 + l_tax) * 100) AS BIGINT)) AS l FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey WHERE abs(t - l) * 100 > t""",
    "c9_visible_snapshot": """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM (SELECT o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1 AND o_orderstatus = 'F')""",
    "h11_noise_lines": "SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) BETWEEN 3 AND 50 GROUP BY 1, 2 HAVING count(*) >= 4",
    "t17_previews": "SELECT doc_id, md5(left(text, 300)) AS head_md5, md5(right(text, 300)) AS tail_md5, length(text) < 80 AS is_stub FROM documents",
    "t16_inspection": "SELECT source, lang, count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS n_chars, count(*) FILTER (WHERE length(text) < 80) AS n_stubs FROM documents GROUP BY 1, 2",
    "s13_trusted_pages": f"""SELECT page_id, host, CAST(n AS INTEGER) AS place FROM (SELECT page_id, host, row_number() OVER (PARTITION BY host ORDER BY page_id) AS n FROM (SELECT page_id, {HOST} AS host FROM pages)
      WHERE regexp_extract(host, '[^.]+[.][^.]+$', 0) IN ('example.com', 'example.org')) WHERE n <= 5""",
    "s10_result_matrix": "SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS score_{k}" for k in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1",
    "s6_store_years": "SELECT o_custkey, string_agg(y, ',' ORDER BY y) AS years FROM (SELECT DISTINCT o_custkey, CAST(year(o_orderdate) AS VARCHAR) AS y FROM orders) GROUP BY 1",
}
