"""Agent runs as event logs: lifecycle of text and reasoning parts, tool calls by id, progress, records, redacted errors, last turns, latencies.

The queries read a log (session_id, seq, kind, id, name, delta, tokens) derived from ``events``: views are text, signups reasoning, clicks tool calls, purchases
their results and errors their errors; every seventh view is a progress note of the last call.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import SQL_SPACE, stripped
from ..sources import derived, scan
from ..streaming.sessions import folder

EMITTED = "session_id long, seq long, ord int, type string, id string"

#: What is taken out of an error's text, in this order, and what stands for it.
REDACTIONS = (
    (r"(?m)Traceback \(most recent call last\):.*\n(?:\s+.*\n)*+", ""),
    (r"\w+://[^\s@]*@[^\s]+", "[connection_string]"),
    (r"(?i)Bearer\s+\S+", "[REDACTED]"),
    (r"\bsk-[A-Za-z0-9_-]{10,}\b", "[REDACTED]"),
    (r"(?i)\b[A-Z_]*(?:KEY|SECRET|TOKEN|PASSWORD)\s*=\s*\S+", "[REDACTED]"),
    (r"(?i)[?&]api_key=[^\s&]+", "[REDACTED]"),
    (r"\b(?:[\w-]+\.internal(?:\.[\w-]+)*|internal(?:\.[\w-]+)+)(?::\d+)?\b", "[internal_host]"),
    (r"(?:/[\w._-]+){3,}", "[path]"),
    (r"[A-Z]:\\(?:[\w._-]+\\){2,}[\w._-]*", "[path]"),
    (r"  +", " "),
)

LOG = """SELECT user_id AS session_id, event_id AS seq, ts, CASE WHEN event_type = 'view' AND event_id % 7 = 0 THEN 'progress' WHEN event_type = 'view' THEN 'text' WHEN event_type = 'signup' THEN 'reasoning' WHEN event_type = 'click' THEN 'tool_call'
  WHEN event_type = 'purchase' THEN 'tool_result' ELSE 'tool_error' END AS kind, props AS delta, CAST(value AS BIGINT) AS tokens FROM events"""


def redact(text: Column) -> Column:
    """An error's text without its traceback, connection strings, keys, internal hosts and paths."""
    for pattern, put in REDACTIONS:
        text = F.regexp_replace(text, pattern, put)
    return stripped(text)


def log(spark, sf_dir: str) -> DataFrame:
    """The event log; a call's id is its place, and what follows it refers to the last call."""
    e = derived(spark, sf_dir, LOG, "events")
    w = Window.partitionBy("session_id").orderBy("seq")
    call = F.last(F.when(F.col("kind") == "tool_call", F.col("seq")), ignorenulls=True).over(w)
    return e.withColumn("call_id", F.when(F.col("kind").isin("tool_call", "tool_result", "tool_error", "progress"), F.concat(F.lit("call-"), F.coalesce(call, F.lit(-1)))))


def lifecycle(events: DataFrame) -> DataFrame:
    """(session_id, seq, ord, type, id): what a client is told of a log, by windows over each session.

    The first event of a model starts the message. A text part goes on until a tool is called, a reasoning part until text or a call; both are
    numbered. At a session's last event what is open is closed, and the session finishes.
    """
    w = Window.partitionBy("session_id").orderBy("seq")
    before, all_ = w.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("session_id")
    kind = F.col("kind")
    spoken = F.when(kind.isin("text", "reasoning", "tool_call"), kind)
    rows = events.select("session_id", "seq", "kind").withColumns(
        {"said": F.last(spoken, ignorenulls=True).over(before), "run": F.coalesce(F.count_if(kind == "tool_call").over(before), F.lit(0)), "last": F.col("seq") == F.max("seq").over(all_), "first": F.col("seq") == F.min(F.when(spoken.isNotNull(), F.col("seq"))).over(all_)}
    )
    here = F.col("said")
    of_run = Window.partitionBy("session_id", "run").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("texts", F.coalesce(F.count_if(kind == "text").over(of_run), F.lit(0)))
    rows = rows.withColumn("text_starts", (kind == "text") & (F.col("texts") == 0)).withColumn("part_starts", (kind == "reasoning") & ~F.coalesce(here == "reasoning", F.lit(False)))
    rows = rows.withColumn("text_no", F.concat(F.lit("text-"), F.count_if("text_starts").over(w) - 1)).withColumn("part_no", F.concat(F.lit("reasoning-"), F.count_if("part_starts").over(w) - 1))
    closes = kind.isin("text", "tool_call") & F.coalesce(here == "reasoning", F.lit(False))
    now = F.coalesce(spoken, here)
    text_open = (F.col("texts") > 0) & (kind != "tool_call") | (kind == "text")
    told = [
        (F.col("first"), "start", F.lit(None).cast("string")),
        (closes, "reasoning-end", F.col("part_no")),
        (F.col("part_starts"), "reasoning-start", F.col("part_no")),
        (kind == "reasoning", "reasoning-delta", F.col("part_no")),
        (F.col("text_starts"), "text-start", F.col("text_no")),
        (kind == "text", "text-delta", F.col("text_no")),
        ((kind == "tool_call") & (F.col("texts") > 0), "text-end", F.col("text_no")),
        (F.col("last") & (now == "reasoning"), "reasoning-end", F.col("part_no")),
        (F.col("last") & text_open, "text-end", F.col("text_no")),
        (F.col("last"), "finish", F.lit(None).cast("string")),
    ]
    each = F.filter(F.array(*(F.struct(F.lit(k).alias("ord"), F.lit(t).alias("type"), i.alias("id"), F.coalesce(c, F.lit(False)).alias("told")) for k, (c, t, i) in enumerate(told))), lambda x: x["told"])
    return rows.select("session_id", "seq", F.inline(each)).drop("told")


def lifecycle_step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The same for a stream: what is open and how far the numbers are is a session's state; it finishes at the time-out, after its last event."""
    started, texts, parts, text_open, part_open, seen = state.get if state.exists else (False, 0, 0, False, False, -1)
    out = []

    def close(seq, text_at, part_at):
        nonlocal text_open, part_open
        if part_at is not None and part_open:
            out.append((key[0], seq, part_at, "reasoning-end", f"reasoning-{parts - 1}"))
            part_open = False
        if text_at is not None and text_open:
            out.append((key[0], seq, text_at, "text-end", f"text-{texts - 1}"))
            text_open = False

    if state.hasTimedOut:
        close(seen, 8, 7)
        out.append((key[0], seen, 9, "finish", None))
        state.remove()
    else:
        rows = pd.concat(frames).sort_values("seq")
        for seq, kind in zip(rows["seq"].tolist(), rows["kind"].tolist(), strict=True):
            seen = max(seen, seq)
            if kind in ("text", "reasoning", "tool_call") and not started:
                started = True
                out.append((key[0], seq, 0, "start", None))
            if kind == "reasoning":
                if not part_open:
                    parts, part_open = parts + 1, True
                    out.append((key[0], seq, 2, "reasoning-start", f"reasoning-{parts - 1}"))
                out.append((key[0], seq, 3, "reasoning-delta", f"reasoning-{parts - 1}"))
            elif kind == "text":
                close(seq, None, 1)
                if not text_open:
                    texts, text_open = texts + 1, True
                    out.append((key[0], seq, 4, "text-start", f"text-{texts - 1}"))
                out.append((key[0], seq, 5, "text-delta", f"text-{texts - 1}"))
            elif kind == "tool_call":
                close(seq, 6, 1)
        state.update((started, texts, parts, text_open, part_open, seen))
        state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + IDLE_MS)
    yield pd.DataFrame(out, columns=["session_id", "seq", "ord", "type", "id"])


#: A session without events for so long, by event time, has ended.
IDLE_MS = 30 * 60 * 1000


def stream_lifecycle(events: DataFrame) -> DataFrame:
    """``lifecycle`` of a stream (session_id, seq, ts, kind) with a watermark on ``ts``."""
    state = "started boolean, texts int, parts int, text_open boolean, part_open boolean, seen long"
    return events.groupBy("session_id").applyInPandasWithState(lifecycle_step, EMITTED, state, "append", GroupStateTimeout.EventTimeTimeout)


def paired_calls(events: DataFrame) -> DataFrame:
    """(session_id, call_id, status, result_seq): each call with the first result or error that names it; results of unknown calls are ``unknown``."""
    calls = events.where("kind = 'tool_call'").select("session_id", "call_id", F.col("seq").alias("call_seq"))
    ends = events.where("kind in ('tool_result', 'tool_error')").groupBy("session_id", "call_id").agg(F.min_by("kind", "seq").alias("end"), F.min("seq").alias("result_seq"))
    both = calls.join(ends, ["session_id", "call_id"], "full")
    status = F.when(F.col("call_seq").isNull(), "unknown").when(F.col("end").isNull(), "pending").when(F.col("end") == "tool_result", "result").otherwise("error")
    return both.select("session_id", "call_id", status.alias("status"), "result_seq")


def pending_progress(events: DataFrame) -> DataFrame:
    """(session_id, seq, call_id): progress notes of calls that have begun and have no result or error yet."""
    w = Window.partitionBy("session_id", "call_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    own = events.where("call_id is not null").withColumns({"begun": F.count_if(F.col("kind") == "tool_call").over(w), "ended": F.count_if(F.col("kind").isin("tool_result", "tool_error")).over(w)})
    return own.where("kind = 'progress' and begun > 0 and ended = 0").select("session_id", "seq", "call_id")


def records(events: DataFrame) -> DataFrame:
    """(session_id, seq, record): the JSON that goes over the wire for each event, by its kind."""
    kind, at = F.col("kind"), F.col("call_id")
    json = lambda *columns: F.to_json(F.struct(*columns))
    name = lambda t: F.lit(t).alias("type")
    record = (
        F.when(kind == "text", json(name("text-delta"), F.col("delta")))
        .when(kind == "reasoning", json(name("reasoning-delta"), F.col("delta")))
        .when(kind == "tool_call", json(name("tool-input-available"), at.alias("toolCallId"), F.col("delta").alias("input")))
        .when(kind == "tool_result", json(name("tool-output-available"), at.alias("toolCallId"), F.col("delta").alias("output")))
        .when(kind == "tool_error", json(name("tool-output-error"), at.alias("toolCallId"), F.col("delta").alias("errorText")))
        .otherwise(json(name("data-tool-progress"), at.alias("id"), F.col("delta").alias("data"), F.lit(True).alias("transient")))
    )
    return events.select("session_id", "seq", record.alias("record"))


def run_results(events: DataFrame) -> DataFrame:
    """(session_id, text_md5, n_results, n_errors, tokens, status): each run in one row. This log has no finish of its own: a run whose last event is an error
    finishes with it and failed; an error that the run got over is none (``streaming.lifecycle.results`` reads finishes)."""
    kind = F.col("kind")
    by = events.groupBy("session_id").agg(
        F.array_sort(F.collect_list(F.when(kind == "text", F.struct("seq", "delta")))).alias("t"), F.count_if(kind == "tool_result").alias("n_results"), F.count_if(kind == "tool_error").alias("n_errors"), F.sum("tokens").alias("tokens"),
        F.max_by("kind", "seq").alias("last"),
    )
    return by.select("session_id", F.md5(F.array_join(F.transform("t", lambda x: x["delta"]), "")).alias("text_md5"), "n_results", "n_errors", "tokens", F.when(F.col("last") == "tool_error", "failed").otherwise("finished").alias("status"))


ERRORS = r"""SELECT event_id, CASE event_id % 6 WHEN 0 THEN concat('Traceback (most recent call last):', chr(10), '  File "/srv/app/tools/x.py", line ', event_id, chr(10), '    call()', chr(10), 'TimeoutError: provider  timed out')
  WHEN 1 THEN concat('postgres://user:pw', event_id, '@db.internal:5432/x refused') WHEN 2 THEN concat('401 with Bearer abc', event_id, ' and sk-abcdefghij', event_id) WHEN 3 THEN concat('API_KEY = v', event_id, ' at https://x.org/a?q=1&api_key=s', event_id)
  WHEN 4 THEN concat('host cache', event_id, '.internal.net:80 lost /var/lib/app/data', event_id, ' twice') ELSE concat('C:\\Users\\me\\data\\f', event_id, '.txt missing, see ', props) END AS error FROM events WHERE event_type = 'error'"""


def redacted_errors(spark, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, ERRORS, "events").select("event_id", redact(F.col("error")).alias("clean"))


def regenerate_target(turns: DataFrame) -> DataFrame:
    """(conv_id, target_turn): where each conversation's last assistant turn begins: from its last assistant row back over assistant and tool rows. Conversations without one have none."""
    assistant, other = F.col("role") == "assistant", ~F.col("role").isin("assistant", "tool")
    by = turns.groupBy("conv_id").agg(F.max(F.when(assistant, F.col("turn"))).alias("last"), F.collect_set(F.when(assistant, F.col("turn"))).alias("own"), F.collect_set(F.when(other, F.col("turn"))).alias("rest"))
    stop = F.coalesce(F.array_max(F.filter("rest", lambda t: t < F.col("last"))), F.lit(-1))
    return by.select("conv_id", F.array_min(F.filter("own", lambda t: t > stop)).alias("target_turn"))


def with_tools(spark, sf_dir: str) -> DataFrame:
    """Conversations in which every system turn after the first is a tool's."""
    return scan(spark, sf_dir, "conversations").withColumn("role", F.when((F.col("role") == "system") & (F.col("turn") > 0) | (F.col("role") == "user") & (F.col("turn") % 4 == 2) & (F.col("conv_id") % 3 == 0), "tool").otherwise(F.col("role")))


def median_latencies(spark, sf_dir: str) -> DataFrame:
    """Median microseconds from a session's start to its first visible event, by what that event is."""
    seen = F.col("kind").isin("text", "reasoning", "tool_call")
    by = derived(spark, sf_dir, LOG, "events").groupBy("session_id").agg(F.min("ts").alias("start"), F.min(F.when(seen, F.struct("ts", "seq", "kind"))).alias("f")).where("f is not null")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return by.groupBy(F.col("f.kind").alias("first_kind")).agg(F.count("*").alias("n_sessions"), F.median(micros("f.ts") - micros("start")).alias("median_us"))


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lifecycle out of a stream; the session that is open at the end is finished by one row far in the future, which moves the watermark."""
    path = folder(spark)
    last = scan(spark, sf_dir, "events").agg(F.max("ts").cast("timestamp").alias("ts")).first()["ts"]
    if last is None:
        return lifecycle(log(spark, sf_dir))
    derived(spark, sf_dir, LOG, "events").select("session_id", "seq", F.col("ts").cast("timestamp").alias("ts"), "kind").write.parquet(f"{path}/log/part=0")
    spark.range(1).select(F.lit(-1).cast("long").alias("session_id"), F.lit(-1).cast("long").alias("seq"), (F.lit(last) + F.expr("interval 2 days")).cast("timestamp").alias("ts"), F.lit("end").alias("kind")).write.parquet(f"{path}/log/part=1")
    stream = spark.readStream.schema("session_id long, seq long, ts timestamp, kind string").option("maxFilesPerTrigger", 100_000).parquet(f"{path}/log/part=*").withWatermark("ts", "1 hour")
    write = lambda rows, batch: rows.write.mode("append").parquet(f"{path}/rows/batch={batch}")
    query = stream_lifecycle(stream).writeStream.outputMode("append").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.parquet(f"{path}/rows").where("session_id >= 0").select("session_id", "seq", "ord", "type", "id").distinct()


def of_log(f):
    return lambda spark, sf_dir: f(log(spark, sf_dir))


WITH_CALLS = f"SELECT *, CASE WHEN kind IN ('tool_call', 'tool_result', 'tool_error', 'progress') THEN 'call-' || coalesce(last_value(CASE WHEN kind = 'tool_call' THEN seq END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING), -1) END AS call_id FROM ({LOG})"
_TOLD = (
    ("first", "start", "NULL"),
    ("kind IN ('text', 'tool_call') AND said = 'reasoning'", "reasoning-end", "part_no"),
    ("part_starts", "reasoning-start", "part_no"),
    ("kind = 'reasoning'", "reasoning-delta", "part_no"),
    ("text_starts", "text-start", "text_no"),
    ("kind = 'text'", "text-delta", "text_no"),
    ("kind = 'tool_call' AND texts > 0", "text-end", "text_no"),
    ("is_last AND CASE WHEN kind IN ('text', 'reasoning', 'tool_call') THEN kind ELSE said END = 'reasoning'", "reasoning-end", "part_no"),
    ("is_last AND (texts > 0 AND kind <> 'tool_call' OR kind = 'text')", "text-end", "text_no"),
    ("is_last", "finish", "NULL"),
)
LIFECYCLE = (
    """WITH a AS (SELECT session_id, seq, kind, last_value(CASE WHEN kind IN ('text', 'reasoning', 'tool_call') THEN kind END IGNORE NULLS) OVER b AS said, count(*) FILTER (WHERE kind = 'tool_call') OVER b AS run,
  seq = max(seq) OVER (PARTITION BY session_id) AS is_last, seq = min(CASE WHEN kind IN ('text', 'reasoning', 'tool_call') THEN seq END) OVER (PARTITION BY session_id) AS first FROM ("""
    + LOG
    + """) WINDOW b AS (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  t AS (SELECT *, count(*) FILTER (WHERE kind = 'text') OVER (PARTITION BY session_id, run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS texts, kind = 'reasoning' AND coalesce(said <> 'reasoning', true) AS part_starts FROM a),
  u AS (SELECT *, kind = 'text' AND texts = 0 AS text_starts FROM t),
  n AS (SELECT *, 'text-' || (count(*) FILTER (WHERE text_starts) OVER w - 1) AS text_no, 'reasoning-' || (count(*) FILTER (WHERE part_starts) OVER w - 1) AS part_no FROM u WINDOW w AS (PARTITION BY session_id ORDER BY seq)) """
    + " UNION ALL ".join(f"SELECT session_id, seq, {k} AS ord, '{t}' AS type, {i} AS id FROM n WHERE {c}" for k, (c, t, i) in enumerate(_TOLD))
)
_REDACTED = "error"
for _pattern, _put in REDACTIONS:
    _REDACTED = f"regexp_replace({_REDACTED}, '{_pattern.replace(')*+', ')*')}', '{_put}', 'g')"

QUERIES = {
    "v1_lifecycle": of_log(lifecycle), "v1_stream_lifecycle": streamed, "v3_paired_calls": of_log(paired_calls), "v4_run_results": of_log(run_results), "v5_pending_progress": of_log(pending_progress), "v7_redacted_errors": redacted_errors, "v8_records": of_log(records),
    "v9_regenerate_target": lambda s, d: regenerate_target(with_tools(s, d)), "v12_median_latency": median_latencies,
}
ORACLE_SQL = {
    "v1_lifecycle": LIFECYCLE,
    "v1_stream_lifecycle": LIFECYCLE,
    "v3_paired_calls": f"""SELECT coalesce(c.session_id, r.session_id) AS session_id, coalesce(c.call_id, r.call_id) AS call_id, CASE WHEN c.call_id IS NULL THEN 'unknown' WHEN r.call_id IS NULL THEN 'pending' WHEN k = 'tool_result' THEN 'result' ELSE 'error' END AS status, result_seq
      FROM (SELECT session_id, call_id FROM ({WITH_CALLS}) WHERE kind = 'tool_call') c FULL JOIN (SELECT session_id, call_id, arg_min(kind, seq) AS k, min(seq) AS result_seq FROM ({WITH_CALLS}) WHERE kind IN ('tool_result', 'tool_error') GROUP BY 1, 2) r ON c.session_id = r.session_id AND c.call_id = r.call_id""",
    "v4_run_results": f"""SELECT session_id, md5(coalesce(string_agg(delta, '' ORDER BY seq) FILTER (WHERE kind = 'text'), '')) AS text_md5, count(*) FILTER (WHERE kind = 'tool_result') AS n_results, count(*) FILTER (WHERE kind = 'tool_error') AS n_errors, CAST(sum(tokens) AS BIGINT) AS tokens,
      CASE WHEN arg_max(kind, seq) = 'tool_error' THEN 'failed' ELSE 'finished' END AS status FROM ({LOG.replace("CAST(value AS BIGINT)", "CAST(trunc(value) AS BIGINT)")}) GROUP BY 1""",
    "v5_pending_progress": f"""SELECT session_id, seq, call_id FROM (SELECT *, count(*) FILTER (WHERE kind = 'tool_call') OVER w AS begun, count(*) FILTER (WHERE kind IN ('tool_result', 'tool_error')) OVER w AS ended FROM ({WITH_CALLS}) WHERE call_id IS NOT NULL
      WINDOW w AS (PARTITION BY session_id, call_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE kind = 'progress' AND begun > 0 AND ended = 0""",
    "v7_redacted_errors": f"SELECT event_id, regexp_replace({_REDACTED}, '^\\s+|\\s+$', '', 'g') AS clean FROM ({ERRORS.replace(chr(92) * 2, chr(92))})",
    "v8_records": f"""SELECT session_id, seq, CAST(CASE kind WHEN 'text' THEN json_object('type', 'text-delta', 'delta', delta) WHEN 'reasoning' THEN json_object('type', 'reasoning-delta', 'delta', delta) WHEN 'tool_call' THEN json_object('type', 'tool-input-available', 'toolCallId', call_id, 'input', delta)
      WHEN 'tool_result' THEN json_object('type', 'tool-output-available', 'toolCallId', call_id, 'output', delta) WHEN 'tool_error' THEN json_object('type', 'tool-output-error', 'toolCallId', call_id, 'errorText', delta) ELSE json_object('type', 'data-tool-progress', 'id', call_id, 'data', delta, 'transient', true) END AS VARCHAR) AS record FROM ({WITH_CALLS})""",
    "v9_regenerate_target": """WITH c AS (SELECT conv_id, turn, CASE WHEN role = 'system' AND turn > 0 OR role = 'user' AND turn % 4 = 2 AND conv_id % 3 = 0 THEN 'tool' ELSE role END AS role FROM conversations), l AS (SELECT conv_id, max(turn) FILTER (WHERE role = 'assistant') AS last FROM c GROUP BY 1),
      s AS (SELECT c.conv_id, coalesce(max(turn) FILTER (WHERE role NOT IN ('assistant', 'tool') AND turn < last), -1) AS stop FROM c JOIN l USING (conv_id) GROUP BY 1) SELECT c.conv_id, min(turn) FILTER (WHERE role = 'assistant' AND turn > stop) AS target_turn FROM c JOIN s USING (conv_id) GROUP BY 1""",
    "v12_median_latency": f"""SELECT k AS first_kind, count(*) AS n_sessions, median(us) AS median_us FROM (SELECT session_id, arg_min(kind, ts) FILTER (WHERE kind IN ('text', 'reasoning', 'tool_call')) AS k, epoch_us(min(ts) FILTER (WHERE kind IN ('text', 'reasoning', 'tool_call'))) - epoch_us(min(ts)) AS us FROM ({LOG}) GROUP BY 1) WHERE k IS NOT NULL GROUP BY 1""",
}
