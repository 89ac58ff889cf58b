"""Agent runs from their raw chunks: what a client is told, all thirteen kinds of it, by windows over a table and by state and timers over a stream; calls met with
their outcomes in an interval; and the wire records.

A raw log has a row for each block of a chunk (session_id, seq, ts, chunk, kind, llm_id, call_id, name, delta, tokens_in, tokens_out). Kinds: text, reasoning and
tool_start come from a model's messages, usage is a message without a block; call, result and error are a tool's updates, progress is its note; failure is an
error of the run, end its natural end. The queries read such a log derived from ``events``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources import derived, scan
from .sessions import folder

#: A session that is silent for so long has ended its run, and what follows is another one; and how long a call waits for its outcome.
IDLE_MS, WAIT = 24 * 3600 * 1000, "interval 12 hours"
#: How far events may come out of order by time.
LATENESS = "1 hour"
MESSAGE = ("text", "reasoning", "tool_start", "usage")
RAW = "session_id long, seq long, ts timestamp, chunk long, kind string, llm_id string, call_id string, name string, delta string, tokens_in long, tokens_out long"
TOLD = "session_id long, seq long, ord int, type string, id string, name string, text string, tokens_in long, tokens_out long"
#: The kinds of what a client is told.
TYPES = ("start", "text-start", "text-delta", "text-end", "tool-call", "tool-result", "tool-error", "tool-progress", "reasoning-start", "reasoning-delta", "reasoning-end", "error", "finish")


def runs(events: DataFrame) -> DataFrame:
    """``events`` with ``run``, the session's runs by silence, and without what follows a run's end or failure: a run is finished once."""
    w = Window.partitionBy("session_id").orderBy("seq")
    ms = lambda c: F.unix_millis(c)
    quiet = F.coalesce(ms(F.col("ts")) - ms(F.lag("ts").over(w)) > IDLE_MS, F.lit(False))
    rows = events.withColumn("run", F.count_if(quiet).over(w))
    before = Window.partitionBy("session_id", "run").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("over", F.coalesce(F.count_if(F.col("kind").isin("end", "failure")).over(before), F.lit(0))).where("over = 0").drop("over")


def told(events: DataFrame) -> DataFrame:
    """What a client is told of a table of ``events``, in order of (session_id, seq, ord); tokens and the reason are the finish's.

    The first message starts. Another model call (a new llm_id that isn't null), text and a tool's start close the open reasoning part; so does reasoning that
    follows reasoning in its chunk. A tool's start closes the open text. Empty deltas are not told, and an empty text opens nothing. Progress
    counts while its call is pending: started under a name and without an outcome yet. Last, what is open is closed, a failure is told, and
    the run finishes with the sums of its tokens. All is told by windows over a run; the stream's processor below tells the same.
    """
    of_run = Window.partitionBy("session_id", "run")
    w = of_run.orderBy("seq")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    kind, some = F.col("kind"), F.coalesce(F.col("delta") != "", F.lit(False))
    message = kind.isin(*MESSAGE)
    no = F.lit(False)
    rows = runs(events).withColumns({"model": F.last(F.when(message, F.col("llm_id")), ignorenulls=True).over(before), "first": message & (F.coalesce(F.count_if(message).over(before), F.lit(0)) == 0), "last": F.col("seq") == F.max("seq").over(of_run)})
    rows = rows.withColumn("other", message & F.col("llm_id").isNotNull() & ~F.col("llm_id").eqNullSafe(F.col("model")))
    # what a row leaves behind: a part that is open or closed, or nothing new
    part = F.when(kind == "reasoning", True).when(kind.isin("text", "tool_start") | ((kind == "usage") & F.col("other")), False)
    text = F.when((kind == "text") & some, True).when(kind == "tool_start", False)
    pending = F.when((kind == "tool_start") & F.col("name").isNotNull() & F.col("call_id").isNotNull(), True).when(kind.isin("result", "error"), False)
    of_call = Window.partitionBy("session_id", "run", "call_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    again = (kind == "reasoning") & F.coalesce((F.lag("kind").over(w) == "reasoning") & (F.lag("chunk").over(w) == F.col("chunk")), no)
    rows = rows.withColumns({"part_open": F.coalesce(F.last(part, ignorenulls=True).over(before), no), "text_open": F.coalesce(F.last(text, ignorenulls=True).over(before), no), "pending": F.coalesce(F.last(pending, ignorenulls=True).over(of_call), no), "again": again})
    closes = F.col("part_open") & (F.col("other") | kind.isin("text", "tool_start") | F.col("again"))
    rows = rows.withColumns({"closes": closes, "part_starts": (kind == "reasoning") & (~F.col("part_open") | closes), "text_starts": (kind == "text") & some & ~F.col("text_open")})
    left = {"part_left": F.coalesce(part, F.col("part_open") & ~F.col("closes")), "text_left": F.coalesce(text, F.col("text_open")), "tin": F.sum(F.when(message, F.col("tokens_in"))).over(of_run), "tout": F.sum(F.when(message, F.col("tokens_out"))).over(of_run)}
    rows = rows.withColumns(left | {"parts": F.count_if("part_starts").over(w), "texts": F.count_if("text_starts").over(w)})
    part_was, part_is = (F.concat(F.lit("reasoning-"), F.col("parts") - n) for n in (1 + F.col("part_starts").cast("int"), 1))
    text_is = F.concat(F.lit("text-"), F.col("texts") - 1)
    null = F.lit(None).cast("string")
    call, failed = F.col("call_id"), kind == "failure"
    list_ = [
        (F.col("closes"), "reasoning-end", part_was, null, null),
        (F.col("first"), "start", F.col("llm_id"), null, null),
        (F.col("part_starts"), "reasoning-start", part_is, null, null),
        ((kind == "reasoning") & some, "reasoning-delta", part_is, null, F.col("delta")),
        (F.col("text_starts"), "text-start", text_is, null, null),
        ((kind == "text") & some, "text-delta", text_is, null, F.col("delta")),
        ((kind == "tool_start") & F.col("text_open"), "text-end", text_is, null, null),
        (kind == "call", "tool-call", call, F.col("name"), F.col("delta")),
        (kind == "result", "tool-result", call, null, F.col("delta")),
        (kind == "error", "tool-error", call, null, F.col("delta")),
        ((kind == "progress") & F.col("pending"), "tool-progress", call, null, F.col("delta")),
        (F.col("last") & F.col("part_left"), "reasoning-end", part_is, null, null),
        (F.col("last") & F.col("text_left"), "text-end", text_is, null, null),
        (failed, "error", null, null, F.coalesce("delta", F.lit(""))),
        (F.col("last"), "finish", null, null, F.when(failed, "error").otherwise("stop")),
    ]
    one = [F.struct(F.lit(k).alias("ord"), F.lit(t).alias("type"), i.alias("id"), n.alias("name"), x.alias("text"), c.alias("told")) for k, (c, t, i, n, x) in enumerate(list_)]
    out = rows.select("session_id", "seq", "tin", "tout", F.inline(F.filter(F.array(*one), lambda x: x["told"]))).drop("told")
    sums = lambda c: F.when(F.col("type") == "finish", F.coalesce(c, F.lit(0)))
    return out.select("session_id", "seq", "ord", "type", "id", "name", "text", sums("tin").alias("tokens_in"), sums("tout").alias("tokens_out"))


STATE = "started boolean, model string, texts int, parts int, text_open boolean, part_open boolean, chunk long, before string, seen long, at long, tokens_in long, tokens_out long, over boolean"
FRESH = (False, None, 0, 0, False, False, None, None, -1, None, 0, 0, False)
FIELDS = [x.split()[0] for x in STATE.split(", ")]


class Mapper(StatefulProcessor):
    """``told`` for a stream. A session's state is what is open and how far its numbers are, and a map of its pending calls; one timer a session ends a silent run.

    Rows of a session are taken in order of seq within a batch, and batches in order of time.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", STATE)
        self.pending = handle.getMapState("pending", "call_id string", "name string")

    def finish(self, s: dict, out: list, seq: int, failed: str | None = None) -> None:
        if s["part_open"]:
            out.append((seq, 11, "reasoning-end", f"reasoning-{s['parts'] - 1}", None, None, 0, 0))
        if s["text_open"]:
            out.append((seq, 12, "text-end", f"text-{s['texts'] - 1}", None, None, 0, 0))
        if failed is not None:
            out.append((seq, 13, "error", None, None, failed, 0, 0))
        out.append((seq, 14, "finish", None, None, "stop" if failed is None else "error", s["tokens_in"], s["tokens_out"]))
        s.update(over=True, part_open=False, text_open=False)

    def take(self, s: dict, r: dict, out: list) -> None:
        seq, kind, delta, call = r["seq"], r["kind"], r["delta"], r["call_id"]
        tell = lambda ord_, type_, id_=None, name=None, text=None: out.append((seq, ord_, type_, id_, name, text, 0, 0))
        part = lambda: f"reasoning-{s['parts'] - 1}"
        if kind in MESSAGE:
            other = r["llm_id"] is not None and r["llm_id"] != s["model"]
            again = kind == "reasoning" and s["before"] == "reasoning" and s["chunk"] is not None and s["chunk"] == r["chunk"]
            if s["part_open"] and (other or again or kind in ("text", "tool_start")):
                tell(0, "reasoning-end", part())
                s["part_open"] = False
            if other:
                s["model"] = r["llm_id"]
            if not s["started"]:
                tell(1, "start", r["llm_id"])
                s["started"] = True
            if kind == "reasoning":
                if not s["part_open"]:
                    s.update(parts=s["parts"] + 1, part_open=True)
                    tell(2, "reasoning-start", part())
                if delta:
                    tell(3, "reasoning-delta", part(), text=delta)
            elif kind == "text" and delta:
                if not s["text_open"]:
                    s.update(texts=s["texts"] + 1, text_open=True)
                    tell(4, "text-start", f"text-{s['texts'] - 1}")
                tell(5, "text-delta", f"text-{s['texts'] - 1}", text=delta)
            elif kind == "tool_start":
                if s["text_open"]:
                    tell(6, "text-end", f"text-{s['texts'] - 1}")
                    s["text_open"] = False
                if call is not None and r["name"] is not None:
                    self.calls[call] = r["name"]
            s.update(tokens_in=s["tokens_in"] + int(r["tokens_in"] or 0), tokens_out=s["tokens_out"] + int(r["tokens_out"] or 0))
        elif kind == "call":
            tell(7, "tool-call", call, r["name"], delta)
        elif kind in ("result", "error"):
            tell(8 + (kind == "error"), f"tool-{kind}", call, text=delta)
            self.calls.pop(call, None)
        elif kind == "progress" and call in self.calls:
            tell(10, "tool-progress", call, text=delta)
        elif kind in ("end", "failure"):
            self.finish(s, out, seq, (delta or "") if kind == "failure" else None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        s = dict(zip(FIELDS, self.open.get() if self.open.exists() else FRESH, strict=True))
        frame = pd.concat(rows).sort_values("seq", kind="stable")
        frame["ms"] = frame["ts"].astype("datetime64[ms]").astype("int64")
        out, timer = [], s["at"]
        # the map is read once and its changes are written once, since each access is a message to the JVM
        before = {k[0]: v[0] for k, v in self.pending.iterator()} if timer is not None else {}
        self.calls = dict(before)
        columns = {c: [None if pd.isna(x) else x for x in frame[c].tolist()] for c in ("seq", "ms", "chunk", "kind", "llm_id", "call_id", "name", "delta", "tokens_in", "tokens_out")}
        for values in zip(*columns.values(), strict=True):
            r = dict(zip(columns, values, strict=True))
            if s["at"] is not None and r["ms"] - s["at"] > IDLE_MS:
                if not s["over"]:
                    self.finish(s, out, s["seen"])
                self.calls = {}
                s = dict(zip(FIELDS, FRESH, strict=True))
            if not s["over"]:
                self.take(s, r, out)
                s["seen"] = r["seq"]
            s.update(at=r["ms"], chunk=None if r["chunk"] is None else int(r["chunk"]), before=r["kind"])
        for call in before.keys() - self.calls.keys():
            self.pending.removeKey((call,))
        for call in self.calls.keys() - before.keys():
            self.pending.updateValue((call,), (self.calls[call],))
        if timer is not None:
            self.handle.deleteTimer(timer + IDLE_MS + 1)
        self.handle.registerTimer(s["at"] + IDLE_MS + 1)
        self.open.update(tuple(s[f] for f in FIELDS))
        yield self.frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.open.exists():
            s = dict(zip(FIELDS, self.open.get(), strict=True))
            if not s["over"]:
                self.finish(s, out, s["seen"])
        self.open.clear()
        self.pending.clear()
        yield self.frame(key, out)

    def frame(self, key, out: list) -> pd.DataFrame:
        made = pd.DataFrame([(key[0], *x) for x in out], columns=[c.split()[0] for c in TOLD.split(", ")])
        return made.astype({"session_id": "int64", "seq": "int64", "ord": "int32", "tokens_in": "int64", "tokens_out": "int64"})

    def close(self) -> None:
        pass


def stream_told(events: DataFrame) -> DataFrame:
    """``told`` of a stream of raw rows; sessions' state is kept by the RocksDB provider, which ``with_state_store`` names."""
    out = events.withWatermark("ts", LATENESS).groupBy("session_id").transformWithStateInPandas(Mapper(), TOLD, "append", "EventTime")
    return out.withColumns({c: F.when(F.col("type") == "finish", F.col(c)) for c in ("tokens_in", "tokens_out")})


def with_state_store(spark: SparkSession) -> Callable[[], None]:
    """Set the state store that several state variables need; the result puts the setting back."""
    name, value = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    return lambda: spark.conf.set(name, before) if before else spark.conf.unset(name)


def sink(path: str) -> Callable[[DataFrame, int], None]:
    """Writes each batch to a folder of its own by overwriting, so a batch that is replayed after a failure leaves its rows once."""
    return lambda rows, batch: rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def run_to_end(out: DataFrame, path: str) -> None:
    """Run a stream over all there is now, from its checkpoint on, into ``sink``."""
    put_back = with_state_store(out.sparkSession)
    try:
        out.writeStream.outputMode("append").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(sink(f"{path}/rows")).start().awaitTermination()
    finally:
        put_back()


def outcomes(calls: DataFrame, ends: DataFrame) -> DataFrame:
    """(session_id, call_id, call_seq, end_seq, status) of tables or of streams with watermarks: every outcome of a call in the time it waits is a ``result`` or an ``error``, a call without one
    is ``pending``, and an outcome without a call, or too late, is ``unexpected``, an error of the log. Of a stream, a row without a partner comes once no partner can come."""
    c = calls.select(F.col("session_id").alias("c_session"), F.col("call_id").alias("c_call"), F.col("seq").alias("call_seq"), F.col("ts").alias("call_ts"))
    e = ends.select(F.col("session_id").alias("e_session"), F.col("call_id").alias("e_call"), F.col("seq").alias("end_seq"), F.col("ts").alias("end_ts"), "kind")
    both = c.join(e, F.expr(f"c_session = e_session and c_call = e_call and end_ts >= call_ts and end_ts <= call_ts + {WAIT}"), "full_outer")
    status = F.when(F.col("call_seq").isNull(), "unexpected").when(F.col("end_seq").isNull(), "pending").otherwise(F.col("kind"))
    return both.select(F.coalesce("c_session", "e_session").alias("session_id"), F.coalesce("c_call", "e_call").alias("call_id"), "call_seq", "end_seq", status.alias("status"))


def ended(events: DataFrame) -> DataFrame:
    return events.where("kind in ('result', 'error')")


def started(events: DataFrame) -> DataFrame:
    return events.where("kind = 'tool_start' and call_id is not null")


def records(out: DataFrame) -> DataFrame:
    """(session_id, seq, ord, record): the line that goes over the wire for each of ``told``, ``data: `` and its JSON; a tool's input, output and note are JSON themselves where they can be read as such."""
    kind = F.col("type")
    text = lambda c: F.coalesce(F.to_json(F.struct(c.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("x")))) - 6), F.lit("null"))
    quoted = lambda c: F.when(c.isNull(), "null").otherwise(text(c))
    value = F.coalesce(F.to_json(F.try_parse_json("text")), quoted(F.col("text")))
    as_ = lambda name, *pairs: F.concat(F.lit('{"type":"' + name + '"'), *(y for key, x in pairs for y in (F.lit(f',"{key}":'), x)), F.lit("}"))
    id_, said = quoted(F.col("id")), quoted(F.col("text"))
    shapes = {
        "start": as_("start", ("messageId", id_), ("messageMetadata", F.concat(F.lit('{"sessionId":"'), F.col("session_id"), F.lit('"}')))),
        "text-start": as_("text-start", ("id", id_)),
        "text-delta": as_("text-delta", ("id", id_), ("delta", said)),
        "text-end": as_("text-end", ("id", id_)),
        "tool-call": as_("tool-input-available", ("toolCallId", id_), ("toolName", quoted(F.col("name"))), ("input", value)),
        "tool-result": as_("tool-output-available", ("toolCallId", id_), ("output", value)),
        "tool-error": as_("tool-output-error", ("toolCallId", id_), ("errorText", said)),
        "tool-progress": as_("data-tool-progress", ("id", id_), ("data", value), ("transient", F.lit("true"))),
        "reasoning-start": as_("reasoning-start", ("id", id_)),
        "reasoning-delta": as_("reasoning-delta", ("id", id_), ("delta", said)),
        "reasoning-end": as_("reasoning-end", ("id", id_)),
        "error": as_("error", ("errorText", said)),
        "finish": as_("finish", ("finishReason", said), ("messageMetadata", F.concat(F.lit('{"usage":{"totalTokens":'), F.col("tokens_in") + F.col("tokens_out"), F.lit("}}")))),
    }
    record = F.lit(None).cast("string")
    for name in reversed(TYPES):
        record = F.when(kind == name, shapes[name]).otherwise(record)
    return out.select("session_id", "seq", "ord", F.concat(F.lit("data: "), record).alias("record"))


def usage(out: DataFrame) -> DataFrame:
    """(session_id, turn, tokens_in, tokens_out): the tokens of each finished run, numbered from 1."""
    turn = F.row_number().over(Window.partitionBy("session_id").orderBy("seq"))
    return out.where("type = 'finish'").select("session_id", turn.alias("turn"), "tokens_in", "tokens_out")


def results(events: DataFrame, out: DataFrame) -> DataFrame:
    """(session_id, seq, status, error) of each run by its finish: it failed if that says error and there is an error, which is the last one told; a run that ends otherwise is finished."""
    w = Window.partitionBy("session_id").orderBy("seq", "ord")
    run = F.coalesce(F.count_if(F.col("type") == "finish").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = out.withColumn("run", run).groupBy("session_id", "run").agg(F.max(F.when(F.col("type") == "finish", F.struct("seq", "text"))).alias("f"), F.max_by("text", F.when(F.col("type").isin("tool-error", "error"), F.struct("seq", "ord"))).alias("error"))
    failed = (F.col("f.text") == "error") & F.col("error").isNotNull()
    return rows.where("f is not null").select("session_id", F.col("f.seq").alias("seq"), F.when(failed, "failed").otherwise("finished").alias("status"), F.when(failed, F.col("error")).alias("error"))


def health(out: DataFrame) -> DataFrame:
    """(session_id, seq, n_calls, n_errors, failing, finished, healthy) of each run by its finish: the calls told, their errors and the names of the tools that failed (by the last call of that id before, else unknown), sorted and each once; healthy: it
    finished, and no tool failed."""
    w = Window.partitionBy("session_id").orderBy("seq", "ord")
    run = F.coalesce(F.count_if(F.col("type") == "finish").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = out.withColumn("run", run)
    of_call = Window.partitionBy("session_id", "run", "id").orderBy("seq", "ord")
    rows = rows.withColumn("tool", F.last(F.when(F.col("type") == "tool-call", F.col("name")), ignorenulls=True).over(of_call))
    failed = F.col("type") == "tool-error"
    by = rows.groupBy("session_id", "run").agg(
        F.max(F.when(F.col("type") == "finish", F.struct("seq", "text"))).alias("f"), F.count_if(F.col("type") == "tool-call").alias("n_calls"), F.count_if(failed).alias("n_errors"), F.array_sort(F.collect_set(F.when(failed, F.coalesce("tool", F.lit("unknown"))))).alias("failing")
    )
    finished = F.col("f.text") != "error"
    return by.where("f is not null").select("session_id", F.col("f.seq").alias("seq"), "n_calls", "n_errors", F.array_join("failing", ",").alias("failing"), finished.alias("finished"), (finished & (F.col("n_errors") == 0)).alias("healthy"))


LOG = """SELECT session_id, seq, ts, chunk, kind, CASE WHEN kind IN ('text', 'reasoning', 'tool_start', 'usage') AND seq % 6 <> 0 THEN concat('m', CAST(floor(seq / 400) AS BIGINT)) END AS llm_id,
  CASE WHEN kind IN ('tool_start', 'call', 'result', 'error', 'progress') THEN concat('call-', coalesce(last_value(CASE WHEN kind = 'tool_start' THEN seq END) IGNORE NULLS OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1)) END AS call_id,
  CASE WHEN kind = 'tool_start' AND seq % 13 <> 0 OR kind = 'call' THEN concat('tool_', seq % 5) END AS name, CASE WHEN seq % 9 = 0 THEN '' ELSE delta END AS delta, CASE WHEN kind IN ('text', 'usage') THEN seq % 700 END AS tokens_in, CASE WHEN kind IN ('text', 'usage') THEN seq % 50 END AS tokens_out
  FROM (SELECT user_id AS session_id, event_id AS seq, ts, CAST(floor(event_id / 300) AS BIGINT) AS chunk, props AS delta, CASE WHEN event_type = 'view' THEN CASE WHEN event_id % 4 = 0 THEN 'progress' WHEN event_id % 4 = 1 THEN 'usage' ELSE 'text' END
    WHEN event_type = 'signup' THEN 'reasoning' WHEN event_type = 'click' THEN CASE WHEN event_id % 3 = 0 THEN 'call' ELSE 'tool_start' END WHEN event_type = 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN 'progress' ELSE 'result' END
    ELSE CASE WHEN event_id % 8 = 0 THEN 'failure' WHEN event_id % 8 = 1 THEN 'end' ELSE 'error' END END AS kind FROM events)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, LOG, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def streamed(spark: SparkSession, sf_dir: str, f: Callable[[DataFrame], DataFrame], slices: int = 2) -> DataFrame:
    """``f`` of the raw log as a stream that is stopped after each slice of the log's time and goes on from its checkpoint when the next has come; last come a call and its
    result far in the future, which move the watermarks past all."""
    path, raw = folder(spark), log(spark, sf_dir).select(*(c.split()[0] for c in RAW.split(", ")))
    first, last = raw.agg(F.min("ts"), F.max("ts")).first()
    out = f(spark.readStream.schema(RAW).option("maxFilesPerTrigger", 100_000).parquet(f"{path}/log/part=*"))
    if first is None:
        return spark.createDataFrame([], out.schema)
    far = spark.createDataFrame([(-1, -2, "tool_start", "far"), (-1, -1, "result", "far")], "session_id long, seq long, kind string, call_id string").withColumn("ts", (F.lit(last) + F.expr("interval 30 days")).cast("timestamp"))
    part = F.least(F.floor((F.unix_micros("ts") - F.unix_micros(F.lit(first))) * slices / (F.unix_micros(F.lit(last)) - F.unix_micros(F.lit(first)) + 1)), F.lit(slices - 1))
    for k in range(slices + 1):
        (raw.where(part == k) if k < slices else far).write.parquet(f"{path}/log/part={k}")
        run_to_end(out, path)
    return spark.read.schema(out.schema).parquet(f"{path}/rows/batch=*").where("session_id >= 0")


def stream_outcomes(events: DataFrame) -> DataFrame:
    events = events.withWatermark("ts", LATENESS)
    return outcomes(started(events), ended(events))


QUERIES = {
    "v1_told": lambda s, d: told(log(s, d)),
    "v1_stream_told": lambda s, d: streamed(s, d, stream_told),
    "v2_run_usage": lambda s, d: usage(told(log(s, d))),
    "v3_outcomes": lambda s, d: outcomes(started(log(s, d)), ended(log(s, d))),
    "v3_stream_outcomes": lambda s, d: streamed(s, d, stream_outcomes),
    "v4_run_status": lambda s, d: results(log(s, d), told(log(s, d))),
    "e12_run_health": lambda s, d: health(told(log(s, d))),
    "v5_stream_progress": lambda s, d: streamed(s, d, lambda e: stream_told(e).where("type = 'tool-progress'")).select("session_id", "seq", "id"),
    "v8_wire_records": lambda s, d: records(told(log(s, d))),
    "v8_stream_records": lambda s, d: streamed(s, d, lambda e: records(stream_told(e))),
}

_MESSAGE = "kind IN ('text', 'reasoning', 'tool_start', 'usage')"
_FLOW = f"""WITH raw AS (SELECT * FROM ({LOG.replace("IGNORE NULLS OVER", "OVER").replace("THEN seq END) OVER", "THEN seq END IGNORE NULLS) OVER")})),
g AS (SELECT *, coalesce(epoch_ms(ts) - epoch_ms(lag(ts) OVER w) > {IDLE_MS}, false) AS quiet FROM raw WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
h AS (SELECT *, count(*) FILTER (WHERE quiet) OVER (PARTITION BY session_id ORDER BY seq) AS run FROM g),
i AS (SELECT * FROM h QUALIFY count(*) FILTER (WHERE kind IN ('end', 'failure')) OVER (PARTITION BY session_id, run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 0),
j AS (SELECT *, delta <> '' AS filled, {_MESSAGE} AND llm_id IS NOT NULL AND llm_id IS DISTINCT FROM last_value(CASE WHEN {_MESSAGE} THEN llm_id END IGNORE NULLS) OVER b AS other, {_MESSAGE} AND count(*) FILTER (WHERE {_MESSAGE}) OVER b = 0 AS first, lead(seq) OVER w IS NULL AS is_last,
  kind = 'reasoning' AND coalesce(lag(kind) OVER w = 'reasoning' AND lag(chunk) OVER w = chunk, false) AS again FROM i WINDOW w AS (PARTITION BY session_id, run ORDER BY seq), b AS (PARTITION BY session_id, run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, CASE WHEN kind = 'reasoning' THEN 1 WHEN kind IN ('text', 'tool_start') OR kind = 'usage' AND other THEN 0 END AS part, CASE WHEN kind = 'text' AND filled THEN 1 WHEN kind = 'tool_start' THEN 0 END AS txt,
  CASE WHEN kind = 'tool_start' AND name IS NOT NULL AND call_id IS NOT NULL THEN 1 WHEN kind IN ('result', 'error') THEN 0 END AS pend FROM j),
l AS (SELECT *, coalesce(last_value(part IGNORE NULLS) OVER b, 0) = 1 AS part_open, coalesce(last_value(txt IGNORE NULLS) OVER b, 0) = 1 AS text_open,
  coalesce(last_value(pend IGNORE NULLS) OVER (PARTITION BY session_id, run, call_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS pending FROM k WINDOW b AS (PARTITION BY session_id, run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, part_open AND (other OR kind IN ('text', 'tool_start') OR again) AS closes, kind = 'text' AND filled AND NOT text_open AS text_starts FROM l),
n AS (SELECT *, kind = 'reasoning' AND (closes OR NOT part_open) AS part_starts FROM m),
o AS (SELECT *, count(*) FILTER (WHERE part_starts) OVER w - 1 AS parts, count(*) FILTER (WHERE text_starts) OVER w - 1 AS texts, CASE WHEN part IS NULL THEN part_open AND NOT closes ELSE part = 1 END AS part_left, CASE WHEN txt IS NULL THEN text_open ELSE txt = 1 END AS text_left,
  CAST(coalesce(sum(CASE WHEN {_MESSAGE} THEN tokens_in END) OVER r, 0) AS BIGINT) AS tin, CAST(coalesce(sum(CASE WHEN {_MESSAGE} THEN tokens_out END) OVER r, 0) AS BIGINT) AS tout FROM n WINDOW w AS (PARTITION BY session_id, run ORDER BY seq), r AS (PARTITION BY session_id, run)),
told AS ({{told}})
"""
_EACH = (
    ("closes", "reasoning-end", "'reasoning-' || (parts - CAST(part_starts AS INTEGER))", "NULL", "NULL"),
    ("first", "start", "llm_id", "NULL", "NULL"),
    ("part_starts", "reasoning-start", "'reasoning-' || parts", "NULL", "NULL"),
    ("kind = 'reasoning' AND filled", "reasoning-delta", "'reasoning-' || parts", "NULL", "delta"),
    ("text_starts", "text-start", "'text-' || texts", "NULL", "NULL"),
    ("kind = 'text' AND filled", "text-delta", "'text-' || texts", "NULL", "delta"),
    ("kind = 'tool_start' AND text_open", "text-end", "'text-' || texts", "NULL", "NULL"),
    ("kind = 'call'", "tool-call", "call_id", "name", "delta"),
    ("kind = 'result'", "tool-result", "call_id", "NULL", "delta"),
    ("kind = 'error'", "tool-error", "call_id", "NULL", "delta"),
    ("kind = 'progress' AND pending", "tool-progress", "call_id", "NULL", "delta"),
    ("is_last AND part_left", "reasoning-end", "'reasoning-' || parts", "NULL", "NULL"),
    ("is_last AND text_left", "text-end", "'text-' || texts", "NULL", "NULL"),
    ("kind = 'failure'", "error", "NULL", "NULL", "delta"),
    ("is_last", "finish", "NULL", "NULL", "CASE WHEN kind = 'failure' THEN 'error' ELSE 'stop' END"),
)
_FLOW = _FLOW.replace("{told}", " UNION ALL ".join(f"SELECT session_id, seq, CAST({k} AS INTEGER) AS ord, '{t}' AS type, {i} AS id, {n} AS name, {x} AS text, {'tin' if t == 'finish' else 'NULL'} AS tokens_in, {'tout' if t == 'finish' else 'NULL'} AS tokens_out FROM o WHERE {c}" for k, (c, t, i, n, x) in enumerate(_EACH)))
_TOLD = _FLOW + "SELECT * FROM told"
_JSON = "CASE WHEN json_valid(text) THEN CAST(text AS JSON) ELSE to_json(text) END"
_RECORDS = _FLOW + f"""SELECT session_id, seq, ord, 'data: ' || CAST(CASE type WHEN 'start' THEN json_object('type', 'start', 'messageId', id, 'messageMetadata', json_object('sessionId', CAST(session_id AS VARCHAR))) WHEN 'text-delta' THEN json_object('type', type, 'id', id, 'delta', text) WHEN 'reasoning-delta' THEN json_object('type', type, 'id', id, 'delta', text)
  WHEN 'tool-call' THEN json_object('type', 'tool-input-available', 'toolCallId', id, 'toolName', name, 'input', {_JSON}) WHEN 'tool-result' THEN json_object('type', 'tool-output-available', 'toolCallId', id, 'output', {_JSON}) WHEN 'tool-error' THEN json_object('type', 'tool-output-error', 'toolCallId', id, 'errorText', text)
  WHEN 'tool-progress' THEN json_object('type', 'data-tool-progress', 'id', id, 'data', {_JSON}, 'transient', true) WHEN 'error' THEN json_object('type', 'error', 'errorText', text) WHEN 'finish' THEN json_object('type', 'finish', 'finishReason', text, 'messageMetadata', json_object('usage', json_object('totalTokens', tokens_in + tokens_out)))
  ELSE json_object('type', type, 'id', id) END AS VARCHAR) AS record FROM told"""
_OUTCOMES = _FLOW + """SELECT coalesce(c.session_id, e.session_id) AS session_id, coalesce(c.call_id, e.call_id) AS call_id, c.seq AS call_seq, e.seq AS end_seq, CASE WHEN c.seq IS NULL THEN 'unexpected' WHEN e.seq IS NULL THEN 'pending' ELSE e.kind END AS status
  FROM (SELECT * FROM raw WHERE kind = 'tool_start' AND call_id IS NOT NULL) c FULL JOIN (SELECT * FROM raw WHERE kind IN ('result', 'error')) e ON c.session_id = e.session_id AND c.call_id = e.call_id AND e.ts >= c.ts AND e.ts <= c.ts + INTERVAL 12 HOUR"""
ORACLE_SQL = {
    "v1_told": _TOLD,
    "v1_stream_told": _TOLD,
    "v2_run_usage": _FLOW + "SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY seq) AS INTEGER) AS turn, tokens_in, tokens_out FROM told WHERE type = 'finish'",
    "v3_outcomes": _OUTCOMES,
    "v3_stream_outcomes": _OUTCOMES,
    "v4_run_status": _FLOW + """SELECT session_id, seq, CASE WHEN failed THEN 'failed' ELSE 'finished' END AS status, CASE WHEN failed THEN error END AS error FROM (SELECT o.session_id, max(o.seq) AS seq, max(CASE WHEN o.kind = 'failure' THEN 1 ELSE 0 END) = 1 AS failed,
      arg_max(o.delta, o.seq) FILTER (WHERE o.kind IN ('error', 'failure')) AS error FROM o GROUP BY o.session_id, o.run)""",
    "e12_run_health": _FLOW + """SELECT session_id, max(seq) AS seq, count(*) FILTER (WHERE kind = 'call') AS n_calls, count(*) FILTER (WHERE kind = 'error') AS n_errors, coalesce(string_agg(DISTINCT tool, ',' ORDER BY tool) FILTER (WHERE kind = 'error'), '') AS failing, NOT bool_or(kind = 'failure') AS finished,
      NOT bool_or(kind IN ('failure', 'error')) AS healthy FROM (SELECT *, coalesce(last_value(CASE WHEN kind = 'call' THEN name END IGNORE NULLS) OVER (PARTITION BY session_id, run, call_id ORDER BY seq), 'unknown') AS tool FROM o) GROUP BY session_id, run""",
    "v5_stream_progress": _FLOW + "SELECT session_id, seq, id FROM told WHERE type = 'tool-progress'",
    "v8_wire_records": _RECORDS,
    "v8_stream_records": _RECORDS,
}
