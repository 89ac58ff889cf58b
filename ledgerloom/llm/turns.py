"""Conversation structure repair: turns are aligned with each feasible length of the alternating grammar string ``(s?(ua)+)?`` by Wagner-Fischer tables in Ukkonen bands."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import table

#: Places of the sorted rows that one segment spans: what one task aligns at a time.
SEGMENT = 1024
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
NONE = 1 << 40
#: Where the grammar stands: before anything, after s, after u, after a. The role it wants next, and where a conversation may end.
WANTS, AFTER = "uuau", {"s": 1, "u": 2, "a": 3}
END = [0, NONE, NONE, 0]
ROLE = {"u": "user", "a": "assistant"}


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with the faults of the known experiment: crc32 of "conv_id:turn" modulo 20 drops a row (0), empties its text (1), takes out
    its ``.!?`` (2), repeats it (3) or makes it the user's (4). Null roles and texts, and null numbers in the hashed text, are one blank."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn"))) % 20
    rows = conversations.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def ordered(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number of copies n and a place ``at`` that follows (conv_id, turn, role, text), nulls first, as a written table; also
    the role's initial (``?`` if not s, u or a), whether the text is blank, whether its last character that isn't white space is no ``.!?``, and a key of role and text."""
    blank = F.rtrim(F.col("text"), F.lit(" \t\n\v\f\r"))
    initial = F.substring("role", 1, 1)
    one = rows.groupBy("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")).agg(F.count("*").alias("n"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    placed = one.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("end", blank)
    return table(
        placed.select(
            F.monotonically_increasing_id().alias("at"), "conv_id", "turn", "role", "text", "n",
            F.when(initial.isin("s", "u", "a"), initial).otherwise("?").alias("initial"),
            (F.col("end") == "").alias("blank"),
            (~F.substring("end", -1, 1).isin(".", "!", "?")).alias("cut"),
            F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("key"),
        )
    )


def segments(placed: DataFrame) -> DataFrame:
    """Runs of up to ``SEGMENT`` places of a conversation, as a written table: their places, initials, fault letters (b, d, t, or - for none) and copies, counts of the faults, whether they are its first or last, and the initial before them.

    A row is a duplicate if an equal one of its conversation has a smaller place; its further copies always are, unless blank.
    """
    first = placed.groupBy("conv_id", "key").agg(F.min("at").alias("first"), F.count("*").alias("times")).where("times > 1").select(F.col("conv_id").alias("of"), "key", "first")
    light = placed.select("conv_id", "at", "n", "initial", "blank", "cut", "key")
    known = light.join(first, light.conv_id.eqNullSafe(first.of) & (light.key == first.key), "left")
    fault = F.when(F.col("blank"), "b").when(F.col("at") > F.col("first"), "d").when(F.col("cut"), "t").otherwise("-")
    known = known.select("conv_id", F.floor(F.col("at") / SEGMENT).alias("slice"), "at", "initial", fault.alias("fault"), "n")
    many = {"blank": F.when(F.col("fault") == "b", F.col("n")), "duplicate": F.when(F.col("fault") == "d", F.col("n")).when(F.col("fault") != "b", F.col("n") - 1), "truncated": F.when(F.col("fault") == "t", 1)}
    counts = [F.sum(F.coalesce(c, F.lit(0))).alias(k) for k, c in many.items()]
    runs = known.groupBy("conv_id", "slice").agg(F.array_sort(F.collect_list(F.struct("at", "initial", "fault", "n"))).alias("rows"), *counts)
    runs = runs.select("conv_id", "slice", *many, F.col("rows.at").alias("ats"), F.array_join("rows.initial", "").alias("initials"), F.array_join("rows.fault", "").alias("faults"), F.col("rows.n").alias("copies"))
    w = Window.partitionBy("conv_id").orderBy("slice")
    return table(runs.withColumns({"first": F.lag("slice").over(w).isNull(), "last": F.lead("slice").over(w).isNull(), "before": F.lag(F.substring("initials", -1, 1)).over(w)}))


class Alignment:
    """Live turns of a segment (not blank, no duplicates) against the strings that alternate u and a.

    ``tables[end][i][r - (n - i) + half]`` is the cost of turns i, i + 1, ... against the last r characters of the string that ends with ``end``: one table
    holds all lengths. Besides the one that every cut turn adds, each step off the diagonal costs two at least, so paths within an
    excess c stay within c / 2 of it: the first, narrow band gives an incumbent, whose excess sets the band that is surely wide enough.
    Only a conversation's last segment may end with inserted turns; others leave them to the turn that follows.
    """

    def __init__(self, initials: str, cuts: list[bool], last: bool):
        self.turns, self.n, self.last = initials, len(initials), last
        self.add = np.array(cuts, np.int64)
        self.rest = [0, *np.cumsum(self.add[::-1]).tolist()][::-1]
        self.half, self.tables = 0, {}

    def fill(self, half: int, ends: str) -> None:
        self.half, self.tables = half, {}
        off = np.arange(-half, half + 1)
        climb = INSERT * np.arange(2 * half + 1)
        for end in ends:
            other = "a" if end == "u" else "u"
            row = np.full(2 * half + 2, NONE)
            row[half] = 0
            if self.last:
                row[half : 2 * half + 1] = INSERT * np.arange(half + 1)
            out = [row.tolist()]
            for i in range(self.n - 1, -1, -1):
                r = self.n - i + off
                kept = np.where((r & 1) == 1, 0 if self.turns[i] == end else REROLE, 0 if self.turns[i] == other else REROLE) + self.add[i]
                x = np.minimum(row[1:] + DELETE, row[:-1] + np.where(r > 0, kept, NONE))
                x[r < 0] = NONE
                new = np.full(2 * half + 2, NONE)
                new[:-1] = np.minimum(np.minimum.accumulate(x - climb) + climb, NONE)
                row = new
                out.append(row.tolist())
            self.tables[end] = out[::-1]

    def starts(self, entry: int, i: int, exits: list[int]):
        """(cost, exit, end, r) of turns i, i + 1, ... from ``entry``: one for each length in the band, and one for deleting all."""
        left, half = self.n - i, self.half
        if entry < 2 and exits[entry] < NONE:
            yield DELETE * left + exits[entry], entry, None, 0
        for end, rows in self.tables.items():
            if exits[AFTER[end]] < NONE:
                r = max(0, left - half)
                odd = WANTS[entry] == end
                r += (r & 1) != odd
                for r in range(r + 2 * (r == 0 and entry < 2), left + half + 1, 2):
                    yield rows[i][r - left + half] + exits[AFTER[end]], AFTER[end], end, r

    def options(self, entry: int, exits: list[int]):
        """``starts`` with the place of the kept s, if there is one: only a grammar at its start takes it, and the turns before it go."""
        for x in self.starts(entry, 0, exits):
            yield *x, None
        if entry == 0:
            for i in range(self.n):
                if self.turns[i] == "s" and i <= self.half:  # each of the deleted costs two beyond what it would anyway
                    for cost, *x in self.starts(1, i + 1, exits):
                        yield DELETE * i + int(self.add[i]) + cost, *x, i

    def solve(self, entry: int, exits: list[int]) -> tuple[int, str, int]:
        """Cost, ASCII-least audit and exit of the cheapest edits from ``entry``, ``exits`` being what each end costs afterwards; (NONE, ...) if there are none."""
        least, half = min(exits), max(4, self.half)
        while True:
            if half != self.half:
                self.fill(half, "a" if self.last else "au")
            found = list(self.options(entry, exits))
            best = min((x[0] for x in found), default=NONE)
            if best >= NONE:
                if half > 2 * self.n + 4:
                    return NONE, "", 0
                half *= 4
            elif (excess := best - least - self.rest[0]) > 2 * half:
                half = excess // 2 + 1
            else:
                audits = {}
                for cost, out, end, r, s in found:
                    if cost == best:
                        audits.setdefault(self.trace(end, r, s), out)
                audit = min(audits)
                return best, audit, audits[audit]

    def trace(self, end: str | None, r: int, s: int | None) -> str:
        """The ASCII-least audit of the cheapest paths of one length: backwards the table is filled, so forwards the smallest letter on a cheapest path is the next."""
        out, i = [], 0
        if s is not None:
            out, i = ["D"] * s + ["K"], s + 1
        if end is None:
            return "".join(out) + "D" * (self.n - i)
        rows, n, half = self.tables[end], self.n, self.half
        other = "a" if end == "u" else "u"
        while i < n or r:
            at = r - (n - i) + half
            now = rows[i][at]
            if i < n and at < 2 * half and rows[i + 1][at + 1] + DELETE == now:
                out.append("D")
                i += 1
            elif r and at and rows[i][at - 1] + INSERT == now:
                out.append("I")
                r -= 1
            else:
                out.append("K" if self.turns[i] == (end if r & 1 else other) else "R")
                i, r = i + 1, r - 1
        return "".join(out)


def small(batches):
    """Batches of few rows, since each may hold a whole segment."""
    for b in batches:
        for k in range(0, b.num_rows, 64):
            yield b.slice(k, 64)


def alignment(row: dict) -> Alignment:
    live = [k for k, f in enumerate(row["faults"]) if f in "-t"]
    return Alignment("".join(row["initials"][k] for k in live), [row["faults"][k] == "t" for k in live], row["last"])


def dead(row: dict) -> int:
    """Rows that must go: blank ones, duplicates and further copies."""
    return sum(n if f in "bd" else n - 1 for f, n in zip(row["faults"], row["copies"], strict=True))


def woven(row: dict, audit: str) -> str:
    """``audit`` with a D for each row that must go, as early as it can stand: D is the least letter, so before inserted turns."""
    steps, out = iter(audit), []
    for f, n in zip(row["faults"], row["copies"], strict=True):
        if f in "-t":
            for step in steps:
                out.append(step)
                if step != "I":
                    break
            n -= 1
        out.append("D" * n)
    return "".join(out) + "".join(steps)


def priced(runs: DataFrame) -> DataFrame:
    """Of each segment of a conversation that has several: the 16 costs from every entry to every exit."""

    def run(batches):
        for b in small(batches):
            out = []
            for r in b.to_pylist():
                known, gone = alignment(r), DELETE * dead(r)
                costs = [min(NONE, gone + known.solve(p, [0 if q == e else NONE for e in range(4)])[0]) for p in range(4) for q in range(4)]
                out.append({"conv_id": r["conv_id"], "slice": r["slice"], "costs": costs})
            yield pa.RecordBatch.from_pylist(out, pa.schema([b.schema.field("conv_id"), b.schema.field("slice"), ("costs", pa.list_(pa.int64()))]))

    kind = runs.schema["conv_id"].dataType.simpleString()
    return runs.where("not (first and last)").mapInArrow(run, f"conv_id {kind}, slice long, costs array<long>")


def ahead(costs: DataFrame) -> DataFrame:
    """What each exit of a segment costs afterwards, from the costs of the conversation's later segments: 16 numbers a segment are all that meets."""
    kind = costs.schema["conv_id"].dataType.simpleString()

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("slice", "descending")])
        exits, out = list(END), []
        for m in group.column("costs").to_pylist():
            out.append(exits)
            exits = [min(NONE, *(m[4 * p + q] + exits[q] for q in range(4))) for p in range(4)]
        return group.drop_columns(["costs"]).append_column("exits", pa.array(out, pa.list_(pa.int64())))

    return costs.groupBy("conv_id").applyInArrow(run, f"conv_id {kind}, slice long, exits array<long>")


def chained(solved: DataFrame) -> DataFrame:
    """The entry of each segment, from its conversation's earlier ones."""
    kind = solved.schema["conv_id"].dataType.simpleString()

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("slice")
        entry, out = 0, []
        for exits in group.column("outs").to_pylist():
            out.append(entry)
            entry = exits[entry]
        return group.drop_columns(["outs"]).append_column("entry", pa.array(out, pa.int32()))

    return solved.groupBy("conv_id").applyInArrow(run, f"conv_id {kind}, slice long, entry int")


def joined(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """``left`` with the columns of ``right`` by (conv_id, slice), null ids equal."""
    right = right.withColumnsRenamed({"conv_id": "r_conv", "slice": "r_slice"})
    return left.join(right, left.conv_id.eqNullSafe(right.r_conv) & (left.slice == right.r_slice), how).drop("r_conv", "r_slice")


def audited(runs: DataFrame) -> DataFrame:
    """(conv_id, slice, entry, audit, cost, exit) of each segment in the cheapest repair of its whole conversation, as a written table.

    A conversation in one segment is solved at once. Of the others, every segment is priced between all places of the grammar, the prices
    are added from the back, each segment is solved from every entry, and the entries are followed from the front.
    """
    kind = runs.schema["conv_id"].dataType.simpleString()
    exits = table(ahead(table(priced(runs))))

    def run(batches):
        for b in small(batches):
            out = []
            for r in b.to_pylist():
                known, gone = alignment(r), DELETE * dead(r)
                after = r["exits"] or END
                for entry in range(1 if r["first"] else 4):
                    cost, audit, exit = known.solve(entry, after)
                    out.append({"conv_id": r["conv_id"], "slice": r["slice"], "entry": entry, "audit": woven(r, audit), "cost": gone + cost - after[exit], "exit": exit})
            yield pa.RecordBatch.from_pylist(out, pa.schema([b.schema.field("conv_id"), ("slice", pa.int64()), ("entry", pa.int32()), ("audit", pa.string()), ("cost", pa.int64()), ("exit", pa.int32())]))

    solved = table(joined(runs, exits).mapInArrow(run, f"conv_id {kind}, slice long, entry int, audit string, cost long, exit int"))
    several = joined(solved, exits, "left_semi")
    outs = several.groupBy("conv_id", "slice").agg(F.transform(F.array_sort(F.collect_list(F.struct("entry", "exit"))), lambda x: x["exit"]).alias("outs"))
    way = chained(outs).withColumnRenamed("entry", "own")
    return table(joined(solved, way).where(F.coalesce("own", F.lit(0)) == F.col("entry")).drop("own"))


def steps(runs: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, slice, step, edit, at, role) of each edit that leaves a turn: of kept ones the role is null, of others it is the new one; an inserted one's at is a negative number."""
    kind = runs.schema["conv_id"].dataType.simpleString()

    def run(batches):
        for b in small(batches):
            for r in b.to_pylist():
                places = iter([a for a, n in zip(r["ats"], r["copies"], strict=True) for _ in range(n)])
                initial = dict(zip(r["ats"], r["initials"], strict=True))
                state, out = r["entry"], []
                for step, edit in enumerate(r["audit"]):
                    at = next(places) if edit != "I" else -1 - (r["slice"] * (SEGMENT + 1) + step)
                    if edit != "D":
                        c = initial[at] if edit == "K" else WANTS[state]
                        out.append({"conv_id": r["conv_id"], "slice": r["slice"], "step": step, "edit": edit, "at": at, "role": None if edit == "K" else ROLE[c]})
                        state = AFTER[c]
                yield pa.RecordBatch.from_pylist(out, pa.schema([b.schema.field("conv_id"), ("slice", pa.int64()), ("step", pa.int32()), ("edit", pa.string()), ("at", pa.int64()), ("role", pa.string())]))

    both = joined(runs.select("conv_id", "slice", "ats", "copies", "initials"), audits.select("conv_id", "slice", "entry", "audit"), "inner")
    return both.mapInArrow(run, f"conv_id {kind}, slice long, step int, edit string, at long, role string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The repaired turns of ``rows`` (conv_id, turn, role, text), and one row per conversation.

    Turns: conv_id, slice, step (together their order), edit (K kept, R role changed, I inserted), role, text, turn (null if inserted).
    Conversations: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    Rows are taken by turn, nulls first, then by role and text. Null roles and texts count as one blank, and rows with a null conv_id are one
    conversation. A row's first fault counts: blank (nothing but white space), duplicate (same role and text earlier), truncated (does not end with
    ``.!?``). Keeping a turn costs 0, changing its role 2, deleting it 3 (blank ones and duplicates must go), inserting an empty one 2; a
    truncated turn that stays adds 1. The cheapest edits leave roles whose initials are ``(s?(ua)+)?``; of equal costs the ASCII-least
    audit counts. An initial that is not s, u or a can't stay. An empty table gives no rows. Other columns are not read.

    Rows are dealt by ranges, so a conversation of any length is in segments of bounded size, aligned in separate tasks; only a few numbers of
    each segment meet. An audit has a letter for every row, in one string.
    """
    placed = ordered(rows)
    runs = segments(placed)
    audits = audited(runs)
    made = steps(runs, audits).withColumnRenamed("role", "new")
    kept = placed.select("at", "role", "text", "turn")
    turns = made.join(kept, "at", "left").select("conv_id", "slice", "step", "edit", F.coalesce("new", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"), "turn")

    pairs = F.concat(F.coalesce("before", F.lit("")), "initials")
    legal = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.length(pairs) - 1, F.lit(1))), lambda i: F.substr(pairs, i, F.lit(2)).isin("su", "ua", "au")))
    within = F.aggregate("copies", F.lit(0).cast("bigint"), lambda a, n: a + n - 1)
    told = runs.select("conv_id", "slice", "blank", "duplicate", "truncated", (F.length(pairs) - 1 - legal + within).alias("illegal"))
    per = joined(told, audits.select("conv_id", "slice", "audit", "cost")).groupBy("conv_id").agg(
        *(F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slice", "audit"))), lambda x: x["audit"]), "").alias("audit")
    )
    turn = F.col("turn").cast("long")
    gaps = placed.groupBy("conv_id", turn.alias("turn")).agg(F.lit(1)).groupBy(F.col("conv_id").alias("of")).agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    return turns, per.join(gaps, per.conv_id.eqNullSafe(gaps.of)).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def hashed(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) over each conversation's ``role:text`` joined by newlines.

    A SHA-256 reads its input in one go, so a conversation's rows pass one task, sorted and as a stream: the task holds a batch of rows and the state of one digest.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", "slice", "step"]

    def run(batches):
        now, digest, fresh = None, None, True
        for b in batches:
            out = []
            for conv, role, text in zip(*(b.column(k).to_pylist() for k in (0, 3, 4)), strict=True):
                if digest is None or conv != now:
                    if digest is not None:
                        out.append((now, digest.hexdigest()))
                    now, digest, fresh = conv, hashlib.sha256(), True
                digest.update(f"{'' if fresh else chr(10)}{role}:{text}".encode())
                fresh = False
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], b.schema.field(0).type), pa.array([x[1] for x in out], pa.string())], names=["conv_id", "repaired_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], b.schema.field(0).type), pa.array([digest.hexdigest()])], names=["conv_id", "repaired_sha256"])

    dealt = turns.select(*order, "role", "text").repartition("conv_id").sortWithinPartitions(*order)
    return dealt.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def digest(conversations: DataFrame) -> DataFrame:
    """``repair`` of ``damaged`` conversations with a row for every original conv_id: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A conversation without rows after damage has zeros, an empty audit and the hash of the empty text.
    """
    turns, per = repair(damaged(conversations))
    sha = hashed(turns)
    ids = conversations.select("conv_id").distinct()
    per, sha = per.withColumnRenamed("conv_id", "p_conv"), sha.withColumnRenamed("conv_id", "s_conv")
    out = ids.join(per, ids.conv_id.eqNullSafe(per.p_conv), "left").join(sha, ids.conv_id.eqNullSafe(sha.s_conv), "left")
    counts: list[Column] = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


#: The same rows for DuckDB, without null and repeated conv_ids and turns: turn by turn, the cheapest edits up to each place of the grammar (0: before anything, 1 to 3: after s, u, a)
#: with the least audit. DuckDB has no crc32, so its bits are shifted here.
DIGEST_SQL = r"""
WITH RECURSIVE hit AS (
  SELECT *, xor(4294967295, list_reduce(list_transform(string_split(conv_id || ':' || turn, ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda crc, b: list_reduce(range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, b)), CAST(4294967295 AS BIGINT))) % 20 AS k
  FROM (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations)),
hurt AS (SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, k FROM hit WHERE k <> 0),
doubled AS (SELECT * FROM hurt UNION ALL SELECT * FROM hurt WHERE k = 3),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM doubled),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM placed),
r AS MATERIALIZED (SELECT conv_id, i, turn, role, text, left(role, 1) AS c, CASE WHEN body = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM numbered),
move(p, k, q, body) AS (VALUES (0, 0, 0, ''), (0, 1, 2, chr(10) || 'user:'), (0, 2, 3, chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 0, 1, ''), (1, 1, 2, chr(10) || 'user:'), (1, 2, 3, chr(10) || 'user:' || chr(10) || 'assistant:'),
  (2, 0, 2, ''), (2, 1, 3, chr(10) || 'assistant:'), (3, 0, 3, ''), (3, 1, 2, chr(10) || 'user:')),
edit(p, op, c, q) AS (VALUES (0, 'D', '', 0), (1, 'D', '', 1), (2, 'D', '', 2), (3, 'D', '', 3), (0, 'K', 's', 1), (0, 'K', 'u', 2), (1, 'K', 'u', 2), (3, 'K', 'u', 2), (2, 'K', 'a', 3), (0, 'R', 'user', 2), (1, 'R', 'user', 2), (3, 'R', 'user', 2), (2, 'R', 'assistant', 3)),
s AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS p, CAST(0 AS BIGINT) AS cost, '' AS audit, '' AS body FROM r
  UNION ALL
  SELECT s.conv_id, r.i, e.q, s.cost + 2 * m.k + CASE e.op WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CAST(e.op <> 'D' AND r.fault = 'truncated' AS INTEGER) AS total, s.audit || repeat('I', m.k) || e.op AS letters,
    s.body || m.body || CASE e.op WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || r.role || ':' || r.text ELSE chr(10) || e.c || ':' || r.text END
  FROM s JOIN r ON r.conv_id = s.conv_id AND r.i = s.i + 1 JOIN move m ON m.p = s.p JOIN edit e ON e.p = m.q AND (e.op = 'D' OR r.fault NOT IN ('blank', 'duplicate') AND (e.op = 'R' OR e.c = r.c))
  QUALIFY row_number() OVER (PARTITION BY s.conv_id, e.q ORDER BY total, letters) = 1),
n AS (SELECT conv_id, max(i) AS i, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
  count(*) FILTER (WHERE before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM r GROUP BY conv_id),
best AS (SELECT s.conv_id, s.cost + 2 * m.k AS cost, s.audit || repeat('I', m.k) AS audit, substr(s.body || m.body, 2) AS body FROM s JOIN n ON n.conv_id = s.conv_id AND n.i = s.i JOIN move m ON m.p = s.p
  WHERE m.q IN (0, 3) QUALIFY row_number() OVER (PARTITION BY s.conv_id ORDER BY s.cost + 2 * m.k, s.audit || repeat('I', m.k)) = 1)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN n USING (conv_id) LEFT JOIN best USING (conv_id)
"""
