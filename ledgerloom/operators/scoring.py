"""Scores of retrieval and agent runs: hits and binding, recall, reciprocal rank, average precision, gates, case identity, validation.

The queries score the neighbours of ``retrieval.ranked`` as retrieved chunks, and agent cases derived from ``events``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import contains_cjk
from ..sources import derived, scan
from .retrieval import RANKED, ranked


def hits(results: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, entry, rank): results (query_id, rank, header_path, text) that hit an expected entry.

    An entry has any number of rows (query_id, entry, path, snippet). A result hits it if its path begins with any of the entry's paths (case counts) and, unless
    all snippets are null or empty, its text holds any of them (case doesn't). A result that repeats a path and text of a better rank is the same chunk and counts there alone.
    """
    entries = expected.groupBy("query_id", "entry").agg(F.collect_set("path").alias("paths"), F.collect_set(F.lower(F.nullif(F.col("snippet"), F.lit("")))).alias("snippets"))
    chunks = results.groupBy("query_id", "header_path", "text").agg(F.min("rank").alias("rank"))
    both = chunks.join(entries, "query_id")
    path = F.exists("paths", lambda p: F.col("header_path").startswith(p))
    snippet = (F.size("snippets") == 0) | F.exists("snippets", lambda s: F.contains(F.lower("text"), s))
    return both.where(path & snippet).select("query_id", "entry", "rank")


def bound_scores(results: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, n_expected, recall_5, recall_10, reciprocal_rank, average_precision) of every query with expected entries (query_id, entry, path, snippet); an entry of several rows is one.

    Recall: the entries in order each take the best ranked hit that none took before. Average precision: by rank, a chunk binds to the
    first entry that is still free; the denominator is the number of entries, so entries without a hit pull it down. Null where nothing is expected.
    """
    found = hits(results, expected).groupBy("query_id").agg(F.array_sort(F.collect_set(F.struct("entry", "rank"))).alias("h"))
    by = expected.groupBy("query_id").agg(F.count_distinct("entry").alias("n_expected"), F.array_sort(F.collect_set("entry")).alias("entries")).join(found, "query_id", "left")
    h = F.coalesce("h", F.array().cast("array<struct<entry:int,rank:int>>"))

    def recall(k: int) -> Column:
        def take(used: Column, entry: Column) -> Column:
            free = F.filter(h, lambda x: (x["entry"] == entry) & (x["rank"] <= k) & ~F.array_contains(used, x["rank"]))
            return F.when(F.size(free) > 0, F.array_append(used, F.array_min(F.transform(free, lambda x: x["rank"])))).otherwise(used)

        return F.size(F.aggregate("entries", F.array().cast("array<int>"), take)) / F.col("n_expected")

    def bind(state: Column, rank: Column) -> Column:
        free = F.filter(h, lambda x: (x["rank"] == rank) & ~F.array_contains(state["taken"], x["entry"]))
        n = F.size(state["taken"]) + 1
        bound = F.struct(F.array_append(state["taken"], F.array_min(F.transform(free, lambda x: x["entry"]))).alias("taken"), (state["total"] + n / rank).alias("total"))
        return F.when(F.size(free) > 0, bound).otherwise(state)

    ranks = F.array_sort(F.array_distinct(F.transform(h, lambda x: x["rank"])))
    start = F.struct(F.array().cast("array<int>").alias("taken"), F.lit(0.0).alias("total"))
    precision = F.aggregate(ranks, start, bind, lambda s: s["total"]) / F.col("n_expected")
    first = F.array_min(F.transform(h, lambda x: x["rank"]))
    return by.select("query_id", "n_expected", recall(5).alias("recall_5"), recall(10).alias("recall_10"), F.coalesce(1 / first, F.lit(0.0)).alias("reciprocal_rank"), precision.alias("average_precision"))


def verdicts(cases: DataFrame, scorers: DataFrame) -> DataFrame:
    """(scenario, scorer, floor, aggregate, n_produced, skipped, errored, cause): each gated scorer's mean of what it produced over the cases that didn't crash.

    ``cases``: scenario, case_id, task_error, scores (map of score by scorer), scorer_errors (array of names). Absent scores are errored or skipped, and listed. Cause is null if the
    mean reaches the floor or every case crashed; else it says why the gate is red.
    """
    alive = cases.where("task_error is null").join(scorers, "scenario")
    score = F.try_element_at("scores", F.col("scorer"))
    state = F.when(score.isNotNull(), "produced").when(F.array_contains("scorer_errors", F.col("scorer")), "errored").otherwise("skipped")
    rows = alive.select("scenario", "scorer", "floor", "case_id", score.alias("score"), state.alias("state"))
    names = lambda which: F.array_join(F.array_sort(F.collect_list(F.when(F.col("state") == which, F.col("case_id")))), ", ")
    by = rows.groupBy("scenario", "scorer", "floor").agg(F.avg("score").alias("aggregate"), F.count("score").alias("n_produced"), F.count_if(F.col("state") == "skipped").alias("s"), F.count_if(F.col("state") == "errored").alias("e"), names("skipped").alias("skipped"), names("errored").alias("errored"))
    none = F.when((F.col("e") > 0) & (F.col("s") == 0), "all cases errored").when((F.col("s") > 0) & (F.col("e") == 0), "all cases skipped").otherwise("every case errored or skipped")
    cause = F.when(F.col("n_produced") == 0, none).when(F.col("aggregate") < F.col("floor"), "below floor")
    by = by.select("scenario", "scorer", "floor", "aggregate", "n_produced", "skipped", "errored", cause.alias("cause"))
    rest = scorers.join(by.select("scenario", "scorer"), ["scenario", "scorer"], "left_anti")
    return by.unionByName(rest.select("scenario", "scorer", "floor", F.lit(0).cast("long").alias("n_produced"), F.lit("").alias("skipped"), F.lit("").alias("errored")), allowMissingColumns=True)


def gate(scenarios: DataFrame, cases: DataFrame, scorers: DataFrame) -> DataFrame:
    """(scenario, status, failures): red on any failing scorer, crashed case, missing gated scorer or missing case; the failures in words."""
    failing = verdicts(cases, scorers).where("cause is not null").groupBy("scenario").agg(F.array_sort(F.collect_list(F.concat_ws(": ", "scorer", "cause"))).alias("f"))
    ran = cases.groupBy("scenario").agg(F.count("*").alias("n_cases"), F.count_if(F.col("task_error").isNotNull()).alias("n_crashed"))
    gated = scorers.groupBy("scenario").agg(F.count("*").alias("n_gated"))
    all_ = scenarios.join(ran, "scenario", "left").join(gated, "scenario", "left").join(failing, "scenario", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    said = F.array(
        F.when(zero("n_gated") == 0, F.lit("no gated scorer")),
        F.when((zero("n_gated") > 0) & (zero("n_cases") == 0), F.lit("no cases")),
        F.when(zero("n_crashed") > 0, F.concat(F.lit("crashed: "), F.col("n_crashed"))),
    )
    failures = F.concat(F.array_compact(said), F.coalesce("f", F.array().cast("array<string>")))
    return all_.select("scenario", F.when(F.size(failures) == 0, "green").otherwise("red").alias("status"), F.array_join(failures, "; ").alias("failures"))


def args_without_cjk(calls: DataFrame, expected: DataFrame) -> DataFrame:
    """(case_id, score): 1 if no text argument of a case's calls (case_id, tool, args map) has CJK characters and its ticker is one; only where ``expected`` (case_id, no_cjk, tool) asks for it, and of its tool if it names one."""
    rows = expected.join(calls.withColumnRenamed("tool", "called"), "case_id", "left")
    bad = F.exists(F.map_entries("args"), lambda a: F.when(a["key"] == "ticker", ~a["value"].rlike(r"^[A-Z][A-Z0-9.\-]*$")).otherwise(contains_cjk(a["value"])))
    counts = F.col("no_cjk") & (F.col("tool").isNull() | (F.col("tool") == F.col("called"))) & bad
    return rows.groupBy("case_id").agg((1 - F.max(F.coalesce(counts, F.lit(False)).cast("int"))).cast("double").alias("score"))


def selected(rows: DataFrame, ids: list[str]) -> DataFrame:
    """(pos, id, status): requested ids in their order, each found, unknown or repeated; an empty request or id is an error."""
    if not ids or any(not i.strip() for i in ids):
        raise ValueError("row ids must be a list of ids that aren't empty")
    ask = rows.sparkSession.range(1).select(F.posexplode(F.array(*(F.lit(i.strip()) for i in ids))).alias("pos", "id"))
    ask = ask.withColumn("again", F.exists(F.slice(F.array(*(F.lit(i.strip()) for i in ids)), F.lit(1), F.col("pos")), lambda x: x == F.col("id")))
    known = rows.select(F.col("id").cast("string").alias("id"), F.lit(True).alias("known")).distinct()
    status = F.when(F.col("again"), "repeated").when(F.col("known"), "found").otherwise("unknown")
    return ask.join(known, "id", "left").select("pos", "id", status.alias("status"))


def diagnostic_rows(rows: DataFrame, dataset: str, version: str, label: str, agent: str, ids: list[str] | None = None) -> DataFrame:
    """(pos, id, diagnostic_id, is_full_dataset, metadata, and the other columns) of a dataset's ``rows`` (id, ...): all of them, pos null, or the requested ``ids`` in their order.

    Ids of the dataset must be there, differ and hold no ``::``; so must names, since an identity is ``dataset::label::row``. Unknown, repeated and empty requests are errors. Each row carries
    its run's metadata as JSON, and whether the run has the whole dataset, so that no subset passes for one.
    """
    for name, part in (("dataset", dataset), ("label", label)):
        if not part.strip() or "::" in part:
            raise ValueError(f"{name} must not be empty or hold '::': {part!r}")
    text = F.col("id").cast("string")
    bad = rows.groupBy(text.alias("id")).agg(F.count("*").alias("n")).where("id is null or trim(id) = '' or n > 1 or contains(id, '::')").select("id").limit(5).collect()
    if bad:
        raise ValueError(f"dataset ids are empty, repeated or hold '::': {[r.id for r in bad]}")
    total, out = rows.count(), rows.withColumn("id", text)
    if ids is None:
        out, whole = out.withColumn("pos", F.lit(None).cast("int")), True
    else:
        asked = selected(rows, ids)
        odd = asked.where("status <> 'found'").orderBy("pos").limit(5).collect()
        if odd:
            raise ValueError("; ".join(f"{r.status} id {r.id}" for r in odd))
        out, whole = out.join(asked.select("pos", "id"), "id"), len(ids) == total
    metadata = F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in (("dataset_name", dataset), ("dataset_version", version), ("run_label", label), ("agent_version", agent))), F.col("id").alias("row_id"), F.lit(whole).alias("is_full_dataset")))
    rest = [c for c in rows.columns if c != "id"]
    return out.select("pos", "id", F.concat_ws("::", F.lit(dataset), F.lit(label), "id").alias("diagnostic_id"), F.lit(whole).alias("is_full_dataset"), metadata.alias("metadata"), *rest)


def diagnostic_run(spark, sf_dir: str) -> DataFrame:
    """Every benchmark item as a row of a diagnostic run."""
    rows = scan(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.md5("text").alias("text_md5"))
    return diagnostic_rows(rows, "benchmark", "v2", "baseline", "a1").drop("pos")


EXPECTED = """SELECT vec_id AS query_id, CAST(entry % 3 AS INTEGER) AS entry, CASE entry WHEN 0 THEN concat('F', t, ' / 2024') WHEN 1 THEN concat('F', (t + 1) % 5, ' / 2024 / Item ', t % 4) WHEN 4 THEN concat('F', (t + 2) % 5, ' / 2024') ELSE concat('F', t, ' / 20') END AS path,
  CASE entry WHEN 0 THEN '' WHEN 1 THEN 'CHUNK 1' WHEN 4 THEN 'chunk 2' ELSE '7 of' END AS snippet FROM (SELECT vec_id, CAST(floor(vec_id / 20) AS BIGINT) % 5 AS t FROM embeddings WHERE vec_id % 20 = 0) CROSS JOIN (SELECT 0 AS entry UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 4) e"""
CASES = """SELECT user_id % 7 AS scenario, concat('case-', user_id) AS case_id, CASE WHEN user_id % 13 = 3 THEN 'crash' END AS task_error, event_type, avg(value) / 100 AS mean, count(*) AS n FROM events WHERE user_id % 7 < 6 GROUP BY user_id, event_type"""
FLOORS = "SELECT s AS scenario, event_type AS scorer, CASE WHEN s = 1 THEN 0.05 ELSE 0.3 END AS floor FROM (SELECT DISTINCT event_type FROM events WHERE event_type < 't') CROSS JOIN (SELECT 0 AS s UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 6) x"


def retrieved(spark, sf_dir: str) -> DataFrame:
    """The neighbours as chunks with a header path and a text."""
    v = F.col("vec_id")
    path = F.concat(F.lit("F"), v % 5, F.lit(" / 2024 / Item "), v % 4, F.lit(". T"))
    return ranked(spark, sf_dir).select("query_id", "rank", "vec_id", path.alias("header_path"), F.concat(F.lit("Chunk "), v, F.lit(" of the store")).alias("text"))


def expectations(spark, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, EXPECTED, "embeddings")


def hit_table(spark, sf_dir: str) -> DataFrame:
    return hits(retrieved(spark, sf_dir), expectations(spark, sf_dir))


def scored(*names: str):
    def query(spark, sf_dir: str) -> DataFrame:
        by = bound_scores(retrieved(spark, sf_dir), expectations(spark, sf_dir))
        return by.select("query_id", *(F.round(n, 9).alias(n) for n in names))

    return query


def entity_precision(spark, sf_dir: str) -> DataFrame:
    """Share of the first 5 and 10 chunks that are of the query's entity, and the mix of the ten."""
    own = ranked(spark, sf_dir).select("query_id", "rank", (F.col("vec_id") % 5).alias("entity"), (F.floor(F.col("query_id") / 20) % 5).alias("target"))
    by = own.groupBy("query_id", "target").agg(F.round(F.sum(((F.col("rank") <= 5) & (F.col("entity") == F.col("target"))).cast("int")) / 5, 9).alias("precision_5"), F.round(F.sum((F.col("entity") == F.col("target")).cast("int")) / 10, 9).alias("precision_10"))
    mix = own.groupBy("query_id", "entity").count().groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("m"), "entity"))).alias("l"))
    return by.drop("target").join(mix.select("query_id", F.array_join(F.transform("l", lambda x: F.concat(F.lit("F"), x["entity"], F.lit(":"), -x["m"])), " ").alias("mix")), "query_id")


def entity_tiers(spark, sf_dir: str) -> DataFrame:
    """By entity: mean, sample deviation, least and greatest precision of its queries' ten chunks, the other entities among them, and its tier."""
    own = ranked(spark, sf_dir).select("query_id", (F.col("vec_id") % 5).alias("entity"), (F.floor(F.col("query_id") / 20) % 5).alias("target"))
    other = F.when(F.col("entity") != F.col("target"), F.concat(F.lit("F"), F.col("entity")))
    by_query = own.groupBy("query_id", "target").agg((F.sum((F.col("entity") == F.col("target")).cast("int")) / 10).alias("p"), F.collect_set(other).alias("others"))
    by = by_query.groupBy("target").agg(F.avg("p").alias("m"), F.stddev_samp("p").alias("s"), F.min("p").alias("low"), F.max("p").alias("high"), F.array_distinct(F.flatten(F.collect_list("others"))).alias("o"))
    tier = F.when(F.col("m") <= 0.2, "weak").when(F.col("m") <= 0.5, "middling").when(F.col("m") == 1, "perfect").otherwise("good")
    return by.select("target", F.round("m", 9).alias("mean"), F.round("s", 9).alias("std"), "low", "high", F.array_join(F.array_sort("o"), " ").alias("contaminants"), tier.alias("tier"))


def agent_cases(spark, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = derived(spark, sf_dir, CASES, "events")
    score = F.when(F.col("n") % 4 < 2, F.col("mean"))
    cases = rows.groupBy("scenario", "case_id", "task_error").agg(F.map_from_entries(F.collect_list(F.struct("event_type", score))).alias("scores"), F.collect_list(F.when(F.col("n") % 4 == 2, F.col("event_type"))).alias("scorer_errors"))
    scenarios = scan(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("scenario")).distinct()
    return scenarios, cases, derived(spark, sf_dir, FLOORS, "events").withColumn("scenario", F.col("scenario").cast("long"))


def scorer_verdicts(spark, sf_dir: str) -> DataFrame:
    _, cases, scorers = agent_cases(spark, sf_dir)
    return verdicts(cases, scorers).select("scenario", "scorer", F.round("aggregate", 7).alias("aggregate"), "n_produced", "skipped", "errored", "cause")


def scenario_gate(spark, sf_dir: str) -> DataFrame:
    return gate(*agent_cases(spark, sf_dir))


def tool_arguments(spark, sf_dir: str) -> DataFrame:
    e = scan(spark, sf_dir, "events")
    ticker = F.when(F.col("value") > 0.5, F.upper("event_type")).otherwise(F.col("event_type"))
    args = F.create_map(F.lit("ticker"), ticker, F.lit("query"), F.concat(F.lit("q "), F.when(F.col("event_id") % 97 == 0, "中").otherwise("x")))
    calls = e.select(F.col("user_id").alias("case_id"), F.col("event_type").alias("tool"), args.alias("args"))
    expected = e.select(F.col("user_id").alias("case_id")).distinct().select("case_id", (F.col("case_id") % 2 == 0).alias("no_cjk"), F.when(F.col("case_id") % 3 == 0, "click").alias("tool"))
    return args_without_cjk(calls, expected)


def judge_scores(spark, sf_dir: str) -> DataFrame:
    """A judge's letter as a score; null where a variable of its rubric is empty (here: texts under 40 characters)."""
    d = scan(spark, sf_dir, "documents").select("doc_id", (F.length("text") >= 40).alias("filled"))
    letter = F.when(F.col("quality") == 1, "Y").otherwise("N")
    scores = F.create_map(F.lit("Y"), F.lit(1.0), F.lit("N"), F.lit(0.0))
    return scan(spark, sf_dir, "labels").join(d, "doc_id").select("doc_id", F.when(F.col("filled"), scores[letter]).alias("score"))


def chosen_rows(spark, sf_dir: str, ids: str = "7, 3,11,999999999,3") -> DataFrame:
    return selected(scan(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), ids.split(","))


def diagnostic_ids(spark, sf_dir: str) -> DataFrame:
    """``dataset::label::row`` and whether no part holds the separator itself."""
    d = scan(spark, sf_dir, "documents")
    label = F.when(F.col("doc_id") % 50 == 0, "a::b").otherwise(F.col("lang"))
    return d.select("doc_id", F.concat_ws("::", "source", label, F.col("doc_id").cast("string")).alias("diagnostic_id"), (~F.contains(F.concat_ws(" ", "source", label), F.lit("::"))).alias("valid"))


def validation(spark, sf_dir: str) -> DataFrame:
    """Each benchmark item's path and snippet against the store: pass, only another case of the snippet, no such snippet, or no such path. Chunks and items meet by their filing."""
    b = scan(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("F"), F.col("item_id") % 6).alias("filing"), (F.col("item_id") % 4).alias("item"), F.when(F.col("item_id") % 3 == 0, "Chunk 1").when(F.col("item_id") % 3 == 1, "chunk 1").otherwise("none").alias("snippet"))
    b = b.withColumn("path", F.concat(F.col("filing"), F.lit(" / 2024 / Item "), F.col("item")))
    v = F.col("vec_id")
    chunks = scan(spark, sf_dir, "embeddings").select(F.concat(F.lit("F"), v % 5).alias("filing"), F.concat(F.lit("F"), v % 5, F.lit(" / 2024 / Item "), v % 3, F.lit(". T")).alias("header_path"), F.concat(F.lit("Chunk "), v).alias("text"))
    met = b.join(chunks, "filing", "left")
    under = F.coalesce(F.col("header_path").startswith(F.col("path")), F.lit(False))
    by = met.groupBy("item_id").agg(F.max(under).alias("path"), F.max(under & F.contains("text", "snippet")).alias("exact"), F.max(under & F.contains(F.lower("text"), F.lower("snippet"))).alias("near"))
    return by.select("item_id", F.when(F.col("exact"), "pass").when(F.col("near"), "near miss").when(F.col("path"), "no snippet").otherwise("no path").alias("status"))


def listed(json: Column) -> Column:
    """The strings of a JSON list; empty for a null or empty text; null for what is no list."""
    value = F.try_parse_json(json)
    is_list = F.schema_of_variant(value).startswith("ARRAY")
    return F.when(F.coalesce(F.trim(json), F.lit("")) == "", F.array().cast("array<string>")).when(is_list, F.try_variant_get(value, "$", "array<string>"))


def prefixed(paths: DataFrame, of: DataFrame) -> DataFrame:
    """(path, header_path): pairs of which the second begins with the first, both of tables of different values. Each header path offers its beginnings of the lengths that paths have, and these meet by equality."""
    lengths = paths.select(F.length("path").alias("n")).distinct().groupBy().agg(F.array_sort(F.collect_set("n")).alias("lengths"))  # one row, no more numbers than a path has characters
    starts = of.crossJoin(F.broadcast(lengths)).select("header_path", F.explode(F.filter("lengths", lambda n: n <= F.length("header_path"))).alias("n"))
    return starts.select("header_path", F.substr("header_path", F.lit(1), F.col("n")).alias("path")).join(paths, "path")


def validated(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """(row_id, place, status) of evaluation ``rows`` (row_id, paths, snippets: JSON lists) against ``chunks`` (header_path, text).

    A row is ``malformed`` (a field is no list) or ``skipped`` (no path), place null; else each of its paths is ``ok`` (chunks begin with it, and one of them holds the
    snippet of the same place, if there is one, in any case), ``no snippet``, ``near miss`` (only in another case) or ``failed``. An empty path is every chunk's. Paths and chunks meet by equal
    beginnings, and each snippet is looked for once among a header path's chunks, however many rows ask for it.
    """
    read = rows.select("row_id", listed(F.col("paths")).alias("p"), listed(F.col("snippets")).alias("s"))
    odd = read.where("p is null or s is null or size(p) = 0").select("row_id", F.lit(None).cast("int").alias("place"), F.when(F.col("p").isNull() | F.col("s").isNull(), "malformed").otherwise("skipped").alias("status"))
    each = read.where("p is not null and s is not null").select("row_id", "s", F.posexplode("p").alias("place", "path"))
    each = each.select("row_id", "place", "path", F.lower(F.nullif(F.get("s", F.col("place")), F.lit(""))).alias("snippet"))
    heads = chunks.select("header_path").distinct()
    exact = prefixed(each.select("path").distinct(), heads)
    asked = each.where("snippet is not null").join(exact, "path").groupBy("header_path").agg(F.collect_set("snippet").alias("asked"))
    held = chunks.join(asked, "header_path").select("header_path", F.explode(F.filter("asked", lambda s: F.contains(F.lower("text"), s))).alias("snippet")).distinct()
    told = exact.join(held, "header_path").select("path", "snippet").distinct().withColumn("told", F.lit(True))
    found = exact.select("path").distinct().withColumn("found", F.lit(True))
    low = heads.select(F.lower("header_path").alias("header_path")).distinct()
    near = prefixed(each.select(F.lower("path").alias("path")).distinct(), low).select(F.col("path").alias("low")).distinct().withColumn("near", F.lit(True))
    out = each.join(found, "path", "left").join(told, ["path", "snippet"], "left").withColumn("low", F.lower("path")).join(near, "low", "left")
    status = F.when(F.col("found") & (F.col("snippet").isNull() | F.col("told")), "ok").when(F.col("found"), "no snippet").when(F.col("near"), "near miss").otherwise("failed")
    return out.select("row_id", "place", status.alias("status")).unionByName(odd)


DATASET = """SELECT item_id AS row_id, CASE item_id % 7 WHEN 0 THEN '' WHEN 1 THEN '{"a": 1}' WHEN 2 THEN concat('["F', item_id % 6, ' / 2024') ELSE concat('["F', item_id % 6, ' / 2024 / Item ', item_id % 4, '", "f', item_id % 5, ' / 2024", "F', item_id % 5, '"]') END AS paths,
  CASE item_id % 5 WHEN 0 THEN '' WHEN 1 THEN '["CHUNK 1", "", "chunk 20"]' WHEN 2 THEN 'x' WHEN 3 THEN '["none", "none", "none"]' ELSE '["chunk 2"]' END AS snippets FROM benchmark"""
STORE = "SELECT concat('F', vec_id % 5, ' / 2024 / Item ', vec_id % 3, '. T') AS header_path, concat('Chunk ', vec_id) AS text FROM embeddings"


def dataset_rows(spark, sf_dir: str) -> DataFrame:
    return validated(derived(spark, sf_dir, DATASET, "benchmark"), derived(spark, sf_dir, STORE, "embeddings"))


CHUNKS = f"SELECT query_id, rank, vec_id, concat('F', vec_id % 5, ' / 2024 / Item ', vec_id % 4, '. T') AS header_path, concat('Chunk ', vec_id, ' of the store') AS text FROM ({RANKED})"
HITS = f"""SELECT query_id, entry, rank FROM ({CHUNKS}) c JOIN (SELECT query_id, entry, list(path) AS p, list(lower(snippet)) FILTER (WHERE snippet <> '') AS s FROM ({EXPECTED}) GROUP BY 1, 2) e USING (query_id)
  WHERE len(list_filter(p, lambda x: starts_with(header_path, x))) > 0 AND (s IS NULL OR len(list_filter(s, lambda x: contains(lower(text), x))) > 0)"""
QUERIES_OF = "SELECT DISTINCT query_id FROM (" + EXPECTED + ")"


def _sql_recall(k: int) -> str:
    return f"""SELECT query_id, round(len(used) / 3, 9) AS recall_{k} FROM (WITH RECURSIVE h AS (SELECT query_id, entry, list(rank) AS r FROM ({HITS}) WHERE rank <= {k} GROUP BY 1, 2), s AS (SELECT query_id, 0 AS e, CAST([] AS INTEGER[]) AS used FROM ({QUERIES_OF})
      UNION ALL SELECT s.query_id, e + 1, CASE WHEN len(list_filter(r, lambda x: NOT list_contains(used, x))) > 0 THEN list_append(used, list_min(list_filter(r, lambda x: NOT list_contains(used, x)))) ELSE used END FROM s LEFT JOIN h ON h.query_id = s.query_id AND h.entry = s.e WHERE e < 3)
      SELECT * FROM s WHERE e = 3)"""


_AP = f"""SELECT query_id, round(total / 3, 9) AS average_precision FROM (WITH RECURSIVE h AS (SELECT query_id, rank, list(entry) AS l FROM ({HITS}) GROUP BY 1, 2), s AS (SELECT query_id, 0 AS k, CAST([] AS INTEGER[]) AS used, CAST(0 AS DOUBLE) AS total FROM ({QUERIES_OF})
  UNION ALL SELECT s.query_id, k + 1, CASE WHEN len(list_filter(l, lambda x: NOT list_contains(used, x))) > 0 THEN list_append(used, list_min(list_filter(l, lambda x: NOT list_contains(used, x)))) ELSE used END,
  total + CASE WHEN len(list_filter(l, lambda x: NOT list_contains(used, x))) > 0 THEN (len(used) + 1) / (k + 1) ELSE 0 END FROM s LEFT JOIN h ON h.query_id = s.query_id AND h.rank = s.k + 1 WHERE k < 10) SELECT * FROM s WHERE k = 10)"""
_STATES = f"""SELECT c.scenario, f.scorer, f.floor, c.case_id, CASE WHEN n % 4 < 2 THEN mean END AS score, CASE WHEN n % 4 < 2 THEN 'produced' WHEN n % 4 = 2 THEN 'errored' ELSE 'skipped' END AS state
  FROM (SELECT DISTINCT scenario, case_id FROM ({CASES}) WHERE task_error IS NULL) c JOIN ({FLOORS}) f ON c.scenario = f.scenario LEFT JOIN ({CASES}) x ON x.scenario = c.scenario AND x.case_id = c.case_id AND x.event_type = f.scorer"""
VERDICTS = f"""SELECT scenario, scorer, aggregate, n_produced, skipped, errored, CASE WHEN n_produced = 0 THEN CASE WHEN e > 0 AND s = 0 THEN 'all cases errored' WHEN s > 0 AND e = 0 THEN 'all cases skipped' ELSE 'every case errored or skipped' END WHEN aggregate < floor THEN 'below floor' END AS cause
  FROM (SELECT scenario, scorer, floor, avg(score) AS aggregate, count(score) AS n_produced, count(*) FILTER (WHERE state = 'skipped') AS s, count(*) FILTER (WHERE state = 'errored') AS e, coalesce(string_agg(case_id, ', ' ORDER BY case_id) FILTER (WHERE state = 'skipped'), '') AS skipped,
  coalesce(string_agg(case_id, ', ' ORDER BY case_id) FILTER (WHERE state = 'errored'), '') AS errored FROM ({_STATES}) GROUP BY 1, 2, 3)
  UNION ALL SELECT CAST(scenario AS BIGINT), scorer, NULL, 0, '', '', NULL FROM ({FLOORS}) WHERE scenario NOT IN (SELECT scenario FROM ({CASES}) WHERE task_error IS NULL)"""

QUERIES = {
    "e1_hits": hit_table, "e2_recall": scored("recall_5", "recall_10"), "e3_reciprocal_rank": scored("reciprocal_rank"), "e4_average_precision": scored("average_precision"), "e5_entity_precision": entity_precision, "e6_entity_tiers": entity_tiers,
    "e10_tool_arguments": tool_arguments, "e13_judge_scores": judge_scores, "e14_scorer_verdicts": scorer_verdicts, "e15_scenario_gate": scenario_gate, "e18_row_subset": chosen_rows, "e19_diagnostic_ids": diagnostic_ids, "e20_validation": validation, "e20_dataset_rows": dataset_rows, "e19_diagnostic_run": diagnostic_run,
}
ORACLE_SQL = {
    "e1_hits": HITS,
    "e2_recall": f"SELECT * FROM ({_sql_recall(5)}) JOIN ({_sql_recall(10)}) USING (query_id)",
    "e3_reciprocal_rank": f"SELECT query_id, coalesce(round(1.0 / r, 9), 0.0) AS reciprocal_rank FROM ({QUERIES_OF}) LEFT JOIN (SELECT query_id, min(rank) AS r FROM ({HITS}) GROUP BY 1) USING (query_id)",
    "e4_average_precision": _AP,
    "e5_entity_precision": f"""SELECT query_id, round(count(*) FILTER (WHERE rank <= 5 AND entity = target) / 5, 9) AS precision_5, round(count(*) FILTER (WHERE entity = target) / 10, 9) AS precision_10,
      any_value(mix) AS mix FROM (SELECT query_id, rank, vec_id % 5 AS entity, CAST(floor(query_id / 20) AS BIGINT) % 5 AS target FROM ({RANKED})) JOIN
      (SELECT query_id, string_agg('F' || entity || ':' || n, ' ' ORDER BY n DESC, entity) AS mix FROM (SELECT query_id, vec_id % 5 AS entity, count(*) AS n FROM ({RANKED}) GROUP BY 1, 2) GROUP BY 1) USING (query_id) GROUP BY 1""",
    "e6_entity_tiers": f"""SELECT target, round(m, 9) AS mean, round(s, 9) AS std, low, high, contaminants, CASE WHEN m <= 0.2 THEN 'weak' WHEN m <= 0.5 THEN 'middling' WHEN m = 1 THEN 'perfect' ELSE 'good' END AS tier FROM
      (SELECT target, avg(p) AS m, stddev_samp(p) AS s, min(p) AS low, max(p) AS high FROM (SELECT query_id, target, count(*) FILTER (WHERE entity = target) / 10 AS p FROM (SELECT query_id, vec_id % 5 AS entity, CAST(floor(query_id / 20) AS BIGINT) % 5 AS target FROM ({RANKED})) GROUP BY 1, 2) GROUP BY 1) JOIN
      (SELECT target, coalesce(string_agg(DISTINCT 'F' || entity, ' ' ORDER BY 'F' || entity) FILTER (WHERE entity <> target), '') AS contaminants FROM (SELECT query_id, vec_id % 5 AS entity, CAST(floor(query_id / 20) AS BIGINT) % 5 AS target FROM ({RANKED})) GROUP BY 1) USING (target)""",
    "e10_tool_arguments": """SELECT user_id AS case_id, CAST(1 - max(CAST(user_id % 2 = 0 AND (user_id % 3 <> 0 OR event_type = 'click') AND (value <= 0.5 OR event_id % 97 = 0) AS INTEGER)) AS DOUBLE) AS score FROM events GROUP BY 1""",
    "e13_judge_scores": "SELECT doc_id, CASE WHEN length(text) >= 40 THEN CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END END AS score FROM labels JOIN documents USING (doc_id)",
    "e14_scorer_verdicts": f"SELECT scenario, scorer, round(aggregate, 7) AS aggregate, n_produced, skipped, errored, cause FROM ({VERDICTS})",
    "e15_scenario_gate": f"""SELECT scenario, CASE WHEN f = '' THEN 'green' ELSE 'red' END AS status, f AS failures FROM (SELECT s.scenario, concat_ws('; ', CASE WHEN s.scenario NOT IN (SELECT scenario FROM ({FLOORS})) THEN 'no gated scorer' END,
      CASE WHEN s.scenario IN (SELECT scenario FROM ({FLOORS})) AND s.scenario NOT IN (SELECT scenario FROM ({CASES})) THEN 'no cases' END, CASE WHEN c > 0 THEN 'crashed: ' || c END, v) AS f FROM (SELECT DISTINCT user_id % 7 AS scenario FROM events) s
      LEFT JOIN (SELECT scenario, count(DISTINCT case_id) AS c FROM ({CASES}) WHERE task_error IS NOT NULL GROUP BY 1) x ON x.scenario = s.scenario
      LEFT JOIN (SELECT scenario, string_agg(scorer || ': ' || cause, '; ' ORDER BY scorer || ': ' || cause) AS v FROM ({VERDICTS}) WHERE cause IS NOT NULL GROUP BY 1) y ON y.scenario = s.scenario)""",
    "e18_row_subset": "SELECT pos, id, CASE WHEN pos = 4 THEN 'repeated' WHEN id IN (SELECT CAST(doc_id AS VARCHAR) FROM documents) THEN 'found' ELSE 'unknown' END AS status FROM (VALUES (0, '7'), (1, '3'), (2, '11'), (3, '999999999'), (4, '3')) t(pos, id)",
    "e19_diagnostic_ids": "SELECT doc_id, concat_ws('::', source, l, doc_id) AS diagnostic_id, NOT contains(source || ' ' || l, '::') AS valid FROM (SELECT doc_id, source, CASE WHEN doc_id % 50 = 0 THEN 'a::b' ELSE lang END AS l FROM documents)",
    "e19_diagnostic_run": """SELECT CAST(item_id AS VARCHAR) AS id, 'benchmark::baseline::' || item_id AS diagnostic_id, true AS is_full_dataset, '{"dataset_name":"benchmark","dataset_version":"v2","run_label":"baseline","agent_version":"a1","row_id":"' || item_id || '","is_full_dataset":true}' AS metadata,
      md5(text) AS text_md5 FROM benchmark""",
    "e20_dataset_rows": f"""WITH r AS (SELECT row_id, CASE WHEN paths = '' THEN CAST([] AS VARCHAR[]) WHEN json_valid(paths) AND json_type(paths) = 'ARRAY' THEN CAST(CAST(paths AS JSON) AS VARCHAR[]) END AS p, CASE WHEN snippets = '' THEN CAST([] AS VARCHAR[]) WHEN json_valid(snippets) AND json_type(snippets) = 'ARRAY' THEN CAST(CAST(snippets AS JSON) AS VARCHAR[]) END AS s
        FROM ({DATASET})), e AS (SELECT row_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS place, unnest(p) AS path, s FROM r WHERE p IS NOT NULL AND s IS NOT NULL), x AS (SELECT row_id, place, path, nullif(s[place + 1], '') AS snippet FROM e)
      SELECT row_id, CAST(NULL AS INTEGER) AS place, CASE WHEN p IS NULL OR s IS NULL THEN 'malformed' ELSE 'skipped' END AS status FROM r WHERE p IS NULL OR s IS NULL OR len(p) = 0 UNION ALL
      SELECT row_id, place, CASE WHEN count(*) FILTER (WHERE starts_with(header_path, path)) > 0 THEN CASE WHEN any_value(snippet) IS NULL OR count(*) FILTER (WHERE starts_with(header_path, path) AND contains(lower(text), lower(snippet))) > 0 THEN 'ok' ELSE 'no snippet' END
        WHEN count(*) FILTER (WHERE starts_with(lower(header_path), lower(path))) > 0 THEN 'near miss' ELSE 'failed' END FROM x LEFT JOIN ({STORE}) ON true GROUP BY row_id, place, path""",
    "e20_validation": """SELECT item_id, CASE WHEN bool_or(u AND contains(text, snippet)) THEN 'pass' WHEN bool_or(u AND contains(lower(text), lower(snippet))) THEN 'near miss' WHEN bool_or(u) THEN 'no snippet' ELSE 'no path' END AS status FROM
      (SELECT b.*, c.text, coalesce(starts_with(c.header_path, b.path), false) AS u FROM (SELECT item_id, 'F' || item_id % 6 || ' / 2024 / Item ' || item_id % 4 AS path, CASE item_id % 3 WHEN 0 THEN 'Chunk 1' WHEN 1 THEN 'chunk 1' ELSE 'none' END AS snippet FROM benchmark) b
      LEFT JOIN (SELECT 'F' || vec_id % 5 || ' / 2024 / Item ' || vec_id % 3 || '. T' AS header_path, 'Chunk ' || vec_id AS text FROM embeddings) c ON true) GROUP BY 1""",
}
