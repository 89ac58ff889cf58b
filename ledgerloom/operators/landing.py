"""Landings, stores and sinks: typed cells and datasets, tickers, provider payloads, result tables, latest filings, work lists, ownership and identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cosine
from ..sources import auto_typed, dataset, derived, mapped, number, reject_reason, save, scan, ticker
from ..streaming.sessions import folder
from . import corpus
from .fundamentals import QF_SQL, merge_columns, quarterly

#: Names of a provider's metrics, and ours.
METRICS = {
    "52WeekHigh": "fiftyTwoWeekHigh",
    "52WeekLow": "fiftyTwoWeekLow",
    "peTTM": "peTTM",
    "forwardPE": "forwardPE",
    "psTTM": "psTTM",
    "pbQuarterly": "pb",
    "marketCapitalization": "marketCap",
    "enterpriseValue": "enterpriseValue",
    "beta": "beta",
    "epsTTM": "epsTTM",
    "roeTTM": "roeTTM",
    "roaTTM": "roaTTM",
    "grossMarginTTM": "grossMarginTTM",
    "netProfitMarginTTM": "netProfitMarginTTM",
    "operatingMarginTTM": "operatingMarginTTM",
    "currentRatioQuarterly": "currentRatio",
    "quickRatioQuarterly": "quickRatio",
    "totalDebt/totalEquityQuarterly": "debtToEquity",
    "dividendYieldIndicatedAnnual": "dividendYield",
    "revenueGrowthTTMYoy": "revenueGrowthTTMYoy",
    "epsGrowthTTMYoy": "epsGrowthTTMYoy",
    "10DayAverageTradingVolume": "tenDayAvgVolume",
}
QUOTE = {"c": "currentPrice", "o": "open", "pc": "previousClose", "d": "change", "dp": "percentChange", "h": "dayHigh", "l": "dayLow"}
UNIVERSE = ["building", "Machinery", "AUTOMOBILE"]

CELLS = "SELECT event_id, CASE event_id % 9 WHEN 0 THEN '' WHEN 1 THEN 'TRUE' WHEN 2 THEN 'false' WHEN 3 THEN concat(event_id, '.5') WHEN 4 THEN '1_000' WHEN 5 THEN '1d' WHEN 6 THEN '  ' WHEN 7 THEN ' -2e3 ' ELSE props END AS cell FROM events"
QUOTES = """SELECT event_id, concat('{"c":', CASE WHEN event_id % 5 = 0 THEN '0' WHEN event_id % 7 = 0 THEN 'null' ELSE concat(event_id, '.25') END, ',"pc":', CASE WHEN event_id % 10 = 0 THEN '0' WHEN event_id % 3 = 0 THEN 'null' ELSE '7.5' END, ',"o":1.5,"h":2,"l":null,"t":', event_id, '}') AS payload FROM events"""
PAYLOADS = """SELECT p_partkey, concat('{"52WeekHigh":', p_size, '.5,"peTTM":', CASE WHEN p_partkey % 3 = 0 THEN 'null' ELSE concat(p_size, '.25') END, ',"totalDebt/totalEquityQuarterly":2.5,"unknown":1}') AS payload FROM part WHERE p_partkey % 5 > 0 UNION ALL SELECT p_partkey, '{"peTTM":null,"unknown":3}' FROM part WHERE p_partkey % 5 = 0"""
FILINGS = """SELECT o_custkey AS company, CASE WHEN o_custkey % 10 = 1 THEN '20-F' WHEN o_custkey % 10 = 2 THEN '10-Q' WHEN o_orderpriority LIKE '1%' THEN '10-K/A' ELSE '10-K' END AS form, CAST(o_orderdate AS DATE) AS filing_date, o_orderkey AS accession FROM orders"""


def typed_cells(spark, sf_dir: str) -> DataFrame:
    cells = derived(spark, sf_dir, CELLS, "events")
    return cells.select("event_id", *(c.alias(n) for n, c in auto_typed(F.col("cell")).items()))


def cell_rejects(spark, sf_dir: str) -> DataFrame:
    """Each cell against each declared kind; the value is given only where it is of the kind."""
    cell = F.col("cell")
    cells = derived(spark, sf_dir, CELLS, "events")
    return cells.select("event_id", *(reject_reason(cell, k).alias(f"as_{k}") for k in ("json", "str", "float", "bool")), F.when(cell != "", number(cell)).alias("value"))


def mapped_rows(spark, sf_dir: str) -> DataFrame:
    """Events in the form input, expected, metadata; the plain ``expected`` gives way to the object."""
    targets = {"user_id": "input.user.id", "event_type": "expected", "props": "expected.raw", "event_id": "metadata.row"}
    e = scan(spark, sf_dir, "events")
    return e.select("event_id", *(F.to_json(c).alias(n) for n, c in mapped(targets).items()))


def csv_round_trip(spark, sf_dir: str) -> DataFrame:
    """Documents written as a CSV dataset and read by the loader: line breaks, quotes and blanks come back."""
    path = f"{folder(spark)}/dataset"
    scan(spark, sf_dir, "documents").select("doc_id", "lang", "text").write.csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return dataset(spark, path, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def run_log(spark, sf_dir: str) -> DataFrame:
    """The audit log after a run for each event type and day was appended, success or error; counters and metadata stay on error. An append writes new files and never reads the log."""
    e = scan(spark, sf_dir, "events")
    bad = F.col("value") > 150
    runs = e.groupBy(F.col("event_type").alias("pipeline"), F.to_date("ts").alias("run_day")).agg(F.date_format(F.min("ts"), "HH:mm:ss").alias("started"), F.date_format(F.max("ts"), "HH:mm:ss").alias("finished"), F.count("*").alias("rows_written"), F.min(F.when(bad, F.col("event_id"))).alias("bad_id"), F.max("event_id").alias("last_id"))
    status = F.when(F.col("bad_id").isNull(), "success").otherwise("error")
    runs = runs.select("pipeline", "run_day", "started", "finished", "rows_written", status.alias("status"), F.when(F.col("bad_id").isNotNull(), F.concat(F.lit("ValueTooLarge: "), F.col("bad_id"))).alias("error"), F.to_json(F.struct("last_id")).alias("metadata"))
    path = f"{folder(spark)}/runs"
    for half in ("day(run_day) <= 15", "day(run_day) > 15"):
        runs.where(half).write.mode("append").partitionBy("status").parquet(path)
    return spark.read.parquet(path).select("pipeline", "run_day", "started", "finished", "rows_written", "status", "error", "metadata")


def filing_rows(spark, sf_dir: str) -> DataFrame:
    o = scan(spark, sf_dir, "orders")
    return o.groupBy(F.concat(F.lit("c"), F.col("o_custkey") % 10).alias("ticker"), F.year("o_orderdate").alias("fiscal_year")).agg(F.count("*").alias("n"))


def stored_filings(spark, sf_dir: str) -> DataFrame:
    """A store by ticker and year that is written twice: the second write replaces its keys and leaves the others."""
    path = f"{folder(spark)}/store"
    rows = filing_rows(spark, sf_dir).withColumn("ticker", ticker(F.col("ticker")))
    save(rows.withColumn("version", F.lit(1)), path, ["ticker", "fiscal_year"])
    save(rows.where("fiscal_year >= 1996").withColumn("version", F.lit(2)), path, ["ticker", "fiscal_year"])
    return spark.read.parquet(path).select("ticker", "fiscal_year", "n", "version")


def existing(spark, sf_dir: str) -> DataFrame:
    """Which requests (every customer's ticker in 1995 and 2001) are in the store."""
    ask = scan(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("c"), F.col("c_custkey") % 12).alias("ticker"), F.explode(F.array(F.lit(1995), F.lit(2001))).alias("fiscal_year"))
    have = filing_rows(spark, sf_dir).select("ticker", "fiscal_year", F.lit(True).alias("have"))
    return ask.join(have, ["ticker", "fiscal_year"], "left").select("c_custkey", "fiscal_year", F.coalesce("have", F.lit(False)).alias("exists"))


def raw_tickers(spark, sf_dir: str) -> DataFrame:
    c = scan(spark, sf_dir, "customer")
    end = F.element_at(F.array(*map(F.lit, ("", ".b", "-c", " x", "!"))), (F.col("c_custkey") % 5 + 1).cast("int"))
    return c.select("c_custkey", F.concat(F.lit(" "), F.lower("c_mktsegment"), end, F.lit(" ")).alias("raw"))


def valid_tickers(spark, sf_dir: str) -> DataFrame:
    t = ticker(F.col("raw"))
    return raw_tickers(spark, sf_dir).select("c_custkey", t.alias("ticker"), t.isNull().alias("rejected"))


def in_universe(spark, sf_dir: str, universe: list[str] = UNIVERSE) -> DataFrame:
    """Customers whose segment is in a given list of names, whatever their case; an empty name is an error."""
    if any(not u.strip() for u in universe):
        raise ValueError("names must not be empty")
    return scan(spark, sf_dir, "customer").where(F.upper("c_mktsegment").isin(*(u.upper() for u in universe))).select("c_custkey", F.upper("c_mktsegment").alias("ticker"))


def chunk_store(spark, sf_dir: str) -> DataFrame:
    """Chunks and commit markers of all documents in one table, as a store holds them."""
    chunks = corpus.chunk_ids(spark, sf_dir)
    markers = chunks.select("doc_id", F.lit(-1).alias("chunk_index"), F.col("marker_id").alias("point_id")).distinct()
    return chunks.select("doc_id", "chunk_index", "point_id").unionByName(markers).withColumn("is_marker", F.col("chunk_index") < 0)


def content_scan(spark, sf_dir: str) -> DataFrame:
    """The whole store without its markers; a search never returns one."""
    return chunk_store(spark, sf_dir).where("not is_marker").select("doc_id", "chunk_index", "point_id")


def rerun(spark, sf_dir: str) -> DataFrame:
    """Points of each slice of documents after the store was written twice: as many as different ids."""
    path = f"{folder(spark)}/points"
    points = chunk_store(spark, sf_dir).withColumn("slice", F.col("doc_id") % 8)
    for _ in range(2):
        save(points, path, ["slice"])
    return spark.read.parquet(path).groupBy(F.col("slice").cast("long").alias("slice")).agg(F.count("*").alias("n_points"), F.count_distinct("point_id").alias("n_ids"))


def result_table(rows: DataFrame, original: list[str], output: str, scores: str, errors: str, failed: str, scorers: list[str], run: dict[str, str] | None = None) -> DataFrame:
    """A results table: the original columns, ``output.*`` fields (``_generated.`` before a name that is taken), output_json, a ``score_`` column a scorer, and the values of ``run``, which
    every row has, such as experiment_name and version.

    ERROR stands in a crashed row and where a scorer failed, SKIPPED where it gave nothing.
    """
    fields = rows.schema[output].dataType.names
    name = lambda k: f"_generated.output.{k}" if f"output.{k}" in original else f"output.{k}"
    crashed = F.col(failed)
    out = [F.when(crashed, "ERROR").otherwise(F.coalesce(F.col(output)[k].cast("string"), F.lit(""))).alias(name(k)) for k in fields]
    score = lambda s: F.when(crashed, "ERROR").when(F.try_element_at(F.col(scores), F.lit(s)).isNotNull(), F.try_element_at(F.col(scores), F.lit(s)).cast("string")).when(F.array_contains(errors, s), "ERROR").otherwise("SKIPPED")
    return rows.select(*(F.col(f"`{c}`") for c in original), *out, F.when(crashed, "").otherwise(F.to_json(output)).alias("output_json"), *(score(s).alias(f"score_{s}") for s in scorers), *(F.lit(v).alias(name(k) if k in original else k) for k, v in (run or {}).items()))


def results(spark, sf_dir: str, run: dict[str, str] | None = None) -> DataFrame:
    e = scan(spark, sf_dir, "events")
    kind = F.col("event_type")
    by = e.groupBy(F.col("user_id").alias("case_id")).agg(F.count("*").alias("n"), F.count_if(kind == "click").alias("clicks"), F.count_if(kind == "view").alias("views"), F.min("event_id").alias("first"))
    scores = F.map_filter(F.create_map(F.lit("click"), F.col("clicks"), F.lit("view"), F.col("views")), lambda k, v: v % 2 == 0)
    errors = F.when(F.col("n") % 3 == 0, F.array(F.lit("click"))).otherwise(F.array().cast("array<string>"))
    rows = by.select("case_id", F.col("n").alias("output.n"), F.struct("n", "first").alias("output"), scores.alias("scores"), errors.alias("errors"), (F.col("case_id") % 11 == 0).alias("failed"))
    return result_table(rows, ["case_id", "output.n"], "output", "scores", "errors", "failed", ["click", "view"], run)


def versioned_results(spark, sf_dir: str) -> DataFrame:
    """The results table of a named experiment and version, written as CSV and read again as text."""
    path = f"{folder(spark)}/results"
    results(spark, sf_dir, {"experiment_name": "baseline, \"a\"", "version": "73faf5f"}).write.csv(path, header=True, quote='"', escape='"', emptyValue="")
    rows = dataset(spark, path, ["case_id", "output_json", "experiment_name", "version"])
    return rows.select("case_id", "`output.n`", F.coalesce("output_json", F.lit("")).alias("output_json"), "score_click", "score_view", "experiment_name", "version")


def quotes(spark, sf_dir: str) -> DataFrame:
    """Typed quotes of a provider's payloads; those without a current and a previous price (0 or null) are rejected."""
    q = derived(spark, sf_dir, QUOTES, "events").select("event_id", F.from_json("payload", ", ".join(f"{k} double" for k in QUOTE)).alias("q"))
    none = (F.coalesce("q.c", F.lit(0.0)) == 0) & (F.coalesce("q.pc", F.lit(0.0)) == 0)
    return q.select("event_id", *(F.when(~none, F.col(f"q.{k}")).alias(n) for k, n in QUOTE.items()), none.alias("rejected"))


def metrics(spark, sf_dir: str) -> DataFrame:
    """(p_partkey, metric, value) under our names; nulls and unknown metrics are dropped."""
    names = F.create_map(*(x for k, v in METRICS.items() for x in (F.lit(k), F.lit(v))))
    m = derived(spark, sf_dir, PAYLOADS, "part").select("p_partkey", F.explode(F.from_json("payload", "map<string,double>")).alias("key", "value"))
    return m.select("p_partkey", names[F.col("key")].alias("metric"), "value").where("metric is not null and value is not null")


def metric_rejects(spark, sf_dir: str) -> DataFrame:
    """(p_partkey, reason): payloads that leave no metric: unreadable ones, and those without a known metric that has a value."""
    payload = F.from_json("payload", "map<string,double>")
    known = F.map_filter(payload, lambda k, v: k.isin(*METRICS) & v.isNotNull())
    reason = F.when(payload.isNull(), "unreadable").when(F.size(known) == 0, "no metrics")
    return derived(spark, sf_dir, PAYLOADS, "part").select("p_partkey", reason.alias("reason")).where("reason is not null")


def latest_filings(filings: DataFrame) -> DataFrame:
    """(company, status, fiscal_year): the year of the period of each company's latest annual report, without amendments; companies with only foreign reports are unsupported."""
    by = filings.groupBy("company").agg(F.max_by("period", F.when(F.col("form") == "10-K", F.struct("filing_date", "accession"))).alias("period"), F.bool_or(F.col("form") == "10-K").alias("has"), F.bool_or(F.col("form") == "20-F").alias("foreign"))
    status = F.when(F.col("has"), "found").when(F.col("foreign"), "unsupported").otherwise("not found")
    return by.select("company", status.alias("status"), F.when(F.col("has"), F.year("period")).alias("fiscal_year"))


def filing_index(spark, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, FILINGS, "orders").withColumn("period", F.date_sub("filing_date", 50))


def latest(spark, sf_dir: str) -> DataFrame:
    return latest_filings(filing_index(spark, sf_dir))


def work_list(requests: DataFrame, complete: DataFrame, stored: DataFrame) -> DataFrame:
    """``requests`` (company, fiscal_year) with what to do: search where chunks are complete, else embed what is stored, else fetch and embed."""
    mark = lambda d, n: d.select("company", "fiscal_year").distinct().withColumn(n, F.lit(True))
    both = requests.join(mark(complete, "complete"), ["company", "fiscal_year"], "left").join(mark(stored, "stored"), ["company", "fiscal_year"], "left")
    return both.select("company", "fiscal_year", F.when(F.col("complete"), "search").when(F.col("stored"), "embed").otherwise("fetch and embed").alias("action"))


def planned(spark, sf_dir: str) -> DataFrame:
    """What to do for each company's latest year, or for 1995 where it has none; orders that are closed count as complete."""
    ask = latest(spark, sf_dir).select("company", F.coalesce("fiscal_year", F.lit(1995)).alias("fiscal_year"))
    o = scan(spark, sf_dir, "orders").select(F.col("o_custkey").alias("company"), F.year("o_orderdate").alias("fiscal_year"), "o_orderstatus")
    return work_list(ask, o.where("o_orderstatus = 'F'"), o)


def latest_scope(spark, sf_dir: str, k: int = 3) -> DataFrame:
    """The ``k`` vectors of each label's latest year that are nearest to the label's first vector; the year is resolved before the search."""
    e = scan(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label", (2018 + F.col("vec_id") % 7).alias("year"))
    scope = e.groupBy("label").agg(F.max("year").alias("year"), F.min_by("embedding", "vec_id").alias("q"))
    scored = e.join(scope, ["label", "year"]).select("label", "year", "vec_id", F.round(cosine(F.col("embedding"), F.col("q")), 9).alias("score"))
    scored = scored.withColumn("salt", F.pmod("vec_id", F.lit(32)))
    for keys in (["label", "salt"], ["label"]):  # each salt keeps its best, so no label is ranked whole by one task
        scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return scored.select("label", "year", "vec_id", "score", "rank")


def two_feeds(spark, sf_dir: str) -> DataFrame:
    """Two feeds that own different columns of the quarters; in either order the table is the same."""
    base = quarterly(spark, sf_dir).drop("period_end", "n_lines")
    key = ["company", "fiscal_year", "fiscal_quarter"]
    one = base.where("fiscal_quarter in (1, 2)").select(*key, F.when(F.col("units") > 500, F.col("units") * 2).alias("units"))
    two = base.where("fiscal_quarter in (2, 3)").select(*key, (F.col("gross_cents") + 1).alias("gross_cents"))
    ab = merge_columns(merge_columns(base, one, key, ["units"]), two, key, ["gross_cents"])
    ba = merge_columns(merge_columns(base, two, key, ["gross_cents"]), one, key, ["units"])
    other = ba.select(*key, F.struct("gross_cents", "units").alias("other"))
    return ab.join(other, key).select(*key, "gross_cents", "units", (F.struct("gross_cents", "units") == F.col("other")).alias("same"))


def broken_identities(df: DataFrame, key: list[str], identities: dict[str, tuple[Column, Column]], tolerance: int) -> DataFrame:
    """(key, identity, off): where the two sides of an accounting identity differ by more than ``tolerance``; a null side breaks none."""
    each = F.array(*(F.struct(F.lit(n).alias("identity"), (a - b).alias("off")) for n, (a, b) in identities.items()))
    return df.select(*key, F.inline(each)).where(F.abs("off") > tolerance)


def identities(spark, sf_dir: str) -> DataFrame:
    """Net is gross less discounts, and charge is net plus tax, by order within two hundredths: lines are rounded one by one."""
    cents = lambda x: F.sum(F.floor(x * 100 + 0.5).cast("long"))
    price, off, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    by = scan(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(cents(price).alias("gross"), cents(price * off).alias("discount"), cents(price * (1 - off)).alias("net"), cents(price * (1 - off) * tax).alias("tax"), cents(price * (1 - off) * (1 + tax)).alias("charge"))
    c = F.col
    return broken_identities(by, ["l_orderkey"], {"net = gross - discount": (c("net"), c("gross") - c("discount")), "charge = net + tax": (c("charge"), c("net") + c("tax"))}, 2)


def ratios(spark, sf_dir: str) -> DataFrame:
    """Price to trailing sales and sales a unit of the last four quarters; null until there are four in a row, and where the divisor is 0."""
    q = quarterly(spark, sf_dir).withColumn("place", F.col("fiscal_year") * 4 + F.col("fiscal_quarter"))
    w = Window.partitionBy("company").orderBy("place").rangeBetween(-3, 0)
    whole = F.count("*").over(w) == 4
    sales, units = F.when(whole, F.sum("gross_cents").over(w)), F.when(whole, F.sum("units").over(w))
    value = F.col("n_lines") * 1_000_000
    over = lambda a, b: F.round(F.when(b != 0, a / b), 9)
    return q.select("company", "fiscal_year", "fiscal_quarter", over(value, sales).alias("price_to_sales"), over(sales, units).alias("sales_per_unit"))


_CELL = f"SELECT event_id, cell, cell <> '' AS filled, CASE lower(cell) WHEN 'true' THEN true WHEN 'false' THEN false END AS flag, CASE WHEN regexp_matches(cell, '(?i)^\\s*[+-]?(?:\\d[\\d_]*\\.?\\d*|\\.\\d+)(?:e[+-]?\\d+)?\\s*$') THEN try_cast(replace(trim(cell), '_', '') AS DOUBLE) END AS number FROM ({CELLS})"
_FILED = f"SELECT *, filing_date - 50 AS period FROM ({FILINGS})"
LATEST = f"""SELECT company, CASE WHEN bool_or(form = '10-K') THEN 'found' WHEN bool_or(form = '20-F') THEN 'unsupported' ELSE 'not found' END AS status, CAST(year(first(period ORDER BY filing_date DESC, accession DESC) FILTER (WHERE form = '10-K')) AS INTEGER) AS fiscal_year FROM ({_FILED}) GROUP BY 1"""
_TICKER = "upper(trim(' ' || lower(c_mktsegment) || (['', '.b', '-c', ' x', '!'])[c_custkey % 5 + 1] || ' '))"
_ROWS = "SELECT 'c' || o_custkey % 10 AS ticker, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year, count(*) AS n FROM orders GROUP BY 1, 2"
_CENTS = "CAST(sum(CAST(floor(({}) * 100 + 0.5) AS BIGINT)) AS BIGINT)"
_SCORE = "CASE WHEN case_id % 11 = 0 THEN 'ERROR' WHEN {0} % 2 = 0 THEN CAST({0} AS VARCHAR) WHEN {1} THEN 'ERROR' ELSE 'SKIPPED' END"
_Q = " , ".join(f"CASE WHEN NOT r THEN CAST(json_extract_string(payload, '$.{k}') AS DOUBLE) END AS {n}" for k, n in QUOTE.items())
_IDS = "SELECT doc_id, source, CAST(unnest(range(0, CAST(greatest(ceil((len(string_split(text, ' ')) - 50) / 462.0), 1) AS BIGINT))) AS INTEGER) AS chunk_index FROM documents"

QUERIES = {
    "s1_csv_dataset": csv_round_trip, "s2_auto_typed": typed_cells, "s3_declared_types": cell_rejects, "s4_mapped_rows": mapped_rows, "s5_filing_store": stored_filings, "s6_exists": existing, "s7_tickers": valid_tickers, "s8_universe": in_universe, "s9_content_scan": content_scan,
    "s10_result_table": results, "s11_quotes": quotes, "s12_metrics": metrics, "s12_metric_rejects": metric_rejects, "s10_versioned_results": versioned_results, "t19_latest_filings": latest, "t21_work_list": planned, "r3_latest_scope": latest_scope, "c11_rerun": rerun, "f5_run_log": run_log, "f3_two_feeds": two_feeds, "f8_identities": identities, "f9_ratios": ratios,
}
ORACLE_SQL = {
    "s1_csv_dataset": "SELECT doc_id, md5(text) AS text_md5 FROM documents",
    "s2_auto_typed": f"SELECT event_id, CASE WHEN filled THEN flag END AS as_bool, CASE WHEN filled THEN number END AS as_double, CASE WHEN filled AND flag IS NULL AND number IS NULL THEN cell END AS as_string FROM ({_CELL})",
    "s3_declared_types": f"SELECT event_id, CASE WHEN filled AND NOT json_valid(cell) THEN 'not json' END AS as_json, CAST(NULL AS VARCHAR) AS as_str, CASE WHEN filled AND number IS NULL THEN 'not float' END AS as_float, CASE WHEN filled AND flag IS NULL THEN 'not bool' END AS as_bool, CASE WHEN filled THEN number END AS value FROM ({_CELL})",
    "s4_mapped_rows": """SELECT event_id, '{"user":{"id":' || user_id || '}}' AS input, CAST(json_object('raw', props) AS VARCHAR) AS expected, '{"row":' || event_id || '}' AS metadata FROM events""",
    "s5_filing_store": f"SELECT upper(ticker) AS ticker, fiscal_year, n, CASE WHEN fiscal_year >= 1996 THEN 2 ELSE 1 END AS version FROM ({_ROWS})",
    "s6_exists": f"SELECT c_custkey, a.fiscal_year, n IS NOT NULL AS exists FROM (SELECT c_custkey, 'c' || c_custkey % 12 AS ticker, unnest([1995, 2001]) AS fiscal_year FROM customer) a LEFT JOIN ({_ROWS}) r ON a.ticker = r.ticker AND a.fiscal_year = r.fiscal_year",
    "s7_tickers": f"SELECT c_custkey, CASE WHEN ok THEN t END AS ticker, NOT ok AS rejected FROM (SELECT c_custkey, {_TICKER} AS t, regexp_matches({_TICKER}, '^[A-Z0-9][A-Z0-9.\\-]*$') AS ok FROM customer)",
    "s8_universe": "SELECT c_custkey, upper(c_mktsegment) AS ticker FROM customer WHERE upper(c_mktsegment) IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE')",
    "s9_content_scan": f"SELECT doc_id, chunk_index, point_id FROM ({corpus.IDS_SQL})",
    "s10_result_table": f"""SELECT case_id, n AS "output.n", CASE WHEN case_id % 11 = 0 THEN 'ERROR' ELSE CAST(n AS VARCHAR) END AS "_generated.output.n", CASE WHEN case_id % 11 = 0 THEN 'ERROR' ELSE CAST(first AS VARCHAR) END AS "output.first",
      CASE WHEN case_id % 11 = 0 THEN '' ELSE '{{"n":' || n || ',"first":' || first || '}}' END AS output_json, {_SCORE.format("clicks", "n % 3 = 0")} AS score_click, {_SCORE.format("views", "false")} AS score_view
      FROM (SELECT user_id AS case_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'view') AS views, min(event_id) AS first FROM events GROUP BY 1)""",
    "s11_quotes": f"SELECT event_id, {_Q}, r AS rejected FROM (SELECT *, coalesce(CAST(json_extract_string(payload, '$.c') AS DOUBLE), 0) = 0 AND coalesce(CAST(json_extract_string(payload, '$.pc') AS DOUBLE), 0) = 0 AS r FROM ({QUOTES}))",
    "s12_metrics": """SELECT p_partkey, metric, value FROM (SELECT p_partkey, unnest(['fiftyTwoWeekHigh', 'peTTM', 'debtToEquity']) AS metric, unnest([p_size + 0.5, CASE WHEN p_partkey % 3 > 0 THEN p_size + 0.25 END, 2.5]) AS value FROM part WHERE p_partkey % 5 > 0) WHERE value IS NOT NULL""",
    "s12_metric_rejects": "SELECT p_partkey, 'no metrics' AS reason FROM part WHERE p_partkey % 5 = 0",
    "s10_versioned_results": f"""SELECT CAST(case_id AS VARCHAR) AS case_id, CAST(n AS VARCHAR) AS "output.n", CASE WHEN case_id % 11 = 0 THEN '' ELSE '{{"n":' || n || ',"first":' || first || '}}' END AS output_json, {_SCORE.format("clicks", "n % 3 = 0")} AS score_click, {_SCORE.format("views", "false")} AS score_view,
      'baseline, "a"' AS experiment_name, '73faf5f' AS version FROM (SELECT user_id AS case_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'view') AS views, min(event_id) AS first FROM events GROUP BY 1)""",
    "t19_latest_filings": LATEST,
    "t21_work_list": f"""SELECT company, y AS fiscal_year, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = company AND year(o_orderdate) = y AND o_orderstatus = 'F') THEN 'search' WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = company AND year(o_orderdate) = y) THEN 'embed' ELSE 'fetch and embed' END AS action
      FROM (SELECT company, coalesce(fiscal_year, 1995) AS y FROM ({LATEST}))""",
    "r3_latest_scope": """WITH e AS (SELECT vec_id, embedding, label, 2018 + vec_id % 7 AS year FROM embeddings), s AS (SELECT label, max(year) AS year, arg_min(embedding, vec_id) AS q FROM e GROUP BY 1),
      c AS (SELECT e.label, e.year, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 9) AS score FROM e JOIN s ON e.label = s.label AND e.year = s.year)
      SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM c) WHERE rank <= 3""",
    "c11_rerun": f"SELECT slice, sum(n) + count(*) AS n_points, sum(n) + count(*) AS n_ids FROM (SELECT doc_id % 8 AS slice, doc_id, count(*) AS n FROM ({_IDS}) GROUP BY 1, 2) GROUP BY 1",
    "f5_run_log": """SELECT pipeline, run_day, started, finished, rows_written, CASE WHEN b IS NULL THEN 'success' ELSE 'error' END AS status, 'ValueTooLarge: ' || b AS error, '{"last_id":' || l || '}' AS metadata FROM (SELECT event_type AS pipeline, CAST(ts AS DATE) AS run_day,
      strftime(min(ts), '%H:%M:%S') AS started, strftime(max(ts), '%H:%M:%S') AS finished, count(*) AS rows_written, min(CASE WHEN value > 150 THEN event_id END) AS b, max(event_id) AS l FROM events GROUP BY 1, 2)""",
    "f3_two_feeds": f"""SELECT company, fiscal_year, fiscal_quarter, CASE WHEN fiscal_quarter IN (2, 3) THEN gross_cents + 1 ELSE gross_cents END AS gross_cents, CASE WHEN fiscal_quarter IN (1, 2) THEN CASE WHEN units > 500 THEN units * 2 END ELSE units END AS units, true AS same FROM ({QF_SQL})""",
    "f8_identities": f"""SELECT l_orderkey, identity, off FROM (SELECT l_orderkey, unnest(['net = gross - discount', 'charge = net + tax']) AS identity, unnest([net - (gross - discount), charge - (net + tax)]) AS off FROM
      (SELECT l_orderkey, {_CENTS.format("l_extendedprice")} AS gross, {_CENTS.format("l_extendedprice * l_discount")} AS discount, {_CENTS.format("l_extendedprice * (1 - l_discount)")} AS net, {_CENTS.format("l_extendedprice * (1 - l_discount) * l_tax")} AS tax, {_CENTS.format("l_extendedprice * (1 - l_discount) * (1 + l_tax)")} AS charge FROM lineitem GROUP BY 1)) WHERE abs(off) > 2""",
    "f9_ratios": f"""SELECT company, fiscal_year, fiscal_quarter, round(n_lines * 1000000 / nullif(s, 0), 9) AS price_to_sales, round(s / nullif(u, 0), 9) AS sales_per_unit FROM (SELECT *, CASE WHEN count(*) OVER w = 4 THEN sum(gross_cents) OVER w END AS s, CASE WHEN count(*) OVER w = 4 THEN sum(units) OVER w END AS u
      FROM ({QF_SQL}) WINDOW w AS (PARTITION BY company ORDER BY fiscal_year * 4 + fiscal_quarter RANGE BETWEEN 3 PRECEDING AND CURRENT ROW))""",
}
