"""Reports and gates over scored runs: spread by entity, floors, verdicts, case identity, health of executions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import scan
from .retrieval import RANKED, ranked

FLOOR = 50.0


def entity_report(spark, sf_dir: str) -> DataFrame:
    """Mean, sample deviation, least, greatest value and tier by entity (event type)."""
    by = scan(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"), F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"))
    tier = F.when(F.col("m") <= 49, "weak").when(F.col("m") <= 51, "middling").otherwise("strong")
    return by.select("event_type", F.round("m", 6).alias("mean_value"), F.round("s", 6).alias("std_value"), "low", "high", "n", tier.alias("tier"))


def gate(scores: DataFrame, keys: list[str], score: Column, floor: Column) -> DataFrame:
    """Per scorer: mean of the produced scores against its floor; skipped (null) scores count apart, none produced fails."""
    by = scores.groupBy(*keys).agg(F.count(score).alias("n_produced"), F.sum(score.isNull().cast("long")).alias("n_skipped"), F.avg(score).alias("m"), F.max(floor).alias("f"))
    return by.select(*keys, "n_produced", "n_skipped", F.coalesce(F.col("m") >= F.col("f"), F.lit(False)).alias("passed"))


def scorer_gates(spark, sf_dir: str) -> DataFrame:
    e = scan(spark, sf_dir, "events").where("event_type <> 'error'")
    return gate(e, ["user_id", "event_type"], F.when(F.col("value") > 1, F.col("value")), F.lit(FLOOR))


def scenario_gates(spark, sf_dir: str) -> DataFrame:
    """A user's scenario is green only when all its scorers pass; the failing ones are listed."""
    by = scorer_gates(spark, sf_dir).groupBy("user_id").agg(F.bool_and("passed").alias("green"), F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("event_type")))).alias("f"))
    return by.select("user_id", "green", F.array_join("f", ",").alias("failing"))


def floors(spark, sf_dir: str) -> DataFrame:
    """Floor by part brand: least price in whole hundredths less 0.20, rounded down to a multiple of 0.05; flagged where it tells nothing, at 0.20 or less."""
    p = scan(spark, sf_dir, "part").groupBy("p_brand").agg((F.min(F.round(F.col("p_retailprice") * 100).cast("long"))).alias("cents"))
    floor = F.floor((F.col("cents") - 20) / 5).cast("long") * 5
    return p.select("p_brand", floor.alias("floor_cents"), (floor <= 20).alias("flagged"))


def case_ids(spark, sf_dir: str) -> DataFrame:
    """Case id: the page's url host, else ``case-NN`` by place (two digits or more); ids that occur twice are listed with how often."""
    p = scan(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://([^/?#]*)", 1).alias("host"), "page_id")
    name = F.when((F.col("host") != "") & (F.col("page_id") % 2 == 0), F.col("host")).otherwise(F.concat(F.lit("case-"), F.format_string("%02d", F.col("page_id") + 1)))
    return p.groupBy(name.alias("case_id")).agg(F.count("*").alias("n")).where("n > 1")


def execution_health(spark, sf_dir: str) -> DataFrame:
    """By user and day: finished (a purchase), failing calls, and healthy: finished without one."""
    e = scan(spark, sf_dir, "events")
    by = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n_calls"), F.sum((F.col("event_type") == "error").cast("long")).alias("n_errors"), F.bool_or(F.col("event_type") == "purchase").alias("finished"))
    return by.withColumn("healthy", F.col("finished") & (F.col("n_errors") == 0))


def expected_call(spark, sf_dir: str) -> DataFrame:
    """Whether a user's session made the expected call (by segment of ids); null where none is expected."""
    calls = scan(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("made"))
    expected = F.when(F.col("user_id") % 3 == 0, F.lit("purchase")).when(F.col("user_id") % 3 == 1, F.lit("signup"))
    return calls.select("user_id", F.array_contains("made", expected).alias("called"))


def arm_comparison(spark, sf_dir: str) -> DataFrame:
    """Two arms rank by rank: all neighbours against the even-numbered ones, ranked anew; either may end first."""
    a = ranked(spark, sf_dir).select("query_id", "rank", F.col("vec_id").alias("left_id"))
    even = a.where("left_id % 2 = 0").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "left_id"))).alias("r"))
    b = even.select("query_id", F.posexplode("r").alias("p", "x")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.left_id").alias("right_id"))
    return a.join(b, ["query_id", "rank"], "full").select("query_id", "rank", "left_id", "right_id", F.coalesce(F.col("left_id") == F.col("right_id"), F.lit(False)).alias("same"))


GATES = f"""SELECT user_id, event_type, count(s) AS n_produced, count(*) - count(s) AS n_skipped, coalesce(avg(s) >= {FLOOR}, false) AS passed
  FROM (SELECT user_id, event_type, CASE WHEN value > 1 THEN value END AS s FROM events WHERE event_type <> 'error') GROUP BY 1, 2"""

QUERIES = {
    "e6_entity_report": entity_report, "e7_arm_comparison": arm_comparison, "e11_expected_call": expected_call, "e12_execution_health": execution_health,
    "e14_scorer_gates": scorer_gates, "e15_scenario_gates": scenario_gates, "e16_floors": floors, "e17_case_ids": case_ids,
}
ORACLE_SQL = {
    "e6_entity_report": """SELECT event_type, round(avg(value), 6) AS mean_value, round(stddev_samp(value), 6) AS std_value, min(value) AS low, max(value) AS high, count(*) AS n,
      CASE WHEN avg(value) <= 49 THEN 'weak' WHEN avg(value) <= 51 THEN 'middling' ELSE 'strong' END AS tier FROM events GROUP BY 1""",
    "e7_arm_comparison": f"""WITH a AS (SELECT query_id, rank, vec_id FROM ({RANKED})), b AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS rank, vec_id FROM a WHERE vec_id % 2 = 0)
      SELECT query_id, rank, a.vec_id AS left_id, b.vec_id AS right_id, coalesce(a.vec_id = b.vec_id, false) AS same FROM a FULL JOIN b USING (query_id, rank)""",
    "e11_expected_call": """SELECT user_id, CASE user_id % 3 WHEN 0 THEN bool_or(event_type = 'purchase') WHEN 1 THEN bool_or(event_type = 'signup') END AS called FROM events GROUP BY user_id""",
    "e12_execution_health": """SELECT *, finished AND n_errors = 0 AS healthy FROM (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n_calls, count(*) FILTER (WHERE event_type = 'error') AS n_errors, bool_or(event_type = 'purchase') AS finished FROM events GROUP BY 1, 2)""",
    "e14_scorer_gates": GATES,
    "e15_scenario_gates": f"SELECT user_id, bool_and(passed) AS green, coalesce(string_agg(event_type, ',' ORDER BY event_type) FILTER (WHERE NOT passed), '') AS failing FROM ({GATES}) GROUP BY 1",
    "e16_floors": "SELECT *, floor_cents <= 20 AS flagged FROM (SELECT p_brand, CAST(floor((min(CAST(round(p_retailprice * 100) AS BIGINT)) - 20) / 5.0) AS BIGINT) * 5 AS floor_cents FROM part GROUP BY 1)",
    "e17_case_ids": """SELECT * FROM (SELECT CASE WHEN h <> '' AND page_id % 2 = 0 THEN h ELSE 'case-' || format('{:02d}', page_id + 1) END AS case_id, count(*) AS n
      FROM (SELECT page_id, regexp_extract(url, '^https?://([^/?#]*)', 1) AS h FROM pages) GROUP BY 1) WHERE n > 1""",
}
