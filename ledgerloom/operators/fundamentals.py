"""Fundamentals star: fiscal periods, column-owned merges, checks, identities, trailing sums, concentration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fiscal_quarter, fiscal_year
from ..sources import scan


def merge_columns(base: DataFrame, feed: DataFrame, key: list[str], owned: list[str]) -> DataFrame:
    """Upsert: on a key match the feed's own columns replace the base's, nulls too; other columns survive."""
    incoming = feed.select(*key, *(F.col(c).alias(f"_new_{c}") for c in owned), F.lit(True).alias("_hit"))
    joined = base.join(incoming, key, "full")
    out = [F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in owned else F.col(c) for c in base.columns if c not in key]
    return joined.select(*key, *out)


def violations(df: DataFrame, key: list[str], required: list[str], rules: dict[str, object]) -> DataFrame:
    """(rule, n): rows against each rule, required column and the key's uniqueness; one pass and one key aggregate."""
    checks = {f"{c} is null": F.col(c).isNull() for c in required} | {k: ~F.coalesce(v, F.lit(True)) for k, v in rules.items()}
    counted = df.agg(*(F.sum(c.cast("long")).alias(k) for k, c in checks.items()))
    one = counted.select(F.inline(F.array(*(F.struct(F.lit(k).alias("rule"), F.coalesce(F.col(f"`{k}`"), F.lit(0)).alias("n")) for k in checks))))
    repeated = df.groupBy(*key).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("key repeated").alias("rule"), "n")
    return one.unionByName(repeated)


def quarterly(spark, sf_dir: str) -> DataFrame:
    """Quarter sums by supplier (as the company, fiscal year ending in September) of its order lines."""
    line = scan(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice", "l_discount", "l_quantity")
    end = F.last_day(F.add_months(F.trunc("l_shipdate", "quarter"), 2))
    fye = F.lit(9)
    by = line.groupBy(F.col("l_suppkey").alias("company"), end.alias("period_end")).agg(F.count("*").alias("n_lines"), F.sum((F.col("l_extendedprice") * 100).cast("long")).alias("gross_cents"), F.sum("l_quantity").cast("long").alias("units"))
    return by.select("company", "period_end", fiscal_year(F.col("period_end"), fye).cast("int").alias("fiscal_year"), fiscal_quarter(F.col("period_end"), fye).alias("fiscal_quarter"), "n_lines", "gross_cents", "units")


def trailing(spark, sf_dir: str) -> DataFrame:
    """Sum of the last four quarters by company, null until there are four in a row."""
    q = quarterly(spark, sf_dir).withColumn("place", F.col("fiscal_year") * 4 + F.col("fiscal_quarter"))
    w = Window.partitionBy("company").orderBy("place").rangeBetween(-3, 0)
    return q.select("company", "fiscal_year", "fiscal_quarter", F.when(F.count("*").over(w) == 4, F.sum("gross_cents").over(w)).alias("ttm_cents"))


def merged(spark, sf_dir: str) -> DataFrame:
    """Two feeds of the quarter table: the second owns units and writes nulls for returned-only quarters."""
    base = quarterly(spark, sf_dir)
    feed = base.where("fiscal_quarter in (1, 2)").select("company", "fiscal_year", "fiscal_quarter", F.when(F.col("units") > 500, F.col("units") * 2).alias("units"))
    return merge_columns(base.drop("period_end"), feed, ["company", "fiscal_year", "fiscal_quarter"], ["units"])


def constraint_report(spark, sf_dir: str) -> DataFrame:
    q = quarterly(spark, sf_dir)
    return violations(q, ["company", "fiscal_year", "fiscal_quarter"], ["company", "period_end"], {"quarter in 1..4": F.col("fiscal_quarter").between(1, 4), "units above 100": F.col("units") > 100})


def concentration(spark, sf_dir: str) -> DataFrame:
    """Customers with over 10 % of their nation's order value in a year."""
    orders = scan(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), (F.col("o_totalprice") * 100).cast("long").alias("cents"))
    by = orders.groupBy("o_custkey", "year").agg(F.sum("cents").alias("cents"))
    by = by.join(scan(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), by.o_custkey == F.col("c_custkey"))
    total = by.groupBy("c_nationkey", "year").agg(F.sum("cents").alias("all_cents"))
    share = F.col("cents") / F.col("all_cents")
    return by.join(total, ["c_nationkey", "year"]).where(share > 0.1).select(F.col("c_nationkey").alias("nation"), "year", F.col("o_custkey").alias("customer"), F.round(share, 9).alias("share"))


def slices(spark, sf_dir: str) -> DataFrame:
    """Revenue of each brand (as segment) and region by quarter and by year: quarterly rows have a quarter, annual ones none; and the share of the period's total."""
    line = scan(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate", F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("long").alias("cents"))
    by_key = line.groupBy("l_partkey", "l_suppkey", F.year("l_shipdate").alias("fiscal_year"), F.quarter("l_shipdate").alias("fiscal_quarter")).agg(F.sum("cents").alias("cents"))
    nation = scan(spark, sf_dir, "nation").join(scan(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    region = scan(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "r_name")
    rows = by_key.join(scan(spark, sf_dir, "part").select("p_partkey", "p_brand"), by_key.l_partkey == F.col("p_partkey")).join(region, by_key.l_suppkey == F.col("s_suppkey"))
    kinds = F.inline(F.array(F.struct(F.lit("segment").alias("slice"), F.col("p_brand").alias("name")), F.struct(F.lit("region").alias("slice"), F.col("r_name").alias("name"))))
    quarter = rows.select("fiscal_year", "fiscal_quarter", "cents", kinds).groupBy("slice", "name", "fiscal_year", "fiscal_quarter").agg(F.sum("cents").alias("cents"))
    both = quarter.withColumn("period_type", F.lit("quarterly")).unionByName(quarter.groupBy("slice", "name", "fiscal_year").agg(F.sum("cents").alias("cents")).withColumns({"period_type": F.lit("annual"), "fiscal_quarter": F.lit(None).cast("int")}))
    total = F.sum("cents").over(Window.partitionBy("slice", "period_type", "fiscal_year", "fiscal_quarter"))
    return both.select("slice", "name", "period_type", "fiscal_year", "fiscal_quarter", "cents", F.round(F.col("cents") / total, 9).alias("share"))


Q_SQL = """SELECT l_suppkey AS company, CAST(last_day(date_trunc('quarter', l_shipdate) + INTERVAL 2 MONTH) AS DATE) AS period_end,
  count(*) AS n_lines, CAST(sum(CAST(trunc(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS gross_cents, CAST(sum(l_quantity) AS BIGINT) AS units
  FROM lineitem GROUP BY 1, 2"""
QF_SQL = f"""SELECT company, period_end, CAST(year(period_end) + CASE WHEN month(period_end) > 9 THEN 1 ELSE 0 END AS INTEGER) AS fiscal_year,
  CAST(CASE month(period_end) WHEN 12 THEN 1 WHEN 3 THEN 2 WHEN 6 THEN 3 ELSE 4 END AS INTEGER) AS fiscal_quarter, n_lines, gross_cents, units FROM ({Q_SQL})"""

QUERIES = {"f1_fiscal_quarters": quarterly, "f9_trailing_four_quarters": trailing, "f2_column_merge": merged, "f4_constraint_report": constraint_report, "f10_customer_concentration": concentration, "f10_slices": slices}
ORACLE_SQL = {
    "f10_slices": """WITH q AS (SELECT slice, name, year(l_shipdate) AS fiscal_year, quarter(l_shipdate) AS fiscal_quarter, CAST(sum(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS BIGINT) AS cents FROM
        (SELECT l_shipdate, l_extendedprice, unnest(['segment', 'region']) AS slice, unnest([p_brand, r_name]) AS name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) GROUP BY 1, 2, 3, 4),
      b AS (SELECT slice, name, 'quarterly' AS period_type, fiscal_year, fiscal_quarter, cents FROM q UNION ALL SELECT slice, name, 'annual', fiscal_year, NULL, CAST(sum(cents) AS BIGINT) FROM q GROUP BY 1, 2, 4)
      SELECT slice, name, period_type, CAST(fiscal_year AS INTEGER) AS fiscal_year, CAST(fiscal_quarter AS INTEGER) AS fiscal_quarter, cents, round(cents / sum(cents) OVER (PARTITION BY slice, period_type, fiscal_year, fiscal_quarter), 9) AS share FROM b""",
    "f1_fiscal_quarters": QF_SQL,
    "f9_trailing_four_quarters": f"""SELECT company, fiscal_year, fiscal_quarter, CASE WHEN count(*) OVER w = 4 THEN CAST(sum(gross_cents) OVER w AS BIGINT) END AS ttm_cents
      FROM ({QF_SQL}) WINDOW w AS (PARTITION BY company ORDER BY fiscal_year * 4 + fiscal_quarter RANGE BETWEEN 3 PRECEDING AND CURRENT ROW)""",
    "f2_column_merge": f"""SELECT company, fiscal_year, fiscal_quarter, n_lines, gross_cents,
      CASE WHEN fiscal_quarter IN (1, 2) THEN CASE WHEN units > 500 THEN units * 2 END ELSE units END AS units FROM ({QF_SQL})""",
    "f4_constraint_report": f"""WITH q AS ({QF_SQL})
      SELECT 'company is null' AS rule, count(*) AS n FROM q WHERE company IS NULL UNION ALL SELECT 'period_end is null', count(*) FROM q WHERE period_end IS NULL
      UNION ALL SELECT 'quarter in 1..4', count(*) FROM q WHERE NOT fiscal_quarter BETWEEN 1 AND 4 UNION ALL SELECT 'units above 100', count(*) FROM q WHERE NOT units > 100
      UNION ALL SELECT 'key repeated', count(*) FROM (SELECT 1 FROM q GROUP BY company, fiscal_year, fiscal_quarter HAVING count(*) > 1)""",
    "f10_customer_concentration": """WITH b AS (SELECT o_custkey, year(o_orderdate) AS y, sum(CAST(trunc(o_totalprice * 100) AS BIGINT)) AS c FROM orders GROUP BY 1, 2),
      j AS (SELECT c_nationkey, y, o_custkey, c, sum(c) OVER (PARTITION BY c_nationkey, y) AS t FROM b JOIN customer ON o_custkey = c_custkey)
      SELECT c_nationkey AS nation, CAST(y AS INTEGER) AS year, o_custkey AS customer, round(c / t, 9) AS share FROM j WHERE c / t > 0.1""",
}
