"""Quarterly statements: accounting identities, valuation ratios, and what annual and quarterly slices must have.

The queries read statements, market snapshots and slices that are derived from whole TPC-H tables: a company is a nation's suppliers, a quarter its lines shipped then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import derived
from .landing import broken_identities

KEY = ["company", "fiscal_year", "fiscal_quarter"]
#: The five identities of a statement; capital expenditure is stored with its sign, so it is added.
IDENTITIES = {
    "gross profit = revenue - cost": ("gross_profit", "total_revenue - cost_of_revenue"),
    "operating income = gross profit - operating expenses": ("operating_income", "gross_profit - (research_and_development + selling_general_admin)"),
    "total debt = long-term + current debt": ("total_debt", "long_term_debt + current_debt"),
    "net debt = total debt - cash": ("net_debt", "total_debt - cash"),
    "free cash flow = operating cash flow - capital expenditure": ("free_cash_flow", "operating_cash_flow + capital_expenditure"),
}


def broken(statements: DataFrame, tolerance: int = 0) -> DataFrame:
    """(company, fiscal_year, fiscal_quarter, identity, off): the identities that a statement breaks; one with a null on a side is not broken."""
    return broken_identities(statements, KEY, {n: (F.col(a), F.expr(b)) for n, (a, b) in IDENTITIES.items()}, tolerance)


def trailing(statements: DataFrame, columns: list[str]) -> DataFrame:
    """``statements`` with the sums of ``columns`` over the last four quarters; null until four stand in a row, or where one of them is null."""
    rows = statements.withColumn("place", F.col("fiscal_year") * 4 + F.col("fiscal_quarter"))
    w = Window.partitionBy("company").orderBy("place").rangeBetween(-3, 0)
    return rows.withColumns({f"{c}_ttm": F.when(F.count(c).over(w) == 4, F.sum(c).over(w)) for c in columns}).drop("place")


def valuations(market: DataFrame, statements: DataFrame) -> DataFrame:
    """(company, as_of, market_cap, enterprise_value, trailing_pe, forward_pe, price_to_book, price_to_sales, ev_to_ebitda, trailing_peg, dividend_yield_pct) of each snapshot.

    ``market``: company, as_of, price, shares, forward_eps, growth_pct, dividend. A snapshot reads the company's latest statement that ended by then: sums of four quarters for flows, the
    statement's own values for balances. A ratio without a divisor, or with one that is 0, is null; so is a price-earnings ratio of losses. A negative multiple of EBITDA or book stays.
    """
    flows = trailing(statements, ["total_revenue", "diluted_eps", "ebitda"]).select("company", "period_end", "total_revenue_ttm", "diluted_eps_ttm", "ebitda_ttm", "total_debt", "cash", "equity")
    # as-of: statements and snapshots in one order by company; each snapshot takes the last statement before it
    told = F.struct(*(c for c in flows.columns if c not in ("company", "period_end")))
    both = market.withColumn("day", F.col("as_of")).withColumn("kind", F.lit(1)).unionByName(flows.select("company", F.col("period_end").alias("day"), F.lit(0).alias("kind"), told.alias("s")), allowMissingColumns=True)
    w = Window.partitionBy("company").orderBy("day", "kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("s", F.last("s", ignorenulls=True).over(w)).where("kind = 1")
    over = lambda a, b: F.round(F.when(b != 0, a / b), 9)
    cap = F.col("price") * F.col("shares")
    ev = cap + F.col("s.total_debt") - F.col("s.cash")
    pe = lambda eps: F.when(eps > 0, F.col("price") / eps)
    earned = pe(F.col("s.diluted_eps_ttm"))
    return rows.select(
        "company", "as_of", F.round(cap, 4).alias("market_cap"), F.round(ev, 4).alias("enterprise_value"), F.round(earned, 9).alias("trailing_pe"), F.round(pe(F.col("forward_eps")), 9).alias("forward_pe"), over(cap, F.col("s.equity")).alias("price_to_book"),
        over(cap, F.col("s.total_revenue_ttm")).alias("price_to_sales"), over(ev, F.col("s.ebitda_ttm")).alias("ev_to_ebitda"), over(earned, F.col("growth_pct")).alias("trailing_peg"), over(F.col("dividend") * 100, F.col("price")).alias("dividend_yield_pct"),
    )


def slice_faults(slices: DataFrame) -> DataFrame:
    """(slice_id, rule): rules that a slice (slice_id, period_type, fiscal_quarter, share) breaks: its period is annual or quarterly, annual ones and they alone have no quarter, quarters are 1 to 4, shares 0 to 1."""
    annual, none = F.col("period_type") == "annual", F.col("fiscal_quarter").isNull()
    rules: dict[str, Column] = {"period is annual or quarterly": F.col("period_type").isin("annual", "quarterly"), "annual without a quarter": annual == none, "quarter in 1..4": F.col("fiscal_quarter").between(1, 4), "share in 0..1": F.col("share").between(0, 1)}
    faults = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(n != "period is annual or quarterly")), F.lit(n)) for n, ok in rules.items())))
    return slices.select("slice_id", F.explode(faults).alias("rule"))


#: A company is a nation, its quarter the lines of its suppliers; a few figures are off or missing on purpose. Amounts are whole hundredths, so sums are exact.
STATEMENTS = """SELECT company, fiscal_year, fiscal_quarter, period_end, total_revenue, cost_of_revenue, CASE WHEN n % 5 = 0 THEN total_revenue - cost_of_revenue + 7 ELSE total_revenue - cost_of_revenue END AS gross_profit, research_and_development, selling_general_admin,
  CASE WHEN n % 7 = 0 THEN NULL WHEN n % 7 = 1 THEN 0 ELSE CASE WHEN n % 5 = 0 THEN total_revenue - cost_of_revenue + 7 ELSE total_revenue - cost_of_revenue END - research_and_development - selling_general_admin END AS operating_income, long_term_debt, current_debt,
  long_term_debt + current_debt + CASE WHEN n % 11 = 0 THEN 1 ELSE 0 END AS total_debt, cash, long_term_debt + current_debt - cash AS net_debt, operating_cash_flow, -capex AS capital_expenditure, CASE WHEN n % 13 = 0 THEN operating_cash_flow + capex ELSE operating_cash_flow - capex END AS free_cash_flow,
  CASE WHEN n % 17 = 0 THEN NULL ELSE n - 50 END AS diluted_eps, total_revenue - cost_of_revenue - 40 * n AS ebitda, equity FROM
  (SELECT s_nationkey AS company, CAST(year(l_shipdate) AS INT) AS fiscal_year, CAST(quarter(l_shipdate) AS INT) AS fiscal_quarter, max(l_shipdate) AS period_end, count(*) AS n, sum(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS total_revenue, sum(CAST(floor(l_extendedprice * 60 + 0.5) AS BIGINT)) AS cost_of_revenue,
    sum(CAST(l_quantity AS BIGINT)) * 100 AS research_and_development, sum(CAST(l_quantity AS BIGINT)) * 50 AS selling_general_admin, sum(CAST(l_orderkey AS BIGINT)) AS long_term_debt, sum(CAST(l_linenumber AS BIGINT)) AS current_debt, sum(CAST(l_suppkey AS BIGINT)) AS cash,
    sum(CAST(l_partkey AS BIGINT)) AS operating_cash_flow, count(*) * 3 AS capex, sum(CAST(l_partkey AS BIGINT)) - count(*) * 400 AS equity FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3) q"""
MARKET = """SELECT s_nationkey AS company, o_orderdate AS as_of, max(CAST(o_custkey % 90 AS DOUBLE)) AS price, count(*) * 1000 AS shares, max(CAST(o_orderkey % 7 AS DOUBLE)) - 1 AS forward_eps, max(CAST(o_orderkey % 5 AS DOUBLE)) AS growth_pct, max(CAST(o_orderkey % 3 AS DOUBLE)) AS dividend
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2"""
SLICES = """SELECT o_orderkey AS slice_id, CASE o_orderkey % 5 WHEN 0 THEN 'annual' WHEN 4 THEN CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'monthly' END ELSE 'quarterly' END AS period_type, CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 7 > 0 OR o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderkey % 6 AS INT) END AS fiscal_quarter,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_custkey % 12 AS DOUBLE) / 10 END AS share FROM orders"""


def statements(spark, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, STATEMENTS, "lineitem", "supplier")


QUERIES = {
    "f4_slice_rules": lambda s, d: slice_faults(derived(s, d, SLICES, "orders")),
    "f8_statement_identities": lambda s, d: broken(statements(s, d)),
    "f9_valuations": lambda s, d: valuations(derived(s, d, MARKET, "orders", "lineitem", "supplier"), statements(s, d)),
}
ORACLE_SQL = {
    "f4_slice_rules": f"""SELECT slice_id, rule FROM (SELECT slice_id, unnest([CASE WHEN period_type IS NULL OR period_type NOT IN ('annual', 'quarterly') THEN 'period is annual or quarterly' END, CASE WHEN period_type = 'annual' AND fiscal_quarter IS NOT NULL OR period_type <> 'annual' AND fiscal_quarter IS NULL THEN 'annual without a quarter' END,
      CASE WHEN fiscal_quarter NOT IN (1, 2, 3, 4) THEN 'quarter in 1..4' END, CASE WHEN share > 1 THEN 'share in 0..1' END]) AS rule FROM ({SLICES})) WHERE rule IS NOT NULL""",
    "f8_statement_identities": " UNION ALL ".join(f"SELECT company, fiscal_year, fiscal_quarter, '{n}' AS identity, CAST({a} - ({b}) AS BIGINT) AS off FROM ({STATEMENTS}) WHERE {a} <> {b}" for n, (a, b) in IDENTITIES.items()),
    "f9_valuations": f"""WITH q AS (SELECT * FROM ({STATEMENTS})), t AS (SELECT q.company, q.period_end, any_value(q.total_debt) AS debt, any_value(q.cash) AS cash, any_value(q.equity) AS equity, CASE WHEN count(p.total_revenue) = 4 THEN sum(p.total_revenue) END AS revenue, CASE WHEN count(p.diluted_eps) = 4 THEN sum(p.diluted_eps) END AS eps,
        CASE WHEN count(p.ebitda) = 4 THEN sum(p.ebitda) END AS ebitda FROM q JOIN q p ON p.company = q.company AND p.fiscal_year * 4 + p.fiscal_quarter BETWEEN q.fiscal_year * 4 + q.fiscal_quarter - 3 AND q.fiscal_year * 4 + q.fiscal_quarter GROUP BY 1, 2),
      m AS (SELECT m.*, t.*, price * shares AS cap, price * shares + debt - t.cash AS ev, CASE WHEN eps > 0 THEN price / eps END AS pe FROM ({MARKET}) m ASOF LEFT JOIN t ON m.company = t.company AND m.as_of >= t.period_end)
      SELECT company, as_of, round(cap, 4) AS market_cap, round(ev, 4) AS enterprise_value, round(pe, 9) AS trailing_pe, round(CASE WHEN forward_eps > 0 THEN price / forward_eps END, 9) AS forward_pe, round(cap / nullif(equity, 0), 9) AS price_to_book, round(cap / nullif(revenue, 0), 9) AS price_to_sales,
        round(ev / nullif(ebitda, 0), 9) AS ev_to_ebitda, round(pe / nullif(growth_pct, 0), 9) AS trailing_peg, round(dividend * 100 / nullif(price, 0), 9) AS dividend_yield_pct FROM m""",
}
