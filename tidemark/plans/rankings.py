"""TK and ST: top-k, extremes, sampling ends and set operations."""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers as num
from ..operators import rankings as rk
from .registry import query, rounded
from .standins import MONTHLY, QUARTERLY, W, money, monthly, quarterly, r

_P = "CAST(period AS VARCHAR) AS period"
_DEVIATION = f"{MONTHLY}, dev AS (SELECT series_id, period, value, value / avg(value) OVER (PARTITION BY series_id) - 1 AS x FROM monthly)"


def deviations(t):
    return monthly(t).select("series_id", "period", "value", (F.col("value") / F.avg("value").over(Window.partitionBy("series_id")) - 1).alias("x"))


@query("tk1_top_absolute", f"""
WITH {_DEVIATION}, k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY abs(x) DESC, period) AS rank FROM dev WHERE abs(x) >= 0.05)
SELECT series_id, {_P}, {r('x')} AS x, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 15""")
def tk1(t):
    return rounded(rk.top_absolute(deviations(t), "x", 15, least=0.05).select("series_id", "period", "x", "rank"))


@query("tk2_order_limit", """
SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
def tk2(t):
    return t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(100)


@query("tk3_extreme_rows", f"""
WITH spend AS (SELECT o_custkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS income FROM orders GROUP BY 1),
a AS (SELECT c_custkey, c_nationkey, c_acctbal, coalesce(income, 0) AS income FROM customer LEFT JOIN spend ON o_custkey = c_custkey)
SELECT c_nationkey, arg_min(c_custkey, (c_acctbal, c_custkey)) AS poorest, arg_max(c_custkey, (c_acctbal, -c_custkey)) AS richest,
  {r('arg_min(income, (c_acctbal, c_custkey))', 2)} AS poorest_income, {r('arg_max(income, (c_acctbal, -c_custkey))', 2)} AS richest_income FROM a GROUP BY 1""")
def tk3(t):
    spend = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(money("o_totalprice").alias("income"))
    agents = t.customer.join(spend, "c_custkey", "left").fillna(0.0, ["income"])
    return rounded(rk.extremes(agents, ["c_nationkey"], "c_acctbal", "c_custkey", {"": "c_custkey", "_income": "income"}), 2)


@query("tk4_head_tail", f"""
WITH {MONTHLY}, k AS (SELECT *, row_number() {W} AS i, row_number() OVER (PARTITION BY series_id ORDER BY period DESC) AS j FROM monthly)
SELECT series_id, {_P}, value, i <= 4 AS is_head FROM k WHERE i <= 4 OR j <= 4""")
def tk4(t):
    return rk.head_tail(monthly(t), 4).select("series_id", "period", "value", "is_head")


@query("tk4_last_points", f"""
WITH {MONTHLY}, k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY period DESC) AS j FROM monthly)
SELECT series_id, {_P}, value FROM k WHERE j <= 13""")
def tk4_last(t):
    return rk.last_points(monthly(t), 13).select("series_id", "period", "value")


@query("tk5_target_period", f"""
WITH {_DEVIATION}, o AS (SELECT *, row_number() {W} AS i FROM dev), ask AS (SELECT series_id, CASE series_id WHEN '2-HIGH' THEN DATE '1998-05-01' WHEN '5-LOW' THEN DATE '2031-01-01' END AS asked FROM (SELECT DISTINCT series_id FROM dev)),
k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY CASE WHEN period = asked THEN 0 WHEN i > 12 THEN 1 ELSE 2 END, abs(x) DESC, period) AS rank,
  CASE WHEN period = asked THEN 'asked' WHEN i > 12 THEN 'largest_after_first_cycle' ELSE 'largest' END AS reason FROM o JOIN ask USING (series_id) WHERE abs(x) >= 0.05 OR period = asked)
SELECT series_id, {_P}, reason, {r('x')} AS x FROM k WHERE rank = 1""")
def tk5(t):
    placed = deviations(t).withColumn("i", F.row_number().over(Window.partitionBy("series_id").orderBy("period")))
    asked = F.when(F.col("series_id") == "2-HIGH", F.lit("1998-05-01").cast("date")).when(F.col("series_id") == "5-LOW", F.lit("2031-01-01").cast("date"))
    events = placed.withColumn("asked", asked).filter((F.abs("x") >= 0.05) | (F.col("period") == F.col("asked")))
    return rounded(rk.target_period(events, "x", F.col("asked"), F.col("i") <= 12).select("series_id", "period", "reason", "x"))


def _records(t):
    m = deviations(t)
    load = m.select(F.lit("load").alias("record_type"), F.date_format("period", "yyyy-MM-dd").alias("time"), F.lit(None).cast("string").alias("sector"),
                    "series_id", (F.col("x") * 100).alias("residual"), num.severity(F.col("x") * 100).alias("severity"), F.lit("% of mean").alias("unit"))
    q = quarterly(t).withColumn("x", F.col("value") / F.avg("value").over(Window.partitionBy("series_id")) - 1)
    label = F.concat(F.year("period"), F.lit("Q"), F.quarter("period"))
    flow = q.select(F.lit("flow").alias("record_type"), label.alias("time"), F.col("series_id").alias("sector"), (F.col("x") * 100).alias("residual"),
                    num.severity(F.col("x") * 100, num.FLOW_LIMITS).alias("severity"), F.lit("%").alias("unit"), (F.quarter("period") == 4).cast("int").alias("annual_reconciliation_risk"))
    grown = q.withColumn("g", F.try_divide(F.col("value"), F.lag("value", 4).over(Window.partitionBy("series_id").orderBy("period"))) * 100 - 100)
    growth = grown.select(F.lit("growth").alias("record_type"), label.alias("time"), F.col("series_id").alias("sector"), F.col("g").alias("residual"),
                          num.severity(F.col("g"), num.GROWTH_LIMITS).alias("severity"), F.lit("points").alias("unit"))
    return rk.anomaly_records([load, growth, flow])


@query("st1_union_records", f"""
WITH {_DEVIATION}, {QUARTERLY}, q AS (SELECT *, 100 * (value / avg(value) OVER (PARTITION BY series_id) - 1) AS x, value / nullif(lag(value, 4) {W}, 0) * 100 - 100 AS g, year(period) || 'Q' || quarter(period) AS label FROM quarterly),
u AS (SELECT 'load' AS record_type, CAST(period AS VARCHAR) AS time, CAST(NULL AS VARCHAR) AS sector, series_id, x * 100 AS residual, CASE WHEN abs(x * 100) >= 10 THEN 'strong' WHEN abs(x * 100) >= 6 THEN 'watch' ELSE 'normal' END AS severity, '% of mean' AS unit, 0 AS annual_reconciliation_risk FROM dev
  UNION ALL SELECT 'growth', label, series_id, NULL, g, CASE WHEN abs(g) >= 5 THEN 'strong' WHEN abs(g) >= 3 THEN 'watch' ELSE 'normal' END, 'points', 0 FROM q
  UNION ALL SELECT 'flow', label, series_id, NULL, x, CASE WHEN abs(x) >= 10 THEN 'strong' WHEN abs(x) >= 5 THEN 'watch' ELSE 'normal' END, '%', CAST(quarter(period) = 4 AS INTEGER) FROM q)
SELECT record_type, time, sector, series_id, {r('residual', 5)} AS residual, severity, unit, annual_reconciliation_risk FROM u WHERE severity <> 'normal'""")
def st1(t):
    return rounded(_records(t), 5)


def triples(t):
    """(src, rel, dst): where nations, suppliers and customers are."""
    def edge(df, src, rel, dst):
        return df.select(src.alias("src"), F.lit(rel).alias("rel"), dst.alias("dst"))

    def tag(kind, key):
        return F.concat(F.lit(kind), F.col(key).cast("string"))

    return (edge(t.nation, tag("n", "n_nationkey"), "IN_REGION", tag("r", "n_regionkey"))
            .unionByName(edge(t.supplier, tag("s", "s_suppkey"), "BASED_IN", tag("n", "s_nationkey")))
            .unionByName(edge(t.customer, tag("c", "c_custkey"), "BASED_IN", tag("n", "c_nationkey"))))


def nodes(t):
    """(id, name) of everything but customers, who stay nameless."""
    def named(df, kind, key, name):
        return df.select(F.concat(F.lit(kind), F.col(key).cast("string")).alias("id"), F.col(name).alias("name"))

    return named(t.nation, "n", "n_nationkey", "n_name").unionByName(named(t.region, "r", "r_regionkey", "r_name")).unionByName(named(t.supplier, "s", "s_suppkey", "s_name"))


TRIPLES = """triples AS (SELECT 'n' || n_nationkey AS src, 'IN_REGION' AS rel, 'r' || n_regionkey AS dst FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'BASED_IN', 'n' || s_nationkey FROM supplier UNION ALL SELECT 'c' || c_custkey, 'BASED_IN', 'n' || c_nationkey FROM customer),
nodes AS (SELECT 'n' || n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name FROM region UNION ALL SELECT 's' || s_suppkey, s_name FROM supplier)"""


@query("st2_merge_triples", f"""
WITH {TRIPLES}, alle AS (SELECT src, rel, dst FROM triples UNION ALL SELECT src, 'LOCATED_IN', dst FROM triples WHERE rel = 'IN_REGION'),
ends AS (SELECT src AS id FROM alle UNION SELECT dst FROM alle)
SELECT rel, count(*) AS n_edges, (SELECT count(*) FROM ends) AS n_nodes FROM alle GROUP BY 1""")
def st2(t):
    seed = triples(t)
    extra = seed.filter(F.col("rel") == "IN_REGION").withColumn("rel", F.lit("LOCATED_IN"))
    edges, ends = rk.merge_triples(seed, extra)
    return edges.groupBy("rel").agg(F.count("*").alias("n_edges")).withColumn("n_nodes", ends.agg(F.count("*")).scalar())


@query("st3_union_distinct", f"""
WITH {TRIPLES}, hits AS (SELECT 1 AS source, src, rel, dst FROM triples WHERE rel = 'IN_REGION' UNION ALL SELECT 2, src, rel, dst FROM triples WHERE src LIKE 'n%' OR src LIKE 's%'),
f AS (SELECT src, rel, dst, min(source) AS source FROM hits GROUP BY 1, 2, 3) SELECT src, rel, dst, CAST(source AS INTEGER) AS source FROM f""")
def st3(t):
    e = triples(t)
    return rk.union_first([e.filter(F.col("rel") == "IN_REGION"), e.filter(F.col("src").startswith("n") | F.col("src").startswith("s"))], ["src", "rel", "dst"])


@query("st4_intersect_except", """
WITH o AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS period FROM orders), l AS (SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) AS period FROM lineitem)
SELECT 'both' AS side, CAST(period AS VARCHAR) AS period FROM (SELECT period FROM o INTERSECT SELECT period FROM l)
UNION ALL SELECT 'orders_only', CAST(period AS VARCHAR) FROM (SELECT period FROM o EXCEPT SELECT period FROM l)
UNION ALL SELECT 'lineitem_only', CAST(period AS VARCHAR) FROM (SELECT period FROM l EXCEPT SELECT period FROM o)""")
def st4(t):
    o = t.orders.select(F.to_date(F.date_trunc("month", "o_orderdate")).alias("period")).distinct()
    l = t.lineitem.select(F.to_date(F.date_trunc("month", "l_shipdate")).alias("period")).distinct()
    parts = {"both": o.intersect(l), "orders_only": o.exceptAll(l), "lineitem_only": l.exceptAll(o)}
    return reduce(lambda a, b: a.unionByName(b), [df.select(F.lit(k).alias("side"), "period") for k, df in parts.items()])
