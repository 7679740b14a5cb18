"""EC: measures over agents (customers), yearly incomes (orders) and trades (line items)."""

from pyspark.sql import functions as F

from ..operators import micropanel as mp
from .registry import query, rounded
from .standins import cents, money, r, revenue

AGENTS = "agents AS (SELECT c_custkey AS agent, c_nationkey AS nation, c_mktsegment AS segment, greatest(c_acctbal, 0.0) AS coin FROM customer)"
YEARLY = """yearly AS (SELECT o_custkey AS agent, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS income, count(*) AS labour FROM orders GROUP BY 1, 2)"""
PANEL = f"{AGENTS}, {YEARLY}, panel AS (SELECT y.*, a.nation, a.segment, a.coin FROM yearly y JOIN agents a USING (agent))"


def agents(t):
    return t.customer.select(F.col("c_custkey").alias("agent"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.greatest("c_acctbal", F.lit(0.0)).alias("coin"))


def yearly(t):
    return t.orders.groupBy(F.col("o_custkey").alias("agent"), F.year("o_orderdate").alias("year")).agg(money("o_totalprice").alias("income"), F.count("*").alias("labour"))


def panel(t):
    return yearly(t).join(agents(t), "agent")


def _gini_sql(keys):
    k = ", ".join(keys)
    return f"""WITH {AGENTS}, o AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY coin) AS i, count(*) OVER (PARTITION BY {k}) AS n FROM agents),
g AS (SELECT {k}, any_value(n) AS n, CASE WHEN any_value(n) < 30 THEN 2 * sum((2 * i - n - 1) * coin) / (2 * any_value(n) * sum(coin) + 1e-10) / ((any_value(n) - 1.0) / any_value(n))
  ELSE 1 - 2.0 / (any_value(n) + 1) * sum((n - i + 1) * coin) / (sum(coin) + 1e-10) END AS gini FROM o GROUP BY {k})
SELECT {k}, n, {r('gini')} AS gini, {r('1 - gini')} AS equality FROM g"""


@query("ec1_gini_by_nation", _gini_sql(["nation"]))
def ec1(t):
    return rounded(mp.gini(agents(t), ["nation"], "coin", mp.SMALL_GROUP))


@query("ec1_gini_small_groups", _gini_sql(["nation", "segment"]))
def ec1_small(t):
    return rounded(mp.gini(agents(t), ["nation", "segment"], "coin", mp.SMALL_GROUP))


@query("ec2_productivity", f"WITH {PANEL} SELECT year, count(*) AS n_agents, {r('sum(income)', 2)} AS total_income, CAST(sum(labour) AS BIGINT) AS total_labour, {r('sum(coin)', 2)} AS total_coin, {r('avg(income)', 3)} AS mean_income, {r('avg(labour)')} AS mean_labour, {r('avg(coin)', 3)} AS mean_coin FROM panel GROUP BY 1")
def ec2(t):
    return rounded(mp.totals(panel(t), ["year"], ("income", "labour", "coin")), 3, total_income=2, total_coin=2, mean_labour=6)


_UTILITY = "(power(coin + 1, 0.7) - 1) / 0.7 * ln(greatest(1.0, income)) - power(labour, 0.7) * 1.5"


def _with_utility(df):
    u = mp.isoelastic_utility([(F.col("coin") + 1, 0.3), (F.col("income"), 1.0)], F.col("labour"), 1.5)
    return df.withColumn("utility", u)


@query("ec3_social_welfare", f"""
WITH {PANEL}, u AS (SELECT *, {_UTILITY} AS utility FROM panel), o AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY coin) AS i, count(*) OVER (PARTITION BY year) AS n FROM u)
SELECT year, {r('(0.6 * (CASE WHEN any_value(n) < 30 THEN 1 - 2 * sum((2 * i - n - 1) * coin) / (2 * any_value(n) * sum(coin) + 1e-10) / ((any_value(n) - 1.0) / any_value(n)) ELSE 2.0 / (any_value(n) + 1) * sum((n - i + 1) * coin) / (sum(coin) + 1e-10) END) + 0.4) * avg(coin)', 4)} AS coin_eq_times_productivity,
  {r('sum(coin / greatest(coin, 1)) / sum(1 / greatest(coin, 1))', 6)} AS inv_income_weighted_coin, {r('sum(utility / greatest(coin, 1)) / sum(1 / greatest(coin, 1))', 5)} AS inv_income_weighted_utility FROM o GROUP BY 1""")
def ec3(t):
    return rounded(mp.welfare(_with_utility(panel(t)), ["year"], "coin", "utility", 0.6, mp.SMALL_GROUP), 6, coin_eq_times_productivity=4, inv_income_weighted_utility=5)


@query("ec4_agent_utility", f"WITH {PANEL} SELECT agent, year, {r(_UTILITY, 5)} AS isoelastic, {r('coin + income - power(labour, 1.5) * 20', 3)} AS linear FROM panel")
def ec4(t):
    linear = mp.linear_utility([F.col("coin"), F.col("income")], F.col("labour"), 1.5, 20.0)
    return rounded(_with_utility(panel(t)).select("agent", "year", F.col("utility").alias("isoelastic"), linear.alias("linear")), 5, linear=3)


@query("ec5_reward_deltas", f"WITH {PANEL}, u AS (SELECT agent, year, {_UTILITY} AS u FROM panel) SELECT agent, year, {r('u - lag(u) OVER (PARTITION BY agent ORDER BY year)', 5)} AS reward FROM u")
def ec5(t):
    return rounded(_with_utility(panel(t)).select("agent", "year", mp.step_change("utility", ["agent"], "year").alias("reward")), 5)


_EDGES = list(zip(mp.CUTOFFS, [*mp.CUTOFFS[1:], None], mp.RATES))


def due_sql(x, top=1.0):
    return " + ".join(f"{min(rate, top)} * {f'least({hi - lo}, greatest(0.0, {x} - {lo}))' if hi else f'greatest(0.0, {x} - {lo})'}" for lo, hi, rate in _EDGES)


def bin_sql(x, values):
    return "CASE WHEN " + x + " < 0 THEN 0.0 " + " ".join(f"WHEN {x} >= {lo} THEN {v}" for lo, v in reversed(list(zip(mp.CUTOFFS, values)))) + " END"


@query("ec6_bracket_tax", f"WITH {YEARLY} SELECT agent, year, {r(due_sql('income', 0.33), 5)} AS tax_due, CAST({bin_sql('income', [min(x, 0.33) for x in mp.RATES])} AS DOUBLE) AS marginal_rate, CAST({bin_sql('income', mp.CUTOFFS)} AS DOUBLE) AS bracket FROM yearly")
def ec6(t):
    z = F.col("income")
    return rounded(yearly(t).select("agent", "year", mp.taxes_due(z, mp.CUTOFFS, mp.RATES, 0.33).alias("tax_due"), mp.by_bracket(z, mp.CUTOFFS, [min(x, 0.33) for x in mp.RATES]).alias("marginal_rate"), mp.by_bracket(z, mp.CUTOFFS, mp.CUTOFFS).alias("bracket")), 5)


@query("ec6_bracket_spacings", f"""
WITH {YEARLY} SELECT year, {r('avg(' + ' + '.join(f"{rate} * " + (f"least({hi - lo}, greatest(0.0, income - {lo}))" if hi is not None else f"greatest(0.0, income - {lo})") for rate, lo, hi in zip(mp.RATES, mp.bracket_cutoffs('linear', 7, 600000.0), [*mp.bracket_cutoffs('linear', 7, 600000.0)[1:], None])) + ')', 3)} AS linear_tax,
  {r('avg(' + ' + '.join(f"{rate} * " + (f"least({hi - lo}, greatest(0.0, income - {lo}))" if hi is not None else f"greatest(0.0, income - {lo})") for rate, lo, hi in zip(mp.RATES, mp.bracket_cutoffs('log', 7, 600000.0), [*mp.bracket_cutoffs('log', 7, 600000.0)[1:], None])) + ')', 3)} AS log_tax FROM yearly GROUP BY 1""")
def ec6_spacings(t):
    z = F.col("income")
    return rounded(yearly(t).groupBy("year").agg(*[F.avg(mp.taxes_due(z, mp.bracket_cutoffs(k, 7, 600000.0), mp.RATES)).alias(f"{k}_tax") for k in ("linear", "log")]), 3)


TAXED = PANEL + f""", prod AS (SELECT *, sum(income) OVER (PARTITION BY agent ORDER BY year) AS production FROM panel), inc AS (SELECT *, production - coalesce(lag(production) OVER (PARTITION BY agent ORDER BY year), 0) AS z FROM prod),
due AS (SELECT *, {due_sql('z')} AS tax_due FROM inc), paid AS (SELECT *, least(coin * 20, tax_due) AS tax_paid FROM due),
taxed AS (SELECT *, tax_paid / greatest(1e-6, z) AS effective_rate, {bin_sql('z', mp.RATES)} AS marginal_rate, {bin_sql('z', mp.CUTOFFS)} AS bracket, avg(tax_paid) OVER (PARTITION BY year) AS lump_sum FROM paid)"""


def taxed(t):
    """Income is the yearly rise of cumulated production; coin stands at twenty times the account balance."""
    from pyspark.sql import Window

    w = Window.partitionBy("agent").orderBy("year")
    grown = panel(t).withColumn("production", F.sum("income").over(w))
    grown = grown.withColumn("z", F.col("production") - F.coalesce(F.lag("production").over(w), F.lit(0.0))).withColumn("purse", F.col("coin") * 20)
    return mp.enact_taxes(grown, "year", "agent", "z", "purse")


@query("ec7_collect_and_redistribute", f"WITH {TAXED} SELECT agent, year, {r('z', 2)} AS income, {r('tax_paid', 5)} AS tax_paid, CAST(marginal_rate AS DOUBLE) AS marginal_rate, {r('effective_rate')} AS effective_rate, {r('lump_sum', 5)} AS lump_sum, {r('coin * 20 - tax_paid + lump_sum', 5)} AS coin_after FROM taxed")
def ec7(t):
    return rounded(taxed(t).select("agent", "year", F.col("z").alias("income"), "tax_paid", "marginal_rate", "effective_rate", "lump_sum", "coin_after"), 5, income=2, effective_rate=6)


@query("ec8_equal_redistribution", f"WITH {AGENTS}, e AS (SELECT *, coin * 0.1 AS escrow FROM agents) SELECT agent, nation, {r('sum(coin + escrow) OVER (PARTITION BY nation) / count(*) OVER (PARTITION BY nation) - escrow', 6)} AS coin_after FROM e")
def ec8(t):
    held = agents(t).withColumn("escrow", F.col("coin") * 0.1)
    return rounded(mp.redistribute_equally(held, ["nation"], "coin", "escrow").select("agent", "nation", "coin_after"), 6)


@query("ec9_bracket_metrics", f"WITH {TAXED}, b(bracket, avg_rate) AS (VALUES {', '.join(f'({a}::DOUBLE, {b}::DOUBLE)' for a, b in zip(mp.CUTOFFS, mp.RATES))}) SELECT b.bracket, b.avg_rate, {r('count(taxed.bracket) * 1.0 / (SELECT count(*) FROM taxed)')} AS occupancy FROM b LEFT JOIN taxed ON CAST(taxed.bracket AS DOUBLE) = b.bracket GROUP BY 1, 2")
def ec9(t):
    return rounded(mp.tax_metrics(taxed(t))[0])


@query("ec9_collection_metrics", f"WITH {TAXED} SELECT {r('avg(effective_rate)')} AS avg_effective_tax_rate, {r('sum(tax_paid)', 2)} AS total_collected_taxes FROM taxed")
def ec9_collection(t):
    return rounded(mp.tax_metrics(taxed(t))[1], 6, total_collected_taxes=2)


@query("ec9_extreme_rates", f"""
WITH {TAXED}, x AS (SELECT arg_min(agent, (coin, agent)) AS p, arg_max(agent, (coin, -agent)) AS q FROM agents), e AS (SELECT 'poorest' AS who, p AS agent FROM x UNION ALL SELECT 'richest', q FROM x)
SELECT who, e.agent, {r('coalesce(sum(tax_paid), 0.0) / greatest(0.001, coalesce(sum(greatest(z, 0.0)), 0.0))')} AS avg_tax_rate FROM e LEFT JOIN taxed t ON t.agent = e.agent GROUP BY 1, 2""")
def ec9_extremes(t):
    return rounded(mp.extreme_tax_rates(taxed(t), "agent", "z", agents(t), "coin"))


def _elasticity_sql(cut):
    return f"""
WITH {TAXED}, l AS (SELECT z, marginal_rate AS m FROM taxed {cut}), u AS (SELECT * FROM l WHERE z > 0 AND m < 1), f AS (SELECT count(*) AS n, stddev_pop(m) AS sd, regr_slope(ln(z), ln(1 - m)) AS b, regr_intercept(ln(z), ln(1 - m)) AS a FROM u)
SELECT n, {r('CASE WHEN n >= 10 AND sd >= 1e-6 THEN 0.02 * greatest(b, 0) + 0.98 * 0.5 ELSE 0.5 END')} AS elasticity, {r('CASE WHEN n >= 10 AND sd >= 1e-6 THEN a ELSE 0.5 END', 5)} AS log_z0 FROM f"""


def _latest():
    return [F.col("year").desc(), F.col("agent").desc()]


@query("ec10_income_elasticity", _elasticity_sql(""))
def ec10(t):
    return rounded(mp.income_elasticity(taxed(t), "z", "marginal_rate", _latest()), 6, log_z0=5)


@query("ec10_elasticity_of_latest_500", _elasticity_sql("ORDER BY year DESC, agent DESC LIMIT 500"))
def ec10_latest(t):
    return rounded(mp.income_elasticity(taxed(t), "z", "marginal_rate", _latest(), keep=500), 6, log_z0=5)


BINS = YEARLY + """, w AS (SELECT 510300.0 / 100 AS width),
cell AS (SELECT year, CASE WHEN income < 0 THEN -1 WHEN income > 510300 THEN 100 ELSE least(CAST(floor(income / (510300.0 / 100)) AS INTEGER), 99) END AS bin, income FROM yearly),
held AS (SELECT year, bin, count(*) AS c, sum(1 / greatest(1.0, income)) AS inv, avg(income) AS mean FROM cell GROUP BY 1, 2),
grid AS (SELECT year, b.bin FROM (SELECT DISTINCT year FROM held), (SELECT CAST(unnest(range(-1, 101)) AS INTEGER) AS bin) b),
fl AS (SELECT g.year, g.bin, coalesce(c, 0) AS c, coalesce(inv, 0.0) AS inv, mean, g.bin * width AS lo, g.bin * width + 0.5 * width AS mid, width FROM grid g LEFT JOIN held h ON h.year = g.year AND h.bin = g.bin, w),
d AS (SELECT *, c / sum(c) OVER (PARTITION BY year) AS pz, CASE WHEN bin < 0 THEN c WHEN bin < 100 THEN c / greatest(1.0, mid) ELSE inv END AS wt FROM fl),
d2 AS (SELECT *, wt / (sum(wt) OVER (PARTITION BY year) + 1e-9) AS dens FROM d),
d3 AS (SELECT *, sum(dens) OVER dn / (sum(pz) OVER dn + 1e-9) AS gz, least(1.0, sum(pz) OVER (PARTITION BY year ORDER BY bin)) AS cum FROM d2 WINDOW dn AS (PARTITION BY year ORDER BY bin DESC)),
bins AS (SELECT year, bin, lo, CASE WHEN bin < 100 THEN lo + width END AS hi, pz, CASE WHEN bin = 100 THEN gz ELSE 0.5 * (gz + lead(gz) OVER (PARTITION BY year ORDER BY bin)) END AS g,
  CASE WHEN bin = 100 THEN CASE WHEN c > 0 THEN mean / (mean - 510300.0 + 1e-9) ELSE 0.0 END WHEN pz > 0 THEN mid * pz / (greatest(0.0, least(1.0, 1 - cum + 0.5 * pz)) + 1e-9) / width END AS a FROM d3 WHERE bin >= -1),
bn AS (SELECT * FROM bins WHERE bin >= 0)"""


@query("ec11_income_bins", f"WITH {BINS} SELECT year, bin, {r('lo', 3)} AS lo, {r('hi', 3)} AS hi, {r('pz')} AS pz, {r('g')} AS g, {r('a')} AS a FROM bn")
def ec11(t):
    return rounded(mp.income_bins(yearly(t), ["year"], "income"), 6, lo=3, hi=3)


RATES_SQL = BINS + """, rw AS (SELECT year, bin, lo, hi, (1 - g) / (1 - g + a * 0.5 + 1e-9) AS t FROM bn UNION ALL SELECT DISTINCT year, -1, NULL, NULL, 0.0 FROM bn),
nb AS (SELECT *, last_value(t IGNORE NULLS) OVER b AS t0, last_value(CASE WHEN t IS NOT NULL THEN bin END IGNORE NULLS) OVER b AS b0, first_value(t IGNORE NULLS) OVER f AS t1, first_value(CASE WHEN t IS NOT NULL THEN bin END IGNORE NULLS) OVER f AS b1 FROM rw
  WINDOW b AS (PARTITION BY year ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY year ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
rt AS (SELECT year, bin, lo, hi, coalesce(t, t0 + (t1 - t0) * (bin - b0) / nullif(b1 - b0, 0)) AS rate FROM nb WHERE bin >= 0)"""


@query("ec12_optimal_rates", f"WITH {RATES_SQL} SELECT year, bin, {r('rate')} AS rate FROM rt")
def ec12(t):
    return rounded(mp.optimal_rates(mp.income_bins(yearly(t), ["year"], "income"), ["year"], 0.5).select("year", "bin", "rate"))


@query("ec12_bracket_rates", f"""
WITH {RATES_SQL}, br(i, cut, upper) AS (VALUES {', '.join(f'({i}, {lo}::DOUBLE, {hi}::DOUBLE)' for i, (lo, hi) in enumerate(zip(mp.CUTOFFS, mp.CUTOFFS[1:])))}),
du AS (SELECT year, i, cut, upper, greatest(0.0, sum(rate * CASE WHEN hi IS NULL THEN greatest(0.0, upper - lo) ELSE least(hi - lo, greatest(0.0, upper - lo)) END)) AS due FROM rt, br GROUP BY 1, 2, 3, 4)
SELECT year, cut AS bracket, {r('greatest(0.0, least(0.9, (due - coalesce(lag(due) OVER (PARTITION BY year ORDER BY i), 0)) / (upper - cut)))')} AS rate FROM du UNION ALL SELECT year, 510300.0, {r('greatest(0.0, least(0.9, rate))')} FROM rt WHERE hi IS NULL""")
def ec12_brackets(t):
    rates = mp.optimal_rates(mp.income_bins(yearly(t), ["year"], "income"), ["year"], 0.5)
    return rounded(mp.bracket_rates(rates, ["year"], rate_max=0.9))


MACRO = """sup AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS step, CAST(sum(CAST(round(l_quantity * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS supply, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / CAST(sum(CAST(round(l_quantity * 100) AS BIGINT)) AS DOUBLE) AS price FROM lineitem GROUP BY 1),
act AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS step, count(DISTINCT o_custkey) AS busy, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 / count(*) AS wage FROM orders GROUP BY 1),
steps AS (SELECT step, supply, price, (SELECT count(*) FROM customer) - busy AS idle, wage FROM sup JOIN act USING (step)),
yrs AS (SELECT year(step) AS year, sum(supply * price) AS nominal_gdp, sum(supply) * (SELECT arg_min(price, step) FROM steps) AS real_gdp, CAST(sum(idle) AS DOUBLE) AS unemployment, avg(price) AS mean_price, avg(wage) AS mean_wage FROM steps GROUP BY 1),
macro AS (SELECT *, (nominal_gdp - lag(nominal_gdp) OVER o) / (lag(nominal_gdp) OVER o + 1e-8) AS nominal_gdp_growth, (real_gdp - lag(real_gdp) OVER o) / (lag(real_gdp) OVER o + 1e-8) AS real_gdp_growth,
  (unemployment - lag(unemployment) OVER o) / (lag(unemployment) OVER o + 1e-8) AS unemployment_growth, (mean_price - lag(mean_price) OVER o) / lag(mean_price) OVER o AS inflation, (mean_wage - lag(mean_wage) OVER o) / lag(mean_wage) OVER o AS wage_inflation FROM yrs WINDOW o AS (ORDER BY year))"""


def macro(t):
    month = F.to_date(F.date_trunc("month", "l_shipdate"))
    supply = t.lineitem.groupBy(month.alias("step")).agg(money("l_quantity").alias("supply"), (money("l_extendedprice") / money("l_quantity")).alias("price"))
    pairs = t.orders.groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("step"), "o_custkey").agg(money("o_totalprice").alias("v"), F.count("*").alias("c"))
    active = pairs.groupBy("step").agg(F.count("*").alias("busy"), (F.sum(F.round(F.col("v") * 100).cast("long")).cast("double") / 100.0 / F.sum("c")).alias("wage"))
    people = t.customer.agg(F.count("*")).scalar()
    return mp.macro_years(supply.join(active, "step").withColumn("idle", people - F.col("busy")))


_MACRO_OUT = f"CAST(year AS INTEGER) AS year, {r('nominal_gdp', 3)} AS nominal_gdp, {r('real_gdp', 1)} AS real_gdp, unemployment, {r('mean_price', 5)} AS mean_price, {r('mean_wage', 3)} AS mean_wage, " + ", ".join(f"{r(c)} AS {c}" for c in ("nominal_gdp_growth", "real_gdp_growth", "unemployment_growth", "inflation", "wage_inflation"))


@query("ec13_macro_years", f"WITH {MACRO} SELECT {_MACRO_OUT} FROM macro")
def ec13(t):
    return rounded(macro(t), 6, nominal_gdp=3, real_gdp=1, mean_price=5, mean_wage=3)


@query("ec14_policy_rate", f"""
WITH {MACRO} SELECT CAST(year AS INTEGER) AS year, {r('unemployment / 12 / (SELECT count(*) FROM customer)')} AS unemployment_rate, {r('greatest(0.0, coalesce(0.03 + 0.5 * (inflation - 0.02) + 0.5 * (0.04 - unemployment / 12 / (SELECT count(*) FROM customer)), 0.03))')} AS interest_rate FROM macro""")
def ec14(t):
    return rounded(mp.policy_rate(macro(t), t.customer.agg(F.count("*")).scalar()).select("year", "unemployment_rate", "interest_rate"))


TRADES = """trades AS (SELECT p_brand AS commodity, l_suppkey AS seller, o_custkey AS buyer, CAST(floor(cents / l_quantity / 10000 + 0.5) AS INTEGER) AS level, CAST(floor(cents / l_quantity + 0.5) AS BIGINT) AS price, cents AS cost, CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT) AS income
  FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem) JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey)"""


def trades(t):
    """Line items as trades, money in whole cents, price levels of a hundred."""
    lines = t.lineitem.withColumn("cents", cents("l_extendedprice"))
    unit = F.col("cents") / F.col("l_quantity")
    joined = lines.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(F.col("p_brand").alias("commodity"), F.col("l_suppkey").alias("seller"), F.col("o_custkey").alias("buyer"), F.floor(unit / 10000 + 0.5).cast("int").alias("level"),
                         F.floor(unit + 0.5).alias("price"), F.col("cents").alias("cost"), revenue().alias("income"))


def _trade_sql(side):
    return f"""WITH {TRADES} SELECT {side} AS agent, commodity, count(*) AS n_sales, {r('avg(price)', 4)} AS price, {r('avg(cost)', 4)} AS cost, {r('avg(income)', 4)} AS income FROM trades GROUP BY GROUPING SETS (({side}, commodity), ({side}))"""


@query("ec15_seller_statistics", _trade_sql("seller"))
def ec15(t):
    return rounded(mp.trade_statistics(trades(t), "agent", "seller"), 4)


@query("ec15_buyer_statistics", _trade_sql("buyer"))
def ec15_buyers(t):
    return rounded(mp.trade_statistics(trades(t), "agent", "buyer"), 4)


@query("ec16_order_depth", f"""
WITH {TRADES}, own AS (SELECT commodity, level, seller, count(*) AS k FROM trades GROUP BY 1, 2, 3), tot AS (SELECT commodity, level, sum(k) AS n FROM own GROUP BY 1, 2)
SELECT commodity, level, CAST(seller AS VARCHAR) AS seller, CAST(n - k AS BIGINT) AS available FROM own JOIN tot USING (commodity, level) UNION ALL SELECT commodity, level, 'anyone', CAST(n AS BIGINT) FROM tot""")
def ec16(t):
    d = mp.depth(trades(t), "seller", "level")
    return d.withColumn("seller", F.coalesce(F.col("seller").cast("string"), F.lit("anyone")))


@query("ec17_price_history", f"WITH {TRADES} SELECT commodity, seller, level, count(*) AS n FROM trades GROUP BY 1, 2, 3")
def ec17(t):
    return trades(t).groupBy("commodity", "seller", "level").agg(F.count("*").alias("n"))


@query("ec18_build_counts", """
WITH a AS (SELECT DISTINCT user_id FROM events), b AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' AND value > 100 GROUP BY 1)
SELECT user_id, coalesce(n, 0) AS n_builds, (SELECT count(*) FROM events WHERE event_type = 'purchase' AND value > 100) AS total_builds FROM a LEFT JOIN b USING (user_id)""")
def ec18(t):
    built = t.events.filter((F.col("event_type") == "purchase") & (F.col("value") > 100))
    return mp.counts_per_agent(built, t.events.select("user_id").distinct(), "user_id", "n_builds").withColumn("total_builds", built.agg(F.count("*")).scalar())


_RULES = f"{PANEL}, rl AS (SELECT agent, year, coin, income / 12 AS inc, lag(income) OVER (PARTITION BY agent ORDER BY year) / 12 AS last FROM panel)"


def _steps_sql(x):
    return f"least(greatest(floor(({x} - ({x}) % CAST(0.02 AS DOUBLE)) / CAST(0.02 AS DOUBLE) + 0.5), 0.0), 50.0)"


_BUFFER = "(1 + (coin / (last + 1e-8) - 1 / 1.03 - 1 / 1.03 * (inc / (last + 1e-8) - 1)) / (1 + (inc / (last + 1e-8) - 1) + 1e-8)) * inc / (coin + inc + 1e-8)"


@query("ec19_decision_rules", f"""
WITH {_RULES} SELECT agent, year, {_steps_sql('power(130.0 / (1e-8 + coin + inc), 0.1)')} AS by_price, {_steps_sql(_BUFFER)} AS by_buffer, {r('power(inc / (coin * 1.03 + 1e-8), 0.1)')} AS work_probability FROM rl WHERE last IS NOT NULL""")
def ec19(t):
    from pyspark.sql import Window

    last = F.lag("income").over(Window.partitionBy("agent").orderBy("year")) / 12
    held = panel(t).select("agent", "year", "coin", (F.col("income") / 12).alias("inc"), last.alias("last")).filter(F.col("last").isNotNull())
    rate = F.lit(0.03)
    return rounded(held.select(
        "agent", "year", mp.consumption_by_price(F.lit(130.0), F.col("coin"), F.col("inc")).alias("by_price"),
        mp.consumption_by_buffer(F.col("coin"), F.col("inc"), F.col("last"), rate).alias("by_buffer"), mp.work_probability(F.col("coin"), F.col("inc"), rate).alias("work_probability")))


@query("ec20_sorted_observations", f"""
WITH {YEARLY}, v AS (SELECT year, income, count(*) AS c FROM yearly GROUP BY 1, 2)
SELECT year, income, CAST(coalesce(sum(c) OVER (PARTITION BY year ORDER BY income ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS first_place, c AS n_equal, CAST(sum(c) OVER (PARTITION BY year) AS BIGINT) AS n FROM v""")
def ec20(t):
    return mp.ordered_values(yearly(t), ["year"], "income")
