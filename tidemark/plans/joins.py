"""JN: equi, as-of, range, interval, nearest, semi, anti and path joins."""

from pyspark.sql import functions as F

from ..operators import calendar as cal
from ..operators import joins as jn
from .calendars import FESTIVAL_SQL, HOLIDAY_SQL, festival_ranges, holidays
from .rankings import TRIPLES, nodes, triples
from .registry import query, rounded
from .standins import DAILY_TOTAL, MONTHLY, QUARTERLY, daily_total, money, monthly, quarterly, r, revenue, temperature, temperature_sql

_P = "CAST(period AS VARCHAR) AS period"


@query("jn1_combine_daily_sources", f"""
WITH {DAILY_TOTAL}, span AS (SELECT series_id, min(period) AS lo, max(period) AS hi FROM daily_total GROUP BY 1), spine AS (SELECT series_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS period FROM span),
ship AS (SELECT CAST(l_shipdate AS DATE) AS period, CAST(sum(CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS revenue FROM lineitem GROUP BY 1), {HOLIDAY_SQL}
SELECT s.series_id, CAST(s.period AS VARCHAR) AS period, d.value, revenue, {r(temperature_sql('s.period'), 5)} AS temp, h.name AS holiday
FROM spine s LEFT JOIN daily_total d ON d.period = s.period AND d.series_id = s.series_id LEFT JOIN ship ON ship.period = s.period LEFT JOIN holidays h ON h.day = s.period""")
def jn1(t):
    d = jn.regular(daily_total(t), "daily").drop("n")
    ship = t.lineitem.groupBy(F.to_date("l_shipdate").alias("period")).agg((F.sum(revenue()).cast("double") / 100.0).alias("revenue"))
    named = holidays(t.spark).select(F.col("day").alias("period"), F.col("name").alias("holiday"))
    out = jn.combine_sources(d, [ship, named], ["period"])
    return rounded(out.withColumn("temp", temperature(F.col("period"))), 5, value=2, revenue=2)


@query("jn2_asof", """
WITH econ AS (SELECT event_type, date_trunc('day', ts) + INTERVAL 6 HOUR AS published, round(CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100.0, 2) AS level FROM events GROUP BY 1, 2),
firsts AS (SELECT event_type, arg_min(level, published) AS level, min(published) AS published FROM econ GROUP BY 1)
SELECT e.event_id, e.event_type, coalesce(a.level, f.level) AS level, strftime(coalesce(a.published, f.published), '%Y-%m-%d %H:%M:%S') AS matched
FROM events e ASOF LEFT JOIN econ a ON e.event_type = a.event_type AND e.ts >= a.published LEFT JOIN firsts f ON f.event_type = e.event_type""")
def jn2(t):
    # a slower table: one level per event type, published each morning
    slow = t.events.groupBy("event_type", (F.date_trunc("day", "ts") + F.expr("interval 6 hours")).alias("ts")).agg(money("value").alias("level"))
    out = jn.asof_join(t.events.select("event_id", "event_type", "ts"), slow, ["event_type"], "ts", ["level"], bucket="day")
    return rounded(out.select("event_id", "event_type", "level", "matched"), 2)


@query("jn2_asof_no_key", """
WITH econ AS (SELECT date_trunc('day', ts) + INTERVAL 6 HOUR AS published, round(CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100.0, 2) AS level FROM events GROUP BY 1),
firsts AS (SELECT arg_min(level, published) AS level, min(published) AS published FROM econ)
SELECT e.event_id, coalesce(a.level, f.level) AS level, strftime(coalesce(a.published, f.published), '%Y-%m-%d %H:%M:%S') AS matched
FROM events e ASOF LEFT JOIN econ a ON e.ts >= a.published, firsts f""")
def jn2_no_key(t):
    slow = t.events.groupBy((F.date_trunc("day", "ts") + F.expr("interval 6 hours")).alias("ts")).agg(money("value").alias("level"))
    out = jn.asof_join(t.events.select("event_id", "ts"), slow, [], "ts", ["level"], bucket="day")
    return rounded(out.select("event_id", "level", "matched"), 2)


@query("jn3_align_two_series", f"""
WITH {MONTHLY}, ship AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS period, CAST(sum(CAST(round(l_quantity * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS quantity FROM lineitem GROUP BY 1)
SELECT series_id, CAST(m.period AS VARCHAR) AS period, value, quantity FROM monthly m JOIN ship USING (period) WHERE value IS NOT NULL AND quantity IS NOT NULL""")
def jn3(t):
    ship = t.lineitem.groupBy(F.to_date(F.date_trunc("month", "l_shipdate")).alias("period")).agg(money("l_quantity").alias("quantity"))
    return jn.align(monthly(t), ship, ["period"], ["value", "quantity"]).select("series_id", "period", "value", "quantity")


_RUNS = f"""{HOLIDAY_SQL}, flagged AS (SELECT d.series_id, d.period, d.value, h.day IS NOT NULL AS hol FROM daily_total d LEFT JOIN holidays h ON h.day = d.period),
runs AS (SELECT series_id, min(period) AS s, max(period) AS e FROM (SELECT *, period - CAST(row_number() OVER (PARTITION BY series_id ORDER BY period) AS INTEGER) AS island FROM flagged WHERE hol) GROUP BY series_id, island),
near AS (SELECT r.series_id, r.s, r.e, avg(f.value) FILTER (f.period BETWEEN r.s - 4 AND r.e + 4) AS v_near, avg(f.value) AS v_wide
  FROM runs r JOIN flagged f ON f.series_id = r.series_id AND NOT f.hol AND f.period BETWEEN r.s - 30 AND r.e + 30 GROUP BY 1, 2, 3)"""


@query("jn4_holiday_reference_days", f"""
WITH {DAILY_TOTAL}, {_RUNS}
SELECT series_id, CAST(s AS VARCHAR) AS start, CAST(e AS VARCHAR) AS "end", {r('coalesce(v_near, v_wide)', 6)} AS replacement FROM near""")
def jn4(t):
    days = daily_total(t).join(holidays(t.spark).select(F.col("day").alias("period"), F.lit(True).alias("h")), "period", "left")
    flagged = days.withColumn("is_holiday", F.coalesce("h", F.lit(False)))
    return rounded(cal.holiday_references(flagged, "is_holiday"), 6)


@query("jn5_events_with_daily_rows", f"""
WITH {DAILY_TOTAL}, {_RUNS}, {MONTHLY}, ev AS (SELECT series_id, s - 10 AS s, e + 10 AS e FROM runs)
SELECT ev.series_id, CAST(s AS VARCHAR) AS start, CAST(e AS VARCHAR) AS "end", count(*) AS n_days, {r('avg(value)', 6)} AS mean_value, {r('avg(CAST(hol AS INTEGER))', 6)} AS holiday_rate, avg(CAST(hol AS INTEGER)) > 0.4 AS in_holiday
FROM ev JOIN flagged f ON f.series_id = ev.series_id AND f.period BETWEEN s AND e GROUP BY ev.series_id, s, e""")
def jn5(t):
    days = daily_total(t).join(holidays(t.spark).select(F.col("day").alias("period"), F.lit(True).alias("h")), "period", "left")
    flagged = days.withColumn("is_holiday", F.coalesce("h", F.lit(False)))
    events = cal.islands(flagged.filter("is_holiday"), consecutive_days=True).select("series_id", F.date_sub("start", 10).alias("start"), F.date_add("end", 10).alias("end"))
    joined = jn.interval_join(flagged.select("series_id", "period", "value", "is_holiday"), events, ["series_id"], "period", "start", "end")
    rate = F.avg(F.col("is_holiday").cast("int"))
    return rounded(joined.groupBy("series_id", "start", "end").agg(F.count("*").alias("n_days"), F.avg("value").alias("mean_value"), rate.alias("holiday_rate"), (rate > 0.4).alias("in_holiday")), 6)


@query("jn6_nearest_festival", f"""
WITH {FESTIVAL_SQL}, days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS period FROM orders), p AS (SELECT period, datediff('day', first_day, period) AS gap, first_day FROM days, festivals)
SELECT CAST(period AS VARCHAR) AS period, CAST(arg_min(gap, (abs(gap), first_day)) AS INTEGER) AS days_to_start FROM p GROUP BY period""")
def jn6(t):
    days = t.orders.select(F.to_date("o_orderdate").alias("period")).distinct()
    return jn.nearest_start(days, "period", festival_ranges(t.spark), "first_day")


@query("jn7_same_year_offset", f"""
WITH {FESTIVAL_SQL}, days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS period FROM orders)
SELECT CAST(period AS VARCHAR) AS period, CAST(coalesce(datediff('day', first_day, period), 999) AS INTEGER) AS days_to_start, coalesce(abs(datediff('day', first_day, period)) <= 15, false) AS near
FROM (SELECT period FROM days UNION ALL SELECT CAST(period + INTERVAL 60 YEAR AS DATE) FROM days) LEFT JOIN festivals ON year(first_day) = year(period)""")
def jn7(t):
    days = t.orders.select(F.to_date("o_orderdate").alias("period")).distinct()
    # the same days sixty years on lie beyond the known festivals
    both = days.unionByName(days.select(F.add_months("period", 720).alias("period")))
    return jn.same_year_offset(both, "period", festival_ranges(t.spark), "first_day")


BRACKETS = [(-1000.0, 0.0, "none"), (0.0, 2454.0, "low"), (2454.0, 5000.0, "middle"), (5000.0, 8000.0, "high"), (8000.0, 100000.0, "top")]


@query("jn8_salary_bracket", """
SELECT c_custkey, CASE WHEN c_acctbal BETWEEN 8000 AND 100000 THEN 'top' WHEN c_acctbal BETWEEN 5000 AND 8000 THEN 'high' WHEN c_acctbal BETWEEN 2454 AND 5000 THEN 'middle'
  WHEN c_acctbal BETWEEN 0 AND 2454 THEN 'low' WHEN c_acctbal BETWEEN -1000 AND 0 THEN 'none' END AS bracket FROM customer""")
def jn8(t):
    return t.customer.select("c_custkey", jn.bracket_of(F.col("c_acctbal"), BRACKETS).alias("bracket"))


@query("jn8_job_offer", """
WITH b AS (SELECT c_custkey, CASE WHEN c_acctbal BETWEEN 8000 AND 100000 THEN 'top' WHEN c_acctbal BETWEEN 5000 AND 8000 THEN 'high' WHEN c_acctbal BETWEEN 2454 AND 5000 THEN 'middle'
  WHEN c_acctbal BETWEEN 0 AND 2454 THEN 'low' WHEN c_acctbal BETWEEN -1000 AND 0 THEN 'none' END AS bracket FROM customer)
SELECT c_custkey, bracket || ' job ' || (('0x' || left(md5(c_custkey || '|42'), 8))::BIGINT % 5 + 1) AS offer FROM b""")
def jn8_offer(t):
    jobs = F.create_map(*[x for lo, hi, name in BRACKETS for x in (F.lit(name), F.array(*[F.lit(f"{name} job {i}") for i in range(1, 6)]))])
    bracket = jn.bracket_of(F.col("c_acctbal"), BRACKETS)
    return t.customer.select("c_custkey", jn.seeded_choice(jobs[bracket], F.col("c_custkey"), F.lit(42)).alias("offer"))


_CUST = "cm AS (SELECT o_custkey AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS period FROM orders GROUP BY 1, 2)"


@query("jn9_missing_periods", f"""
WITH {_CUST}, span AS (SELECT series_id, min(period) AS lo, max(period) AS hi FROM cm GROUP BY 1), g AS (SELECT series_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS period FROM span)
SELECT g.series_id, CAST(g.period AS VARCHAR) AS period FROM g ANTI JOIN cm USING (series_id, period)""")
def jn9(t):
    return jn.missing_periods(monthly(t, "o_custkey"), "monthly")


@query("jn10_target_periods", f"""
WITH {QUARTERLY}, target AS (SELECT DISTINCT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000)
SELECT series_id, {_P}, value FROM quarterly SEMI JOIN target USING (period)""")
def jn10(t):
    large = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 400000)
    target = t.orders.filter(large).select(F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("period"))
    return quarterly(t).join(target, "period", "left_semi").select("series_id", "period", "value")


@query("jn11_month_to_quarter", f"""
WITH {MONTHLY}, {QUARTERLY} SELECT m.series_id, q.series_id AS sector, CAST(m.period AS VARCHAR) AS period, CAST(q.period AS VARCHAR) AS quarter, m.value, q.value AS revenue
FROM monthly m LEFT JOIN quarterly q ON CAST(date_trunc('quarter', m.period) AS DATE) = q.period""")
def jn11(t):
    q = quarterly(t).select(F.col("series_id").alias("sector"), F.col("period").alias("quarter"), F.col("value").alias("revenue"))
    m = monthly(t).withColumn("quarter", F.to_date(F.date_trunc("quarter", "period")))
    return m.join(q, "quarter", "left").select("series_id", "sector", "period", "quarter", "value", "revenue")


@query("jn12_last_year", f"""
WITH {MONTHLY} SELECT a.series_id, CAST(a.period AS VARCHAR) AS period, a.value, b.value AS value_last_year, {r('(a.value - b.value) / abs(b.value)')} AS yoy
FROM monthly a LEFT JOIN monthly b ON a.series_id = b.series_id AND b.period = a.period - INTERVAL 12 MONTH""")
def jn12(t):
    out = jn.same_period_last_year(monthly(t).drop("n"), ["value"])
    return rounded(out.withColumn("yoy", F.try_divide(F.col("value") - F.col("value_last_year"), F.abs("value_last_year"))), 6, value=2, value_last_year=2)


@query("jn13_named_triples", f"""
WITH {TRIPLES}, j AS (SELECT src, dst, rel, coalesce(a.name, src) AS subject_name, coalesce(b.name, dst) AS object_name FROM triples LEFT JOIN nodes a ON a.id = src LEFT JOIN nodes b ON b.id = dst)
SELECT src, rel, dst, subject_name, object_name FROM j WHERE upper(rel) = 'BASED_IN' AND contains(lower(object_name), 'nation_1')""")
def jn13(t):
    found = jn.named_triples(triples(t), nodes(t), relation="based_in", object_part="Nation_1")
    return found.select("src", "rel", "dst", "subject_name", "object_name")


@query("jn14_two_hop_paths", f"""
WITH {TRIPLES} SELECT a.src, a.dst AS mid, b.dst FROM triples a LEFT JOIN triples b ON b.src = a.dst AND b.rel = 'IN_REGION' WHERE a.rel = 'BASED_IN'""")
def jn14(t):
    return jn.two_hops(triples(t), "BASED_IN", "IN_REGION")


@query("jn15_feature_assembly", f"""
WITH {MONTHLY} SELECT series_id, {_P}, {r('(value - lag(value) OVER w) / nullif(abs(lag(value) OVER w), 0) * 100')} AS mom, {r('avg(value) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)', 3)} AS ma_3, {r('sum(value) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)', 2)} AS capacity_delta
FROM monthly WINDOW w AS (PARTITION BY series_id ORDER BY period)""")
def jn15(t):
    from ..operators import windows as wn

    out = wn.net_increment(monthly(t)).select("series_id", "period", wn.lag_growth("value", 1).alias("mom"), wn.moving_average("value", 3).alias("ma_3"), "capacity_delta")
    return rounded(out, 6, ma_3=3, capacity_delta=2)
