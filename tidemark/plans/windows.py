"""WN: growth, smoothing, filling, outliers and mixed-frequency windows."""

from pyspark.sql import functions as F

from ..operators import joins as jn
from ..operators import ordered as od
from ..operators import windows as wn
from .registry import query, rounded
from .standins import DAILY, DAILY_GRID, DAILY_TOTAL, HOURLY, MONTHLY, QUARTERLY, W, daily, daily_total, frame, hourly, monthly, quarterly, r

_P = "CAST(period AS VARCHAR) AS period"


def _growth(lag, source="monthly", with_=MONTHLY):
    return f"""WITH {with_} SELECT series_id, {_P}, {r(f'(value - lag(value, {lag}) {W}) / nullif(abs(lag(value, {lag}) {W}), 0) * 100')} AS growth FROM {source}"""


@query("wn1_yoy_growth", _growth(12))
def wn1(t):
    return rounded(monthly(t).select("series_id", "period", wn.lag_growth("value", 12).alias("growth")))


@query("wn2_mom_growth", _growth(1))
def wn2(t):
    return rounded(monthly(t).select("series_id", "period", wn.lag_growth("value", 1).alias("growth")))


@query("wn3_cumulative_growth", f"""
WITH {MONTHLY}, y AS (SELECT *, sum(value) OVER (PARTITION BY series_id, year(period) ORDER BY period) AS ytd FROM monthly)
SELECT series_id, {_P}, {r(f'(ytd / nullif(lag(ytd, 12) {W}, 0) - 1) * 100')} AS cumulative_yoy FROM y""")
def wn3(t):
    return rounded(wn.cumulative_growth(monthly(t)).select("series_id", "period", "cumulative_yoy"))


@query("wn4_moving_average", f"""
WITH {MONTHLY} SELECT series_id, {_P}, {', '.join(f"{r(f'avg(value) {W[:-1]} {frame(w)})', 3)} AS ma_{w}" for w in (3, 6, 12))},
  {r(f'avg(value) {W[:-1]} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)', 3)} AS trailing_3 FROM monthly""")
def wn4(t):
    return rounded(monthly(t).select("series_id", "period", *[wn.moving_average("value", w).alias(f"ma_{w}") for w in (3, 6, 12)],
                                     wn.moving_average("value", 3, centre=False).alias("trailing_3")), 3)


def _roll_sql(w):
    over = f"{W[:-1]} {frame(w)})"
    guard = f"CASE WHEN count(value) {over} >= {min(3, w)} THEN"
    fns = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max", "skew": "skewness", "kurt": "kurtosis"}
    digits = {"skew": 6, "kurt": 6}
    return ", ".join(f"{r(f'{guard} {fn}(value) {over} END', digits.get(s, 3))} AS roll_{w}_{s}" for s, fn in fns.items())


@query("wn5_rolling_stats", f"WITH {MONTHLY} SELECT series_id, {_P}, {', '.join(_roll_sql(w) for w in (3, 6, 12))} FROM monthly")
def wn5(t):
    stats = ("mean", "std", "min", "max", "skew", "kurt")
    out = wn.rolling_stats(monthly(t), "value", (3, 6, 12), stats).drop("value", "n")
    return rounded(out, 3, **{f"roll_{w}_{s}": 6 for w in (3, 6, 12) for s in ("skew", "kurt")})


@query("wn6_net_increment", f"""
WITH {MONTHLY}, d AS (SELECT *, sum(value) {W[:-1]} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS cd FROM monthly)
SELECT series_id, {_P}, {r('cd', 3)} AS capacity_delta, {r(f'lag(cd, 12) {W}', 3)} AS capacity_delta_prev_year,
  {r(f'(cd - lag(cd, 12) {W}) / nullif(abs(lag(value, 12) {W}), 0) * 100')} AS capacity_change_rate FROM d""")
def wn6(t):
    return rounded(wn.net_increment(monthly(t)).drop("value", "n"), 3, capacity_change_rate=6)


@query("wn7_first_difference", f"WITH {MONTHLY} SELECT series_id, {_P}, {r(f'value - lag(value) {W}', 3)} AS diff FROM monthly")
def wn7(t):
    return rounded(monthly(t).select("series_id", "period", wn.difference().alias("diff")), 3)


_LAST = f"last_value(value IGNORE NULLS) {W[:-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_NEXT = f"first_value(value IGNORE NULLS) {W[:-1]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query("wn8_fill_methods", f"""
WITH {DAILY_GRID}, s AS (SELECT series_id, avg(value) AS mean, median(value) AS med FROM daily_grid GROUP BY 1)
SELECT series_id, {_P}, coalesce(value, {_LAST}, {_NEXT}) AS forward_fill, coalesce(value, {_NEXT}, {_LAST}) AS backward_fill,
  {r('coalesce(value, mean)', 3)} AS mean, {r('coalesce(value, med)', 3)} AS median, coalesce(value, 0.0) AS zero FROM daily_grid JOIN s USING (series_id)""")
def wn8(t):
    out = jn.regular(daily(t), "daily").drop("n")
    for m in ("forward_fill", "backward_fill", "mean", "median", "zero"):
        out = wn.fill(out, "value", m, m)
    return rounded(out.drop("value"), 3)


def _interp_sql(value, at, source):
    """Two CTEs: neighbours and the filled column ``v``."""
    prev = f"{W[:-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    nxt = f"{W[:-1]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return f"""placed AS (SELECT *, {at} AS pos FROM {source}),
near AS (SELECT *, last_value({value} IGNORE NULLS) {prev} AS v0, last_value(CASE WHEN {value} IS NOT NULL THEN pos END IGNORE NULLS) {prev} AS a0,
  first_value({value} IGNORE NULLS) {nxt} AS v1, first_value(CASE WHEN {value} IS NOT NULL THEN pos END IGNORE NULLS) {nxt} AS a1 FROM placed),
filled AS (SELECT *, coalesce({value}, v0 + (v1 - v0) * (pos - a0) / nullif(a1 - a0, 0), v0, v1) AS v FROM near)"""


_ROW_AT = f"CAST(row_number() {W} AS DOUBLE)"


@query("wn9_interpolation", f"""
WITH {MONTHLY}, {DAILY_GRID}, uneven AS (SELECT series_id, period, value FROM daily_grid WHERE value IS NOT NULL OR day(period) IN (1, 15)),
{_interp_sql('value', _ROW_AT, 'uneven')},
timed AS (SELECT series_id, period, coalesce(value, v0 + (v1 - v0) * (d - d0) / nullif(d1 - d0, 0), v0, v1) AS by_time FROM (
  SELECT *, CAST(epoch(period) AS DOUBLE) AS d, last_value(CASE WHEN value IS NOT NULL THEN CAST(epoch(period) AS DOUBLE) END IGNORE NULLS) {W[:-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS d0,
    first_value(CASE WHEN value IS NOT NULL THEN CAST(epoch(period) AS DOUBLE) END IGNORE NULLS) {W[:-1]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS d1 FROM filled))
SELECT series_id, {_P}, {r('v', 3)} AS by_row, {r('by_time', 3)} AS by_time FROM filled JOIN timed USING (series_id, period)""")
def wn9(t):
    # days with orders plus fixed reading days: an unevenly spaced grid, so the two forms differ
    uneven = jn.regular(daily(t), "daily").drop("n").filter(F.col("value").isNotNull() | F.dayofmonth("period").isin(1, 15))
    out = wn.interpolate(wn.interpolate(uneven, "value", "by_row"), "value", "by_time", by_time=True)
    return rounded(out.drop("value"), 3)


@query("wn10_seasonal_interpolation", f"""
WITH {DAILY_GRID}, n AS (SELECT series_id, count(*) AS n FROM daily_grid GROUP BY 1), g AS (SELECT series_id, period, ln(value) AS value, n FROM daily_grid JOIN n USING (series_id)),
tr AS (SELECT *, CASE WHEN n >= 24 THEN avg(value) {W[:-1]} {frame(12)}) WHEN n >= 14 THEN avg(value) {W[:-1]} {frame(7)}) ELSE avg(value) {W[:-1]} {frame(3)}) END AS trend FROM g),
rest AS (SELECT series_id, period, trend, value - trend AS rest FROM tr),
{_interp_sql('rest', _ROW_AT, 'rest')},
s AS (SELECT series_id, period, trend + v AS value FROM filled)
SELECT series_id, {_P}, {r(f'coalesce(value, {_LAST}, {_NEXT})', 7)} AS filled FROM s""")
def wn10(t):
    logs = jn.regular(daily(t), "daily").withColumn("value", F.ln("value"))
    return rounded(wn.seasonal_interpolate(logs, "value", "filled").select("series_id", "period", "filled"), 7)


@query("wn11_auto_fill", f"""
WITH {DAILY_TOTAL}, span AS (SELECT series_id, min(period) AS lo, max(period) AS hi FROM daily_total GROUP BY 1),
spine AS (SELECT series_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS period FROM span),
g AS (SELECT s.series_id, s.period, d.value, d.n, CASE WHEN d.n IS NOT NULL THEN 'seen' END AS note FROM spine s LEFT JOIN daily_total d USING (series_id, period)),
rate AS (SELECT 100.0 * count(*) FILTER (value IS NULL) / count(*) AS miss FROM g),
{_interp_sql('value', _ROW_AT, 'g')}
SELECT series_id, {_P}, CASE WHEN (SELECT miss FROM rate) <= 20 THEN {r('v', 3)} END AS value, (SELECT miss FROM rate) <= 20 AS kept FROM filled""")
def wn11(t):
    gaps = jn.regular(daily_total(t), "daily").withColumn("note", F.when(F.col("n").isNotNull(), "seen")).drop("n")
    out = wn.auto_fill(gaps, ["value", "note"])
    # a column with more than a fifth missing is left out by the operator
    kept = {"value", "note"} <= set(out.columns)
    return rounded(out.select("series_id", "period", (F.col("value") if kept else F.lit(None).cast("double")).alias("value"), F.lit(kept).alias("kept")), 3)


@query("wn12_rolling_zscore", f"""
WITH {DAILY_TOTAL}, z AS (SELECT *, CASE WHEN count(value) {W[:-1]} {frame(30)}) >= 3 THEN
  (value - avg(value) {W[:-1]} {frame(30)})) / nullif(stddev_samp(value) {W[:-1]} {frame(30)}), 0) END AS z FROM daily_total)
SELECT series_id, {_P}, {r('z')} AS z, coalesce(abs(z) > 3, false) AS is_outlier FROM z""")
def wn12(t):
    return rounded(wn.rolling_zscore_outlier(daily_total(t)).select("series_id", "period", "z", "is_outlier"))


_BOUNDS = """priced AS (SELECT o_orderkey, o_orderpriority, power(o_totalprice / 100000.0, 3) AS v FROM orders),
bounds AS (SELECT o_orderpriority, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper, m - 3 * sd AS lower_sigma, m + 3 * sd AS upper_sigma FROM (
  SELECT o_orderpriority, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, avg(v) AS m, stddev_samp(v) AS sd FROM priced GROUP BY 1))"""


def _bounds(df, key, value):
    q = od.quantiles(df, [key], value, [0.25, 0.75], ["q1", "q3"])
    iqr = F.col("q3") - F.col("q1")
    iqr_bounds = q.select(key, (F.col("q1") - 1.5 * iqr).alias("lower"), (F.col("q3") + 1.5 * iqr).alias("upper"))
    spread = df.groupBy(key).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_sd"))
    sigma = spread.select(key, (F.col("_m") - 3 * F.col("_sd")).alias("lower_sigma"), (F.col("_m") + 3 * F.col("_sd")).alias("upper_sigma"))
    return iqr_bounds.join(sigma, key)


def _priced(t):
    return t.orders.select("o_orderkey", "o_orderpriority", F.pow(F.col("o_totalprice") / 100000.0, 3).alias("v"))


@query("wn13_iqr_sigma_outliers", f"""
WITH {_BOUNDS} SELECT o_orderpriority, {r('lower', 2)} AS lower, {r('upper', 2)} AS upper, {r('lower_sigma', 2)} AS lower_sigma, {r('upper_sigma', 2)} AS upper_sigma,
  count(*) FILTER (v < lower OR v > upper) AS n_iqr, count(*) FILTER (v < lower_sigma OR v > upper_sigma) AS n_sigma, count(*) AS n
FROM priced JOIN bounds USING (o_orderpriority) GROUP BY ALL""")
def wn13(t):
    priced = _priced(t)
    marked = wn.outside(priced, _bounds(priced, "o_orderpriority", "v"), "v", "o_orderpriority", "lower", "upper", "iqr")
    sigma = (F.col("v") < F.col("lower_sigma")) | (F.col("v") > F.col("upper_sigma"))
    return rounded(marked.groupBy("o_orderpriority", "lower", "upper", "lower_sigma", "upper_sigma").agg(
        F.count_if("iqr").alias("n_iqr"), F.count_if(sigma).alias("n_sigma"), F.count("*").alias("n")), 2)


@query("wn14_handle_outliers", f"""
WITH {DAILY_TOTAL}, b AS (SELECT series_id, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM daily_total GROUP BY 1),
m AS (SELECT d.series_id, d.period, d.value, q1 - 0.5 * (q3 - q1) AS lower, q3 + 0.5 * (q3 - q1) AS upper FROM daily_total d JOIN b USING (series_id)),
k AS (SELECT series_id, period, value AS raw, lower, upper, value < lower OR value > upper AS flag, CASE WHEN NOT (value < lower OR value > upper) THEN value END AS value FROM m),
{_interp_sql('value', _ROW_AT, 'k')}
SELECT series_id, {_P}, flag, {r('v', 3)} AS interpolated, {r('greatest(lower, least(upper, raw))', 3)} AS capped, {r('value', 3)} AS kept FROM filled""")
def wn14(t):
    d = daily_total(t).drop("n")
    q = d.groupBy("series_id").agg(F.percentile("value", 0.25).alias("q1"), F.percentile("value", 0.75).alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    bounds = q.select("series_id", (F.col("q1") - 0.5 * iqr).alias("lower"), (F.col("q3") + 0.5 * iqr).alias("upper"))
    marked = wn.outside(d, bounds, "value", "series_id", "lower", "upper", "is_outlier")
    on = ["series_id", "period"]
    flags = wn.handle_outliers(marked, "flag").select(*on, F.col("is_outlier_value").alias("flag"))
    smooth = wn.handle_outliers(marked, "interpolate").select(*on, F.col("value").alias("interpolated"))
    capped = wn.handle_outliers(marked, "cap").select(*on, F.col("value").alias("capped"))
    kept = wn.handle_outliers(marked, "remove").select(*on, F.col("value").alias("kept"))
    return rounded(flags.join(smooth, on).join(capped, on).join(kept, on, "left"), 3)


@query("wn15_ytd_to_month", f"""
WITH {MONTHLY}, y AS (SELECT series_id, period, sum(value) OVER (PARTITION BY series_id, year(period) ORDER BY period) AS ytd FROM (SELECT series_id, period, value FROM monthly UNION ALL SELECT series_id || ' late', period, value FROM monthly WHERE NOT (year(period) = 1997 AND month(period) <= 3))),
p AS (SELECT *, lag(ytd) OVER (PARTITION BY series_id, year(period) ORDER BY period) AS prev,
  last_value(CASE WHEN month(period) = 12 THEN ytd END IGNORE NULLS) {W[:-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dec_v,
  last_value(CASE WHEN month(period) = 12 THEN year(period) END IGNORE NULLS) {W[:-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dec_y FROM y),
s AS (SELECT series_id, period, CASE WHEN month(period) = 1 OR (prev IS NULL AND month(period) <= 2) THEN ytd WHEN prev IS NOT NULL THEN ytd - prev WHEN dec_y = year(period) - 1 THEN ytd - dec_v END AS single FROM p)
SELECT series_id, {_P}, {r('CASE WHEN single >= 0 THEN single END', 2)} AS single FROM s WHERE single IS NOT NULL""")
def wn15(t):
    # beside every series a copy of which one year opens in April, as with a late first report
    every = monthly(t).select("series_id", "period", "value")
    late = every.filter(~((F.year("period") == 1997) & (F.month("period") <= 3))).withColumn("series_id", F.concat("series_id", F.lit(" late")))
    ytd = every.unionByName(late).select("series_id", "period", wn.year_to_date().alias("ytd"))
    return rounded(wn.monthly_from_ytd(ytd, "ytd").select("series_id", "period", "single"), 2)


@query("wn16_ytd_to_quarter", f"""
WITH {QUARTERLY}, y AS (SELECT series_id, period, sum(value) OVER (PARTITION BY series_id, year(period) ORDER BY period) AS ytd FROM quarterly),
s AS (SELECT *, ytd - coalesce(lag(ytd) OVER (PARTITION BY series_id, year(period) ORDER BY period), 0) AS single FROM y)
SELECT series_id, {_P}, {r('single', 2)} AS single, CAST(year(period) >= 1997 AND single > 0 AS INTEGER) AS eligible FROM s""")
def wn16(t):
    ytd = quarterly(t).select("series_id", "period", wn.year_to_date().alias("ytd"))
    return rounded(wn.quarterly_from_ytd(ytd, "ytd", since=1997).select("series_id", "period", "single", "eligible"), 2)


_KINDS = ("almon", "beta", "exponential", "equal")


def _midas_sql(kind, newest_first):
    w = wn.lag_weights(30, kind)
    w = list(reversed(w)) if newest_first else w
    return f"CASE WHEN len(vs) = 30 THEN list_inner_product(vs, {[float(x) for x in w]}) END"


@query("wn17_midas", f"""
WITH {DAILY}, h AS (SELECT series_id, period, CAST(date_trunc('month', period) AS DATE) AS bucket, list(value) {W[:-1]} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS vs,
  lead(date_trunc('month', period)) {W} AS nxt FROM daily),
e AS (SELECT series_id, bucket, {', '.join(f'{_midas_sql(k, True)} AS {k}' for k in _KINDS)}, {_midas_sql('almon', False)} AS almon_oldest_first
  FROM h WHERE nxt IS NULL OR nxt <> bucket),
g AS (SELECT series_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS bucket FROM (SELECT series_id, min(bucket) AS lo, max(bucket) AS hi FROM e GROUP BY 1)),
c AS (SELECT g.series_id, g.bucket, {', '.join(f'last_value({k} IGNORE NULLS) OVER (PARTITION BY g.series_id ORDER BY g.bucket) AS {k}' for k in (*_KINDS, 'almon_oldest_first'))} FROM g LEFT JOIN e USING (series_id, bucket))
SELECT series_id, CAST(bucket AS VARCHAR) AS bucket, {', '.join(f'{r(k, 3)} AS {k}' for k in (*_KINDS, 'almon_oldest_first'))} FROM c WHERE equal IS NOT NULL""")
def wn17(t):
    d = daily(t)
    both = wn.mixed_frequency(d, {k: wn.lag_weights(30, k) for k in _KINDS})
    oldest = wn.mixed_frequency(d, {"almon_oldest_first": wn.lag_weights(30, "almon")}, newest_first=False)
    return rounded(both.join(oldest, ["series_id", "bucket"]), 3)


@query("wn18_median_baseline", f"""
WITH {DAILY_TOTAL}, b AS (SELECT *, CASE WHEN count(value) {W[:-1]} {frame(91)}) >= 15 THEN quantile_cont(value, 0.5) {W[:-1]} {frame(91)}) END AS baseline FROM daily_total)
SELECT series_id, {_P}, {r('baseline', 3)} AS baseline, {r('coalesce(value - baseline, 0)', 3)} AS deviation FROM b""")
def wn18(t):
    return rounded(wn.rolling_median_deviation(daily_total(t)).select("series_id", "period", "baseline", "deviation"), 3)


@query("wn19_sliding_vectors", f"""
WITH {HOURLY}, z AS (SELECT series_id, period, (value - avg(value) OVER s) / (stddev_pop(value) OVER s + 1e-8) AS a, (n - avg(n) OVER s) / (stddev_pop(n) OVER s + 1e-8) AS b
  FROM hourly WINDOW s AS (PARTITION BY series_id)),
v AS (SELECT series_id, lead(period, 15) {W} AS period, list([a, b]) {W[:-1]} ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING) AS rows FROM z)
SELECT series_id, strftime(period, '%Y-%m-%d %H:%M:%S') AS period, CAST(len(flatten(rows)) AS INTEGER) AS size, {r('list_sum(flatten(rows))')} AS total, {r('rows[1][1]')} AS head, {r('rows[30][2]')} AS tail
FROM v WHERE len(rows) = 30""")
def wn19(t):
    v = wn.sliding_vectors(hourly(t), ["value", "n"])
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x)
    return rounded(v.select("series_id", "period", F.size("vector").alias("size"), total.alias("total"), F.get("vector", F.lit(0)).alias("head"), F.get("vector", F.lit(59)).alias("tail")))


_CLIMATOLOGY = f"""{DAILY_TOTAL}, cm AS (SELECT series_id, CAST(dayofyear(period) AS INTEGER) AS doy, avg(value) AS m FROM daily_total GROUP BY 1, 2),
cg AS (SELECT s.series_id, d.doy AS period, cm.m AS value FROM (SELECT DISTINCT series_id FROM cm) s, (SELECT CAST(unnest(range(1, 367)) AS INTEGER) AS doy) d LEFT JOIN cm ON cm.series_id = s.series_id AND cm.doy = d.doy),
{_interp_sql('value', _ROW_AT, 'cg')},
ring AS (SELECT series_id, period, v FROM filled UNION ALL SELECT series_id, period - 366, v FROM filled WHERE period > 359 UNION ALL SELECT series_id, period + 366, v FROM filled WHERE period <= 7),
sm AS (SELECT series_id, period AS doy, avg(v) {W[:-1]} {frame(15)}) AS s FROM ring),
cl AS (SELECT series_id, doy, s - avg(s) OVER (PARTITION BY series_id) AS climatology FROM sm WHERE doy BETWEEN 1 AND 366)"""


@query("wn20_remove_climatology", f"""
WITH {_CLIMATOLOGY} SELECT d.series_id, CAST(d.period AS VARCHAR) AS period, {r('climatology', 2)} AS climatology, {r('value - climatology', 2)} AS adjusted
FROM daily_total d JOIN cl ON cl.series_id = d.series_id AND cl.doy = dayofyear(d.period)""")
def wn20(t):
    return rounded(wn.remove_climatology(daily_total(t)).select("series_id", "period", "climatology", "adjusted"), 2)


@query("wn21_robust_z", f"""
WITH {MONTHLY}, m AS (SELECT series_id, median(value) AS med, stddev_pop(value) AS sd FROM monthly GROUP BY 1),
a AS (SELECT series_id, median(abs(value - med)) AS mad FROM monthly JOIN m USING (series_id) GROUP BY 1),
j AS (SELECT series_id, median(abs(d - dm)) AS jump FROM (SELECT *, median(d) OVER (PARTITION BY series_id) AS dm FROM (SELECT series_id, value - lag(value) {W} AS d FROM monthly)) GROUP BY 1)
SELECT series_id, {_P}, {r('(value - med) / (1.4826 * CASE WHEN mad > 1e-12 THEN mad WHEN sd > 0 THEN sd ELSE 1e-12 END)')} AS robust_z, {r('jump', 3)} AS jump_scale
FROM monthly JOIN m USING (series_id) JOIN a USING (series_id) JOIN j USING (series_id)""")
def wn21(t):
    m = monthly(t)
    steps = m.select("series_id", wn.difference().alias("d"))
    middle = steps.groupBy("series_id").agg(F.percentile("d", 0.5).alias("dm"))
    jump = steps.join(middle, "series_id").groupBy("series_id").agg(F.percentile(F.abs(F.col("d") - F.col("dm")), 0.5).alias("jump_scale"))
    return rounded(wn.robust_z(m).join(jump, "series_id").select("series_id", "period", "robust_z", "jump_scale"), 6, jump_scale=3)
