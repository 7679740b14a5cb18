"""MDL: regressions on panels and the chains built from them."""

from functools import reduce

from pyspark.sql import functions as F

from ..functions.numbers import growth
from ..operators import models as md
from ..operators import windows as wn
from .calendars import holidays
from .registry import query, rounded
from .standins import DAILY, MONTHLY, W, cents, daily, frame, monthly, r, revenue, temperature, temperature_sql

_P = "CAST(period AS VARCHAR) AS period"
_TEMP_SQL = temperature_sql("CAST(period + INTERVAL 14 DAY AS DATE)")


def _with_temp(t):
    return monthly(t).drop("n").withColumn("temp", temperature(F.date_add("period", 14)))


def _daily_temp(t):
    return daily(t).drop("n").withColumn("temp", temperature(F.col("period")))


def _shown(df):
    return rounded(df.withColumn("month_coefs", F.to_json("month_coefs")), 4)


# within months: sums of squares and products about the month's means, solved for the two slopes
_WITHIN = f"""d0 AS (SELECT series_id, month(period) AS m, value AS y, greatest(0, 10.0 - t) AS a, greatest(0, t - 25.0) AS b FROM (SELECT *, {temperature_sql("period")} AS t FROM daily)),
d1 AS (SELECT *, avg(y) OVER w AS my, avg(a) OVER w AS ma, avg(b) OVER w AS mb FROM d0 WINDOW w AS (PARTITION BY series_id, m)),
s1 AS (SELECT series_id, count(*) AS n, sum((a-ma)*(a-ma)) AS aa, sum((a-ma)*(b-mb)) AS ab, sum((b-mb)*(b-mb)) AS bb, sum((a-ma)*(y-my)) AS ay, sum((b-mb)*(y-my)) AS by_, sum((y-my)*(y-my)) AS yy, var_pop(y) * count(*) AS total FROM d1 GROUP BY 1),
s2 AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS ha, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS cb FROM s1),
jan AS (SELECT series_id, any_value(my) AS my, any_value(ma) AS ma, any_value(mb) AS mb FROM d1 WHERE m = 1 GROUP BY 1)"""


@query("mdl1_temperature_piecewise", f"""
WITH {DAILY}, {_WITHIN} SELECT series_id, 'piecewise' AS method, n, {r('my - ha * ma - cb * mb', 2)} AS intercept, {r('ha', 3)} AS heating_coef, {r('cb', 3)} AS cooling_coef, {r('1 - (yy - ha * ay - cb * by_) / total', 6)} AS r_squared FROM s2 JOIN jan USING (series_id)""")
def mdl1(t):
    return rounded(md.fit_temperature(_daily_temp(t)).select("series_id", "method", "n", "intercept", "heating_coef", "cooling_coef", "r_squared"), 6, intercept=2, heating_coef=3, cooling_coef=3)


@query("mdl1_month_marks", f"""
WITH {DAILY}, {_WITHIN} SELECT DISTINCT series_id, CAST(m AS INTEGER) AS month, {r('d.my - j.my - ha * (d.ma - j.ma) - cb * (d.mb - j.mb)', 2)} AS coef FROM d1 d JOIN s2 USING (series_id) JOIN jan j USING (series_id) WHERE m > 1""")
def mdl1_months(t):
    fit = md.fit_temperature(_daily_temp(t))
    return rounded(fit.select("series_id", F.explode("month_coefs").alias("month", "coef")), 2)


@query("mdl1_temperature_line", f"""
WITH {MONTHLY}, m AS (SELECT *, {_TEMP_SQL} AS temp FROM monthly)
SELECT series_id, 'linear' AS method, count(*) AS n, {r('regr_intercept(value, temp)', 2)} AS intercept, {r('regr_slope(value, temp)', 3)} AS temp_coef, {r('regr_r2(value, temp)', 6)} AS r_squared FROM m GROUP BY 1""")
def mdl1_line(t):
    return rounded(md.fit_temperature(_with_temp(t), "linear", months=False).select("series_id", "method", "n", "intercept", "temp_coef", "r_squared"), 6, intercept=2, temp_coef=3)


@query("mdl2_ridge", f"""
WITH {MONTHLY}, m AS (SELECT series_id, value, {_TEMP_SQL} AS temp FROM monthly), s AS (SELECT series_id, count(*) AS n, avg(temp) AS mt, avg(value) AS mv, covar_pop(value, temp) * count(*) / (var_pop(temp) * count(*) + 1) AS b FROM m GROUP BY 1)
SELECT series_id, 'ridge' AS method, n, {r('mv - mt * b', 2)} AS intercept, {r('b', 3)} AS temp_coef FROM s""")
def mdl2_ridge(t):
    return rounded(md.fit_temperature(_with_temp(t), "ridge", months=False).select("series_id", "method", "n", "intercept", "temp_coef"), 3, intercept=2)


@query("mdl2_huber")
def mdl2_huber(t):
    return _shown(md.fit_temperature(_with_temp(t), "huber"))


@query("mdl3_temperature_correct", f"""
WITH {MONTHLY}, m AS (SELECT *, {_TEMP_SQL} AS temp FROM monthly), c AS (SELECT series_id, regr_slope(value, temp) AS b FROM m GROUP BY 1)
SELECT series_id, {_P}, {r('b * temp', 3)} AS temp_effect, {r('value - b * temp', 3)} AS corrected FROM m JOIN c USING (series_id)""")
def mdl3(t):
    m = _with_temp(t)
    return rounded(md.temperature_correct(m, md.fit_temperature(m, "linear", months=False)).select("series_id", "period", "temp_effect", "corrected"), 3)


@query("mdl4_correction_chain")
def mdl4(t):
    return rounded(md.apply_corrections(_daily_temp(t), holidays(t.spark)), 3)


PANEL = MONTHLY + f""",
mg AS (SELECT *, (value - lag(value, 12) OVER w) / nullif(abs(lag(value, 12) OVER w), 0) * 100 AS yoy, sum(value) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS cd, lag(value, 12) OVER w AS base FROM monthly WINDOW w AS (PARTITION BY series_id ORDER BY period)),
mc AS (SELECT *, (cd - lag(cd, 12) {W}) / nullif(abs(base), 0) * 100 AS cap_rate FROM mg),
qt AS (SELECT CAST(date_trunc('quarter', l_shipdate) AS DATE) AS quarter, CAST(sum(CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS v FROM lineitem GROUP BY 1),
gdp AS (SELECT quarter, (v - lag(v, 4) OVER (ORDER BY quarter)) / nullif(abs(lag(v, 4) OVER (ORDER BY quarter)), 0) * 100 AS gdp FROM qt),
wide AS (SELECT series_id, CAST(date_trunc('quarter', period) AS DATE) AS quarter, {', '.join(f"max(CASE WHEN (month(period) - 1) % 3 + 1 = {m} THEN {c} END) AS month{m}_{c}" for c in ('yoy', 'cap_rate') for m in (1, 2, 3))} FROM mc GROUP BY 1, 2),
panel AS (SELECT w.*, g.gdp, p.gdp AS prev_gdp FROM wide w LEFT JOIN gdp g USING (quarter) LEFT JOIN gdp p ON p.quarter + INTERVAL 3 MONTH = w.quarter)"""
_PANEL_COLS = ["prev_gdp", *[f"month{m}_{n}" for n in ("yoy", "cap_rate") for m in (1, 2, 3)], "gdp"]


def panel(t):
    m = wn.net_increment(monthly(t)).select("series_id", "period", wn.lag_growth("value", 12).alias("yoy"), F.col("capacity_change_rate").alias("cap_rate"))
    q = t.lineitem.groupBy(F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("quarter")).agg((F.sum(revenue()).cast("double") / 100.0).alias("v"))
    before = q.select(F.add_months("quarter", 12).alias("quarter"), F.col("v").alias("v0"))
    gdp = q.join(before, "quarter", "left").select("quarter", growth(F.col("v"), F.col("v0")).alias("gdp"))
    return md.quarter_panel(m, gdp)


@query("mdl5_quarter_panel", f"WITH {PANEL} SELECT series_id, CAST(quarter AS VARCHAR) AS quarter, {', '.join(f'{r(c, 5)} AS {c}' for c in _PANEL_COLS)} FROM panel")
def mdl5(t):
    return rounded(panel(t), 5)


def _stage_sql(stage, features, window=9):
    """One stage as common table expressions: moments of the frame, centred, then one elimination step per feature."""
    p, names = len(features), [*features, "gdp"]
    full = " AND ".join(f"{n} IS NOT NULL" for n in names)
    w = f"(PARTITION BY series_id ORDER BY quarter ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING)"
    cells = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    sums = ", ".join([f"sum({n}) FILTER ({full}) OVER w AS s{i}" for i, n in enumerate(names)] + [f"sum({names[i]} * {names[j]}) FILTER ({full}) OVER w AS r{i}_{j}" for i, j in cells])
    keep = f"series_id, quarter, {', '.join(names)}, n, lo, hi, total, {', '.join(f'm{i}, o{i}' for i in range(p + 1))}"
    out = [f"{stage}_w AS (SELECT series_id, quarter, {', '.join(names)}, count(*) FILTER ({full}) OVER w AS n, count(*) OVER w AS k, min(quarter) OVER w AS lo, max(quarter) OVER w AS hi, {sums} FROM panel WINDOW w AS {w})",
           f"{stage}_0 AS (SELECT *, c{p}_{p} AS total, {', '.join(f's{i} / n AS m{i}, c{i}_{i} AS o{i}' for i in range(p + 1))} FROM (SELECT *, {', '.join(f'r{i}_{j} - s{i} * s{j} / n AS c{i}_{j}' for i, j in cells)} FROM {stage}_w WHERE k = {window} AND n >= {p + 1} AND {' AND '.join(f'{f} IS NOT NULL' for f in features)}))"]
    at = lambda i, j: f"c{min(i, j)}_{max(i, j)}"
    for k in range(p):
        new = [f"{'-1.0 / ' + at(k, k) if i == j == k else at(i, j) + ' / ' + at(k, k) if k in (i, j) else at(i, j) + ' - ' + at(i, k) + ' * ' + at(k, j) + ' / ' + at(k, k)} AS {at(i, j)}" for i, j in cells]
        out.append(f"{stage}_{k + 1} AS (SELECT {keep}, {', '.join(new)} FROM {stage}_{k} WHERE {at(k, k)} > 1e-9 * o{k})")
    level = f"m{p} - " + " - ".join(f"c{i}_{p} * m{i}" for i in range(p))
    around = " + ".join(f"m{i} * m{j} * -{at(i, j)}" for i in range(p) for j in range(p))
    final = (f"SELECT '{stage}' AS stage, series_id, quarter, gdp AS actual, n, lo, hi, n - {p + 1} AS dof, 1 - greatest(c{p}_{p}, 0) / total AS r2, CASE WHEN n > {p + 1} THEN greatest(c{p}_{p}, 0) / (n - {p + 1}) END AS spread, "
             f"{level} + {' + '.join(f'c{i}_{p} * {f}' for i, f in enumerate(features))} AS prediction, ['const', {', '.join(repr(f) for f in features)}] AS names, [{level}, {', '.join(f'c{i}_{p}' for i in range(p))}] AS b, "
             f"[1.0 / n + {around}, {', '.join(f'-{at(i, i)}' for i in range(p))}] AS v FROM {stage}_{p}")
    return out, final


def _fits_sql():
    parts = [_stage_sql(s, f) for s, f in md.STAGES.items()]
    return ", ".join([PANEL, *[x for out, _ in parts for x in out], "fits AS (" + " UNION ALL ".join(final for _, final in parts) + ")"])


@query("mdl6_rolling_stages", f"""
WITH {_fits_sql()} SELECT series_id, CAST(quarter AS VARCHAR) AS quarter, stage, {r('prediction', 5)} AS prediction, {r('actual', 5)} AS actual, {r('r2', 5)} AS r_squared, {r('sqrt(spread)', 5)} AS rmse,
  CAST(n AS INTEGER) AS n_train, CAST(lo AS VARCHAR) AS train_start, CAST(hi AS VARCHAR) AS train_end FROM fits""")
def mdl6(t):
    fits = md.rolling_stages(panel(t))
    return rounded(fits.select("series_id", "quarter", "stage", "prediction", "actual", "r_squared", "rmse", "n_train", "train_start", "train_end"), 5)


def _line_sql(stage, feature):
    w = "OVER (PARTITION BY series_id ORDER BY quarter ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING)"
    ok = f"count(*) {w} = 9 AND count(CASE WHEN {feature} IS NOT NULL AND gdp IS NOT NULL THEN 1 END) {w} >= 3"
    return f"""SELECT series_id, quarter, '{stage}' AS stage, gdp AS actual, CASE WHEN {ok} THEN regr_slope(gdp, {feature}) {w} END AS slope,
  CASE WHEN {ok} THEN regr_intercept(gdp, {feature}) {w} + regr_slope(gdp, {feature}) {w} * {feature} END AS prediction FROM panel"""


_LINES = {"stage_1": "prev_gdp", "stage_2": "month1_yoy", "stage_3": "month2_yoy"}
ONE_FEATURE = PANEL + ", lines AS (" + " UNION ALL ".join(_line_sql(s, f) for s, f in _LINES.items()) + "), one_feature AS (SELECT * FROM lines WHERE prediction IS NOT NULL)"


def one_feature_predictions(t):
    p = panel(t)
    return reduce(lambda a, b: a.unionByName(b), [md.rolling_line(p, s, f) for s, f in _LINES.items()])


@query("mdl6_rolling_line", f"WITH {ONE_FEATURE} SELECT series_id, CAST(quarter AS VARCHAR) AS quarter, stage, {r('actual', 5)} AS actual, {r('slope', 5)} AS slope, {r('prediction', 5)} AS prediction FROM one_feature")
def mdl6_line(t):
    return rounded(one_feature_predictions(t), 5)


# two-sided tail of Student's t for the degrees of freedom that nine quarters leave
_TAIL = """CASE dof WHEN 1 THEN 1 - 2 * a / pi() WHEN 2 THEN 1 - sin(a) WHEN 3 THEN 1 - 2 / pi() * (a + sin(a) * cos(a)) WHEN 4 THEN 1 - sin(a) * (1 + cos(a) * cos(a) / 2)
  WHEN 5 THEN 1 - 2 / pi() * (a + sin(a) * (cos(a) + 2 * cos(a) * cos(a) * cos(a) / 3)) END"""


@query("mdl7_coefficient_history", f"""
WITH {_fits_sql()}, long AS (SELECT series_id, quarter, stage, dof, spread, unnest(names) AS name, unnest(b) AS b, unnest(v) AS v FROM fits),
t AS (SELECT *, CASE WHEN spread * v > 0 THEN b / sqrt(spread * v) END AS t FROM long), a AS (SELECT *, CASE WHEN dof > 0 THEN atan(abs(t) / sqrt(dof)) END AS a FROM t)
SELECT series_id, CAST(quarter AS VARCHAR) AS quarter, stage, name, {r('b', 5)} AS coefficient, {r('t', 5)} AS t_value, CASE WHEN t IS NOT NULL THEN {r(f'greatest(0, {_TAIL})', 5)} END AS p_value FROM a""")
def mdl7(t):
    return rounded(md.coefficient_history(md.rolling_stages(panel(t))), 5)


def _shares(t):
    from ..operators.aggregates import sector_shares

    s = sector_shares(t.orders, F.to_date(F.date_trunc("month", "o_orderdate")), "o_orderstatus", cents("o_totalprice"))
    return s.groupBy("period").agg(*[F.max(F.when(F.col("sector") == x, F.col("share_of_mean"))).alias(f"share_{x.lower()}") for x in ("F", "O", "P")])


_ROLL = ", ".join(f"{r(f'CASE WHEN count(value) {W[:-1]} {frame(w)}) >= 3 THEN {fn}(value) {W[:-1]} {frame(w)}) END', 3)} AS roll_{w}_{s}" for w in (3, 6, 12) for s, fn in (("mean", "avg"), ("std", "stddev_samp")))
_MA = ", ".join(f"{r(f'avg(value) {W[:-1]} {frame(w)})', 3)} AS consumption_ma_{w}" for w in (3, 6, 12))


@query("mdl8_feature_matrix", f"""
WITH {MONTHLY}, b AS (SELECT *, {_TEMP_SQL} AS temp, sum(value) OVER (PARTITION BY series_id, year(period) ORDER BY period) AS ytd, sum(value) {W[:-1]} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS cd FROM monthly),
sc AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, o_orderstatus AS x, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) AS s, count(*) AS n FROM orders GROUP BY 1, 2),
sh AS (SELECT period, x, s / n / (sum(s) OVER p / sum(n) OVER p) * 100 AS share FROM sc WINDOW p AS (PARTITION BY period)),
sw AS (SELECT period, max(share) FILTER (x = 'F') AS share_f, max(share) FILTER (x = 'O') AS share_o, max(share) FILTER (x = 'P') AS share_p FROM sh GROUP BY 1),
f AS (SELECT series_id, period, value AS consumption, {r('temp', 5)} AS temp, {r(f'(ytd / nullif(lag(ytd, 12) {W}, 0) - 1) * 100', 5)} AS consumption_cumulative_yoy, {r('cd', 2)} AS capacity_delta, {r(f'lag(cd, 12) {W}', 2)} AS capacity_delta_prev_year,
  {r(f'(cd - lag(cd, 12) {W}) / nullif(abs(lag(value, 12) {W}), 0) * 100', 5)} AS capacity_change_rate, {r(f'(value - lag(value, 12) {W}) / nullif(abs(lag(value, 12) {W}), 0) * 100', 5)} AS consumption_yoy,
  {r(f'(value - lag(value) {W}) / nullif(abs(lag(value) {W}), 0) * 100', 5)} AS consumption_mom, {_MA}, {_ROLL}, {r(f'value - lag(value) {W}', 2)} AS consumption_diff,
  CAST(month(period) AS INTEGER) AS month, CAST(quarter(period) AS INTEGER) AS quarter, CAST((month(period) - 1) % 3 + 1 AS INTEGER) AS quarter_month, CAST(isodow(period) >= 6 AS INTEGER) AS is_weekend, CAST(dayofyear(period) AS INTEGER) AS day_of_year, CAST(quarter(period) AS INTEGER) AS season,
  {r('temp - 18', 5)} AS temperature_deviation, {r('greatest(0, 10 - temp)', 5)} AS hdd, {r('greatest(0, temp - 25)', 5)} AS cdd, CAST(temp < 10 AS INTEGER) AS is_heating_season, CAST(temp > 25 AS INTEGER) AS is_cooling_season FROM b)
SELECT f.* REPLACE (CAST(f.period AS VARCHAR) AS period), {r('share_f', 5)} AS share_f, {r('share_o', 5)} AS share_o, {r('share_p', 5)} AS share_p FROM f LEFT JOIN sw USING (period)""")
def mdl8(t):
    m = md.feature_matrix(_with_temp(t), "temp", _shares(t))
    two = {c: 2 for c in ("consumption", "capacity_delta", "capacity_delta_prev_year", "consumption_diff")}
    three = {c: 3 for c in m.columns if c.startswith(("roll_", "consumption_ma_"))}
    return rounded(m, 5, **two, **three)


@query("mdl9_clean_series")
def mdl9(t):
    d = daily(t)
    lines = d.select(F.to_csv(F.struct("series_id", F.date_format("period", "yyyy-MM-dd").alias("d"), "value")).alias("line"))
    cleaned = md.clean_lines(lines, "line", "Sector string, Day date, Consumption double", {"series_id": ["sector"], "period": ["date", "day"], "value": ["consumption"], "seq": ["day"]},
                             {}, ["value"])
    return rounded(cleaned, 3)
