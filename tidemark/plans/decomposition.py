"""DEC: decomposition, strengths, anomaly scan, bands, detectors and score fusion."""

from pyspark.sql import functions as F

from ..operators import confounders as cf
from ..operators import decompose as dc
from ..operators import stl
from ..operators import windows as wn
from .calendars import FESTIVAL_SQL, HOLIDAY_SQL, festival_ranges, holidays
from .registry import query, rounded
from .standins import DAILY, DAILY_TOTAL, MONTHLY, W, daily, daily_total, frame, hourly, money, monthly, quarterly, r, temperature, temperature_sql

_P = "CAST(period AS VARCHAR) AS period"
DEC = MONTHLY + f""",
dec_base AS (SELECT series_id, period, value, count(value) OVER s AS n, min(value) OVER s > 0 AS use_log FROM monthly WINDOW s AS (PARTITION BY series_id)),
dec_y AS (SELECT *, CASE WHEN use_log THEN ln(value) ELSE value END AS y FROM dec_base WHERE n >= 24),
dec_t AS (SELECT *, (0.5 * lag(y, 6) OVER w + sum(y) OVER (w ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) + 0.5 * lead(y, 6) OVER w) / 12 AS t FROM dec_y WINDOW w AS (PARTITION BY series_id ORDER BY period)),
dec_d AS (SELECT *, y - t AS d, coalesce(t, last_value(t IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(t IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS trend
  FROM dec_t WINDOW w AS (PARTITION BY series_id ORDER BY period)),
dec_m AS (SELECT series_id, month(period) AS m, coalesce(avg(d), 0) AS md FROM dec_d GROUP BY 1, 2),
dec_s AS (SELECT series_id, m, md - avg(md) OVER (PARTITION BY series_id) AS seasonal FROM dec_m),
dec_r AS (SELECT d.series_id, d.period, d.value, d.use_log, d.trend, s.seasonal, d.y - d.trend - s.seasonal AS residual,
  CASE WHEN d.use_log THEN exp(d.trend + s.seasonal) ELSE d.trend + s.seasonal END AS expected FROM dec_d d JOIN dec_s s ON s.series_id = d.series_id AND s.m = month(d.period)),
dec AS (SELECT *, CASE WHEN abs(expected) > 1e-12 THEN (value - expected) / abs(expected) ELSE 0.0 END AS residual_pct FROM dec_r)"""
STRENGTH = """CASE WHEN var_pop(residual + {0}) > 1e-12 THEN greatest(0.0, least(1.0, 1 - var_pop(residual) / var_pop(residual + {0}))) ELSE 0.0 END"""


@query("dec1_classical", f"""
WITH {DEC} SELECT series_id, {_P}, value, use_log, {r('trend')} AS trend, {r('seasonal')} AS seasonal, {r('residual')} AS residual, {r('expected', 2)} AS expected, {r('residual_pct')} AS residual_pct FROM dec""")
def dec1(t):
    return rounded(dc.classical(monthly(t)).drop("cycle"), 6, expected=2, value=2)


@query("dec2_robust_monthly")
def dec2(t):
    by_nation = t.orders.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).groupBy(
        F.col("c_nationkey").cast("string").alias("series_id"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("period")).agg(money("o_totalprice").alias("value"))
    return rounded(stl.stl(by_nation, stl.fixed_spans(stl.MONTHLY), 24, log=False), 4)


@query("dec2_robust_by_frequency")
def dec2_by_frequency(t):
    m = stl.stl(monthly(t), stl.cycle_spans(12), 24).withColumn("freq", F.lit("monthly"))
    q = stl.stl(quarterly(t), stl.cycle_spans(4), 8).withColumn("freq", F.lit("quarterly"))
    return rounded(m.unionByName(q), 4)


@query("dec3_short_series")
def dec3(t):
    by_customer = monthly(t, "o_custkey").withColumn("series_id", F.col("series_id").cast("string"))
    return rounded(stl.stl(by_customer, stl.monthly_spans, 12, log=False), 4)


@query("dec4_quarterly_flow")
def dec4_quarterly(t):
    return rounded(stl.stl(quarterly(t), stl.fixed_spans(stl.QUARTERLY), 16, log=True), 4)


@query("dec4_quarterly_growth")
def dec4_growth(t):
    g = quarterly(t).withColumn("value", wn.lag_growth("value", 4)).filter(F.col("value").isNotNull())
    return rounded(stl.stl(g, stl.fixed_spans(stl.QUARTERLY), 16, log=False), 4)


@query("dec4_annual")
def dec4_annual(t):
    # yearly points of every brand; a half year counts as a point, as 7 calendar years fall short of the eight needed
    half = F.to_date(F.date_trunc("quarter", F.add_months("l_shipdate", -F.when(F.quarter("l_shipdate") % 2 == 0, 3).otherwise(0))))
    brand = t.lineitem.join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    s = brand.groupBy(F.col("p_brand").alias("series_id"), half.alias("period")).agg(money("l_extendedprice").alias("value"))
    return rounded(stl.stl(s, stl.fixed_spans(stl.ANNUAL), 8, log=False), 4)


@query("dec5_strengths", f"""
WITH {DEC} SELECT series_id, {r(STRENGTH.format('trend'))} AS trend_strength, {r(STRENGTH.format('seasonal'))} AS seasonal_strength FROM dec GROUP BY 1""")
def dec5(t):
    return rounded(dc.strengths(dc.classical(monthly(t))))


def _less(name, *others):
    """SQL sum: a column less its projection on columns that are at right angles to one another."""
    return name + "".join(f" - sum({name} * {o}) OVER s / sum({o} * {o}) OVER s * {o}" for o in others)


# marks are fixed effects, so all columns are taken about the mean of their mark; then each regressor is cleared of those before it
_CONFOUNDERS = f"""nr AS (SELECT period, arg_min(datediff('day', first_day, period), (abs(datediff('day', first_day, period)), first_day)) AS gap FROM (SELECT DISTINCT period FROM daily), festivals GROUP BY 1),
x0 AS (SELECT d.series_id, d.period, ln(d.value) AS y, greatest(0, t - 24.0) AS c, greatest(0, 10.0 - t) AS h, CAST(isodow(d.period) >= 6 AS DOUBLE) AS w, CAST(d.period IN (SELECT day FROM holidays) AS DOUBLE) AS v, CASE WHEN abs(gap) <= 21 THEN gap END AS mark
  FROM (SELECT *, {temperature_sql("period")} AS t FROM daily) d JOIN nr USING (period)),
x1 AS (SELECT *, {", ".join(f"{k} - avg({k}) OVER m AS {k}1" for k in "ychwv")}, {", ".join(f"avg({k}) OVER m AS {k}m" for k in "ychwv")} FROM x0 WINDOW m AS (PARTITION BY series_id, mark)),
x2 AS (SELECT *, {_less("h1", "c1")} AS h2 FROM x1 WINDOW s AS (PARTITION BY series_id)), x3 AS (SELECT *, {_less("w1", "c1", "h2")} AS w2 FROM x2 WINDOW s AS (PARTITION BY series_id)),
x4 AS (SELECT *, {_less("v1", "c1", "h2", "w2")} AS v2 FROM x3 WINDOW s AS (PARTITION BY series_id)),
b4 AS (SELECT *, sum(y1 * v2) OVER s / sum(v2 * v2) OVER s AS bv FROM x4 WINDOW s AS (PARTITION BY series_id)), b3 AS (SELECT *, sum((y1 - bv * v1) * w2) OVER s / sum(w2 * w2) OVER s AS bw FROM b4 WINDOW s AS (PARTITION BY series_id)),
b2 AS (SELECT *, sum((y1 - bv * v1 - bw * w1) * h2) OVER s / sum(h2 * h2) OVER s AS bh FROM b3 WINDOW s AS (PARTITION BY series_id)),
b1 AS (SELECT *, sum((y1 - bv * v1 - bw * w1 - bh * h1) * c1) OVER s / sum(c1 * c1) OVER s AS bc FROM b2 WINDOW s AS (PARTITION BY series_id)),
lv AS (SELECT *, ym - bc * cm - bh * hm - bw * wm - bv * vm AS level FROM b1),
fit AS (SELECT *, level - max(CASE WHEN mark IS NULL THEN level END) OVER s AS effect, 1 - sum(power(y1 - bc * c1 - bh * h1 - bw * w1 - bv * v1, 2)) OVER s / (var_pop(y) OVER s * count(*) OVER s) AS r2 FROM lv WINDOW s AS (PARTITION BY series_id))"""


@query("dec6_confounder_regression", f"""
WITH {DAILY}, {HOLIDAY_SQL}, {FESTIVAL_SQL}, {_CONFOUNDERS} SELECT series_id, CAST(period AS VARCHAR) AS period, {r('bc * c + bh * h')} AS weather_effect, {r('bw * w + bv * v + effect')} AS calendar_effect, {r('y - bc * c - bh * h - bw * w - bv * v - effect')} AS economic_signal, {r('r2')} AS r_squared FROM fit""")
def dec6(t):
    out = cf.remove_confounders(cf.daily_inputs(daily(t), holidays(t.spark), festival_ranges(t.spark), temperature))
    return rounded(out.select("series_id", "period", "weather_effect", "calendar_effect", "economic_signal", "r_squared"), 6)


@query("dec7_decoupled_signal")
def dec7(t):
    return rounded(cf.decouple(cf.daily_inputs(daily(t), holidays(t.spark), festival_ranges(t.spark), temperature)), 6)


def _logs(t):
    return daily_total(t).select("series_id", "period", F.ln("value").alias("value"))


def _band(j):
    return "value" if j == 0 else f"avg(value) {W[:-1]} {frame(2 ** j)})"


_BANDS = f"{DAILY_TOTAL}, logs AS (SELECT series_id, period, ln(value) AS value FROM daily_total), bands AS (SELECT series_id, period, {', '.join(f'{_band(j - 1)} - {_band(j)} AS band_{j}' for j in range(1, 5))}, {_band(4)} AS smooth FROM logs)"


@query("dec8_scale_bands", f"WITH {_BANDS} SELECT series_id, {_P}, {', '.join(f'{r(c, 7)} AS {c}' for c in ('band_1', 'band_2', 'band_3', 'band_4', 'smooth'))} FROM bands")
def dec8(t):
    return rounded(dc.scale_bands(_logs(t)).drop("value"), 7)


_SQ = [f"sum({c} * {c})" for c in ("band_1", "band_2", "band_3", "band_4", "smooth")]


@query("dec8_band_energy", f"WITH {_BANDS} SELECT series_id, {', '.join(f'{r(s + chr(47) + chr(40) + chr(43).join(_SQ) + chr(41))} AS {c}_share' for s, c in zip(_SQ, ('band_1', 'band_2', 'band_3', 'band_4', 'smooth')))} FROM bands GROUP BY 1")
def dec8_energy(t):
    return rounded(dc.band_energy(dc.scale_bands(_logs(t))))


SCAN = DEC + f""",
scan_med AS (SELECT series_id, median(residual_pct) AS med, stddev_pop(residual_pct) AS sd FROM dec GROUP BY 1),
scan_mad AS (SELECT series_id, median(abs(residual_pct - med)) AS mad FROM dec JOIN scan_med USING (series_id) GROUP BY 1),
scan_all AS (SELECT d.*, (residual_pct - med) / (1.4826 * CASE WHEN mad > 1e-12 THEN mad WHEN sd > 0 THEN sd ELSE 1e-12 END) AS robust_z, (value - lag(value, 12) OVER w) / nullif(abs(lag(value, 12) OVER w), 0) AS yoy,
  row_number() OVER w AS i, row_number() OVER (PARTITION BY d.series_id ORDER BY period DESC) AS j
  FROM dec d JOIN scan_med USING (series_id) JOIN scan_mad USING (series_id) WINDOW w AS (PARTITION BY d.series_id ORDER BY period)),
scan_tag AS (SELECT *, array_to_string(list_filter([CASE WHEN i = 1 OR j = 1 THEN 'series_edge' END, CASE WHEN month(period) = 12 THEN 'december_balance' END, CASE WHEN i <= 12 THEN 'first_cycle' END], lambda x: x IS NOT NULL), ',') AS risks FROM scan_all)"""


@query("dec9_anomaly_scan", f"""
WITH {SCAN}, k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY abs(residual_pct) DESC, period) AS rank FROM scan_tag WHERE abs(residual_pct) >= 0.05)
SELECT series_id, {_P}, {r('residual_pct')} AS residual_pct, {r('expected', 2)} AS expected, {r('robust_z', 5)} AS robust_z, {r('yoy')} AS yoy, risks, CASE WHEN abs(residual_pct) >= 0.08 THEN 'high' ELSE 'medium' END AS level,
  CASE WHEN residual_pct > 0 THEN 'above_expected' ELSE 'below_expected' END AS direction, i = 1 OR j = 1 AS endpoint, CAST(rank AS INTEGER) AS rank FROM k""")
def dec9(t):
    s = dc.scan(dc.classical(monthly(t)))
    return rounded(s.select("series_id", "period", "residual_pct", "expected", "robust_z", "yoy", F.array_join("risks", ",").alias("risks"), "level", "direction", "endpoint", "rank"), 6, expected=2, robust_z=5)


@query("dec10_summary", f"""
WITH {DEC}, med AS (SELECT series_id, median(residual) AS m FROM dec GROUP BY 1), mad AS (SELECT series_id, median(abs(residual - m)) AS residual_mad FROM dec JOIN med USING (series_id) GROUP BY 1)
SELECT series_id, count(*) AS n, {r(STRENGTH.format('trend'))} AS trend_strength, {r(STRENGTH.format('seasonal'))} AS seasonal_strength, {r('stddev_pop(residual)')} AS residual_std, {r('any_value(residual_mad)')} AS residual_mad,
  {r('arg_min(exp(trend), period)', 2)} AS trend_start, {r('arg_max(exp(trend), period)', 2)} AS trend_end, {r('(arg_max(exp(trend), period) - arg_min(exp(trend), period)) / arg_min(exp(trend), period)')} AS trend_change, count(*) < 36 AS endpoint_warning
FROM dec JOIN mad USING (series_id) GROUP BY 1""")
def dec10(t):
    return rounded(dc.summary(dc.classical(monthly(t))), 6, trend_start=2, trend_end=2)


@query("dec11_reconstruction_error")
def dec11(t):
    vectors = wn.sliding_vectors(hourly(t), ["value", "n"])
    scored = dc.reconstruction_error(vectors).select("series_id", "period", "error")
    # back on every hour: the windows' centres lack the ends
    full = hourly(t).select("series_id", "period").join(scored, ["series_id", "period"], "left")
    return rounded(wn.interpolate(full, "error", "score").select("series_id", "period", "score"))


@query("dec12_score_fusion", f"""
WITH {DAILY_TOTAL}, b AS (SELECT *, CASE WHEN count(value) {W[:-1]} {frame(91)}) >= 15 THEN quantile_cont(value, 0.5) {W[:-1]} {frame(91)}) END AS baseline, value - avg(value) {W[:-1]} {frame(4)}) AS wiggle FROM daily_total),
d AS (SELECT *, abs(coalesce(value - baseline, 0)) AS a, wiggle * wiggle AS err FROM b), m AS (SELECT series_id, median(a) AS med FROM d GROUP BY 1), md AS (SELECT series_id, median(abs(a - med)) + 1e-8 AS mad FROM d JOIN m USING (series_id) GROUP BY 1),
z AS (SELECT d.*, abs(a - med) / (1.4826 * mad) AS z FROM d JOIN m USING (series_id) JOIN md USING (series_id)),
s AS (SELECT *, 0.5 * (err - min(err) OVER g) / (max(err) OVER g - min(err) OVER g + 1e-12) + 0.5 * (z - min(z) OVER g) / (max(z) OVER g - min(z) OVER g + 1e-12) AS score FROM z WINDOW g AS (PARTITION BY series_id)),
q AS (SELECT series_id, quantile_cont(score, 0.9) AS threshold FROM s GROUP BY 1)
SELECT series_id, {_P}, {r('score')} AS score, {r('threshold')} AS threshold, CAST(score > threshold AS INTEGER) AS is_anomaly FROM s JOIN q USING (series_id)""")
def dec12(t):
    d = wn.rolling_median_deviation(daily_total(t))
    wiggle = F.col("value") - wn.moving_average("value", 4)
    held = d.withColumn("_w", wiggle).withColumn("error", F.col("_w") * F.col("_w"))
    return rounded(dc.fuse_scores(held, "error", "deviation").select("series_id", "period", "score", "threshold", "is_anomaly"))
