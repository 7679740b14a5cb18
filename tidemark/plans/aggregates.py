"""AG: reports, context, events, detector and answer quality."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as txt
from ..operators import aggregates as ag
from ..operators import calendar as cal
from ..operators import decompose as dc
from ..operators import joins as jn
from ..operators import windows as wn
from .calendars import FESTIVAL_SQL, HOLIDAY_SQL, festival_ranges, holidays
from .decomposition import DEC
from .models import ONE_FEATURE, one_feature_predictions
from .rankings import TRIPLES, triples
from .registry import query, rounded
from .standins import DAILY, DAILY_GRID, DAILY_TOTAL, MONTHLY, W, cents, daily, daily_total, money, monthly, r, temperature, temperature_sql

_P = "CAST(period AS VARCHAR) AS period"


@query("ag1_missing_report", f"""
WITH {DAILY_GRID}, g AS (SELECT s.series_id, s.period, d.value, d.n FROM daily_spine s LEFT JOIN daily d USING (series_id, period))
SELECT 'series_id' AS "column", 0 AS missing_count, 0.0 AS missing_rate, 'string' AS dtype UNION ALL SELECT 'period', 0, 0.0, 'date'
UNION ALL SELECT 'value', count(*) FILTER (value IS NULL), {r('100.0 * count(*) FILTER (value IS NULL) / count(*)')}, 'double' FROM g
UNION ALL SELECT 'n', count(*) FILTER (n IS NULL), {r('100.0 * count(*) FILTER (n IS NULL) / count(*)')}, 'bigint' FROM g""")
def ag1(t):
    grid = jn.regular(daily(t), "daily")
    return rounded(wn.missing_report(grid, ["series_id", "period", "value", "n"]))


_NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("ag2_describe", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count({c}) AS n, {r(f'avg({c})', 4)} AS mean, {r(f'stddev_samp({c})', 4)} AS std, min({c}) AS min, {r(f'quantile_cont({c}, 0.25)', 4)} AS q25, {r(f'quantile_cont({c}, 0.5)', 4)} AS q50,
  {r(f'quantile_cont({c}, 0.75)', 4)} AS q75, max({c}) AS max, 0.0 AS missing_rate FROM lineitem""" for c in _NUMERIC))
def ag2(t):
    return rounded(ag.describe(t.lineitem, _NUMERIC), 4)


@query("ag2_distribution", f"""
WITH m AS (SELECT l_returnflag, median(l_extendedprice) AS med FROM lineitem GROUP BY 1)
SELECT l_returnflag, count(*) AS n, {r('avg(l_extendedprice)', 3)} AS mean, {r('stddev_pop(l_extendedprice)', 3)} AS std, {r('quantile_cont(l_extendedprice, 0.05)', 4)} AS p05, {r('quantile_cont(l_extendedprice, 0.95)', 4)} AS p95,
  {r('median(abs(l_extendedprice - med))', 4)} AS mad FROM lineitem JOIN m USING (l_returnflag) GROUP BY 1""")
def ag2_distribution(t):
    return rounded(ag.distribution(t.lineitem.select("l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice"), 4, mean=3, std=3)


@query("ag3_seasonal_profile", f"""
WITH {DEC}, g AS (SELECT DISTINCT series_id, m.m FROM dec, (SELECT unnest(range(1, 13)) AS m) m)
SELECT g.series_id, CAST(g.m AS INTEGER) AS month, {r('coalesce(avg(seasonal), 0.0)')} AS mean_seasonal FROM g LEFT JOIN dec d ON d.series_id = g.series_id AND month(d.period) = g.m GROUP BY ALL""")
def ag3(t):
    return rounded(dc.seasonal_profile(dc.classical(monthly(t))))


@query("ag4_yearly_totals", f"WITH {MONTHLY} SELECT series_id, CAST(year(period) AS INTEGER) AS year, {r('sum(value)', 2)} AS total, count(*) AS n, count(*) = 12 AS complete FROM monthly GROUP BY ALL")
def ag4(t):
    return rounded(ag.yearly_totals(monthly(t)), 2)


@query("ag5_series_summary", f"""
WITH {MONTHLY}, s AS (SELECT *, (value - lag(value) {W}) / nullif(abs(lag(value) {W}), 0) AS mom, row_number() OVER (PARTITION BY series_id ORDER BY period DESC) AS j FROM monthly)
SELECT series_id, count(*) AS n_points, CAST(min(period) AS VARCHAR) AS period_start, CAST(max(period) AS VARCHAR) AS latest_period, arg_max(value, period) AS latest_value, {r('arg_max(mom, period)')} AS mom,
  {r('avg(value)', 3)} AS mean, {r('stddev_pop(value)', 3)} AS std, string_agg(strftime(period, '%Y-%m') || '=' || CAST(CAST(round(value) AS BIGINT) AS VARCHAR), ' ' ORDER BY period) FILTER (j <= 13) AS points FROM s GROUP BY 1""")
def ag5(t):
    s = ag.series_summary(monthly(t))
    points = F.array_join(F.transform("points", lambda p: F.concat(F.date_format(p["period"], "yyyy-MM"), F.lit("="), F.round(p["value"]).cast("long").cast("string"))), " ")
    return rounded(s.withColumn("points", points), 3, mom=6)


@query("ag6_trend_growth", f"""
WITH {DEC}, e AS (SELECT series_id, count(*) AS n, arg_min(exp(trend), period) AS a, arg_max(exp(trend), period) AS b, min(period) AS s, max(period) AS t FROM dec GROUP BY 1)
SELECT series_id, n, {r('(b / a - 1) * 100', 5)} AS growth_pct, {r("(power(b / a, 12.0 / datediff('month', s, t)) - 1) * 100", 5)} AS annualised_pct FROM e""")
def ag6(t):
    return rounded(dc.trend_growth(dc.classical(monthly(t))).select("series_id", "n", "growth_pct", "annualised_pct"), 5)


_CUSTOMER = """cust AS (SELECT o_custkey AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS value FROM orders GROUP BY 1, 2)"""
_DUP = "dup AS (SELECT o_custkey AS series_id, CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1)"
_JUMPS = f"""st AS (SELECT series_id, period, lag(value) {W} AS a, value AS b FROM cust), sd AS (SELECT *, b - a AS d FROM st WHERE a IS NOT NULL),
jm AS (SELECT series_id, median(d) AS m FROM sd GROUP BY 1 HAVING count(*) >= 4), ja AS (SELECT series_id, median(abs(d - m)) AS mad FROM sd JOIN jm USING (series_id) GROUP BY 1 HAVING median(abs(d - m)) > 1e-12),
jumps AS (SELECT series_id, period, a AS "from", b AS "to", {r('(b - a) / nullif(abs(a), 0)')} AS change FROM sd JOIN ja USING (series_id) WHERE abs(d) > 8 * 1.4826 * mad)"""


def _customers(t):
    return monthly(t, "o_custkey").drop("n")


def _order_days(t):
    return t.orders.select(F.col("o_custkey").alias("series_id"), F.to_date("o_orderdate").alias("day"))


@query("ag7_duplicate_periods", f"WITH {_DUP} SELECT series_id, CAST(day AS VARCHAR) AS day, n FROM dup")
def ag7_duplicates(t):
    return ag.duplicate_periods(_order_days(t), "series_id", "day")


@query("ag7_irregular_gaps", f"""
WITH {_CUSTOMER}, g AS (SELECT series_id, lag(period) {W} AS a, period AS b FROM cust), d AS (SELECT *, datediff('day', a, b) AS gap FROM g WHERE a IS NOT NULL),
m AS (SELECT series_id, CAST(median(gap) AS DOUBLE) AS typical FROM d GROUP BY 1 HAVING count(*) >= 2)
SELECT series_id, CAST(a AS VARCHAR) AS after, CAST(b AS VARCHAR) AS before, CAST(gap AS INTEGER) AS gap_days, typical FROM d JOIN m USING (series_id) WHERE gap > typical * 2.5 OR gap < typical * 0.4""")
def ag7_gaps(t):
    return ag.irregular_gaps(_customers(t))


@query("ag7_abrupt_jumps", f"WITH {_CUSTOMER}, {_JUMPS} SELECT series_id, CAST(period AS VARCHAR) AS period, \"from\", \"to\", change FROM jumps")
def ag7_jumps(t):
    return rounded(ag.abrupt_jumps(_customers(t)), 6)


@query("ag7_quality_flags", f"""
WITH {_CUSTOMER}, {_DUP}, {_JUMPS}, span AS (SELECT series_id, count(*) AS n, datediff('month', min(period), max(period)) + 1 AS expected FROM cust GROUP BY 1)
SELECT series_id, n, array_to_string(list_filter([CASE WHEN series_id IN (SELECT series_id FROM jumps) THEN 'abrupt-jumps' END, CASE WHEN series_id IN (SELECT series_id FROM dup) THEN 'duplicate-periods' END,
  CASE WHEN n < expected THEN 'missing-periods' END, CASE WHEN n < 24 THEN 'short-series' END], lambda x: x IS NOT NULL), ',') AS flags FROM span""")
def ag7_flags(t):
    return ag.quality_flags(_customers(t), _order_days(t), "day").withColumn("flags", F.array_join("flags", ","))


_DAYS = f"""{HOLIDAY_SQL}, span AS (SELECT CAST(date_trunc('month', min(o_orderdate)) AS DATE) AS lo, CAST(last_day(max(o_orderdate)) AS DATE) AS hi FROM orders),
spine AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM span),
days AS (SELECT s.day, h.name, CAST(isodow(s.day) >= 6 AS INTEGER) AS is_weekend, CAST(h.name IS NOT NULL AS INTEGER) AS is_holiday, CAST(isodow(s.day) < 6 AND h.name IS NULL AS INTEGER) AS is_workday FROM spine s LEFT JOIN holidays h ON h.day = s.day)"""


def calendar_table(t):
    """Day table over the months the orders cover."""
    span = t.orders.agg(F.to_date(F.date_trunc("month", F.min("o_orderdate"))).alias("lo"), F.last_day(F.max("o_orderdate")).alias("hi"))
    days = span.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("day"))
    return cal.calendar_days(days, holidays(t.spark))


@query("ag8_calendar_context", f"""
WITH {_DAYS}, hol AS (SELECT CAST(date_trunc('month', day) AS DATE) AS period, name, min(day) AS a, max(day) AS b, count(*) AS n FROM days WHERE name IS NOT NULL GROUP BY 1, 2),
lst AS (SELECT period, string_agg(name || ':' || n || ':' || a || ':' || b, ' ' ORDER BY a) AS holidays FROM hol GROUP BY 1),
tot AS (SELECT CAST(date_trunc('month', day) AS DATE) AS period, count(*) AS n_days, CAST(sum(is_workday) AS BIGINT) AS n_workdays, CAST(count(*) - sum(is_workday) AS BIGINT) AS n_nonworkdays, CAST(sum(is_holiday) AS BIGINT) AS holiday_break_days, count(*) FILTER (name = '春节') AS festival_days FROM days GROUP BY 1)
SELECT CAST(period AS VARCHAR) AS period, n_days, n_workdays, n_nonworkdays, holiday_break_days, festival_days, coalesce(holidays, '') AS holidays FROM tot LEFT JOIN lst USING (period)""")
def ag8(t):
    c = cal.calendar_context(calendar_table(t))
    shown = F.array_join(F.transform("holidays", lambda h: F.concat_ws(":", h["name"], h["n"].cast("string"), h["first"].cast("string"), h["last"].cast("string"))), " ")
    return c.withColumn("holidays", F.coalesce(shown, F.lit(""))).drop("makeup_workdays")


# the Sunday before a festival and the Saturday after it are worked
@query("ag8_makeup_days", f"""
WITH {_DAYS}, {FESTIVAL_SQL}, mk AS (SELECT CAST(first_day - INTERVAL 1 DAY * isodow(first_day) AS DATE) AS day FROM festivals UNION SELECT CAST(last_day + INTERVAL 1 DAY * (CASE WHEN isodow(last_day) < 6 THEN 6 ELSE 13 END - isodow(last_day)) AS DATE) FROM festivals),
m AS (SELECT d.*, CAST(is_weekend = 1 AND name IS NULL AND day IN (SELECT day FROM mk) AS INTEGER) AS worked FROM days d)
SELECT CAST(CAST(date_trunc('month', day) AS DATE) AS VARCHAR) AS period, count(*) AS n_days, CAST(sum(is_workday + worked) AS BIGINT) AS n_workdays, CAST(count(*) - sum(is_workday + worked) AS BIGINT) AS n_nonworkdays, CAST(sum(worked) AS BIGINT) AS makeup_workdays FROM m GROUP BY 1""")
def ag8_makeup(t):
    f = festival_ranges(t.spark)
    before = f.select(F.date_sub("first_day", F.weekday("first_day") + 1).alias("day"))
    after = f.select(F.next_day("last_day", "Sat").alias("day"))
    days = cal.calendar_days(calendar_table(t).select("day"), holidays(t.spark), makeup=before.unionByName(after))
    return cal.calendar_context(days).select("period", "n_days", "n_workdays", "n_nonworkdays", "makeup_workdays")


_WEATHER = f"""{_DAYS}, tdays AS (SELECT day, {temperature_sql('day')} AS temp FROM days),
weather AS (SELECT CAST(date_trunc('month', day) AS DATE) AS period, avg(temp) AS temp_mean, sum(greatest(0, 18 - temp)) AS hdd, sum(greatest(0, temp - 18)) AS cdd, count(*) FILTER (temp >= 28.5) AS hot_days, count(*) FILTER (temp <= 5.5) AS cold_days FROM tdays GROUP BY 1)"""


def monthly_weather(t):
    days = calendar_table(t).select("day", temperature(F.col("day")).alias("temp"))
    temp = F.col("temp")
    return days.groupBy(F.to_date(F.date_trunc("month", "day")).alias("period")).agg(
        F.avg("temp").alias("temp_mean"), F.sum(F.greatest(F.lit(0.0), 18 - temp)).alias("hdd"), F.sum(F.greatest(F.lit(0.0), temp - 18)).alias("cdd"),
        F.count_if(temp >= 28.5).alias("hot_days"), F.count_if(temp <= 5.5).alias("cold_days"))


@query("ag9_weather_context", f"""
WITH {_WEATHER}, ask AS (SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) AS period FROM lineitem)
SELECT CAST(a.period AS VARCHAR) AS period, {r('temp_mean', 5)} AS temp_mean, {r('hdd', 5)} AS hdd, {r('cdd', 5)} AS cdd, CAST(coalesce(hot_days, -1) AS BIGINT) AS hot_days, CAST(coalesce(cold_days, -1) AS BIGINT) AS cold_days, w.period IS NOT NULL AS available FROM ask a LEFT JOIN weather w USING (period)""")
def ag9(t):
    ask = t.lineitem.select(F.to_date(F.date_trunc("month", "l_shipdate")).alias("period")).distinct()
    return rounded(cal.weather_context(monthly_weather(t), ask).fillna(-1, ["hot_days", "cold_days"]), 5)


@query("ag10_weather_rollup", f"""
WITH h AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, avg(value) AS temp FROM events GROUP BY 1, 2), d AS (SELECT series_id, CAST(ts AS DATE) AS day, avg(temp) AS mean, max(temp) AS hi, min(temp) AS lo FROM h GROUP BY 1, 2)
SELECT series_id, CAST(CAST(date_trunc('month', day) AS DATE) AS VARCHAR) AS period, {r('avg(mean)', 5)} AS temp_mean, {r('avg(hi)', 5)} AS daily_max_mean, {r('avg(lo)', 5)} AS daily_min_mean, {r('max(hi)', 5)} AS temp_max, {r('min(lo)', 5)} AS temp_min,
  {r('sum(greatest(0, 18 - mean))', 5)} AS hdd, {r('sum(greatest(0, mean - 18))', 5)} AS cdd, count(*) FILTER (hi >= 35) AS hot_days, count(*) FILTER (lo <= 0) AS cold_days, count(*) AS n_days FROM d GROUP BY ALL""")
def ag10(t):
    hours = t.events.groupBy(F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").alias("ts")).agg(F.avg("value").alias("temp"))
    return rounded(cal.weather_rollup(hours), 5)


@query("ag10_weather_columns", f"""
WITH h AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, avg(value) AS temp, avg(event_id % 100) AS humidity, sum(user_id % 7) AS rain, max(value) AS wind, sum(event_id % 13) AS sun FROM events GROUP BY 1, 2),
d AS (SELECT series_id, CAST(ts AS DATE) AS day, avg(humidity) AS humidity, sum(rain) AS rain, max(wind) AS wind, sum(sun) AS sun FROM h GROUP BY 1, 2)
SELECT series_id, CAST(CAST(date_trunc('month', day) AS DATE) AS VARCHAR) AS period, {r('avg(humidity)', 5)} AS humidity_mean, CAST(sum(rain) AS BIGINT) AS rain_sum, CAST(sum(sun) AS BIGINT) AS sun_sum, {r('max(wind)', 5)} AS wind_max FROM d GROUP BY ALL""")
def ag10_columns(t):
    e = t.events.select(F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").alias("ts"), "value", (F.col("event_id") % 100).alias("h"), (F.col("user_id") % 7).alias("r"), (F.col("event_id") % 13).alias("s"))
    hours = e.groupBy("series_id", "ts").agg(F.avg("value").alias("temp"), F.avg("h").alias("humidity"), F.sum("r").alias("rain"), F.max("value").alias("wind"), F.sum("s").alias("sun"))
    out = cal.weather_rollup(hours, means=["humidity"], sums=["rain", "sun"], highs=["wind"])
    return rounded(out.select("series_id", "period", "humidity_mean", "rain_sum", "sun_sum", "wind_max"), 5)


@query("ag11_sector_shares", f"""
WITH c AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, o_orderpriority AS sector, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) AS s, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT CAST(period AS VARCHAR) AS period, sector, {r('s / n / 100', 5)} AS value, {r('s / n / (sum(s) OVER p / sum(n) OVER p) * 100')} AS share_of_mean, {r('s / n / sum(s / n) OVER p * 100')} AS share_of_sum FROM c WINDOW p AS (PARTITION BY period)""")
def ag11(t):
    out = ag.sector_shares(t.orders, F.to_date(F.date_trunc("month", "o_orderdate")), "o_orderpriority", cents("o_totalprice"))
    return rounded(out.withColumn("value", F.col("value") / 100), 6, value=5)


@query("ag12_weekday_adjust", f"""
WITH {DAILY_TOTAL}, i AS (SELECT *, isodow(period) AS dow, value / nullif(avg(value) OVER (PARTITION BY series_id, isoyear(period), weekofyear(period)), 0) AS ix, count(value) OVER (PARTITION BY series_id) AS rows_held FROM daily_total),
m AS (SELECT series_id, dow, avg(ix) AS m FROM i GROUP BY 1, 2), a AS (SELECT *, avg(m) OVER (PARTITION BY series_id) AS am FROM m)
SELECT i.series_id, CAST(i.period AS VARCHAR) AS period, {r('CASE WHEN rows_held >= 14 THEN value / m * am ELSE value END', 3)} AS adjusted FROM i JOIN a USING (series_id, dow)""")
def ag12(t):
    return rounded(cal.weekday_adjust(daily_total(t).drop("n")).select("series_id", "period", "adjusted"), 3)


EVENTS = f"""{DAILY}, scored AS (SELECT series_id, period, value, value / avg(value) OVER (PARTITION BY series_id) AS score, ln(value / avg(value) OVER (PARTITION BY series_id)) AS deviation FROM daily),
fl AS (SELECT *, score > 0.6 AS flag FROM scored), ri AS (SELECT *, sum(CAST(NOT flag AS INTEGER)) {W} AS island FROM fl),
ev AS (SELECT series_id, min(period) AS s, max(period) AS e, count(*) AS n, max(score) AS peak, avg(deviation) AS dev FROM ri WHERE flag GROUP BY series_id, island HAVING count(*) >= 5)"""


def scored_days(t):
    share = F.col("value") / F.avg("value").over(Window.partitionBy("series_id"))
    return daily(t).withColumn("score", share).withColumn("deviation", F.ln("score")).withColumn("flag", F.col("score") > 0.6)


def event_spans(t):
    return cal.islands(scored_days(t), flag="flag", aggs=[F.max("score").alias("peak_score")], least=5)


@query("ag13_event_spans", f"WITH {EVENTS} SELECT series_id, CAST(s AS VARCHAR) AS start, CAST(e AS VARCHAR) AS \"end\", n, {r('peak', 5)} AS peak_score FROM ev")
def ag13(t):
    return rounded(event_spans(t), 5)


@query("ag14_event_report", f"""
WITH {EVENTS}, m AS (SELECT *, round(dev * 100, 2) AS mag FROM ev)
SELECT series_id, count(*) AS n_events, count(*) FILTER (dev > 0) AS n_up, count(*) FILTER (dev <= 0) AS n_down, CASE WHEN count(*) FILTER (dev > 0) >= count(*) FILTER (dev <= 0) THEN 'expanding' ELSE 'weakening' END AS tone,
  CAST(arg_max(s, (abs(mag), s)) AS VARCHAR) AS worst_start, CAST(arg_max(e, (abs(mag), s)) AS VARCHAR) AS worst_end, arg_max(mag, (abs(mag), s)) AS worst_pct FROM m GROUP BY 1""")
def ag14(t):
    return ag.event_report(ag.event_features(event_spans(t), scored_days(t).select("series_id", "period", "deviation")))


@query("ag15_detector_quality", f"""
WITH d AS (SELECT lang, quality, CAST(n_chars > 1000 AS INTEGER) AS flag, n_chars FROM labels JOIN documents USING (doc_id)),
b AS (SELECT lang, count(*) AS n, sum(quality * flag) AS tp, sum(flag) AS p, sum(quality) AS t FROM d GROUP BY 1),
rk AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0 AS ar FROM d),
a AS (SELECT lang, (sum(ar) FILTER (quality = 1) - sum(quality) * (sum(quality) + 1) / 2.0) / nullif(sum(quality) * (count(*) - sum(quality)), 0) AS auc FROM rk GROUP BY 1)
SELECT lang, n, {r('coalesce(tp / nullif(p, 0), 0.0)')} AS precision, {r('coalesce(tp / nullif(t, 0), 0.0)')} AS recall, {r('coalesce(2.0 * tp / nullif(p + t, 0), 0.0)')} AS f1, {r('auc')} AS auc FROM b JOIN a USING (lang)""")
def ag15(t):
    joined = t.labels.join(t.documents.select("doc_id", "lang", "n_chars"), "doc_id").withColumn("flag", (F.col("n_chars") > 1000).cast("int"))
    return rounded(ag.detector_quality(joined, ["lang"], "quality", "flag", "n_chars"))


@query("ag16_regression_quality", f"""
WITH {ONE_FEATURE} SELECT coalesce(stage, 'overall') AS stage, count(*) AS n, {r('sqrt(avg((actual - prediction) * (actual - prediction)))', 5)} AS rmse, {r('avg(abs(actual - prediction))', 5)} AS mae,
  {r('1 - avg((actual - prediction) * (actual - prediction)) / var_pop(actual)', 5)} AS r2 FROM one_feature WHERE actual IS NOT NULL AND prediction IS NOT NULL GROUP BY ROLLUP (stage)""")
def ag16(t):
    return rounded(ag.regression_quality(one_feature_predictions(t)), 5)


@query("ag17_stage_improvement", f"""
WITH {ONE_FEATURE}, q AS (SELECT stage, sqrt(avg((actual - prediction) * (actual - prediction))) AS e FROM one_feature WHERE actual IS NOT NULL AND prediction IS NOT NULL GROUP BY 1),
p AS (SELECT max(e) FILTER (stage = 'stage_1') AS a, max(e) FILTER (stage = 'stage_2') AS b, max(e) FILTER (stage = 'stage_3') AS c FROM q)
SELECT {r('(a - b) / a * 100', 5)} AS stage_1_to_stage_2_pct, {r('(b - c) / b * 100', 5)} AS stage_2_to_stage_3_pct, {r('(a - c) / a * 100', 5)} AS stage_1_to_stage_3_pct FROM p""")
def ag17(t):
    return rounded(ag.stage_improvement(ag.regression_quality(one_feature_predictions(t)), ["stage_1", "stage_2", "stage_3"]), 5)


_RULES_SQL = """array_to_string(list_filter([CASE WHEN length(text) / 2000.0 > 0.85 THEN 'confidence above ceiling' END, CASE WHEN NOT (contains(text, 'the') OR contains(text, 'and') OR contains(text, 'que')) THEN 'key term missing' END,
  CASE WHEN len(str_split(text, chr(10))) < 2 THEN 'no counter evidence' END, CASE WHEN NOT contains(text, ',') THEN 'no uncertainty' END], lambda x: x IS NOT NULL), ',')"""


def scored_answers(t):
    text = F.col("text")
    return ag.score_answers(t.conversations, {
        "confidence above ceiling": F.length(text) / 2000.0 > 0.85,
        "key term missing": ~(text.contains("the") | text.contains("and") | text.contains("que")),
        "no counter evidence": F.size(F.split(text, "\n")) < 2,
        "no uncertainty": ~text.contains(",")})


@query("ag18_rule_checks", f"SELECT conv_id, turn, {_RULES_SQL} AS failures, {_RULES_SQL} = '' AS passed FROM conversations")
def ag18(t):
    return scored_answers(t).select("conv_id", "turn", F.array_join("failures", ",").alias("failures"), "passed")


@query("ag18_pass_totals", f"SELECT coalesce(role, 'overall') AS role, count(*) AS n, count(*) FILTER ({_RULES_SQL} = '') AS n_passed FROM conversations GROUP BY ROLLUP (role)")
def ag18_totals(t):
    return ag.pass_totals(scored_answers(t), "role")


@query("ag19_asserted_phrase", r"""
WITH pieces AS (SELECT doc_id, text, str_split(text, 'the') AS p FROM documents),
occ AS (SELECT doc_id, text, unnest(p) AS piece, generate_subscripts(p, 1) AS i, len(p) AS k FROM pieces),
pos AS (SELECT doc_id, text, i, k, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) + (i - 1) * 3 AS upto FROM occ),
ctx AS (SELECT doc_id, substr(text, CAST(greatest(1, upto - 19) AS BIGINT), CAST(least(20, upto) AS BIGINT)) AS before FROM pos WHERE i < k),
hit AS (SELECT doc_id, bool_or(NOT (regexp_matches(before, 'no|wh') OR right(regexp_replace(before, '[\s\p{Z}\x0b\x1c-\x1f\x{85}]+$', ''), 1) IN ('"', ''''))) AS asserted FROM ctx GROUP BY 1)
SELECT d.doc_id, coalesce(asserted, false) AS asserted FROM documents d LEFT JOIN hit USING (doc_id)""")
def ag19(t):
    return t.documents.select("doc_id", txt.asserts_phrase(F.col("text"), "the", negations=("no", "wh"), quotes=('"', "'")).alias("asserted"))


@query("ag20_relation_types", f"""
WITH {TRIPLES}, x AS (SELECT rel FROM triples UNION ALL SELECT 'affects' FROM triples WHERE rel = 'IN_REGION'), d AS (SELECT DISTINCT upper(rel) AS rel FROM x)
SELECT string_agg(rel, ',' ORDER BY rel) AS available, string_agg(rel, ',' ORDER BY rel) FILTER (rel IN ('AFFECTS', 'MAY_AFFECT', 'CANDIDATE_CAUSE', 'DISTURBS', 'PROXIES_FOR', 'DERIVES_FEATURE', 'INFLUENCES', 'DRIVES')) AS mechanisms FROM d""")
def ag20(t):
    e = triples(t)
    found = ag.relation_types(e.unionByName(e.filter(F.col("rel") == "IN_REGION").withColumn("rel", F.lit("affects"))))
    return found.select(F.array_join("available", ",").alias("available"), F.array_join("mechanisms", ",").alias("mechanisms"))


@query("ag21_quality_flag_sets", """
SELECT o_orderpriority, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS flags FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1""")
def ag21(t):
    return t.orders.groupBy("o_orderpriority").agg(F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("flags"))


_PRICE = """price AS (SELECT l_returnflag AS series_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS period, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 / (CAST(sum(CAST(round(l_quantity * 100) AS BIGINT)) AS DOUBLE) / 100.0) AS price FROM lineitem GROUP BY 1, 2)"""


@query("ag22_price_index", f"""
WITH {_PRICE} SELECT series_id, {_P}, {r('price / avg(price) OVER p * 100')} AS price_index, {r("price / max(CASE WHEN period = DATE '1998-01-01' THEN price END) OVER p * 100")} AS based_index FROM price WINDOW p AS (PARTITION BY series_id)""")
def ag22(t):
    price = t.lineitem.groupBy(F.col("l_returnflag").alias("series_id"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("period")).agg(
        (money("l_extendedprice") / money("l_quantity")).alias("price"))
    based = ag.price_index(price, "price", "1998-01-01").withColumnRenamed("price_index", "based_index")
    return rounded(ag.price_index(based, "price").select("series_id", "period", "price_index", "based_index"))


@query("ag23_trace_statistics", """
SELECT conv_id, count(*) AS n_steps, max(turn) - min(turn) AS span, count(*) FILTER (length(text) < 100) AS n_failed, arg_min(role, turn) AS first_tool, arg_max(role, turn) AS last_tool FROM conversations GROUP BY 1""")
def ag23(t):
    return ag.trace_statistics(t.conversations, "conv_id", "turn", "role", F.length("text") < 100)[0]


@query("ag23_tool_attempts", """
SELECT conv_id, role, count(*) AS attempts, count(*) FILTER (length(text) < 100) AS failures FROM conversations GROUP BY 1, 2""")
def ag23_tools(t):
    return ag.trace_statistics(t.conversations, "conv_id", "turn", "role", F.length("text") < 100)[1]


@query("ag23_tool_sequence", """
SELECT user_id, row_number() OVER w AS position, event_type AS tool, floor(epoch(ts)) - floor(epoch(lag(ts) OVER w)) AS seconds_since FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def ag23_sequence(t):
    out = ag.tool_sequence(t.events.withColumn("at", F.unix_seconds(F.col("ts").cast("timestamp"))), "user_id", "event_id", "event_type", "at")
    return out.select("user_id", "position", F.col("event_type").alias("tool"), "seconds_since")


@query("ag23_run_durations", """
SELECT user_id, count(*) AS n_steps, CAST(max(floor(epoch(ts))) - min(floor(epoch(ts))) AS BIGINT) AS seconds FROM events GROUP BY 1""")
def ag23_durations(t):
    return ag.run_durations(t.events.withColumn("at", F.unix_seconds(F.col("ts").cast("timestamp"))), "user_id", "at")
