"""PRJ: parsing, scaling, labelling and classifying columns."""

from pyspark.sql import functions as F

from ..functions import numbers as num
from ..functions import periods as per
from ..functions import text as txt
from ..operators import decompose as dc
from ..operators import series as ser
from ..operators import stl
from .registry import query, rounded
from .standins import DAILY, MONTHLY, daily, money, monthly, r, temperature, temperature_sql


def _forms(t):
    d = F.col("o_orderdate")
    forms = {
        "month": F.date_format(d, "yyyy-MM"),
        "quarter": F.concat(F.year(d), F.lit(" Q"), F.quarter(d)),
        "dashed_quarter": F.concat(F.year(d), F.lit("-q"), F.quarter(d)),
        "year": F.date_format(d, "yyyy"),
        "compact": F.date_format(d, "yyyyMM"),
        "date": F.date_format(d, "yyyy-MM-dd"),
        "stamp": F.date_format(d, "yyyy-MM-dd HH:mm"),
        "slashed": F.date_format(d, "yyyy/MM/dd"),
        "short": F.concat_ws("/", F.year(d), F.month(d), F.day(d)),
        "dashed_short": F.concat_ws("-", F.year(d), F.month(d), F.day(d)),
        "digits": F.date_format(d, "yyyyMMdd"),
        "fraction": F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss.5"),
        "no_day": F.concat(F.year(d), F.lit("/02/30")),
        "garbage": F.concat(F.year(d), F.lit("-13")),
        "blank": F.lit(" NaN "),
        "word": F.col("o_orderstatus"),
    }
    return t.orders.select(F.explode(F.create_map(*[x for k, v in forms.items() for x in (F.lit(k), v)])).alias("form", "text"))


@query("prj1_period_parser", """
WITH forms AS (
  SELECT unnest([
    {'form': 'month', 'text': strftime(o_orderdate, '%Y-%m')},
    {'form': 'quarter', 'text': year(o_orderdate) || ' Q' || quarter(o_orderdate)},
    {'form': 'dashed_quarter', 'text': year(o_orderdate) || '-q' || quarter(o_orderdate)},
    {'form': 'year', 'text': strftime(o_orderdate, '%Y')},
    {'form': 'compact', 'text': strftime(o_orderdate, '%Y%m')},
    {'form': 'date', 'text': strftime(o_orderdate, '%Y-%m-%d')},
    {'form': 'stamp', 'text': strftime(o_orderdate, '%Y-%m-%d %H:%M')},
    {'form': 'slashed', 'text': strftime(o_orderdate, '%Y/%m/%d')},
    {'form': 'short', 'text': year(o_orderdate) || '/' || month(o_orderdate) || '/' || day(o_orderdate)},
    {'form': 'dashed_short', 'text': year(o_orderdate) || '-' || month(o_orderdate) || '-' || day(o_orderdate)},
    {'form': 'digits', 'text': strftime(o_orderdate, '%Y%m%d')},
    {'form': 'fraction', 'text': strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.5')},
    {'form': 'no_day', 'text': year(o_orderdate) || '/02/30'},
    {'form': 'garbage', 'text': year(o_orderdate) || '-13'},
    {'form': 'blank', 'text': ' NaN '},
    {'form': 'word', 'text': o_orderstatus}], recursive := true) FROM orders),
parsed AS (SELECT form, trim("text") AS t FROM forms)
SELECT form, CAST(period AS VARCHAR) AS period, count(*) AS n FROM (
  SELECT form, CASE
    WHEN lower(t) IN ('', 'nan', 'none', 'nat', 'null') THEN NULL
    WHEN regexp_full_match(t, '(\\d{4})\\s*[-_/]?\\s*[Qq]\\s*([1-4])')
      THEN make_date(CAST(left(t, 4) AS BIGINT), CAST(right(t, 1) AS BIGINT) * 3 - 2, 1)
    WHEN regexp_full_match(t, '(\\d{4})\\s*[-_/]\\s*(1[0-2]|0?[1-9])')
      THEN make_date(CAST(left(t, 4) AS BIGINT), CAST(regexp_extract(t, '[-_/]\\s*(\\d+)$', 1) AS BIGINT), 1)
    WHEN regexp_full_match(t, '(\\d{4})(0[1-9]|1[0-2])')
      THEN make_date(CAST(left(t, 4) AS BIGINT), CAST(right(t, 2) AS BIGINT), 1)
    WHEN regexp_full_match(t, '\\d{4}') THEN make_date(CAST(t AS BIGINT), 1, 1)
    WHEN regexp_full_match(t, '\\d{8}') THEN try_strptime(t, '%Y%m%d')::DATE
    WHEN regexp_full_match(t, '\\d{4}[-/]\\d{1,2}[-/]\\d{1,2}([ T]\\d{2}:\\d{2}(:\\d{2}(\\.\\d+)?)?)?') THEN TRY_CAST(replace(regexp_extract(t, '^[^ T]+'), '/', '-') AS DATE)
  END AS period FROM parsed) GROUP BY ALL""")
def prj1(t):
    return (_forms(t).select("form", per.parse_period(F.col("text")).cast("date").alias("period"))
            .groupBy("form", "period").agg(F.count("*").alias("n")))


@query("prj2_period_label", """
SELECT strftime(o_orderdate, '%Y') AS annual, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarterly,
  strftime(o_orderdate, '%Y-%m') AS monthly, strftime(o_orderdate, '%Y-%m-%d') AS daily,
  strftime(o_orderdate, '%Y-%m-%d %H:00') AS hourly, count(*) AS n FROM orders GROUP BY ALL""")
def prj2(t):
    freqs = ("annual", "quarterly", "monthly", "daily", "hourly")
    labels = [per.period_label(F.col("o_orderdate"), f).alias(f) for f in freqs]
    return t.orders.groupBy(*labels).agg(F.count("*").alias("n"))


@query("prj3_period_shift", f"""
WITH {MONTHLY}
SELECT series_id, CAST(period AS VARCHAR) AS period,
  CAST(CAST(period - INTERVAL 12 MONTH AS DATE) AS VARCHAR) AS last_year,
  CAST(CAST(period + INTERVAL 2 MONTH AS DATE) AS VARCHAR) AS two_months_on,
  CAST(CAST(period - INTERVAL 3 MONTH AS DATE) AS VARCHAR) AS quarter_back,
  CAST(CAST(period - INTERVAL 21 DAY AS DATE) AS VARCHAR) AS three_weeks_back,
  CAST(CAST(period + INTERVAL 30 DAY AS DATE) AS VARCHAR) AS unknown_on FROM monthly""")
def prj3(t):
    p = F.col("period")
    return monthly(t).select(
        "series_id", "period", per.last_year(p, "monthly").alias("last_year"),
        per.shift_period(p, "monthly", 2).alias("two_months_on"), per.shift_period(p, "quarterly", -1).alias("quarter_back"),
        per.shift_period(p, "weekly", -3).alias("three_weeks_back"), per.shift_period(p, "unknown", 1).alias("unknown_on"))


@query("prj4_dirty_numbers", """
WITH dirty AS (SELECT o_orderstatus, o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN '--' WHEN '2-HIGH' THEN ' '
    ELSE ' ' || format('{:,.2f}', o_totalprice) END AS written FROM orders)
SELECT o_orderstatus, o_orderpriority, count(*) AS n,
  count(TRY_CAST(nullif(nullif(trim(replace(written, ',', '')), '--'), '') AS DOUBLE)) AS n_numbers,
  CAST(sum(CAST(round(TRY_CAST(nullif(nullif(trim(replace(written, ',', '')), '--'), '') AS DOUBLE) * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS total
FROM dirty GROUP BY ALL""")
def prj4(t):
    written = (F.when(F.col("o_orderpriority") == "1-URGENT", "--").when(F.col("o_orderpriority") == "2-HIGH", " ")
               .otherwise(F.concat(F.lit(" "), F.format_number("o_totalprice", 2))))
    parsed = t.orders.select("o_orderstatus", "o_orderpriority", num.parse_number(written).alias("v"))
    return parsed.groupBy("o_orderstatus", "o_orderpriority").agg(
        F.count("*").alias("n"), F.count("v").alias("n_numbers"), money("v").alias("total"))


@query("prj5_unit_conversion", f"""
WITH {MONTHLY} SELECT series_id, CAST(period AS VARCHAR) AS period, {r('value / 10000.0')} AS value_large FROM monthly""")
def prj5(t):
    return rounded(monthly(t).select("series_id", "period", num.to_large_unit(F.col("value")).alias("value_large")))


@query("prj6_percent_scale", f"""
SELECT l_returnflag, l_linestatus, {r('v', 4)} AS pct, count(*) AS n FROM (
  SELECT l_returnflag, l_linestatus, CASE WHEN abs(x) > 1.5 THEN x ELSE x * 100 END AS v FROM (
    SELECT l_returnflag, l_linestatus, CASE WHEN l_linestatus = 'O' THEN l_discount * 100 ELSE l_discount END AS x FROM lineitem))
GROUP BY ALL""")
def prj6(t):
    x = F.when(F.col("l_linestatus") == "O", F.col("l_discount") * 100).otherwise(F.col("l_discount"))
    return (t.lineitem.groupBy("l_returnflag", "l_linestatus", F.round(num.as_percent(x), 4).alias("pct"))
            .agg(F.count("*").alias("n")))


@query("prj7_row_filters", """
SELECT o_orderpriority, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS value
FROM orders WHERE o_orderstatus = 'F' AND o_totalprice IS NOT NULL AND NOT isnan(o_totalprice)
  AND CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' GROUP BY 1""")
def prj7(t):
    kept = ser.select_points(t.orders, "o_orderdate", "o_totalprice", indicator=("o_orderstatus", "F"),
                             start="1996-01-01", end="1999-12-31")
    return kept.groupBy("o_orderpriority").agg(F.count("*").alias("n"), money("o_totalprice").alias("value"))


_BY_CUSTOMER = """points AS (SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS period FROM orders GROUP BY 1, 2),
sized AS (SELECT o_custkey, count(*) AS n FROM points GROUP BY 1)"""


@query("prj8_minimum_sample", f"""
WITH {_BY_CUSTOMER}
SELECT o_custkey AS series_id, n, CASE WHEN n >= 12 THEN 'kept' ELSE 'needs 12 points, has ' || n END AS outcome FROM sized""")
def prj8(t):
    points = t.orders.select(F.col("o_custkey").alias("series_id"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("period")).distinct()
    kept, rejected = ser.require_points(points, 12)
    return kept.groupBy("series_id").agg(F.count("*").alias("n")).withColumn("outcome", F.lit("kept")).unionByName(
        rejected.withColumnRenamed("reason", "outcome"))


@query("prj8_rejected_series", f"""
WITH {_BY_CUSTOMER}
SELECT o_custkey AS series_id, n, 'classical' AS by, 'needs 24 points, has ' || n AS reason FROM sized WHERE n < 24
UNION ALL SELECT o_custkey, n, 'stl', 'no setting fits ' || n || ' points' FROM sized WHERE n < 26""")
def prj8_rejected(t):
    points = t.orders.groupBy(F.col("o_custkey").alias("series_id"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("period")).agg(money("o_totalprice").alias("value"))
    monthly_spans = stl.cycle_spans(12)
    return dc.rejected(points).withColumn("by", F.lit("classical")).unionByName(stl.rejected(points, monthly_spans, 26).withColumn("by", F.lit("stl")))


@query("prj9_severity", f"""
WITH {MONTHLY}, m AS (SELECT *, 100 * (value / avg(value) OVER (PARTITION BY series_id) - 1) AS x FROM monthly),
s AS (SELECT series_id, CASE WHEN abs(x) >= 10 THEN 'strong' WHEN abs(x) >= 6 THEN 'watch' ELSE 'normal' END AS load,
  CASE WHEN abs(x) >= 5 THEN 'strong' WHEN abs(x) >= 3 THEN 'watch' ELSE 'normal' END AS growth,
  CASE WHEN abs(x) >= 10 THEN 'strong' WHEN abs(x) >= 5 THEN 'watch' ELSE 'normal' END AS flow FROM m)
SELECT series_id, load, growth, flow, count(*) AS n FROM s GROUP BY ALL""")
def prj9(t):
    m = monthly(t).withColumn("x", 100 * (F.col("value") / F.avg("value").over(ser.whole("series_id")) - 1))
    x = F.col("x")
    return m.groupBy("series_id", num.severity(x, num.LOAD_LIMITS).alias("load"), num.severity(x, num.GROWTH_LIMITS).alias("growth"),
                     num.severity(x, num.FLOW_LIMITS).alias("flow")).agg(F.count("*").alias("n"))


@query("prj10_degree_days", f"""
WITH {DAILY}, d AS (SELECT series_id, date_trunc('month', period) AS m, {temperature_sql('period')} AS temp FROM daily)
SELECT series_id, strftime(m, '%Y-%m') AS month, {r('sum(greatest(0, 18 - temp))', 5)} AS hdd18, {r('sum(greatest(0, temp - 18))', 5)} AS cdd18,
  {r('sum(temp - 18)', 5)} AS deviation, {r('sum(greatest(0, 10 - temp))', 5)} AS hdd10, {r('sum(greatest(0, temp - 25))', 5)} AS cdd25,
  {r('sum(greatest(0, 10 - temp))', 5)} AS hdd_low, {r('sum(greatest(0, temp - 24))', 5)} AS cdd_high FROM d GROUP BY ALL""")
def prj10(t):
    temp = F.col("temp")
    h18, c18 = num.degree_days(temp)
    h10, c25 = num.degree_days(temp, 10.0, 25.0)
    hl, ch = num.degree_days(temp, 18.0 - 8.0, 18.0 + 6.0)
    d = daily(t).select("series_id", F.date_format("period", "yyyy-MM").alias("month"), temperature(F.col("period")).alias("temp"))
    return rounded(d.groupBy("series_id", "month").agg(
        F.sum(h18).alias("hdd18"), F.sum(c18).alias("cdd18"), F.sum(temp - 18.0).alias("deviation"), F.sum(h10).alias("hdd10"),
        F.sum(c25).alias("cdd25"), F.sum(hl).alias("hdd_low"), F.sum(ch).alias("cdd_high")), 5)


@query("prj11_calendar_labels", """
SELECT CAST(month(o_orderdate) AS INTEGER) AS month, CAST(quarter(o_orderdate) AS INTEGER) AS quarter,
  CAST((month(o_orderdate) - 1) % 3 + 1 AS INTEGER) AS quarter_month, CAST(isodow(o_orderdate) >= 6 AS INTEGER) AS is_weekend,
  CAST(dayofyear(o_orderdate) AS INTEGER) AS day_of_year, count(*) AS n FROM orders GROUP BY ALL""")
def prj11(t):
    return t.orders.groupBy(*ser.calendar_labels(F.col("o_orderdate"))).agg(F.count("*").alias("n"))


@query("prj12_one_hot", f"""
WITH {DAILY}, d AS (SELECT series_id, period, datediff('day', make_date(year(period), 2, 5), period) AS near FROM daily)
SELECT series_id, {', '.join(f"CAST(count(*) FILTER (month(period) = {m}) AS DOUBLE) AS month_{m}" for m in range(2, 13))},
  {', '.join(f"CAST(count(*) FILTER (near = {k}) AS DOUBLE) AS day_{'m' if k < 0 else ''}{abs(k)}" for k in range(-21, 22))} FROM d GROUP BY 1""")
def prj12(t):
    d = daily(t)
    near = F.datediff("period", F.make_date(F.year("period"), F.lit(2), F.lit(5)))
    coded = d.select("series_id", *num.one_hot(F.month("period"), range(2, 13), "month_"), *num.one_hot(near, range(-21, 22), "day_"))
    return coded.groupBy("series_id").agg(*[F.sum(c).alias(c) for c in coded.columns[1:]])


@query("prj13_edge_risks", f"""
WITH {MONTHLY}, o AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY period) AS i,
  row_number() OVER (PARTITION BY series_id ORDER BY period DESC) AS j FROM monthly)
SELECT series_id, CAST(period AS VARCHAR) AS period, array_to_string(list_filter([
    CASE WHEN i = 1 OR j = 1 THEN 'series_edge' END, CASE WHEN month(period) = 12 THEN 'december_balance' END,
    CASE WHEN i <= 12 THEN 'first_cycle' END], lambda x: x IS NOT NULL), ',') AS risks,
  CAST(i <= 6 OR j <= 6 AS INTEGER) AS edge_flag FROM o""")
def prj13(t):
    return ser.point_risks(monthly(t), "monthly").select(
        "series_id", "period", F.array_join("risks", ",").alias("risks"), "edge_flag")


_QUESTION = """(CASE role WHEN 'user' THEN text || ' ' || (1990 + conv_id % 30) || '年第' || substr('一二三四', CAST(turn % 4 + 1 AS INTEGER), 1) || '季度'
  WHEN 'assistant' THEN text || ' ' || (1990 + conv_id % 30) || '-' || (turn + 7) || ' 未来' ELSE text || ' ' || (1990 + conv_id % 30) || '年' || (turn + 11) || '月' END)"""
_ASKED_SQL = r"""coalesce(
    CASE WHEN regexp_matches(q, '(\d{4})\s*[Qq]\s*([1-4])') THEN regexp_extract(q, '(\d{4})\s*[Qq]\s*([1-4])', 1) || 'Q' || regexp_extract(q, '(\d{4})\s*[Qq]\s*([1-4])', 2) END,
    CASE WHEN regexp_matches(q, '(\d{4})\s*年\s*第?\s*([1-4一二三四])\s*季度') THEN regexp_extract(q, '(\d{4})\s*年\s*第?\s*([1-4一二三四])\s*季度', 1) || 'Q' || translate(regexp_extract(q, '(\d{4})\s*年\s*第?\s*([1-4一二三四])\s*季度', 2), '一二三四', '1234') END,
    CASE WHEN TRY_CAST(regexp_extract(q, '(\d{4})\s*年\s*(\d{1,2})\s*月', 2) AS INTEGER) BETWEEN 1 AND 12 THEN regexp_extract(q, '(\d{4})\s*年\s*(\d{1,2})\s*月', 1) || '-' || lpad(regexp_extract(q, '(\d{4})\s*年\s*(\d{1,2})\s*月', 2), 2, '0') END,
    CASE WHEN TRY_CAST(regexp_extract(q, '(\d{4})-(\d{1,2})(?:\D|$)', 2) AS INTEGER) BETWEEN 1 AND 12 THEN regexp_extract(q, '(\d{4})-(\d{1,2})(?:\D|$)', 1) || '-' || lpad(regexp_extract(q, '(\d{4})-(\d{1,2})(?:\D|$)', 2), 2, '0') END)"""


def _questions(t):
    year = 1990 + F.col("conv_id") % 30
    q = (F.when(F.col("role") == "user", F.concat("text", F.lit(" "), year, F.lit("年第"), F.substring(F.lit("一二三四"), (F.col("turn") % 4 + 1).cast("int"), F.lit(1)), F.lit("季度")))
         .when(F.col("role") == "assistant", F.concat("text", F.lit(" "), year, F.lit("-"), F.col("turn") + 7, F.lit(" 未来")))
         .otherwise(F.concat("text", F.lit(" "), year, F.lit("年"), F.col("turn") + 11, F.lit("月"))))
    return t.conversations.select("conv_id", "turn", "role", q.alias("q"))


@query("prj14_question_period", f"""
SELECT conv_id, turn, asked FROM (SELECT conv_id, turn, {_ASKED_SQL} AS asked FROM (SELECT conv_id, turn, {_QUESTION} AS q FROM conversations))""")
def prj14(t):
    return _questions(t).select("conv_id", "turn", per.question_period(F.col("q")).alias("asked"))


@query("prj15_out_of_scope", f"""
WITH span AS (SELECT CAST(date_trunc('month', min(o_orderdate)) AS DATE) AS lo, CAST(date_trunc('month', max(o_orderdate)) AS DATE) AS hi FROM orders),
asked AS (SELECT conv_id, turn, q, {_ASKED_SQL} AS label FROM (SELECT conv_id, turn, {_QUESTION} AS q FROM conversations)),
dated AS (SELECT *, CASE WHEN label LIKE '%Q%' THEN make_date(CAST(left(label, 4) AS BIGINT), CAST(right(label, 1) AS BIGINT) * 3 - 2, 1)
  ELSE CAST(label || '-01' AS DATE) END AS d FROM asked)
SELECT coalesce(CASE WHEN regexp_matches(q, '{'|'.join(per.FORECAST_PHRASES)}') THEN 'forecast'
  WHEN d < (SELECT lo FROM span) OR d > (SELECT hi FROM span) THEN 'outside_range' END, 'answerable') AS outcome, count(*) AS n FROM dated GROUP BY 1""")
def prj15(t):
    month = F.to_date(F.date_trunc("month", F.col("o_orderdate")))
    span = t.orders.agg(F.struct(F.min(month).alias("lo"), F.max(month).alias("hi")).alias("s")).scalar()
    asked = (_questions(t).withColumn("label", per.question_period(F.col("q")))
             .withColumn("asked", per.parse_period(F.col("label")).cast("date")).withColumn("span", span))
    outcome = per.out_of_scope(F.col("q"), F.col("asked"), F.col("span.lo"), F.col("span.hi"))
    return asked.groupBy(F.coalesce(outcome, F.lit("answerable")).alias("outcome")).agg(F.count("*").alias("n"))


_REPLY = """CASE event_type WHEN 'click' THEN '{"work": ' || CAST(value / 100 AS DECIMAL(10, 4)) || ', "consumption": ' || CAST(k / 100.0 AS DECIMAL(10, 4)) || '}'
  WHEN 'view' THEN '{"work": ' || CAST(k / 100.0 AS DECIMAL(10, 4)) || '}' WHEN 'error' THEN 'I will work ' || k ELSE
  '{"work": 1, "consumption": ' || CAST(k / 50.0 AS DECIMAL(10, 4)) || '}' END"""


@query("prj16_decision_records", f"""
WITH raw AS (SELECT event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
reply AS (SELECT event_type, {_REPLY} AS reply FROM raw),
parsed AS (SELECT event_type, CASE WHEN json_valid(reply) THEN TRY_CAST(json_extract_string(reply, '$.work') AS DOUBLE) END AS w,
  CASE WHEN json_valid(reply) THEN TRY_CAST(json_extract_string(reply, '$.consumption') AS DOUBLE) END AS c FROM reply),
judged AS (SELECT *, coalesce(w BETWEEN 0 AND 1 AND c BETWEEN 0 AND 1, false) AS ok FROM parsed)
SELECT event_type, count(*) AS n, count(*) FILTER (NOT ok) AS errors,
  {r('sum(CASE WHEN ok THEN w ELSE 1 END)', 3)} AS work, {r('sum(CASE WHEN ok THEN c ELSE 0.5 END / 0.02)', 3)} AS consumption_steps FROM judged GROUP BY 1""")
def prj16(t):
    k = F.get_json_object("props", "$.k").cast("int")

    def four(c):
        return c.cast("decimal(10,4)")

    reply = (
        F.when(F.col("event_type") == "click", F.concat(F.lit('{"work": '), four(F.col("value") / 100), F.lit(', "consumption": '), four(k / 100.0), F.lit("}")))
        .when(F.col("event_type") == "view", F.concat(F.lit('{"work": '), four(k / 100.0), F.lit("}")))
        .when(F.col("event_type") == "error", F.concat(F.lit("I will work "), k))
        .otherwise(F.concat(F.lit('{"work": 1, "consumption": '), four(k / 50.0), F.lit("}"))))
    decided = ser.parse_decisions(t.events.select("event_type", reply.alias("reply")), "reply")
    return rounded(decided.groupBy("event_type").agg(
        F.count("*").alias("n"), F.sum(F.col("invalid").cast("long")).alias("errors"), F.sum("work").alias("work"),
        F.sum("consumption_steps").alias("consumption_steps")), 3)


_SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]+"


@query("prj17_condense_text", rf"""
WITH flat AS (SELECT doc_id, trim(regexp_replace(text, '{_SPACE}', ' ', 'g'), ' ') AS s, str_split(text, chr(10)) AS lines FROM documents)
SELECT doc_id, md5(CASE WHEN length(s) <= 420 THEN s ELSE substr(s, 1, 420) || '…' END) AS condensed, CAST(length(s) AS INTEGER) AS flat_chars,
  md5(array_to_string(CASE WHEN len(lines) <= 8 THEN lines ELSE list_concat(list_concat(lines[1:4], ['…（省略 ' || (len(lines) - 8) || ' 项）']), lines[-4:]) END, '|')) AS lines
FROM flat""")
def prj17(t):
    return t.documents.select(
        "doc_id", F.md5(txt.condense(F.col("text"))).alias("condensed"), F.length(F.trim(txt.squeeze(F.col("text")))).alias("flat_chars"),
        F.md5(F.array_join(txt.shorten_list(F.split("text", "\n")), "|")).alias("lines"))
