"""SC: the scalar functions the operators rest on, as one query per family."""

from pyspark.sql import functions as F

from .registry import query, rounded
from .standins import r


@query("sc1_string_functions", r"""
SELECT doc_id, md5(lower(trim(text))) AS lowered, CAST(length(replace(text, 'e', '')) AS INTEGER) AS without_e, regexp_extract(text, '([A-Za-z]+)', 1) AS first_word,
  md5(regexp_replace(text, '[0-9]+', '#', 'g')) AS masked, concat_ws('-', lang, source) AS joined, printf('%05d', doc_id) AS padded, contains(text, 'http') AS has_link,
  CAST(len(str_split(text, ' ')) AS INTEGER) AS n_parts FROM documents""")
def sc1(t):
    return t.documents.select(
        "doc_id", F.md5(F.lower(F.trim("text"))).alias("lowered"), F.length(F.replace("text", F.lit("e"), F.lit(""))).alias("without_e"),
        F.regexp_extract("text", "([A-Za-z]+)", 1).alias("first_word"), F.md5(F.regexp_replace("text", "[0-9]+", "#")).alias("masked"),
        F.concat_ws("-", "lang", "source").alias("joined"), F.format_string("%05d", "doc_id").alias("padded"), F.col("text").contains("http").alias("has_link"),
        F.size(F.split("text", " ")).alias("n_parts"))


@query("sc2_date_functions", """
SELECT CAST(o_orderdate AS DATE)::VARCHAR AS day, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(quarter(o_orderdate) AS INTEGER) AS q, CAST(month(o_orderdate) AS INTEGER) AS m,
  CAST(isodow(o_orderdate) - 1 AS INTEGER) AS weekday, CAST(dayofyear(o_orderdate) AS INTEGER) AS doy, CAST(weekofyear(o_orderdate) AS INTEGER) AS iso_week,
  CAST(last_day(o_orderdate) AS VARCHAR) AS month_end, CAST(CAST(date_trunc('quarter', o_orderdate) AS DATE) AS VARCHAR) AS quarter_start,
  CAST(CAST(o_orderdate + INTERVAL 5 MONTH AS DATE) AS VARCHAR) AS five_months_on, CAST(datediff('day', DATE '1995-01-01', o_orderdate) AS INTEGER) AS age_days, count(*) AS n FROM orders GROUP BY ALL""")
def sc2(t):
    d = F.col("o_orderdate")
    return t.orders.groupBy(
        F.date_format(d, "yyyy-MM-dd").alias("day"), F.year(d).alias("y"), F.quarter(d).alias("q"), F.month(d).alias("m"), F.weekday(d).alias("weekday"),
        F.dayofyear(d).alias("doy"), F.weekofyear(d).alias("iso_week"), F.last_day(d).alias("month_end"), F.to_date(F.date_trunc("quarter", d)).alias("quarter_start"),
        F.add_months(d, 5).alias("five_months_on"), F.datediff(d, F.lit("1995-01-01").cast("date")).alias("age_days")).agg(F.count("*").alias("n"))


@query("sc3_math_functions", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {r('ln(l_extendedprice)', 8)} AS log_price, {r('exp(-l_discount)', 8)} AS decay, {r('abs(l_quantity - 25)')} AS off, {r('power(l_quantity, 1.5)')} AS pow_q,
  {r('sqrt(l_extendedprice)')} AS root, {r('greatest(10, least(40, l_quantity))')} AS clipped, CAST(sign(l_quantity - 25) AS INTEGER) AS side, {r('CASE WHEN l_tax <> 0 THEN l_discount / l_tax END')} AS safe_ratio FROM lineitem""")
def sc3(t):
    q = F.col("l_quantity")
    return rounded(t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.ln("l_extendedprice").alias("log_price"), F.exp(-F.col("l_discount")).alias("decay"), F.abs(q - 25).alias("off"), F.pow(q, 1.5).alias("pow_q"),
        F.sqrt("l_extendedprice").alias("root"), F.greatest(F.lit(10.0), F.least(F.lit(40.0), q)).alias("clipped"), F.sign(q - 25).cast("int").alias("side"),
        F.try_divide("l_discount", "l_tax").alias("safe_ratio")), 6, log_price=8, decay=8)


@query("sc4_nested_values", """
SELECT event_type, CAST(date_trunc('hour', ts) AS VARCHAR) AS hour, count(*) AS n, array_to_string(list_sort(list_distinct(list(CASE WHEN value > 100 THEN 'large' WHEN value > 20 THEN 'middle' ELSE 'small' END))), ',') AS sizes,
  bool_or(value > 100) AS has_large, 'cause:' || event_type AS cause FROM events GROUP BY event_type, date_trunc('hour', ts)""")
def sc4(t):
    size = F.when(F.col("value") > 100, "large").when(F.col("value") > 20, "middle").otherwise("small")
    grouped = t.events.groupBy("event_type", F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss").alias("hour")).agg(
        F.count("*").alias("n"), F.collect_set(size).alias("s"))
    cause = F.struct(F.lit("cause").alias("kind"), F.col("event_type").alias("name"))
    known = F.create_map(F.lit("large"), F.lit(True), F.lit("middle"), F.lit(False), F.lit("small"), F.lit(False))
    return grouped.withColumn("c", cause).select(
        "event_type", "hour", "n", F.array_join(F.array_sort("s"), ",").alias("sizes"), F.exists("s", lambda x: known[x]).alias("has_large"),
        F.concat_ws(":", "c.kind", "c.name").alias("cause"))


@query("sc5_json_functions", """
SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, '{"kind":"' || event_type || '","k":' || json_extract_string(props, '$.k') || '}' AS record, count(*) AS n FROM events GROUP BY ALL""")
def sc5(t):
    parsed = t.events.select("event_type", F.from_json("props", "k int").alias("p"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    record = F.to_json(F.struct(F.col("event_type").alias("kind"), F.col("p.k").alias("k")))
    return parsed.groupBy("event_type", "k", record.alias("record")).agg(F.count("*").alias("n"))
