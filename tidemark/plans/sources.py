"""SRC and SNK: scans, profiling, passages, logs and sinks."""

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import joins as jn
from ..operators import series as ser
from ..session import shared_dir
from ..sources import csv, documents, logs, profile, tables
from .registry import query, rounded
from .standins import DAILY_TOTAL, HOURLY, MONTHLY, QUARTERLY, daily_total, hourly, money, monthly, quarterly, r


@query("src1_csv_scan", """
SELECT series_id, CAST(period AS VARCHAR) AS period, o_orderkey, amount FROM (
  SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS period, o_orderkey, o_totalprice AS amount,
    row_number() OVER (PARTITION BY o_orderpriority, CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS i FROM orders) WHERE i = 1""")
def src1(t):
    # written as CSV files in the order of the key, and read back
    base = shared_dir(t.spark)
    rows = t.orders.select(F.col("o_orderpriority").alias("series_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("period"), "o_orderkey", F.col("o_totalprice").alias("amount"))
    csv.write_table(rows.orderBy("o_orderkey"), base, "csv")
    schema = T.StructType().add("series_id", "string").add("period", "date").add("o_orderkey", "long").add("amount", "double")
    return csv.read_csv(t.spark, base, schema, "period", ["series_id"])


@query("src2_wide_to_long", f"""
WITH {QUARTERLY} SELECT series_id, CAST(year(period) AS INTEGER) AS year, CAST(quarter(period) AS INTEGER) AS quarter, value FROM quarterly""")
def src2(t):
    q = quarterly(t).withColumn("head", F.concat(F.year("period"), F.lit("年"), F.quarter("period"), F.lit("季度")))
    # the header row of the wide sheet: calendar quarters of the whole table, a calendar-sized list
    span = q.agg(F.min("period"), F.max("period")).first()
    heads = [f"{y}年{k}季度" for y in range(span[0].year, span[1].year + 1) for k in range(1, 5)]
    wide = q.groupBy("series_id").pivot("head", heads).agg(F.first("value"))
    long = wide.unpivot(["series_id"], heads, "head", "value").filter(F.col("value").isNotNull() & ~F.isnan("value"))
    part = [F.regexp_extract("head", r"(\d{4})年([1-4])季度", i).cast("int") for i in (1, 2)]
    return long.select("series_id", part[0].alias("year"), part[1].alias("quarter"), "value")


@query("src3_column_aliases", """
SELECT n_nationkey AS id, n_name AS name, CAST(n_regionkey AS VARCHAR) AS parent, CAST(NULL AS VARCHAR) AS notes FROM nation
UNION ALL SELECT r_regionkey + 1000, r_name, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM region""")
def src3(t):
    aliases = {"id": ["id", "N_NATIONKEY", "r_regionkey"], "name": ["name", "n_name", "r_name"], "parent": ["parent", "n_regionkey"], "notes": ["notes", "remark"]}
    types = {"parent": "string", "notes": "string"}
    n = csv.rename_columns(t.nation, aliases, types).withColumn("parent", F.col("parent").cast("string"))
    return n.unionByName(csv.rename_columns(t.region, aliases, types).withColumn("id", F.col("id") + 1000))


@query("src4_normalise_series", """
SELECT CAST(date_trunc('month', o_orderdate) AS VARCHAR)[1:10] AS period, o_orderpriority AS metric, o_orderpriority AS industry, 'yuan' AS unit, 'orders' AS source,
  count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS value FROM orders GROUP BY ALL
UNION ALL SELECT CAST(date_trunc('month', l_shipdate) AS VARCHAR)[1:10], 'l_quantity', NULL, NULL, 'lineitem',
  count(*), CAST(sum(CAST(round(l_quantity * 100) AS BIGINT)) AS DOUBLE) / 100.0 FROM lineitem GROUP BY ALL""")
def src4(t):
    a = ser.normalise(t.orders, F.date_format("o_orderdate", "yyyy-MM"), F.col("o_totalprice").cast("string"), "o_totalprice", F.col("o_orderpriority"), "yuan", "orders")
    b = ser.normalise(t.lineitem, F.date_format("l_shipdate", "yyyyMM"), F.col("l_quantity").cast("string"), "l_quantity", source="lineitem")
    return (a.unionByName(b).groupBy("period", "metric", "industry", "unit", "source")
            .agg(F.count("*").alias("n"), money("value").alias("value")))


def _unlike(t):
    """Three tables nobody has described: written dates with gaps and figures as text, compact months with two candidates for the value, and one without periods."""
    o, key = t.orders, F.col("o_orderkey")
    orders = o.select(
        "o_orderstatus", F.when(key % 97 == 0, "n/a").when(key % 101 == 0, F.lit(None)).otherwise(F.date_format("o_orderdate", "yyyy/M/d")).alias("booked"),
        F.when(key % 89 == 0, "broken").when(key % 83 == 0, " ").otherwise(F.col("o_totalprice").cast("string")).alias("consumption_kwh"))
    lines = t.lineitem.select(F.date_format("l_shipdate", "yyyyMM").alias("Month"), F.col("l_quantity").alias("load"), (F.col("l_quantity") * 3).alias("load_ytd"), F.col("l_returnflag").alias("note"))
    return {"orders": orders, "lines": lines, "segments": t.customer.select("c_mktsegment", F.col("c_acctbal").alias("balance_yuan"))}


_UNLIKE = """o AS (SELECT o_orderkey AS k, o_orderdate AS d, o_totalprice AS v, CASE WHEN o_orderkey % 97 = 0 THEN 'period unreadable' WHEN o_orderkey % 101 = 0 THEN 'period missing'
  WHEN o_orderkey % 89 = 0 THEN 'value unreadable' WHEN o_orderkey % 83 = 0 THEN 'value missing' END AS reason FROM orders)"""


@query("src4_auto_series", f"""
WITH {_UNLIKE} SELECT CAST(date_trunc('month', d) AS VARCHAR)[1:10] AS month, 'consumption_kwh' AS metric, 'kwh' AS unit, 'orders' AS source, count(*) AS n, count(DISTINCT CAST(d AS DATE)) AS n_periods, CAST(sum(CAST(round(v * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS value FROM o WHERE reason IS NULL GROUP BY ALL
UNION ALL SELECT CAST(date_trunc('month', l_shipdate) AS VARCHAR)[1:10], 'load', NULL, 'lines', count(*), 1, CAST(sum(CAST(round(l_quantity * 100) AS BIGINT)) AS DOUBLE) / 100.0 FROM lineitem GROUP BY ALL""")
def src4_auto(t):
    series, _ = tables.auto_series(_unlike(t), {"orders": "kwh"})
    return series.groupBy(F.to_date(F.date_trunc("month", "period")).alias("month"), "metric", "unit", "source").agg(F.count("*").alias("n"), F.count_distinct("period").alias("n_periods"), money("value").alias("value"))


@query("src4_rejects", f"""
WITH {_UNLIKE} SELECT 'orders' AS source, reason, count(*) AS n, CASE reason WHEN 'period unreadable' THEN 'n/a' WHEN 'value unreadable' THEN 'broken' WHEN 'value missing' THEN '' END AS example FROM o WHERE reason IS NOT NULL GROUP BY reason
UNION ALL SELECT 'segments', 'no period column', count(*), NULL FROM customer HAVING count(*) > 0""")
def src4_rejects(t):
    return tables.auto_series(_unlike(t))[1]


@query("src5_period_columns", f"""
WITH s AS (SELECT count(*) AS n, count(*) FILTER (o_orderstatus <> '') AS ns FROM orders)
SELECT 'when_written' AS "column", n, n AS parsed, 1.0::DOUBLE AS rate, true AS chosen FROM s
UNION ALL SELECT 'o_orderstatus', n, 0, 0.0, false FROM s
UNION ALL SELECT 'o_orderpriority', n, 0, 0.0, false FROM s
UNION ALL SELECT 'price', n, (SELECT count(*) FROM orders WHERE regexp_full_match(CAST(CAST(round(o_totalprice) AS BIGINT) AS VARCHAR), '\\d{{4}}|\\d{{4}}(0[1-9]|1[0-2])')),
  {r("(SELECT count(*) FROM orders WHERE regexp_full_match(CAST(CAST(round(o_totalprice) AS BIGINT) AS VARCHAR), '[0-9][0-9][0-9][0-9]|[0-9][0-9][0-9][0-9](0[1-9]|1[0-2])')) * 1.0 / n")}, false FROM s""")
def src5(t):
    written = t.orders.select(F.col("o_orderstatus"), F.col("o_orderpriority"), F.round("o_totalprice").cast("long").alias("price"),
                              F.date_format("o_orderdate", "yyyy-MM-dd").alias("when_written"))
    return rounded(profile.period_columns(written))


@query("src6_value_columns", f"""
WITH long AS (
  SELECT 'quantity_kwh' AS "column", l_quantity AS v, 1.5 AS base FROM lineitem UNION ALL
  SELECT 'price_month_yuan', l_extendedprice, 7.5 FROM lineitem UNION ALL
  SELECT 'price_ytd_yuan', l_extendedprice * 2, -1.5 FROM lineitem UNION ALL
  SELECT 'load_tax', l_tax, 1.5 FROM lineitem),
s AS (SELECT "column", count(v) AS n_numeric, base + 0.2 * least(stddev_samp(v) / abs(avg(v)), 5.0) AS score FROM long GROUP BY "column", base)
SELECT "column", n_numeric, {r('score')} AS score, row_number() OVER (ORDER BY score DESC, "column") = 1 AS chosen FROM s""")
def src6(t):
    named = t.lineitem.select(
        F.col("l_shipdate").alias("day"), F.col("l_quantity").alias("quantity_kwh"), F.col("l_extendedprice").alias("price_month_yuan"),
        (F.col("l_extendedprice") * 2).alias("price_ytd_yuan"), F.col("l_discount").alias("discount_rate"), F.col("l_tax").alias("load_tax"),
        F.col("l_returnflag").alias("return_note"))
    return rounded(profile.value_columns(named, "day"))


@query("src7_frequency", f"""
WITH {MONTHLY}, {DAILY_TOTAL}, {QUARTERLY}, {HOURLY},
points AS (SELECT 'm:' || series_id AS series_id, CAST(period AS TIMESTAMP) AS p FROM monthly UNION ALL SELECT 'd:' || series_id, CAST(period AS TIMESTAMP) FROM daily_total
  UNION ALL SELECT 'q:' || series_id, CAST(period AS TIMESTAMP) FROM quarterly UNION ALL SELECT 'h:' || series_id, period FROM hourly
  UNION ALL SELECT 'one', max(CAST(period AS TIMESTAMP)) FROM monthly),
gaps AS (SELECT series_id, epoch(p - lag(p) OVER (PARTITION BY series_id ORDER BY p)) / 86400.0 AS g FROM points),
med AS (SELECT series_id, list_sort(list(g) FILTER (g > 0)) AS gs, count(*) AS n FROM gaps GROUP BY 1),
m AS (SELECT series_id, n, gs[CAST(floor(len(gs) / 2) AS INTEGER) + 1] AS gap_days FROM med)
SELECT series_id, n, {r('gap_days')} AS gap_days, CASE WHEN gap_days IS NULL THEN 'unknown' WHEN gap_days <= 3 THEN 'daily' WHEN gap_days <= 10 THEN 'weekly'
  WHEN gap_days <= 45 THEN 'monthly' WHEN gap_days <= 135 THEN 'quarterly' ELSE 'annual' END AS frequency FROM m""")
def src7(t):
    def tagged(df, tag):
        return df.select(F.concat(F.lit(tag), "series_id").alias("series_id"), F.col("period").cast("timestamp_ntz").alias("period"))

    one = monthly(t).agg(F.max("period").cast("timestamp_ntz").alias("period")).select(F.lit("one").alias("series_id"), "period")
    parts = [tagged(monthly(t), "m:"), tagged(daily_total(t), "d:"), tagged(quarterly(t), "q:"), tagged(hourly(t), "h:"), one]
    return rounded(profile.series_frequency(reduce(lambda a, b: a.unionByName(b), parts)))


_PROFILED = {"region": (None, None), "nation": (None, None), "customer": (None, "c_mktsegment"), "supplier": (None, None), "part": (None, "p_type"),
             "orders": ("o_orderdate", "o_orderstatus"), "lineitem": ("l_shipdate", "l_returnflag"), "events": ("ts", "event_type"), "documents": (None, "lang"),
             "embeddings": (None, None), "pages": (None, None), "benchmark": (None, None), "labels": (None, None), "conversations": (None, "role")}


def _profile_sql(name, period, flag):
    when = f"CAST({period} AS DATE)" if period else "CAST(NULL AS DATE)"
    flags = f"(SELECT string_agg({flag}, ',' ORDER BY {flag}) FROM (SELECT DISTINCT {flag} FROM {name} WHERE {flag} IS NOT NULL))" if flag else "''"
    cols = f"(SELECT string_agg(column_name, ',' ORDER BY column_name) FROM (DESCRIBE {name}))"
    n_cols = f"(SELECT CAST(count(*) AS INTEGER) FROM (DESCRIBE {name}))"
    return f"""SELECT '{name}' AS dataset, CASE WHEN count({when}) > 0 AND count({when}) >= greatest(3, count(*) * 0.7) THEN 'timeseries' ELSE 'table' END AS kind,
      count(*) AS n_rows, {n_cols} AS n_columns, {cols} AS columns, CAST(min({when}) AS VARCHAR) AS period_start, CAST(max({when}) AS VARCHAR) AS period_end, {flags} AS flags FROM {name}"""


@query("src8_dataset_inventory", " UNION ALL ".join(_profile_sql(n, p, f) for n, (p, f) in _PROFILED.items()))
def src8(t):
    rows = [profile.describe_dataset(getattr(t, n), n, p, f) for n, (p, f) in _PROFILED.items()]
    return reduce(lambda a, b: a.unionByName(b), rows)


@query("src8_regions", """
SELECT r_regionkey AS code, r_name AS name, CASE WHEN count(n_nationkey) > 0 THEN 'region' ELSE 'empty' END AS level, count(n_nationkey) AS n_members
FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL""")
def src8_regions(t):
    members = t.nation.groupBy(F.col("n_regionkey").alias("code")).agg(F.count("*").alias("n_members"))
    out = t.region.select(F.col("r_regionkey").alias("code"), F.col("r_name").alias("name")).join(members, "code", "left").fillna(0, ["n_members"])
    return out.select("code", "name", F.when(F.col("n_members") > 0, "region").otherwise("empty").alias("level"), "n_members")


@query("src9_date_spine", """
WITH span AS (SELECT o_orderstatus AS series_id, CAST(date_trunc('month', min(o_orderdate)) AS DATE) AS lo, CAST(date_trunc('month', max(o_orderdate)) AS DATE) AS hi FROM orders GROUP BY 1)
SELECT series_id, CAST(CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS VARCHAR) AS period, 'monthly' AS freq FROM span
UNION ALL SELECT series_id, CAST(CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS VARCHAR), 'daily' FROM span""")
def src9(t):
    months = t.orders.select(F.col("o_orderstatus").alias("series_id"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("period"))
    return jn.spine(months, "monthly").withColumn("freq", F.lit("monthly")).unionByName(jn.spine(months, "daily").withColumn("freq", F.lit("daily")))


_ENDS = r"^[\s\p{Z}\x0b\x1c-\x1f\x{85}]+|[\s\p{Z}\x0b\x1c-\x1f\x{85}]+$"


@query("src10_sliding_chunks", rf"""
WITH clean AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\n{{3,}}', chr(10) || chr(10), 'g'), '{_ENDS}', '', 'g') AS s FROM documents),
starts AS (SELECT doc_id, s, unnest(range(0, CASE WHEN length(s) <= 320 THEN 1 ELSE CAST(ceil((length(s) - 320) / 260.0) AS BIGINT) + 1 END)) AS i FROM clean WHERE length(s) > 0),
pieces AS (SELECT doc_id, CAST(i AS INTEGER) AS chunk_no, regexp_replace(substr(s, i * 260 + 1, 320), '{_ENDS}', '', 'g') AS c FROM starts)
SELECT doc_id || '#' || chunk_no AS chunk_id, doc_id, chunk_no, CAST(length(c) AS INTEGER) AS n_chars, md5(c) AS chunk FROM pieces WHERE length(c) > 0""")
def src10(t):
    chunks = documents.sliding_chunks(t.documents, "doc_id", "text")
    return chunks.select("chunk_id", "doc_id", "chunk_no", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk"))


@query("src10_text_files", rf"""
SELECT 'shared:d' || doc_id AS doc_id, 'd' || doc_id AS title, 'd' || doc_id || '.txt' AS source, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS text FROM documents WHERE text <> ''""")
def src10_files(t):
    # written as one file each, beside files of another kind, and found again by walking the folder
    base = shared_dir(t.spark)
    uri = base if ":" in base.split("/")[0] else f"file://{base}"
    for part, name in (("even", F.col("doc_id") % 2 == 0), ("odd/below", F.col("doc_id") % 2 == 1)):
        documents.write_documents(t.documents.filter(name).select(F.concat(F.lit("d"), "doc_id").alias("title"), "text"), f"{uri}/{part}", "title", "text").write.format("noop").mode("overwrite").save()
    t.benchmark.limit(1).write.json(f"{base}/other")
    found = documents.read_documents(t.spark, uri)
    return found.select("doc_id", "title", "source", F.length("text").alias("n_chars"), F.md5("text").alias("text"))


@query("src11_packed_chunks", rf"""
WITH paras AS (SELECT doc_id, list_filter(list_transform(str_split(text, chr(10)), lambda x: regexp_replace(x, '{_ENDS}', '', 'g')), lambda x: length(x) > 0) AS p FROM documents),
folded AS (SELECT doc_id, p, list_reduce(list_transform(p, lambda x: {{'used': length(x), 'chunk': 0, 'marks': [0]}}), lambda s, x: {{
    'used': CASE WHEN s.used + x.used > 220 THEN x.used ELSE s.used + 1 + x.used END,
    'chunk': s.chunk + CAST(s.used + x.used > 220 AS INTEGER), 'marks': list_append(s.marks, s.chunk + CAST(s.used + x.used > 220 AS INTEGER))}}).marks AS marks
  FROM paras WHERE len(p) > 0),
rows AS (SELECT doc_id, unnest(p) AS para, unnest(marks) AS chunk, generate_subscripts(p, 1) AS i FROM folded)
SELECT doc_id, CAST(chunk AS INTEGER) AS chunk_no, md5(string_agg(para, chr(10) ORDER BY i)) AS chunk, CAST(sum(length(para)) + count(*) - 1 AS BIGINT) AS n_chars
FROM rows GROUP BY doc_id, chunk""")
def src11(t):
    paragraphs = t.documents.select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    chunks = documents.packed_chunks(paragraphs, "doc_id", "text")
    return chunks.select("doc_id", "chunk_no", F.md5("chunk").alias("chunk"), F.length("chunk").cast("long").alias("n_chars"))


_STATE = "struct<coin:double,n_chars:int>"


@query("src12_nested_log", """
SELECT CAST(conv_id AS VARCHAR) AS episode, CAST(turn AS INTEGER) AS step, role AS agent, CAST(length(text) AS INTEGER) AS n_chars, conv_id / 10.0 AS coin,
  CASE WHEN turn % 4 = 3 THEN CAST(turn AS DOUBLE) END AS rate FROM conversations""")
def src12(t):
    # one JSON episode per turn position: the log keeps the nesting, a long conversation stays spread over rows
    state = F.to_json(F.struct((F.col("conv_id") / 10.0).alias("coin"), F.length("text").alias("n_chars")))
    rate = F.when(F.col("turn") % 4 == 3, F.concat(F.lit(', "rate": '), F.col("turn"))).otherwise("")
    text = F.concat(F.lit('{"episode": "'), F.col("conv_id"), F.lit('", "offset": '), F.col("turn"), F.lit(', "world": [{"price": 1'), rate, F.lit('}], "states": [{"'),
                    F.col("role"), F.lit('": '), state, F.lit("}]}"))
    schema = f"struct<episode:string,offset:int,world:array<struct<price:double,rate:double>>,states:array<map<string,{_STATE}>>>"
    log = t.conversations.select(F.from_json(text, schema).alias("j")).select("j.*").withColumn(
        "episode", F.struct("episode", "offset"))
    agents = logs.flatten_agents(log)
    world = logs.flatten_world(log)
    joined = agents.join(world.drop("price"), ["episode", "step"])
    return joined.select("episode.episode", (F.col("episode.offset") + F.col("step")).alias("step"), "agent", "n_chars", "coin", "rate")


@query("src13_trace_replay", """
SELECT conv_id, count(*) AS n_steps, count(*) FILTER (role = 'assistant') AS tool_call_count, arg_min(role, turn) AS first_phase, arg_max(role, turn) AS last_phase
FROM conversations GROUP BY 1""")
def src13(t):
    return logs.replay(t.conversations, "conv_id", "turn", "role", "assistant")[1]


@query("src13_trace_steps", """
SELECT conv_id, turn, role, CAST(sum(CAST(role = 'assistant' AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS tool_calls_so_far FROM conversations""")
def src13_steps(t):
    return logs.replay(t.conversations, "conv_id", "turn", "role", "assistant")[0].select("conv_id", "turn", "role", "tool_calls_so_far")


@query("snk1_table_sinks", f"""
WITH {MONTHLY} SELECT unnest(['csv', 'json', 'parquet']) AS fmt, series_id, CAST(period AS VARCHAR) AS period, value, n FROM monthly""")
def snk1(t):
    base = shared_dir(t.spark)
    series = monthly(t)
    back = []
    for fmt in ("csv", "json", "parquet"):
        csv.write_table(series, f"{base}/{fmt}", fmt, ["series_id"])
        reader = t.spark.read.schema("period date, value double, n long, series_id string")
        back.append((reader.option("header", True) if fmt == "csv" else reader).format(fmt).load(f"{base}/{fmt}").withColumn("fmt", F.lit(fmt)))
    return reduce(lambda a, b: a.unionByName(b), back)


@query("src12_actions_and_rewards", f"""
SELECT CAST(conv_id AS VARCHAR) AS episode, CAST(turn AS INTEGER) AS step, role AS agent, CAST(length(text) % 50 AS INTEGER) AS action, {r('length(text) / 100.0 - turn')} AS reward FROM conversations""")
def src12_lists(t):
    pair = lambda v: F.concat(F.lit('[{"'), F.col("role"), F.lit('": '), v.cast("string"), F.lit("}]"))
    text = F.concat(F.lit('{"episode": "'), F.col("conv_id"), F.lit('", "offset": '), F.col("turn"), F.lit(', "actions": '), pair(F.length("text") % 50), F.lit(', "rewards": '), pair(F.length("text") / 100.0 - F.col("turn")), F.lit("}"))
    log = t.conversations.select(F.from_json(text, "struct<episode:string,offset:int,actions:array<map<string,int>>,rewards:array<map<string,double>>>").alias("j")).select("j.*").withColumn("episode", F.struct("episode", "offset"))
    both = logs.flatten_values(log, "actions", "action").join(logs.flatten_values(log, "rewards", "reward"), ["episode", "step", "agent"])
    return rounded(both.select("episode.episode", (F.col("episode.offset") + F.col("step")).alias("step"), "agent", "action", "reward"))
