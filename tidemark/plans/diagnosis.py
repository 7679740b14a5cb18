"""DGN: causes, explanations, divergence and verdicts."""

from pyspark.sql import functions as F

from ..operators import aggregates as ag
from ..operators import calendar as cal
from ..operators import decompose as dc
from ..operators import diagnose as dg
from ..operators import joins as jn
from ..operators import windows as wn
from ..session import stage
from .aggregates import EVENTS, _DAYS, _WEATHER, calendar_table, event_spans, monthly_weather, scored_days
from .calendars import FESTIVAL_SQL, festival_ranges
from .decomposition import SCAN
from .rankings import _DEVIATION, _records
from .registry import query, rounded
from .retrieval import BM25, hits
from .standins import MONTHLY, QUARTERLY, W, monthly, quarterly, r, revenue

_P = "CAST(period AS VARCHAR) AS period"
_CAL = f"{_DAYS}, cal AS (SELECT CAST(date_trunc('month', day) AS DATE) AS period, count(*) FILTER (name = '春节') AS festival_days, sum(is_holiday) AS holiday_break_days FROM days GROUP BY 1)"
_C = dg.CAUSE_NAMES


@query("dgn1_record_causes", f"""
WITH {_DEVIATION}, {QUARTERLY}, {_CAL}, q AS (SELECT *, 100 * (value / avg(value) OVER (PARTITION BY series_id) - 1) AS x, value / nullif(lag(value, 4) {W}, 0) * 100 - 100 AS g, year(period) || 'Q' || quarter(period) AS label FROM quarterly),
u AS (SELECT 'load' AS record_type, CAST(period AS VARCHAR) AS time, NULL AS sector, series_id, month(period) AS m, 0 AS risk FROM dev WHERE abs(x * 100) >= 6
  UNION ALL SELECT 'growth', label, series_id, NULL, NULL, 0 FROM q WHERE abs(g) >= 3 UNION ALL SELECT 'flow', label, series_id, NULL, NULL, CAST(quarter(period) = 4 AS INTEGER) FROM q WHERE abs(x) >= 5),
j AS (SELECT u.*, coalesce(festival_days, 0) AS fd FROM u LEFT JOIN cal ON record_type = 'load' AND CAST(cal.period AS VARCHAR) = time)
SELECT record_type, time, sector, series_id, array_to_string(list_filter([
  CASE WHEN record_type = 'load' AND m IN (1, 2) THEN '{_C['calendar']}[' || CASE WHEN fd > 0 THEN 'high' ELSE 'medium' END || ']' END,
  CASE WHEN record_type = 'load' AND m IN (7, 8, 9) THEN '{_C['weather']}[unknown]' END, CASE WHEN record_type = 'load' THEN '{_C['activity']}[unknown]' END,
  CASE WHEN record_type = 'growth' AND time = '1998Q1' THEN '{_C['shock']}[high]' END, CASE WHEN record_type = 'growth' AND time IN ('1999Q1', '1999Q2', '1999Q3') THEN '{_C['recovery']}[high]' END,
  CASE WHEN record_type = 'growth' THEN '{_C['cycle']}[unknown]' END, CASE WHEN record_type = 'flow' AND risk = 1 THEN '{_C['accounting']}[high]' END, CASE WHEN record_type = 'flow' THEN '{_C['economy']}[unknown]' END], lambda x: x IS NOT NULL), '; ') AS causes FROM j""")
def dgn1(t):
    context = cal.calendar_context(calendar_table(t)).select(F.date_format("period", "yyyy-MM-dd").alias("time"), "festival_days", F.lit("load").alias("record_type"))
    records = _records(t).join(context, ["record_type", "time"], "left").withColumn("month", F.when(F.col("record_type") == "load", F.substring("time", 6, 2).cast("int")))
    caused = dg.record_causes(records, shocks=("1998Q1",), recoveries=("1999Q1", "1999Q2", "1999Q3"))
    shown = F.array_join(F.transform("causes", lambda c: F.concat(c["entity"], F.lit("["), c["confidence"], F.lit("]"))), "; ")
    return caused.select("record_type", "time", "sector", "series_id", shown.alias("causes"))


def explanations(t, m=None):
    points = dc.scan(dc.classical(monthly(t) if m is None else m), medium=0.0)
    return dg.explain(points, cal.calendar_context(calendar_table(t)), monthly_weather(t))


_EXPLAIN = SCAN + f""", {_WEATHER}, cal AS (SELECT CAST(date_trunc('month', day) AS DATE) AS period, count(*) FILTER (name = '春节') AS festival_days, sum(is_holiday) AS holiday_break_days FROM days GROUP BY 1),
ex AS (SELECT s.*, coalesce(c.festival_days, 0) AS f0, coalesce(b.festival_days, 0) AS f1, coalesce(c.holiday_break_days, 0) AS hb, w.hdd, w.cdd, w.period IS NOT NULL AS wa
  FROM scan_tag s LEFT JOIN cal c ON c.period = s.period LEFT JOIN cal b ON b.period + INTERVAL 12 MONTH = s.period LEFT JOIN weather w ON w.period = s.period)"""


@query("dgn2_exclusion_explanation", f"""
WITH {_EXPLAIN}
SELECT series_id, {_P}, {r('residual_pct')} AS residual_pct, {r('yoy')} AS yoy, CASE WHEN abs(residual_pct) >= 0.08 THEN 'high' ELSE 'medium' END AS level, CASE WHEN residual_pct > 0 THEN 'above_expected' ELSE 'below_expected' END AS direction,
  f0 AS festival_now, f1 AS festival_before, array_to_string(list_filter([CASE WHEN risks <> '' THEN 'data_construction:high' END,
    CASE WHEN f0 > 0 OR f1 > 0 THEN 'spring_festival_shift:' || CASE WHEN f0 <> f1 THEN 'high' ELSE 'medium' END END, CASE WHEN hb > 0 AND f0 = 0 THEN 'holiday_effect:medium' END,
    CASE WHEN wa AND month(period) IN (6, 7, 8, 12, 1, 2) THEN 'weather_load:' || CASE WHEN hdd > 200 OR cdd > 200 THEN 'high' ELSE 'medium' END END, 'economic_activity:low', 'structural_change:low'], lambda x: x IS NOT NULL), ' > ') AS causes,
  array_to_string(list_filter([CASE WHEN risks <> '' THEN 'data_construction_risk' END, CASE WHEN f0 > 0 OR f1 > 0 THEN 'spring_festival_shift' END, CASE WHEN hb > 0 AND f0 = 0 THEN 'holiday_effect' END,
    CASE WHEN wa AND month(period) IN (6, 7, 8, 12, 1, 2) THEN 'weather_load' END, CASE WHEN abs(residual_pct) < 0.05 THEN 'residual_negligible' END, 'economic_activity_unverified'], lambda x: x IS NOT NULL), ',') AS rules,
  array_to_string(list_filter([CASE WHEN risks <> '' THEN 'data_construction' END, CASE WHEN (f0 > 0 OR f1 > 0) AND f0 <> f1 THEN 'festival_moved' END, CASE WHEN wa THEN 'weather_is_proxy' ELSE 'weather_unknown' END,
    CASE WHEN abs(residual_pct) < 0.05 THEN 'nothing_to_explain' END], lambda x: x IS NOT NULL), ',') AS exclusions FROM ex""")
def dgn2(t):
    causes = F.array_join(F.transform("causes", lambda c: F.concat_ws(":", c["cause_id"], c["confidence"])), " > ")
    return rounded(explanations(t).select(
        "series_id", "period", "residual_pct", "yoy", "level", "direction", "festival_now", "festival_before", causes.alias("causes"),
        F.array_join("rules", ",").alias("rules"), F.array_join("exclusions", ",").alias("exclusions")))


_PMI = """pm AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, CAST(sum(CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT)) AS DOUBLE) AS v FROM lineitem GROUP BY 1),
pmi AS (SELECT month, 50 * v / avg(v) OVER () AS pmi FROM pm)"""


def diagnosed_events(t):
    days = scored_days(t).select("series_id", "period", "deviation")
    facts = jn.nearest_start(days.select("period").distinct(), "period", festival_ranges(t.spark), "first_day")
    by_month = t.lineitem.groupBy(F.to_date(F.date_trunc("month", "l_shipdate")).alias("month")).agg(F.sum(revenue()).cast("double").alias("v"))
    pmi = by_month.select("month", (50 * F.col("v") / by_month.agg(F.avg("v")).scalar()).alias("pmi"))
    rows = days.join(facts, "period").withColumn("month", F.to_date(F.date_trunc("month", "period"))).join(pmi, "month", "left")
    inside = jn.interval_join(rows, event_spans(t), ["series_id"], "period", "start", "end")
    events = inside.groupBy("series_id", "start", "end", "n", "peak_score").agg(
        F.avg("deviation").alias("mean_deviation"), (F.avg(F.abs("days_to_start")) < 20).alias("near_festival"), F.round(F.avg("pmi"), 1).alias("avg_pmi"))
    return dg.diagnose_events(events.withColumn("magnitude_pct", F.round(F.col("mean_deviation") * 100, 2)), dg.seed_graph(t.spark))


@query("dgn3_event_diagnosis", f"""
WITH {EVENTS}, {FESTIVAL_SQL}, {_PMI}, dd AS (SELECT DISTINCT period FROM scored), nr AS (SELECT period, arg_min(datediff('day', first_day, period), (abs(datediff('day', first_day, period)), first_day)) AS gap FROM dd, festivals GROUP BY 1),
x AS (SELECT ev.series_id, ev.s, ev.e, ev.n, ev.peak, avg(sc.deviation) AS dev, avg(abs(nr.gap)) < 20 AS near, round(avg(pmi), 1) AS avg_pmi FROM ev JOIN scored sc ON sc.series_id = ev.series_id AND sc.period BETWEEN ev.s AND ev.e
  JOIN nr ON nr.period = sc.period LEFT JOIN pmi ON pmi.month = CAST(date_trunc('month', sc.period) AS DATE) GROUP BY 1, 2, 3, 4, 5),
g AS (SELECT *, CASE WHEN near AND dev < 0 THEN '春节后复工偏慢' WHEN dev < 0 THEN '持续负偏离_非节假日' ELSE '持续正偏离_非节假日' END AS signature FROM x)
SELECT series_id, CAST(s AS VARCHAR) AS start, CAST(e AS VARCHAR) AS "end", signature, CASE signature WHEN '春节后复工偏慢' THEN 1 ELSE 2 END AS n_causes,
  CASE signature WHEN '春节后复工偏慢' THEN '外需疲弱/企业信心不足' WHEN '持续负偏离_非节假日' THEN '制造业订单下滑/需求走弱' ELSE '重大项目投产/产能扩张' END AS top_cause,
  CASE signature WHEN '持续负偏离_非节假日' THEN 'PMI下行' WHEN '持续正偏离_非节假日' THEN '固定资产投资上升' END AS indicator, avg_pmi,
  CASE WHEN avg_pmi IS NULL THEN 'no_macro_data' WHEN avg_pmi < 50 AND dev < 0 THEN 'confirms_weak_demand' WHEN avg_pmi >= 50 AND dev > 0 THEN 'confirms_expansion' ELSE 'directions_differ' END AS macro_note,
  CASE WHEN near THEN 'low' WHEN abs(round(dev * 100, 2)) > 8 THEN 'high' ELSE 'medium' END AS confidence FROM g""")
def dgn3(t):
    return diagnosed_events(t).select("series_id", "start", "end", "signature", F.col("n_causes").cast("int").alias("n_causes"), "top_cause", "indicator", "avg_pmi", "macro_note", "confidence")


_BM25 = BM25.replace("d AS (", "docs AS (", 1).replace("FROM d)", "FROM docs)").replace("s AS (SELECT item_id", "sco AS (SELECT item_id").replace("FROM s WHERE", "FROM sco WHERE").replace("FROM d,", "FROM docs,")
# the question asked about each cause: stand-ins are the first benchmark items
ASKED = ("data_construction", "spring_festival_shift", "holiday_effect", "weather_load", "economic_activity", "structural_change")
_ASKED_SQL = "asked(cause_id, item_id) AS (VALUES " + ", ".join(f"('{c}', {i})" for i, c in enumerate(ASKED)) + ")"
_GRAPH_SQL = "graph(src, rel, dst) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c, _ in dg.SEED_TRIPLES) + "), entities(cause_id, e) AS (VALUES " + ", ".join(f"('{c}', '{e}')" for c, e in dg.CAUSE_ENTITIES.items()) + ")"


def passages(t):
    """(cause_id, doc_id, score, rank): documents found for the question about each cause."""
    number = F.create_map(*[F.lit(x) for i, c in enumerate(ASKED) for x in (i, c)])[F.col("item_id").cast("int")]
    # only the questions that are asked are ranked
    return hits(t, t.benchmark.filter(F.col("item_id").isin(*range(len(ASKED))))).withColumn("cause_id", number).select("cause_id", "doc_id", "score", "rank")


@query("dgn2_evidence", f"""
WITH {_EXPLAIN}, {_BM25}, {_ASKED_SQL}, {_GRAPH_SQL},
c AS (SELECT series_id, period, unnest(list_filter([CASE WHEN risks <> '' THEN 'data_construction' END, CASE WHEN f0 > 0 OR f1 > 0 THEN 'spring_festival_shift' END, CASE WHEN hb > 0 AND f0 = 0 THEN 'holiday_effect' END,
  CASE WHEN wa AND month(period) IN (6, 7, 8, 12, 1, 2) THEN 'weather_load' END, 'economic_activity', 'structural_change'], lambda x: x IS NOT NULL)) AS cause_id FROM ex)
SELECT series_id, {_P}, cause_id, 'triple' AS kind, rel AS source, other AS detail FROM c JOIN entities USING (cause_id) JOIN (SELECT src AS e, rel, dst AS other FROM graph UNION ALL SELECT dst, rel, src FROM graph) g USING (e)
UNION ALL SELECT series_id, {_P}, cause_id, 'passage', CAST(doc_id AS VARCHAR), CAST(rank AS VARCHAR) FROM c JOIN asked USING (cause_id) JOIN k USING (item_id) WHERE rank <= 4""")
def dgn2_evidence(t):
    return dg.evidence(explanations(t), dg.seed_graph(t.spark), passages(t))


def economy(t):
    """Sector growth per quarter as a fraction. P, a copy of A that does not report second quarters, is preferred; the next sector steps in there."""
    q = quarterly(t).withColumn("yoy", wn.lag_growth("value", 4) / 100).filter(F.col("yoy").isNotNull()).select("period", F.col("series_id").alias("sector"), "yoy")
    partly = q.filter((F.col("sector") == "A") & (F.quarter("period") != 2)).withColumn("sector", F.lit("P"))
    return dg.preferred_sector(q.unionByName(partly), F.col("sector") == "P")


_ECON = f"""eq AS (SELECT series_id AS sector, period, (value - lag(value, 4) {W}) / nullif(abs(lag(value, 4) {W}), 0) AS yoy FROM quarterly),
eb AS (SELECT * FROM eq UNION ALL SELECT 'P', period, yoy FROM eq WHERE sector = 'A' AND quarter(period) <> 2),
ep AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY CASE WHEN sector = 'P' THEN 0 ELSE 1 END, sector) AS i FROM eb WHERE yoy IS NOT NULL),
nc AS (SELECT m.series_id, m.period, e.sector, (value - lag(value, 12) OVER w) / nullif(abs(lag(value, 12) OVER w), 0) * 100 AS load_yoy, CASE WHEN abs(e.yoy) > 1.5 THEN e.yoy ELSE e.yoy * 100 END AS economy_yoy
  FROM monthly m LEFT JOIN ep e ON e.i = 1 AND e.period = CAST(date_trunc('quarter', m.period) AS DATE) WINDOW w AS (PARTITION BY m.series_id ORDER BY m.period))"""


@query("dgn4_divergence", f"""
WITH {MONTHLY}, {QUARTERLY}, {_ECON} SELECT series_id, {_P}, sector, {r('load_yoy', 5)} AS load_yoy, {r('economy_yoy', 5)} AS economy_yoy, {r('load_yoy - economy_yoy', 5)} AS divergence, coalesce(abs(load_yoy - economy_yoy) > 10, false) AS significant,
  concat_ws(',', CASE WHEN load_yoy IS NULL THEN 'load_base' END, CASE WHEN economy_yoy IS NULL THEN 'economy' END) AS missing FROM nc""")
def dgn4(t):
    return rounded(dg.divergence(monthly(t), economy(t)), 5)


#: A passage of at least this score speaks to a cause.
LEAST_SCORE = 40.0


def asked_periods(t):
    """(series_id, period): each series' months and the half year after its last one."""
    span = monthly(t).groupBy("series_id").agg(F.min("period").alias("lo"), F.max("period").alias("last"))
    return span.select("series_id", "last", F.explode(F.sequence("lo", F.add_months("last", 6), F.expr("interval 1 month"))).alias("period"))


def judged(t):
    m = stage(monthly(t))
    explained = stage(explanations(t, m))
    ex = explained.select("series_id", "period", "residual_pct", (F.size("risks") > 0).alias("has_risks"), F.lit(True).alias("has_explanation"))
    raw = t.orders.select(F.col("o_orderpriority").alias("series_id"), F.col("o_orderkey"), F.to_date("o_orderdate").alias("day"))
    # a repeat is the same order twice, which the order table has none of
    flags = ag.quality_flags(m, raw.withColumnRenamed("o_orderkey", "key_day"), "key_day").select("series_id", F.size("flags").alias("n_flags"))
    short = dc.summary(dc.classical(m)).select("series_id", "endpoint_warning")
    econ = dg.divergence(m, economy(t)).select("series_id", "period", (F.col("missing") == "").alias("has_economy"))
    # the last two causes are left when nothing else is found, so only documents on the others count
    found = passages(t).filter((F.col("score") >= LEAST_SCORE) & ~F.col("cause_id").isin(*ASKED[-2:])).select("cause_id").distinct()
    backed = explained.select("series_id", "period", F.explode("causes.cause_id").alias("cause_id")).join(found, "cause_id").select("series_id", "period", F.lit(True).alias("has_documents")).distinct()
    out = asked_periods(t).join(ex, ["series_id", "period"], "left").join(econ, ["series_id", "period"], "left").join(backed, ["series_id", "period"], "left").join(flags, "series_id", "left").join(short, "series_id", "left")
    out = out.withColumn("has_series", F.col("n_flags").isNotNull()).withColumn("checked_quality", F.col("n_flags").isNotNull())
    out = out.fillna(False, ["has_risks", "has_explanation", "has_documents", "has_economy", "endpoint_warning"]).fillna(0, ["n_flags"])
    return dg.verdict(out.withColumn("abort", F.col("period") > F.col("last")))


@query("dgn5_verdict", f"""
WITH {_EXPLAIN}, {QUARTERLY}, {_ECON}, {_BM25}, {_ASKED_SQL}, spans AS (SELECT series_id, min(period) AS lo, max(period) AS hi, count(*) AS n, datediff('month', min(period), max(period)) + 1 AS expected FROM monthly GROUP BY 1),
st AS (SELECT series_id, lag(value) {W} AS a, value AS b FROM monthly), sd AS (SELECT series_id, b - a AS d FROM st WHERE a IS NOT NULL), jm AS (SELECT series_id, median(d) AS m FROM sd GROUP BY 1), ja AS (SELECT series_id, median(abs(d - m)) AS mad FROM sd JOIN jm USING (series_id) GROUP BY 1),
jump AS (SELECT DISTINCT series_id FROM sd JOIN ja USING (series_id) WHERE mad > 1e-12 AND abs(d) > 8 * 1.4826 * mad),
fl AS (SELECT series_id, CAST(n < 24 AS INTEGER) + CAST(n < expected AS INTEGER) + CAST(series_id IN (SELECT series_id FROM jump) AS INTEGER) AS n_flags, n >= 24 AND n < 36 AS short FROM spans),
ask AS (SELECT series_id, hi, CAST(unnest(generate_series(lo, hi + INTERVAL 6 MONTH, INTERVAL 1 MONTH)) AS DATE) AS period FROM spans),
found AS (SELECT cause_id FROM asked JOIN k USING (item_id) WHERE rank <= 4 AND score >= {LEAST_SCORE}), backed AS (SELECT series_id, period FROM ex WHERE (risks <> '' AND 'data_construction' IN (FROM found)) OR ((f0 > 0 OR f1 > 0) AND 'spring_festival_shift' IN (FROM found)) OR (hb > 0 AND f0 = 0 AND 'holiday_effect' IN (FROM found))
  OR (wa AND month(period) IN (6, 7, 8, 12, 1, 2) AND 'weather_load' IN (FROM found))),
j AS (SELECT a.series_id, a.period, a.period > a.hi AS abort, d.residual_pct, d.series_id IS NOT NULL AS ok, coalesce(d.risks <> '', false) AS risky, n_flags, short, coalesce(nc.load_yoy IS NOT NULL AND nc.economy_yoy IS NOT NULL, false) AS eco,
  (a.series_id, a.period) IN (SELECT (series_id, period) FROM backed) AS docs FROM ask a JOIN fl USING (series_id) LEFT JOIN scan_tag d ON d.series_id = a.series_id AND d.period = a.period LEFT JOIN nc ON nc.series_id = a.series_id AND nc.period = a.period),
kk AS (SELECT *, greatest(0.15, least(0.75, 0.62 - CASE WHEN short THEN 0.08 ELSE 0 END - 0.06 * least(n_flags, 2) - CASE WHEN ok AND risky THEN 0.10 ELSE 0 END - CASE WHEN ok AND NOT docs THEN 0.05 ELSE 0 END - CASE WHEN NOT ok THEN 0.12 ELSE 0 END - CASE WHEN NOT eco THEN 0.06 ELSE 0 END)) AS held,
  coalesce(ok AND abs(residual_pct) < 0.05, false) AS small FROM j)
SELECT series_id, {_P}, round(CAST(CASE WHEN abort THEN least(held, 0.30) WHEN small THEN least(held + 0.12, 0.8) ELSE held END AS DOUBLE), 2) AS confidence, CASE WHEN abort THEN 'data_quality_risk' WHEN small THEN 'observed' WHEN ok THEN 'candidate_cause' ELSE 'observed' END AS causal_status,
  array_to_string(list_filter([CASE WHEN ok THEN 'no_direct_economic_indicator' ELSE 'no_exclusion_run' END, CASE WHEN eco THEN 'units_not_aligned' END, CASE WHEN NOT abort AND small THEN 'would_fall_with_repeated_deviation' END], lambda x: x IS NOT NULL), ',') AS counter_evidence,
  array_to_string(list_filter([CASE WHEN short THEN 'short_sample' END, CASE WHEN n_flags > 0 THEN 'quality_flags' END, CASE WHEN ok AND risky THEN 'construction_risk' END, CASE WHEN ok AND NOT docs THEN 'no_documents' END, CASE WHEN NOT ok THEN 'not_explained' END,
    CASE WHEN NOT eco THEN 'no_economy_check' END, CASE WHEN NOT abort AND small THEN 'single_reading' END], lambda x: x IS NOT NULL), ',') AS uncertainty FROM kk""")
def dgn5(t):
    return judged(t).select("series_id", "period", "confidence", "causal_status", F.array_join("counter_evidence", ",").alias("counter_evidence"), F.array_join("uncertainty", ",").alias("uncertainty"))


@query("dgn6_validation", """
WITH c AS (SELECT conv_id, turn, length(text) / 1500.0 AS confidence, CASE role WHEN 'user' THEN 'observed' WHEN 'assistant' THEN 'candidate_cause' ELSE 'proven' END AS status, contains(text, ',') AS counter, contains(text, 'th') AS doubt FROM conversations)
SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN NOT counter THEN 'counter_evidence empty' END, CASE WHEN NOT doubt THEN 'uncertainty empty' END, CASE WHEN confidence > 1 THEN 'confidence outside 0..1' END, CASE WHEN status = 'proven' THEN 'unknown causal status' END], lambda x: x IS NOT NULL), ',') AS reasons FROM c""")
def dgn6(t):
    held = F.col("text")
    records = t.conversations.select(
        "conv_id", "turn", (F.length(held) / 1500.0).alias("confidence"), F.when(F.col("role") == "user", "observed").when(F.col("role") == "assistant", "candidate_cause").otherwise("proven").alias("causal_status"),
        F.when(held.contains(","), F.array(F.lit("clause"))).otherwise(F.array().cast("array<string>")).alias("counter_evidence"),
        F.when(held.contains("th"), F.array(F.lit("word"))).otherwise(F.array().cast("array<string>")).alias("uncertainty"))
    valid, rejected = dg.validate(records)
    return valid.select("conv_id", "turn", F.lit("").alias("reasons")).unionByName(rejected.select("conv_id", "turn", F.array_join("reasons", ",").alias("reasons")))
