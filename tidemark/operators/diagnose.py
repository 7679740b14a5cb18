"""Candidate causes, exclusion-ordered explanations, divergence checks and verdicts, for all periods at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import as_percent, growth
from .joins import two_hops
from .series import along

# Knowledge seed as (head, relation, tail, type), in the order causes are offered.
SEED_TRIPLES = (
    ("制造业", "affects", "工业用电", "Sector-Load"),
    ("房地产", "affects", "建材冶金用电", "Sector-Load"),
    ("居民消费", "affects", "商业与居民用电", "Sector-Load"),
    ("出口", "affects", "外向型制造用电", "Sector-Load"),
    ("新能源发电", "affects", "净负荷波动", "Sector-Load"),
    ("高温天气", "indicates", "制冷负荷骤升", "Disturbance-Sig"),
    ("寒潮", "indicates", "采暖负荷骤升", "Disturbance-Sig"),
    ("春节假期", "indicates", "工业用电断崖式下降", "Disturbance-Sig"),
    ("国庆假期", "indicates", "用电小幅回落", "Disturbance-Sig"),
    ("电价调整", "indicates", "用电时段结构变化", "Disturbance-Sig"),
    ("限电限产政策", "indicates", "工业用电阶段性下降", "Disturbance-Sig"),
    ("持续负偏离_非节假日", "explained_by", "制造业订单下滑/需求走弱", "Sig-Cause"),
    ("持续负偏离_非节假日", "explained_by", "行业限产或环保督察", "Sig-Cause"),
    ("持续正偏离_非节假日", "explained_by", "重大项目投产/产能扩张", "Sig-Cause"),
    ("持续正偏离_非节假日", "explained_by", "促消费政策/经济回暖", "Sig-Cause"),
    ("春节后复工偏慢", "explained_by", "外需疲弱/企业信心不足", "Sig-Cause"),
    ("高频剧烈波动", "explained_by", "新能源大发或极端天气", "Sig-Cause"),
    ("制造业订单下滑/需求走弱", "corroborated_by", "PMI下行", "Cause-Indicator"),
    ("重大项目投产/产能扩张", "corroborated_by", "固定资产投资上升", "Cause-Indicator"),
    ("促消费政策/经济回暖", "corroborated_by", "社会消费品零售总额回升", "Cause-Indicator"),
    ("行业限产或环保督察", "corroborated_by", "行业开工率下降", "Cause-Indicator"),
)
# Cause names of anomaly records.
CAUSE_NAMES = {
    "calendar": "春节及调休", "weather": "气温与制冷负荷", "activity": "工业生产与行业结构",
    "shock": "新冠疫情冲击", "recovery": "低基数与复苏", "cycle": "产业景气与政策",
    "accounting": "年度核算与数据修订", "economy": "真实经济波动",
}
# Evidence asked for where confidence is unknown.
REQUIRED = {
    "weather": ("月均温", "高温日数", "制冷度日CDD"),
    "activity": ("规上工业增加值", "制造业分行业用电", "重点企业开工率"),
    "cycle": ("行业增加值", "投资", "出口", "政策事件"),
    "economy": ("季度核算说明", "行业月度数据", "政策与外部冲击"),
}
# What the verdict starts from and takes off, and its limits.
START, FLOOR, CEILING = 0.62, 0.15, 0.75
PENALTIES = {"no_series": 0.20, "endpoint": 0.08, "flag": 0.06, "risks": 0.10, "no_documents": 0.05, "no_explanation": 0.12, "no_economy": 0.06}
ABORTED, NEGLIGIBLE_BONUS, NEGLIGIBLE_CEILING = 0.30, 0.12, 0.80
NEGLIGIBLE = 0.05
CAUSAL_STATUSES = ("observed", "correlation", "candidate_cause", "data_quality_risk", "established")
WEATHER_MONTHS = (6, 7, 8, 12, 1, 2)
EXTREME_DEGREE_DAYS = 200.0


def _cause(kind: str, relation: str, confidence: Column | str) -> Column:
    level = F.lit(confidence) if isinstance(confidence, str) else confidence
    required = F.array(*[F.lit(x) for x in REQUIRED[kind]]) if kind in REQUIRED else F.array().cast("array<string>")
    return F.struct(F.lit(CAUSE_NAMES[kind]).alias("entity"), F.lit(relation).alias("relation"), level.alias("confidence"), required.alias("required_evidence"))


def record_causes(df: DataFrame, shocks: Sequence[str] = ("2020Q1",), recoveries: Sequence[str] = ("2021Q1", "2021Q2", "2021Q3")) -> DataFrame:
    """Adds ``causes`` by record type from record_type, time, month, festival_days, annual_reconciliation_risk."""
    load, grown, flow = (F.col("record_type") == k for k in ("load", "growth", "flow"))
    festival = F.when(F.coalesce("festival_days", F.lit(0)) > 0, "high").otherwise("medium")
    offers = [
        F.when(load & F.col("month").isin(1, 2), _cause("calendar", "calendar_effect", festival)),
        F.when(load & F.col("month").isin(7, 8, 9), _cause("weather", "weather_effect", "unknown")),
        F.when(load, _cause("activity", "economic_activity_effect", "unknown")),
        F.when(grown & F.col("time").isin(*shocks), _cause("shock", "external_shock", "high")),
        F.when(grown & F.col("time").isin(*recoveries), _cause("recovery", "base_effect_and_recovery", "high")),
        F.when(grown, _cause("cycle", "sector_cycle_or_policy", "unknown")),
        F.when(flow & (F.col("annual_reconciliation_risk") == 1), _cause("accounting", "statistical_reconciliation", "high")),
        F.when(flow, _cause("economy", "economic_activity_effect", "unknown")),
    ]
    return df.withColumn("causes", F.array_compact(F.array(*offers)))


def explain(points: DataFrame, calendar: DataFrame, weather: DataFrame, key: str = "series_id", order: str = "period") -> DataFrame:
    """Explanations in a fixed order of exclusion for every point of a scanned decomposition.

    ``points``: residual_pct, risks; ``calendar``: festival_days, holiday_break_days per
    period; ``weather``: hdd, cdd per period, absent where unknown. Both are calendar-sized.
    Adds ``causes`` (id, confidence, status) in order, ``rules`` and ``not_excluded``.
    """
    now = calendar.select(F.col("period").alias(order), F.col("festival_days").alias("festival_now"), "holiday_break_days")
    before = calendar.select(F.add_months("period", 12).alias(order), F.col("festival_days").alias("festival_before"))
    sky = weather.select(F.col("period").alias(order), "hdd", "cdd", F.lit(True).alias("weather_available"))
    df = points.join(now, order, "left").join(before, order, "left").join(sky, order, "left")
    df = df.fillna(0, ["festival_now", "festival_before", "holiday_break_days"]).withColumn("weather_available", F.coalesce("weather_available", F.lit(False)))

    def cause(name: str, confidence: Column | str, status: str = "candidate_cause") -> Column:
        level = F.lit(confidence) if isinstance(confidence, str) else confidence
        return F.struct(F.lit(name).alias("cause_id"), level.alias("confidence"), F.lit(status).alias("causal_status"))

    risky = F.size("risks") > 0
    festive = (F.col("festival_now") > 0) | (F.col("festival_before") > 0)
    shifted = F.col("festival_now") != F.col("festival_before")
    holiday = (F.col("holiday_break_days") > 0) & (F.col("festival_now") == 0)
    loaded = F.col("weather_available") & F.month(order).isin(*WEATHER_MONTHS)
    extreme = F.coalesce((F.col("hdd") > EXTREME_DEGREE_DAYS) | (F.col("cdd") > EXTREME_DEGREE_DAYS), F.lit(False))
    small = F.abs("residual_pct") < NEGLIGIBLE
    causes = F.array_compact(F.array(
        F.when(risky, cause("data_construction", "high", "data_quality_risk")),
        F.when(festive, cause("spring_festival_shift", F.when(shifted, "high").otherwise("medium"))),
        F.when(holiday, cause("holiday_effect", "medium")),
        F.when(loaded, cause("weather_load", F.when(extreme, "high").otherwise("medium"))),
        cause("economic_activity", "low"),
        cause("structural_change", "low")))
    rules = F.array_compact(F.array(
        F.when(risky, "data_construction_risk"), F.when(festive, "spring_festival_shift"), F.when(holiday, "holiday_effect"), F.when(loaded, "weather_load"),
        F.when(small, "residual_negligible"), F.lit("economic_activity_unverified")))
    open_points = F.array_compact(F.array(
        F.when(risky, "data_construction"), F.when(festive & shifted, "festival_moved"), F.when(F.col("weather_available"), "weather_is_proxy").otherwise("weather_unknown"),
        F.when(small, "nothing_to_explain")))
    return df.select(*points.columns, "festival_now", "festival_before", causes.alias("causes"), rules.alias("rules"), open_points.alias("exclusions"))


#: Entities of the seed graph that stand for a cause.
CAUSE_ENTITIES = {"spring_festival_shift": "春节假期", "holiday_effect": "国庆假期", "weather_load": "高温天气", "economic_activity": "制造业"}


def evidence(explained: DataFrame, graph: DataFrame, passages: DataFrame, key: str = "series_id", order: str = "period") -> DataFrame:
    """One row per piece of evidence for a cause of a point: (key, order, cause_id, kind, source, detail).

    ``explained`` is what :func:`explain` gives; triples of ``graph`` that touch the entity of a cause are of kind triple, with relation
    and other end; ``passages`` (cause_id, doc_id, rank) of kind passage, with the document and its rank.
    """
    named = explained.select(key, order, F.explode("causes.cause_id").alias("cause_id"))
    entity = F.create_map(*[F.lit(x) for pair in CAUSE_ENTITIES.items() for x in pair])[F.col("cause_id")]
    ends = graph.select(F.col("src").alias("_e"), "rel", F.col("dst").alias("other")).unionByName(graph.select(F.col("dst").alias("_e"), "rel", F.col("src").alias("other")))
    triples = named.withColumn("_e", entity).join(ends, "_e").select(key, order, "cause_id", F.lit("triple").alias("kind"), F.col("rel").alias("source"), F.col("other").alias("detail"))
    texts = named.join(passages, "cause_id").select(key, order, "cause_id", F.lit("passage").alias("kind"), F.col("doc_id").cast("string").alias("source"), F.col("rank").cast("string").alias("detail"))
    return triples.unionByName(texts)


def seed_graph(spark: SparkSession) -> DataFrame:
    rows = [(i, *t) for i, t in enumerate(SEED_TRIPLES)]
    return spark.createDataFrame(rows, "position int, src string, rel string, dst string, type string")


def match_signature(deviation: Column, near_festival: Column, restless: Column | None = None) -> Column:
    """Name of the pattern an event shows."""
    sign = F.when(deviation < 0, "持续负偏离_非节假日").otherwise("持续正偏离_非节假日")
    plain = sign if restless is None else F.when(restless, "高频剧烈波动").otherwise(sign)
    return F.when(near_festival & (deviation < 0), "春节后复工偏慢").otherwise(plain)


def diagnose_events(events: DataFrame, graph: DataFrame) -> DataFrame:
    """Adds signature, n_causes, top_cause, its indicator, macro note and confidence to events.

    Needs mean_deviation, magnitude_pct, near_festival, avg_pmi. The graph is a vocabulary
    of a few dozen rows.
    """
    named = events.withColumn("signature", match_signature(F.col("mean_deviation"), F.col("near_festival")))
    paths = two_hops(graph, "explained_by", "corroborated_by")
    places = graph.filter(F.col("rel") == "explained_by").select("src", F.col("dst").alias("mid"), "position")
    per_sign = paths.join(places, ["src", "mid"]).groupBy(F.col("src").alias("signature")).agg(
        F.count_distinct("mid").alias("n_causes"), F.min_by("mid", "position").alias("top_cause"), F.min_by("dst", "position").alias("indicator"))
    out = named.join(per_sign, "signature", "left")
    pmi, dev = F.col("avg_pmi"), F.col("mean_deviation")
    note = (F.when(pmi.isNull(), "no_macro_data").when((pmi < 50) & (dev < 0), "confirms_weak_demand").when((pmi >= 50) & (dev > 0), "confirms_expansion").otherwise("directions_differ"))
    confidence = F.when(F.col("near_festival"), "low").when(F.abs("magnitude_pct") > 8, "high").otherwise("medium")
    return out.withColumn("macro_note", note).withColumn("confidence", confidence)


def preferred_sector(economy: DataFrame, preferred: Column, order: str = "period") -> DataFrame:
    """One row per period: the preferred sector where present, else the first by name; partial aggregation."""
    rank = F.struct(F.when(preferred, 0).otherwise(1), "sector")
    return economy.groupBy(order).agg(F.min_by("sector", rank).alias("sector"), F.min_by("yoy", rank).alias("economy_yoy"))


def divergence(series: DataFrame, economy: DataFrame, lag: int = 12, limit: float = 10.0, key: str = "series_id", order: str = "period") -> DataFrame:
    """Load growth in percent against economy growth of the same quarter, their gap in points, and what is missing."""
    own = growth(F.col("value"), F.lag("value", lag).over(along(key, order)))
    left = series.select(key, order, own.alias("load_yoy"), F.to_date(F.date_trunc("quarter", order)).alias("_q"))
    out = left.join(economy.withColumnRenamed(order, "_q"), "_q", "left").withColumn("economy_yoy", as_percent(F.col("economy_yoy")))
    gap = F.col("load_yoy") - F.col("economy_yoy")
    absent = F.concat_ws(",", F.when(F.col("load_yoy").isNull(), "load_base"), F.when(F.col("economy_yoy").isNull(), "economy"))
    return out.select(key, order, "sector", "load_yoy", "economy_yoy", gap.alias("divergence"), F.coalesce(F.abs(gap) > limit, F.lit(False)).alias("significant"), absent.alias("missing"))


def verdict(df: DataFrame) -> DataFrame:
    """Confidence, causal status, and the counter-evidence and uncertainty codes behind them.

    Needs has_series, endpoint_warning, n_flags, has_risks, has_documents, has_explanation,
    has_economy, residual_pct, abort, checked_quality.
    """
    def off(cond: Column, name: str) -> Column:
        return F.when(cond, PENALTIES[name]).otherwise(0.0)

    explained = F.col("has_explanation")
    raw = (START - off(~F.col("has_series"), "no_series") - off(F.col("endpoint_warning"), "endpoint") - PENALTIES["flag"] * F.least(F.col("n_flags"), F.lit(2))
           - off(explained & F.col("has_risks"), "risks") - off(explained & ~F.col("has_documents"), "no_documents") - off(~explained, "no_explanation") - off(~F.col("has_economy"), "no_economy"))
    held = F.greatest(F.lit(FLOOR), F.least(F.lit(CEILING), raw))
    small = F.coalesce(explained & (F.abs("residual_pct") < NEGLIGIBLE), F.lit(False))
    confidence = (F.when(F.col("abort"), F.least(held, F.lit(ABORTED))).when(small, F.least(held + NEGLIGIBLE_BONUS, F.lit(NEGLIGIBLE_CEILING))).otherwise(held))
    status = (F.when(F.col("abort"), F.when(F.col("checked_quality"), "data_quality_risk").otherwise("observed")).when(small, "observed").when(explained, "candidate_cause").otherwise("observed"))
    counter = F.array_compact(F.array(
        F.when(explained, "no_direct_economic_indicator").otherwise("no_exclusion_run"), F.when(F.col("has_economy"), "units_not_aligned"), F.when(~F.col("abort") & small, "would_fall_with_repeated_deviation")))
    doubt = F.array_compact(F.array(
        F.when(~F.col("has_series"), "no_series"), F.when(F.col("endpoint_warning"), "short_sample"), F.when(F.col("n_flags") > 0, "quality_flags"), F.when(explained & F.col("has_risks"), "construction_risk"),
        F.when(explained & ~F.col("has_documents"), "no_documents"), F.when(~explained, "not_explained"), F.when(~F.col("has_economy"), "no_economy_check"), F.when(~F.col("abort") & small, "single_reading")))
    return df.withColumn("confidence", F.round(confidence, 2)).withColumn("causal_status", status).withColumn("counter_evidence", counter).withColumn("uncertainty", doubt)


def validate(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with reasons): both lists must hold something, confidence lies in [0, 1], the status is a known one."""
    reasons = F.array_compact(F.array(
        F.when(F.coalesce(F.size("counter_evidence"), F.lit(0)) <= 0, "counter_evidence empty"), F.when(F.coalesce(F.size("uncertainty"), F.lit(0)) <= 0, "uncertainty empty"),
        F.when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence outside 0..1"),
        F.when(~F.coalesce(F.col("causal_status").isin(*CAUSAL_STATUSES), F.lit(False)), "unknown causal status")))
    checked = df.withColumn("reasons", reasons)
    return checked.filter(F.size("reasons") == 0).drop("reasons"), checked.filter(F.size("reasons") > 0)
