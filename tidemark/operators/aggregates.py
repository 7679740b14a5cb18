"""Reports over series, events, detectors, answers and traces."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numbers import growth
from ..session import stage
from .joins import missing_periods
from .ordered import quantiles, quantiles_of_counts, running, value_counts
from .rankings import last_points
from .series import along

# Relation names that state a mechanism.
MECHANISMS = ("AFFECTS", "MAY_AFFECT", "CANDIDATE_CAUSE", "DISTURBS", "PROXIES_FOR", "DERIVES_FEATURE", "INFLUENCES", "DRIVES")


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n, mean, std, min, q25, q50, q75, max, missing_rate) with exact quartiles of whole columns."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "column", "value")
    stats = long.groupBy("column").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
        (F.count_if(F.col("value").isNull()) * 100.0 / F.count("*")).alias("missing_rate"))
    quarts = quantiles(long, ["column"], "value", [0.25, 0.5, 0.75], ["q25", "q50", "q75"]).drop("n")
    return stats.join(quarts, "column", "left")


def distribution(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, population std, MAD, p05 and p95 per group, exact on groups of any size."""
    tails = quantiles(df, keys, value, [0.05, 0.5, 0.95], ["p05", "_med", "p95"]).drop("n")
    stats = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    # every value meets its group's median once; the right side has one row per group and part, so neither the join nor what counts after it holds a group in one task
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    medians = tails.select(*keys, "_med", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"))
    dealt = value_counts(df, keys, value).withColumn("_part", F.pmod(F.hash(value), F.lit(parts)))
    off = dealt.join(medians, [*keys, "_part"]).groupBy(*keys, F.abs(F.col(value) - F.col("_med")).alias("_off")).agg(F.sum("c").alias("c"))
    # read three times: counted, cut into ranges, and summed
    mad = quantiles_of_counts(stage(off), keys, "_off", [0.5], ["mad"]).drop("n")
    return stats.join(tails.drop("_med"), keys).join(mad, keys)


def yearly_totals(df: DataFrame, value: str = "value", key: str = "series_id", order: str = "period", full: int = 12) -> DataFrame:
    return df.groupBy(key, F.year(order).alias("year")).agg(F.sum(value).alias("total"), F.count(value).alias("n")).withColumn("complete", F.col("n") == full)


def series_summary(df: DataFrame, tail: int = 13, key: str = "series_id", order: str = "period", value: str = "value") -> DataFrame:
    """Latest point, change on the one before, mean, population std, size, and the last ``tail`` points."""
    step = growth(F.col(value), F.lag(value).over(along(key, order)), percent=False)
    held = df.select(key, order, value, step.alias("_mom"))
    stats = held.groupBy(key).agg(
        F.count("*").alias("n_points"), F.min(order).alias("period_start"), F.max(order).alias("latest_period"), F.max_by(value, order).alias("latest_value"),
        F.max_by("_mom", order).alias("mom"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    # at most ``tail`` points per series are gathered
    points = last_points(df.select(key, order, value), tail, key, order).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("points"))
    return stats.join(points, key)


def duplicate_periods(raw: DataFrame, key: str, order: str) -> DataFrame:
    return raw.groupBy(key, order).agg(F.count("*").alias("n")).filter("n > 1")


def irregular_gaps(points: DataFrame, key: str = "series_id", order: str = "period", wide: float = 2.5, narrow: float = 0.4, least: int = 3) -> DataFrame:
    """Steps far from the series' median step; ``points`` has one row per (key, period)."""
    steps = points.select(key, F.lag(order).over(along(key, order)).alias("after"), F.col(order).alias("before"))
    steps = steps.filter(F.col("after").isNotNull()).withColumn("gap_days", F.datediff("before", "after"))
    usual = steps.groupBy(key).agg(F.percentile("gap_days", 0.5).alias("typical"), F.count("*").alias("_n")).filter((F.col("_n") >= least - 1) & (F.col("typical") > 0))
    odd = (F.col("gap_days") > F.col("typical") * wide) | (F.col("gap_days") < F.col("typical") * narrow)
    return steps.join(usual.drop("_n"), key).filter(odd)


def abrupt_jumps(df: DataFrame, times: float = 8.0, least: int = 5, key: str = "series_id", order: str = "period", value: str = "value") -> DataFrame:
    """Steps larger than ``times`` robust deviations of all steps of the series."""
    steps = df.select(key, order, F.lag(value).over(along(key, order)).alias("from"), F.col(value).alias("to")).filter(F.col("from").isNotNull())
    steps = steps.withColumn("_d", F.col("to") - F.col("from"))
    med = steps.groupBy(key).agg(F.percentile("_d", 0.5).alias("_m"), F.count("*").alias("_n")).filter(F.col("_n") >= least - 1)
    mad = steps.join(med, key).groupBy(key).agg(F.percentile(F.abs(F.col("_d") - F.col("_m")), 0.5).alias("_mad")).filter(F.col("_mad") > 1e-12)
    large = steps.join(mad, key).filter(F.abs("_d") > times * 1.4826 * F.col("_mad"))
    return large.select(key, order, "from", "to", growth(F.col("to"), F.col("from"), percent=False).alias("change"))


def quality_flags(df: DataFrame, raw: DataFrame, raw_order: str, freq: str = "monthly", cycle: int = 12, key: str = "series_id", order: str = "period") -> DataFrame:
    """(key, flags): sorted set of short-series, missing-periods, duplicate-periods and abrupt-jumps; every series has a row."""
    def flagged(part: DataFrame, name: str) -> DataFrame:
        return part.select(key).distinct().withColumn("flag", F.lit(name))

    sizes = df.groupBy(key).agg(F.count("*").alias("n"))
    parts = [flagged(sizes.filter(F.col("n") < 2 * cycle), "short-series"), flagged(missing_periods(df, freq, key, order), "missing-periods"),
             flagged(duplicate_periods(raw, key, raw_order), "duplicate-periods"), flagged(abrupt_jumps(df, key=key, order=order), "abrupt-jumps")]
    # four names at most per series
    sets = reduce(lambda a, b: a.unionByName(b), parts).groupBy(key).agg(F.array_sort(F.collect_set("flag")).alias("flags"))
    return sizes.join(sets, key, "left").withColumn("flags", F.coalesce("flags", F.array().cast("array<string>")))


def sector_shares(raw: DataFrame, time: Column, sector: str, value: Column) -> DataFrame:
    """(period, sector, value, share_of_mean, share_of_sum): sector means against the mean over all rows, and against their sum.

    Rows are reduced to a sum and a count per (period, sector) before any window.
    """
    cells = raw.groupBy(time.alias("period"), F.col(sector).alias("sector")).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    w = Window.partitionBy("period")
    mean = F.col("_s") / F.col("_n")
    return cells.select("period", "sector", mean.alias("value"), (mean / (F.sum("_s").over(w) / F.sum("_n").over(w)) * 100).alias("share_of_mean"),
                        (mean / F.sum(mean).over(w) * 100).alias("share_of_sum"))


def event_features(events: DataFrame, days: DataFrame, key: str = "series_id", order: str = "period") -> DataFrame:
    """Direction, mean deviation and percent size of each event from the daily rows inside it."""
    from .joins import interval_join

    inside = interval_join(days, events, [key], order, "start", "end")
    kept = [c for c in events.columns if c not in (key, "start", "end")]
    out = inside.groupBy(key, "start", "end", *kept).agg(F.avg("deviation").alias("mean_deviation"))
    return out.withColumn("direction", F.when(F.col("mean_deviation") > 0, "up").otherwise("down")).withColumn("magnitude_pct", F.round(F.col("mean_deviation") * 100, 2))


def event_report(events: DataFrame, key: str = "series_id") -> DataFrame:
    """Counts up and down, the largest event, and the tone of the overview."""
    up = F.count_if(F.col("direction") == "up")
    worst = F.max_by(F.struct("start", "end", "magnitude_pct"), F.struct(F.abs("magnitude_pct"), F.col("start")))
    out = events.groupBy(key).agg(F.count("*").alias("n_events"), up.alias("n_up"), (F.count("*") - up).alias("n_down"), worst.alias("_w"))
    tone = F.when(F.col("n_up") >= F.col("n_down"), "expanding").otherwise("weakening")
    return out.select(key, "n_events", "n_up", "n_down", tone.alias("tone"), F.col("_w.start").alias("worst_start"), F.col("_w.end").alias("worst_end"), F.col("_w.magnitude_pct").alias("worst_pct"))


def detector_quality(df: DataFrame, keys: list[str], truth: str, flag: str, score: str) -> DataFrame:
    """precision, recall, f1 and ROC-AUC per group, ties in the score counted half.

    Scores are reduced to one row per value before the ordered sums, so no group is sorted whole.
    """
    hit = F.sum(((F.col(truth) == 1) & (F.col(flag) == 1)).cast("long"))
    basic = df.groupBy(*keys).agg(F.count("*").alias("n"), hit.alias("_tp"), F.sum(flag).alias("_p"), F.sum(truth).alias("_t"))
    counts = value_counts(df, keys, score, {"pos": F.sum(F.col(truth).cast("long"))}).withColumn("neg", F.col("c") - F.col("pos"))
    placed = running(counts, keys, score, ["pos", "neg"], df)
    area = placed.groupBy(*keys).agg(F.sum(F.col("pos") * (F.col("before_neg") + 0.5 * F.col("neg"))).alias("_a"), F.first("all_pos").alias("_ap"), F.first("all_neg").alias("_an"))
    out = basic.join(area, keys)
    zero = F.lit(0.0)
    precision, recall = F.coalesce(F.try_divide("_tp", "_p"), zero), F.coalesce(F.try_divide("_tp", "_t"), zero)
    return out.select(*keys, "n", precision.alias("precision"), recall.alias("recall"),
                      F.coalesce(F.try_divide(2.0 * F.col("_tp"), F.col("_p") + F.col("_t")), zero).alias("f1"),
                      F.try_divide("_a", F.col("_ap").cast("double") * F.col("_an")).alias("auc"))


def regression_quality(df: DataFrame, stage: str = "stage", actual: str = "actual", predicted: str = "prediction") -> DataFrame:
    """(stage, n, rmse, mae, r2) with an 'overall' row, from one pass of sums."""
    e = F.col(actual) - F.col(predicted)
    sums = df.filter(F.col(actual).isNotNull() & F.col(predicted).isNotNull()).rollup(stage).agg(
        F.count("*").alias("n"), F.avg(e * e).alias("_mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(actual).alias("_v"))
    return sums.select(F.coalesce(stage, F.lit("overall")).alias(stage), "n", F.sqrt("_mse").alias("rmse"), "mae",
                       (1 - F.try_divide("_mse", "_v")).alias("r2"))


def stage_improvement(quality: DataFrame, stages: Sequence[str], stage: str = "stage") -> DataFrame:
    """Percent fall of the error from stage to stage, and from the first to the last."""
    one = quality.filter(F.col(stage).isin(*stages)).groupBy().pivot(stage, list(stages)).agg(F.first("rmse"))
    pairs = [*zip(stages, stages[1:]), (stages[0], stages[-1])]
    return one.select(*[(F.try_divide(F.col(a) - F.col(b), F.col(a)) * 100).alias(f"{a}_to_{b}_pct") for a, b in pairs])


def score_answers(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Adds ``failures`` (names of the rules that hold) and ``passed``; a rule is a Column that is true on failure."""
    failures = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), name) for name, c in rules.items()]))
    return df.withColumn("failures", failures).withColumn("passed", F.size("failures") == 0)


def pass_totals(scored: DataFrame, group: str) -> DataFrame:
    return scored.rollup(group).agg(F.count("*").alias("n"), F.count_if("passed").alias("n_passed")).select(
        F.coalesce(group, F.lit("overall")).alias(group), "n", "n_passed")


def relation_types(triples: DataFrame) -> DataFrame:
    """One row: sorted distinct relation names, and those that state a mechanism. The names are a vocabulary, not data."""
    names = triples.select(F.upper("rel").alias("rel")).distinct()
    return names.agg(F.array_sort(F.collect_list("rel")).alias("available")).withColumn(
        "mechanisms", F.array_intersect("available", F.array(*[F.lit(m) for m in MECHANISMS])))


def price_index(df: DataFrame, price: str, base: str | None = None, key: str = "series_id", order: str = "period") -> DataFrame:
    """Price against the series mean, or against its value in the base period, times 100."""
    w = Window.partitionBy(key)
    level = F.max(F.when(F.col(order) == F.lit(base).cast("date"), F.col(price))).over(w) if base else F.avg(price).over(w)
    return df.withColumn("price_index", F.col(price) / level * 100)


def trace_statistics(trace: DataFrame, run: str, step: str, tool: str, failed: Column) -> tuple[DataFrame, DataFrame]:
    """(per run: steps, span of steps, failures, first and last tool; per run and tool: attempts and failures)."""
    per_run = trace.groupBy(run).agg(
        F.count("*").alias("n_steps"), (F.max(step) - F.min(step)).alias("span"), F.count_if(failed).alias("n_failed"),
        F.min_by(tool, step).alias("first_tool"), F.max_by(tool, step).alias("last_tool"))
    return per_run, trace.groupBy(run, tool).agg(F.count("*").alias("attempts"), F.count_if(failed).alias("failures"))


def tool_sequence(trace: DataFrame, run: str, step: str, tool: str, time: str) -> DataFrame:
    """The tools of every run in order, one row each: (run, step, tool, position, seconds_since the step before).

    Positions are counted in two levels and the step before is looked up by position, so a run that holds much of the trace is not sorted in one task.
    """
    held = running(trace.select(run, step, tool, time).withColumn("_one", F.lit(1)), [run], step, ["_one"]).withColumn("position", F.col("before__one") + 1)
    before = held.select(F.col(run).alias("_run"), (F.col("position") + 1).alias("_at"), F.col(time).alias("_before"))
    out = held.join(before, F.col(run).eqNullSafe(F.col("_run")) & (F.col("position") == F.col("_at")), "left")
    return out.select(run, step, tool, "position", (F.col(time) - F.col("_before")).cast("double").alias("seconds_since"))


def run_durations(trace: DataFrame, run: str, time: str) -> DataFrame:
    """(run, n_steps, seconds from the first to the last step)."""
    return trace.groupBy(run).agg(F.count("*").alias("n_steps"), (F.max(time) - F.min(time)).alias("seconds"))
