"""Calendar operators: runs of flagged days, holiday smoothing, weekday effects, period context."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .joins import interval_join


def islands(df: DataFrame, key: str = "series_id", order: str = "period", consecutive_days: bool = False, flag: str | None = None,
            aggs: list[Column] | None = None, least: int = 1) -> DataFrame:
    """Runs of consecutive rows: (key, start, end, n, ...).

    With ``consecutive_days`` the rows given are all members and a run breaks at a missing
    day; otherwise a run is consecutive rows with ``flag`` true, whatever the dates.
    """
    w = Window.partitionBy(key).orderBy(order)
    if consecutive_days:
        held = df.withColumn("_island", F.date_sub(F.col(order), F.row_number().over(w)))
    else:
        held = df.withColumn("_island", F.sum((~F.col(flag)).cast("long")).over(w)).filter(F.col(flag))
    out = held.groupBy(key, "_island").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n"), *(aggs or []))
    return out.filter(F.col("n") >= least).drop("_island")


def holiday_references(days: DataFrame, flag: str, value: str = "value", before: int = 3, after: int = 3, wide: int = 30,
                       key: str = "series_id", order: str = "period") -> DataFrame:
    """(key, start, end, replacement) per holiday run: mean of the ordinary days around it.

    The near range reaches one day beyond ``before`` and ``after``; a run without any
    ordinary day there takes the mean of the wide range.
    """
    runs = islands(days.filter(flag).select(key, order), key, order, consecutive_days=True).select(
        key, "start", "end", F.date_sub("start", wide).alias("_from"), F.date_add("end", wide).alias("_to"))
    ordinary = days.filter(~F.col(flag) & F.col(value).isNotNull()).select(key, order, value)
    near = F.col(order).between(F.date_sub("start", before + 1), F.date_add("end", after + 1))
    joined = interval_join(ordinary, runs, [key], order, "_from", "_to")
    return joined.groupBy(key, "start", "end").agg(
        F.coalesce(F.avg(F.when(near, F.col(value))), F.avg(value)).alias("replacement"))


def smooth_holidays(days: DataFrame, flag: str, value: str = "value", name: str = "smoothed", before: int = 3, after: int = 3,
                    key: str = "series_id", order: str = "period") -> DataFrame:
    """Holiday values replaced by their run's reference mean."""
    refs = holiday_references(days, flag, value, before, after, 30, key, order)
    covered = interval_join(days, refs.withColumnRenamed("start", "_s").withColumnRenamed("end", "_e"), [key], order, "_s", "_e", how="left")
    return covered.withColumn(name, F.coalesce("replacement", value)).drop("_s", "_e", "replacement")


def weekday_adjust(df: DataFrame, value: str = "value", name: str = "adjusted", key: str = "series_id", order: str = "period", least: int = 14) -> DataFrame:
    """Remove the mean weekday pattern within ISO weeks; series under ``least`` rows are unchanged."""
    week = F.extract(F.lit("YEAROFWEEK"), F.col(order))
    by_week = Window.partitionBy(key, week, F.weekofyear(order))
    indexed = df.withColumn("_dow", F.weekday(order)).withColumn("_i", F.try_divide(F.col(value), F.nullif(F.avg(value).over(by_week), F.lit(0.0))))
    means = indexed.groupBy(key, "_dow").agg(F.avg("_i").alias("_m"))
    means = means.withColumn("_all", F.avg("_m").over(Window.partitionBy(key)))
    out = indexed.join(means, [key, "_dow"], "left")
    n = F.count(value).over(Window.partitionBy(key))
    adjusted = F.try_divide(F.col(value), F.col("_m")) * F.col("_all")
    return out.withColumn(name, F.when(n >= least, adjusted).otherwise(F.col(value))).drop("_dow", "_i", "_m", "_all")


def calendar_days(days: DataFrame, holidays: DataFrame, day: str = "day", makeup: DataFrame | None = None) -> DataFrame:
    """Day table with weekend, holiday, working-day marks; a holiday on a weekday is a break day, a weekend day listed in ``makeup`` is worked."""
    named = days.join(holidays, day, "left")
    worked = F.lit(False)
    if makeup is not None:
        named = named.join(makeup.select(day, F.lit(True).alias("_worked")).distinct(), day, "left")
        worked = F.coalesce("_worked", F.lit(False))
    weekend = F.weekday(day) >= 5
    return named.select(
        *[c for c in named.columns if c != "_worked"], weekend.cast("int").alias("is_weekend"), F.col("name").isNotNull().cast("int").alias("is_holiday"),
        (F.col("name").isNull() & (~weekend | worked)).cast("int").alias("is_workday"), (F.col("name").isNull() & weekend & worked).cast("int").alias("is_makeup"))


def calendar_context(days: DataFrame, grain: str = "month", day: str = "day", festival: str = "春节") -> DataFrame:
    """Per period: days, working and other days, worked weekend days, break days, festival days, and the holidays with first and last day.

    A period ends before the next one begins.
    """
    period = F.to_date(F.date_trunc(grain, day)).alias("period")
    named = days.filter(F.col("name").isNotNull()).groupBy(period, "name").agg(F.count("*").alias("n"), F.min(day).alias("first"), F.max(day).alias("last"))
    # at most a dozen holiday names exist per period
    listed = named.groupBy("period").agg(F.array_sort(F.collect_list(F.struct("first", "name", "n", "last"))).alias("holidays"))
    totals = days.groupBy(period).agg(
        F.count("*").alias("n_days"), F.sum("is_workday").alias("n_workdays"), (F.count("*") - F.sum("is_workday")).alias("n_nonworkdays"), F.sum("is_makeup").alias("makeup_workdays"),
        F.sum("is_holiday").alias("holiday_break_days"), F.count_if(F.col("name") == festival).alias("festival_days"))
    return totals.join(listed, "period", "left")


def weather_context(weather: DataFrame, periods: DataFrame) -> DataFrame:
    """Weather beside each asked period with an explicit availability mark."""
    return periods.join(weather.withColumn("available", F.lit(True)), "period", "left").withColumn("available", F.coalesce("available", F.lit(False)))


def weather_rollup(hourly: DataFrame, temp: str = "temp", time: str = "ts", key: str = "series_id", base: float = 18.0,
                   means: Sequence[str] = (), sums: Sequence[str] = (), highs: Sequence[str] = ()) -> DataFrame:
    """Hours to days to months: mean, mean daily extremes, degree-day sums, hot and cold day counts.

    Further columns: ``means`` (humidity) as the mean of daily means, ``sums`` (precipitation, radiation) as totals,
    ``highs`` (wind) as the highest hour, under the names <column>_mean, _sum and _max.
    """
    more = [F.avg(c).alias(f"_{c}") for c in means] + [F.sum(c).alias(f"_{c}") for c in sums] + [F.max(c).alias(f"_{c}") for c in highs]
    monthly = [F.avg(f"_{c}").alias(f"{c}_mean") for c in means] + [F.sum(f"_{c}").alias(f"{c}_sum") for c in sums] + [F.max(f"_{c}").alias(f"{c}_max") for c in highs]
    daily = hourly.groupBy(key, F.to_date(time).alias("day")).agg(F.avg(temp).alias("mean"), F.max(temp).alias("hi"), F.min(temp).alias("lo"), *more)
    zero = F.lit(0.0)
    return daily.groupBy(key, F.to_date(F.date_trunc("month", "day")).alias("period")).agg(
        F.avg("mean").alias("temp_mean"), F.avg("hi").alias("daily_max_mean"), F.avg("lo").alias("daily_min_mean"), F.max("hi").alias("temp_max"), F.min("lo").alias("temp_min"),
        F.sum(F.greatest(zero, base - F.col("mean"))).alias("hdd"), F.sum(F.greatest(zero, F.col("mean") - base)).alias("cdd"),
        F.count_if(F.col("hi") >= 35).alias("hot_days"), F.count_if(F.col("lo") <= 0).alias("cold_days"), F.count("*").alias("n_days"), *monthly)
