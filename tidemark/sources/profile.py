"""Column and dataset profiling: which column is the period, which the value, how often, how much."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import periods as per

# Column names that are periods.
PERIOD_NAMES = (
    "date", "month", "period", "time", "datetime", "day", "quarter", "year",
    "月份", "日期", "时间", "年月", "季度", "年份",
)
# Name parts that raise, lower or exclude a value column.
PREFERRED_PARTS = ("consumption", "用电", "value_", "_value", "demand")
HINT_PARTS = ("kwh", "generation", "temp", "capacity", "gdp", "yuan", "degree", "precipitation", "radiation", "load")
CUMULATIVE_PARTS = ("ytd", "cumulative", "_cum", "cum_", "累计", "year_to_date")
MONTH_PARTS = ("_month", "month_", "monthly", "当月", "单月")
EXCLUDED_PARTS = (
    "pct", "yoy", "mom", "rate", "flag", "url", "id", "note", "quality",
    "source", "description", "weekday", "day_type", "holiday_name", "is_",
    "name", "label", "unit", "remark",
)


def period_columns(df: DataFrame, least: float = 0.8) -> DataFrame:
    """(column, n, parsed, rate, chosen): parse rate of every column in one pass, best candidate marked.

    A column named like a period wins outright; otherwise the highest rate of at least ``least``.
    All rows are counted, where a sample would do on one machine: the pass is a single aggregate.
    """
    stats = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns]).select(
        *[F.struct(F.col(f"`{c}`").isNotNull().alias("given"), per.parse_period(F.col(f"`{c}`")).isNotNull().alias("ok")).alias(c) for c in df.columns]
    ).agg(*[F.struct(F.count_if(F.col(f"`{c}`.given")).alias("n"), F.count_if(F.col(f"`{c}`.ok")).alias("parsed")).alias(c) for c in df.columns])
    long = stats.unpivot([], list(df.columns), "column", "s").select("column", "s.n", "s.parsed")
    named = F.lower(F.trim("column")).isin(*PERIOD_NAMES)
    rate = F.try_divide(F.col("parsed").cast("double"), F.col("n"))
    position = reduce(lambda a, b: a.when(F.col("column") == b[1], b[0]), enumerate(df.columns), F.when(F.lit(False), 0))
    ranked = long.withColumn("rate", rate).withColumn("_named", named).withColumn("_pos", position)
    best = Window.orderBy(F.col("_named").desc(), F.when(F.col("_named"), 0.0).otherwise(-F.coalesce("rate", F.lit(0.0))), "_pos")
    # one row per column of the table, so the unpartitioned window holds a handful of rows
    return ranked.withColumn("chosen", (F.row_number().over(best) == 1) & (F.col("_named") | (F.col("rate") >= least))).select(
        "column", "n", "parsed", "rate", "chosen")


def _hits(name: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, [name.contains(p).cast("int") for p in parts])


def name_score(name: str) -> float:
    """How much a column's name speaks for it being the main value, by the weights of `value_columns`."""
    low = name.strip().lower()
    hits = lambda parts: sum(p in low for p in parts)
    return 3.0 * hits(PREFERRED_PARTS) + 1.5 * hits(HINT_PARTS) + 3.0 * hits(MONTH_PARTS) - 3.0 * hits(CUMULATIVE_PARTS)


def name_usable(name: str) -> bool:
    return not any(p in name.strip().lower() for p in EXCLUDED_PARTS)


def value_columns(df: DataFrame, period: str) -> DataFrame:
    """(column, n_numeric, score, chosen) for every column that could be the main value."""
    cols = [c for c in df.columns if c != period]
    numeric = df.select(*[F.col(f"`{c}`").cast("string").try_cast("double").alias(c) for c in cols])
    stats = numeric.agg(
        F.count("*").alias("_rows"),
        *[F.struct(F.count(f"`{c}`").alias("n"), F.stddev_samp(f"`{c}`").alias("sd"), F.abs(F.avg(f"`{c}`")).alias("mean")).alias(c) for c in cols])
    long = stats.unpivot(["_rows"], cols, "column", "s").select("column", "_rows", "s.n", "s.sd", "s.mean")
    name = F.lower(F.trim("column"))
    usable = (_hits(name, EXCLUDED_PARTS) == 0) & (F.col("n") >= F.greatest(F.lit(3.0), F.col("_rows") * 0.5)) & (F.coalesce("sd", F.lit(0.0)) > 0)
    variation = F.when(F.col("mean") > 1e-9, F.try_divide("sd", "mean")).otherwise(F.col("sd"))
    score = (3.0 * _hits(name, PREFERRED_PARTS) + 1.5 * _hits(name, HINT_PARTS) + 3.0 * _hits(name, MONTH_PARTS)
             - 3.0 * _hits(name, CUMULATIVE_PARTS) + 0.2 * F.least(variation, F.lit(5.0)))
    scored = long.filter(usable).withColumn("score", score)
    first = Window.orderBy(F.col("score").desc(), "column")  # a handful of columns
    return scored.withColumn("chosen", F.row_number().over(first) == 1).select("column", F.col("n").alias("n_numeric"), "score", "chosen")


def series_frequency(df: DataFrame, key: str = "series_id", time: str = "period") -> DataFrame:
    """(key, n, gap_days, frequency) from the upper median of the positive gaps.

    Gaps are first counted per distinct length, so the ordering step sees at most one
    row per gap length and not one per observation.
    """
    points = df.select(key, F.col(time).alias("_t")).distinct()
    seconds = F.unix_timestamp(F.col("_t").cast("timestamp"))
    gap = (seconds - F.lag(seconds).over(Window.partitionBy(key).orderBy("_t"))) / 86400.0
    gaps = points.withColumn("gap", gap)
    counts = gaps.filter("gap > 0").groupBy(key, "gap").agg(F.count("*").alias("c"))
    w = Window.partitionBy(key).orderBy("gap")
    placed = counts.withColumn("upto", F.sum("c").over(w)).withColumn("total", F.sum("c").over(Window.partitionBy(key)))
    middle = placed.filter(F.col("upto") > F.floor(F.col("total") / 2)).groupBy(key).agg(F.min("gap").alias("gap_days"))
    sizes = points.groupBy(key).agg(F.count("*").alias("n"))
    return sizes.join(middle, key, "left").withColumn("frequency", per.frequency_name(F.col("gap_days")))


def describe_dataset(df: DataFrame, name: str, period: str | None = None, flag: str | None = None) -> DataFrame:
    """One inventory row; the kind follows the name and the share of usable periods."""
    when = F.col(period).cast("date") if period else F.lit(None).cast("date")
    stats = df.agg(F.count("*").alias("n_rows"), F.count(when).alias("_dated"), F.min(when).alias("period_start"), F.max(when).alias("period_end"),
                   *([F.array_join(F.array_sort(F.collect_set(flag)), ",").alias("flags")] if flag else []))
    kind = (F.when(F.lit("calendar" in name.lower()), "calendar")
            .when((F.col("_dated") > 0) & (F.col("_dated") >= F.greatest(F.lit(3.0), F.col("n_rows") * 0.7)), "timeseries").otherwise("table"))
    return stats.select(
        F.lit(name).alias("dataset"), kind.alias("kind"), "n_rows", F.lit(len(df.columns)).alias("n_columns"),
        F.lit(",".join(sorted(df.columns))).alias("columns"), "period_start", "period_end",
        (F.col("flags") if flag else F.lit("")).alias("flags"))
