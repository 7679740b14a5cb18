"""Row-window operators on series tables with one row per (series, period).

Each series is a calendar-long list of points, already aggregated from the raw rows, so
a window group is bounded by the calendar and not by the data volume. Several operators
applied in turn share one shuffle, because they all partition by the series.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numbers import growth
from .series import along, centred, whole

ALL = (Window.unboundedPreceding, Window.unboundedFollowing)


def lag_growth(value: str = "value", periods: int = 12, key: str = "series_id", order: str = "period") -> Column:
    """Percent change against the value ``periods`` rows earlier."""
    return growth(F.col(value), F.lag(value, periods).over(along(key, order)))


def year_to_date(value: str = "value", key: str = "series_id", order: str = "period") -> Column:
    return F.sum(value).over(Window.partitionBy(key, F.year(order)).orderBy(order))


def cumulative_growth(df: DataFrame, value: str = "value", name: str = "cumulative_yoy", key: str = "series_id", order: str = "period") -> DataFrame:
    """Year-to-date total against the total twelve rows earlier."""
    with_ytd = df.withColumn("_ytd", year_to_date(value, key, order))
    before = F.lag("_ytd", 12).over(along(key, order))
    return with_ytd.withColumn(name, (F.try_divide("_ytd", before) - 1) * 100).drop("_ytd")


def moving_average(value: str = "value", width: int = 3, centre: bool = True, key: str = "series_id", order: str = "period") -> Column:
    w = centred(width, key, order) if centre else along(key, order).rowsBetween(-(width - 1), 0)
    return F.avg(value).over(w)


def rolling_stat(value: str, width: int, stat: str, key: str = "series_id", order: str = "period") -> Column:
    """Centred mean, std, min, max, skew or kurt; NULL below min(3, width) points. Skew and kurtosis are bias-corrected."""
    w = centred(width, key, order)
    n = F.count(value).over(w)
    if stat == "skew":
        raw = F.when(n >= 3, F.sqrt(n * (n - 1.0)) / (n - 2) * F.skewness(value).over(w))
    elif stat == "kurt":
        raw = F.when(n >= 4, (n - 1.0) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(value).over(w) + 6))
    else:
        raw = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}[stat](value).over(w)
    return F.when(n >= min(3, width), raw)


def rolling_stats(df: DataFrame, value: str = "value", widths: Sequence[int] = (3, 6, 12), stats: Sequence[str] = ("mean", "std"),
                  key: str = "series_id", order: str = "period") -> DataFrame:
    return df.select("*", *[rolling_stat(value, w, s, key, order).alias(f"roll_{w}_{s}") for w in widths for s in stats])


def net_increment(df: DataFrame, value: str = "value", window: int = 3, lag: int = 12, key: str = "series_id", order: str = "period") -> DataFrame:
    """Trailing ``window``-row total, the same a year earlier, and their difference relative to last year's value."""
    w = along(key, order)
    out = df.withColumn("capacity_delta", F.sum(value).over(w.rowsBetween(-(window - 1), 0)))
    before = F.lag("capacity_delta", lag).over(w)
    out = out.withColumn("capacity_delta_prev_year", before)
    return out.withColumn("capacity_change_rate", F.try_divide(F.col("capacity_delta") - F.col("capacity_delta_prev_year"), F.abs(F.lag(value, lag).over(w))) * 100)


def difference(value: str = "value", key: str = "series_id", order: str = "period") -> Column:
    return F.col(value) - F.lag(value).over(along(key, order))


def _carried(value: Column, w, forward: bool) -> Column:
    if forward:
        return F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))


def interpolate(df: DataFrame, value: str, name: str, by_time: bool = False, key: str = "series_id", order: str = "period") -> DataFrame:
    """Linear between known neighbours, by row or by elapsed time; ends take the nearest known value."""
    w = along(key, order)
    place = F.unix_timestamp(F.col(order).cast("timestamp")).cast("double") if by_time else F.row_number().over(w).cast("double")
    held = df.withColumn("_at", place)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("_at").alias("at"), F.col(value).alias("v")))
    held = held.withColumn("_lo", _carried(known, w, True)).withColumn("_hi", _carried(known, w, False))
    between = F.col("_lo.v") + (F.col("_hi.v") - F.col("_lo.v")) * (F.col("_at") - F.col("_lo.at")) / F.nullif(F.col("_hi.at") - F.col("_lo.at"), F.lit(0.0))
    return held.withColumn(name, F.coalesce(value, between, F.col("_lo.v"), F.col("_hi.v"))).drop("_at", "_lo", "_hi")


def seasonal_interpolate(df: DataFrame, value: str, name: str, key: str = "series_id", order: str = "period") -> DataFrame:
    """Moving-average trend plus the interpolated rest; the average is 12, 7 or a third of the series wide."""
    n = F.count("*").over(whole(key))
    narrow = F.when(n >= 12, moving_average(value, 4, True, key, order)).when(n >= 9, moving_average(value, 3, True, key, order)).otherwise(
        moving_average(value, 2, True, key, order))
    trend = F.when(n >= 24, moving_average(value, 12, True, key, order)).when(n >= 14, moving_average(value, 7, True, key, order)).otherwise(narrow)
    held = df.withColumn("_trend", trend).withColumn("_rest", F.col(value) - F.col("_trend"))
    held = interpolate(held, "_rest", "_rest_full", False, key, order).withColumn("_sum", F.col("_trend") + F.col("_rest_full"))
    w = along(key, order)
    return held.withColumn(name, F.coalesce("_sum", _carried(F.col("_sum"), w, True), _carried(F.col("_sum"), w, False))).drop(
        "_trend", "_rest", "_rest_full", "_sum")


def fill(df: DataFrame, value: str, method: str, name: str | None = None, key: str = "series_id", order: str = "period") -> DataFrame:
    """Fill gaps per series; an unknown method carries forward, then back."""
    name = name or value
    w = along(key, order)
    c = F.col(value)
    if method == "linear_interp":
        return interpolate(df, value, name, False, key, order)
    if method == "time_interp":
        return interpolate(df, value, name, True, key, order)
    if method == "seasonal_interp":
        return seasonal_interpolate(df, value, name, key, order)
    if method == "drop":
        return df
    if method == "mean":
        filled = F.coalesce(c, F.avg(c).over(whole(key)))
    elif method == "median":
        filled = F.coalesce(c, F.percentile(c, 0.5).over(whole(key)))
    elif method == "zero":
        filled = F.coalesce(c, F.lit(0.0))
    elif method == "backward_fill":
        filled = F.coalesce(c, _carried(c, w, False), _carried(c, w, True))
    else:
        filled = F.coalesce(c, _carried(c, w, True), _carried(c, w, False))
    return df.withColumn(name, filled)


def missing_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, missing_count, missing_rate in percent, dtype) from one aggregate."""
    kinds = dict(df.dtypes)
    one = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    long = one.unpivot(["_n"], columns, "column", "missing_count")
    dtype = F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(kinds[c]))])[F.col("column")]
    return long.select("column", "missing_count", (F.col("missing_count") * 100.0 / F.col("_n")).alias("missing_rate"), dtype.alias("dtype"))


def auto_fill(df: DataFrame, columns: list[str], key: str = "series_id", order: str = "period", drop_above: float = 20.0, linear_up_to: float = 5.0) -> DataFrame:
    """Choose a fill per column from its share of gaps; columns with too many are left out.

    The choice needs one small action: a row per column.
    """
    out = df
    for row in missing_report(df, columns).collect():
        if row.missing_count == 0:
            continue
        if row.missing_rate > drop_above:
            out = out.drop(row.column)
        elif row.dtype in ("double", "float", "int", "bigint", "smallint"):
            out = fill(out, row.column, "linear_interp" if row.missing_rate <= linear_up_to else "time_interp", None, key, order)
        else:
            out = fill(out, row.column, "forward_fill", None, key, order)
    return out


def rolling_zscore_outlier(df: DataFrame, value: str = "value", width: int = 30, threshold: float = 3.0, key: str = "series_id", order: str = "period") -> DataFrame:
    mean, sd = rolling_stat(value, width, "mean", key, order), rolling_stat(value, width, "std", key, order)
    z = F.try_divide(F.col(value) - mean, F.nullif(sd, F.lit(0.0)))
    return df.withColumn("z", z).withColumn("is_outlier", F.coalesce(F.abs("z") > threshold, F.lit(False)))


def outside(df: DataFrame, bounds: DataFrame, value: str, key: str, lower: str, upper: str, name: str) -> DataFrame:
    """Flag rows beyond per-series bounds; the bounds table has one row per series."""
    flag = F.coalesce((F.col(value) < F.col(lower)) | (F.col(value) > F.col(upper)), F.lit(False))
    return df.join(bounds, key, "left").withColumn(name, flag)


def handle_outliers(df: DataFrame, strategy: str, value: str = "value", flag: str = "is_outlier", key: str = "series_id", order: str = "period",
                    lower: str = "lower", upper: str = "upper") -> DataFrame:
    """flag: keep the mark; interpolate: replace marked values; cap: clip to the bounds; remove: drop marked rows."""
    if strategy == "flag":
        return df.withColumn(f"is_outlier_{value}", F.col(flag))
    if strategy == "interpolate":
        blanked = df.withColumn("_kept", F.when(~F.col(flag), F.col(value)))
        return interpolate(blanked.drop(value), "_kept", value, False, key, order).drop("_kept")
    if strategy == "cap":
        return df.withColumn(value, F.greatest(F.col(lower), F.least(F.col(upper), F.col(value))))
    if strategy == "remove":
        return df.filter(~F.col(flag))
    raise ValueError(f"unknown strategy {strategy}")


def monthly_from_ytd(df: DataFrame, ytd: str, key: str = "series_id", order: str = "period") -> DataFrame:
    """Single months from year-to-date totals.

    A year opening in January or February starts from zero; later openings subtract last
    December's total when it is there, else the row is left out. Negative results are NULL.
    """
    in_year = Window.partitionBy(key, F.year(order)).orderBy(order)
    december = F.last(F.when(F.month(order) == 12, F.struct(F.year(order).alias("y"), F.col(ytd).alias("v"))), ignorenulls=True).over(
        along(key, order).rowsBetween(Window.unboundedPreceding, -1))
    held = df.withColumn("_prev", F.lag(ytd).over(in_year)).withColumn("_dec", december)
    single = (
        F.when((F.month(order) == 1) | (F.col("_prev").isNull() & (F.month(order) <= 2)), F.col(ytd))
        .when(F.col("_prev").isNotNull(), F.col(ytd) - F.col("_prev"))
        .when(F.col("_dec.y") == F.year(order) - 1, F.col(ytd) - F.col("_dec.v"))
    )
    out = held.withColumn("single", single).filter(F.col("single").isNotNull())
    return out.withColumn("single", F.when(F.col("single") >= 0, F.col("single"))).drop("_prev", "_dec")


def quarterly_from_ytd(df: DataFrame, ytd: str, key: str = "series_id", order: str = "period", since: int = 2010) -> DataFrame:
    """Single quarters from year-to-date totals, starting each year from zero."""
    before = F.coalesce(F.lag(ytd).over(Window.partitionBy(key, F.year(order)).orderBy(order)), F.lit(0.0))
    out = df.withColumn("single", F.col(ytd) - before)
    return out.withColumn("eligible", ((F.year(order) >= since) & (F.col("single") > 0)).cast("int"))


def lag_weights(n: int = 30, kind: str = "almon", theta: tuple[float, float] = (-0.1, -0.01), shape: tuple[float, float] = (1.0, 5.0), decay: float = 0.9) -> list[float]:
    """Normalised lag weights, lag 0 first."""
    if kind == "almon":
        raw = [math.exp(theta[0] * k + theta[1] * k * k) for k in range(n)]
    elif kind == "beta":
        x = [0.001 + 0.998 * k / (n - 1) for k in range(n)]
        raw = [v ** (shape[0] - 1) * (1 - v) ** (shape[1] - 1) for v in x]
    elif kind == "exponential":
        raw = [decay**k for k in range(n)]
    elif kind == "equal":
        raw = [1.0] * n
    else:
        raise ValueError(f"unknown weights {kind}")
    total = sum(raw)
    return [v / total for v in raw]


def mixed_frequency(df: DataFrame, weights: Mapping[str, Sequence[float]], to: str = "month", value: str = "value", newest_first: bool = True,
                    key: str = "series_id", order: str = "period") -> DataFrame:
    """(key, bucket start, one weighted sum per name): the last rows up to each bucket's end, dotted with the weights.

    All weightings have one length and share one pass. Lag 0 weighs the newest row;
    ``newest_first=False`` gives it to the oldest. Buckets without rows repeat the last row
    before them; those with too short a history are left out.
    """
    n = len(next(iter(weights.values())))
    w = along(key, order)
    bucket = F.to_date(F.date_trunc(to, order))
    last = F.coalesce(F.lead(bucket).over(w) != bucket, F.lit(True))
    held = df.select(key, order, F.collect_list(value).over(w.rowsBetween(-(n - 1), 0)).alias("_v"), bucket.alias("bucket"), last.alias("_last")).filter("_last")

    def dot(ws: Sequence[float]) -> Column:
        ordered = list(reversed(ws)) if newest_first else list(ws)
        return F.aggregate(F.zip_with("_v", F.array(*[F.lit(x) for x in ordered]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)

    ends = held.select(key, "bucket", F.when(F.size("_v") == n, F.struct(*[dot(ws).alias(name) for name, ws in weights.items()])).alias("_dots"))
    span = ends.groupBy(key).agg(F.min("bucket").alias("_lo"), F.max("bucket").alias("_hi"))
    grid = span.select(key, F.explode(F.sequence("_lo", "_hi", F.expr(f"interval 1 {to}"))).alias("bucket"))
    carried = F.last("_dots", ignorenulls=True).over(Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    return grid.join(ends, [key, "bucket"], "left").select(key, "bucket", carried.alias("_d")).filter(F.col("_d").isNotNull()).select(key, "bucket", "_d.*")


def rolling_median_deviation(df: DataFrame, value: str = "value", width: int = 91, least: int = 15, key: str = "series_id", order: str = "period") -> DataFrame:
    """Distance from the centred rolling median; 0 where too few rows back it."""
    w = centred(width, key, order)
    baseline = F.when(F.count(value).over(w) >= least, F.percentile(value, 0.5).over(w))
    return df.withColumn("baseline", baseline).withColumn("deviation", F.coalesce(F.col(value) - F.col("baseline"), F.lit(0.0)))


def standardise(df: DataFrame, columns: list[str], key: str = "series_id") -> DataFrame:
    w = whole(key)
    return df.select(*[c for c in df.columns if c not in columns], *[
        ((F.col(c) - F.avg(c).over(w)) / (F.stddev_pop(c).over(w) + 1e-8)).alias(c) for c in columns])


def sliding_vectors(df: DataFrame, columns: list[str], width: int = 30, key: str = "series_id", order: str = "period") -> DataFrame:
    """One flattened vector per full window of ``width`` rows, named by the row in its centre."""
    scaled = standardise(df, columns, key)
    w = along(key, order)
    frame = w.rowsBetween(0, width - 1)
    held = scaled.select(key, F.lead(order, width // 2).over(w).alias(order), F.collect_list(F.array(*columns)).over(frame).alias("_rows"))
    return held.filter(F.size("_rows") == width).select(key, order, F.flatten("_rows").alias("vector"))


def remove_climatology(df: DataFrame, value: str = "value", width: int = 15, key: str = "series_id", order: str = "period") -> DataFrame:
    """Subtract the smoothed day-of-year profile, smoothed around the year's end and centred on zero."""
    half = width // 2
    means = df.groupBy(key, F.dayofyear(order).alias("doy")).agg(F.avg(value).alias("_m"))
    days = means.select(key).distinct().select(key, F.explode(F.sequence(F.lit(1), F.lit(366))).alias("doy"))
    profile = interpolate(days.join(means, [key, "doy"], "left"), "_m", "_full", False, key, "doy")
    # repeat the ends on the far side, so the average runs around the year
    shifts = F.array_compact(F.array(F.lit(0), F.when(F.col("doy") > 366 - half, -366), F.when(F.col("doy") <= half, 366)))
    ring = profile.select(key, "_full", F.explode(shifts).alias("_s"), "doy").select(key, "_full", (F.col("doy") + F.col("_s")).alias("_d"))
    smooth = ring.withColumn("_sm", F.avg("_full").over(centred(width, key, "_d"))).filter(F.col("_d").between(1, 366))
    smooth = smooth.select(key, F.col("_d").alias("doy"), (F.col("_sm") - F.avg("_sm").over(whole(key))).alias("climatology"))
    out = df.withColumn("doy", F.dayofyear(order)).join(smooth, [key, "doy"], "left")
    return out.withColumn("adjusted", F.col(value) - F.col("climatology")).drop("doy")


def robust_z(df: DataFrame, value: str = "value", name: str = "robust_z", key: str = "series_id") -> DataFrame:
    """(x - median) / (1.4826 MAD); the population deviation stands in where the MAD vanishes."""
    med = df.groupBy(key).agg(F.percentile(value, 0.5).alias("_med"), F.stddev_pop(value).alias("_sd"))
    held = df.join(med, key)
    mad = held.groupBy(key).agg(F.percentile(F.abs(F.col(value) - F.col("_med")), 0.5).alias("_mad"))
    scale = F.when(F.col("_mad") > 1e-12, F.col("_mad")).when(F.col("_sd") > 0, F.col("_sd")).otherwise(F.lit(1e-12))
    return held.join(mad, key).withColumn(name, (F.col(value) - F.col("_med")) / (1.4826 * scale)).drop("_med", "_sd", "_mad")
