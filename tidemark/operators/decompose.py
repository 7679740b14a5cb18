"""Trend, season and residual by window expressions, and what is read off a decomposition."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numbers import growth, share_of_variance
from .series import along, centred, point_risks, whole
from .windows import robust_z

# Relative deviation from which an anomaly is high or medium.
HIGH, MEDIUM = 0.08, 0.05


def classical(df: DataFrame, period: int = 12, key: str = "series_id", order: str = "period", value: str = "value") -> DataFrame:
    """Classical decomposition with the column contract of ``stl``.

    Trend is the centred two-by-``period`` average, carried to the ends; the season is
    the mean detrended value per calendar position, centred on zero. Logs are taken when
    a whole series is positive. Everything partitions by series, so one shuffle serves all.
    """
    w = along(key, order)
    half = period // 2
    held = df.withColumn("_n", F.count(value).over(whole(key))).filter(F.col("_n") >= 2 * period)
    held = held.withColumn("use_log", F.min(value).over(whole(key)) > 0)
    held = held.withColumn("_y", F.when(F.col("use_log"), F.ln(value)).otherwise(F.col(value)))
    inner = F.sum("_y").over(w.rowsBetween(-(half - 1), half - 1))
    raw = (0.5 * F.lag("_y", half).over(w) + inner + 0.5 * F.lead("_y", half).over(w)) / period
    held = held.withColumn("_t", raw).withColumn("_d", F.col("_y") - F.col("_t"))
    back, on = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    held = held.withColumn("trend", F.coalesce("_t", F.last("_t", ignorenulls=True).over(back), F.first("_t", ignorenulls=True).over(on)))
    position = F.month(order) if period == 12 else F.quarter(order)
    slot = Window.partitionBy(key, position)
    held = held.withColumn("_m", F.coalesce(F.avg("_d").over(slot), F.lit(0.0))).withColumn("_c", 1.0 / F.count("*").over(slot))
    held = held.withColumn("seasonal", F.col("_m") - F.sum(F.col("_m") * F.col("_c")).over(whole(key)) / F.sum("_c").over(whole(key)))
    held = held.withColumn("residual", F.col("_y") - F.col("trend") - F.col("seasonal"))
    both = F.col("trend") + F.col("seasonal")
    held = held.withColumn("expected", F.when(F.col("use_log"), F.exp(both)).otherwise(both))
    share = F.when(F.abs("expected") > 1e-12, (F.col(value) - F.col("expected")) / F.abs("expected")).otherwise(0.0)
    return held.withColumn("residual_pct", share).select(
        key, order, F.col(value).alias("value"), "trend", "seasonal", "residual", "expected", "residual_pct", "use_log", F.lit(period).alias("cycle"))


def rejected(df: DataFrame, period: int = 12, key: str = "series_id", value: str = "value") -> DataFrame:
    """(key, n, reason) for every series that :func:`classical` leaves out: it needs two whole cycles of values."""
    sizes = df.groupBy(key).agg(F.count(value).alias("n")).filter(F.col("n") < 2 * period)
    return sizes.withColumn("reason", F.concat(F.lit(f"needs {2 * period} points, has "), F.col("n").cast("string")))


def strengths(dec: DataFrame, key: str = "series_id") -> DataFrame:
    return dec.groupBy(key).agg(
        share_of_variance(F.col("residual"), F.col("trend")).alias("trend_strength"),
        share_of_variance(F.col("residual"), F.col("seasonal")).alias("seasonal_strength"))


def seasonal_profile(dec: DataFrame, key: str = "series_id", order: str = "period") -> DataFrame:
    """Mean seasonal component per calendar month, 0 for months never seen."""
    seen = dec.groupBy(key, F.month(order).alias("month")).agg(F.avg("seasonal").alias("mean_seasonal"))
    grid = dec.select(key).distinct().select(key, F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    return grid.join(seen, [key, "month"], "left").fillna(0.0, ["mean_seasonal"])


def trend_growth(dec: DataFrame, key: str = "series_id", order: str = "period") -> DataFrame:
    """Percent change of the trend from first to last point, overall and per year; the trend is read on the original scale."""
    shown = dec.withColumn("_t", F.when(F.col("use_log"), F.exp("trend")).otherwise(F.col("trend")))
    ends = shown.groupBy(key).agg(F.min_by("_t", order).alias("trend_start"), F.max_by("_t", order).alias("trend_end"), F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n"))
    ratio = F.try_divide("trend_end", "trend_start")
    months = F.months_between("end", "start")
    return ends.select(key, "n", "start", "end", "trend_start", "trend_end", ((ratio - 1) * 100).alias("growth_pct"),
                       F.when(months > 0, (F.pow(ratio, 12.0 / months) - 1) * 100).alias("annualised_pct"))


def summary(dec: DataFrame, key: str = "series_id", order: str = "period") -> DataFrame:
    """Strengths, residual spread, trend change and the short-sample warning (under three cycles)."""
    med = dec.groupBy(key).agg(F.percentile("residual", 0.5).alias("_med"))
    mad = dec.join(med, key).groupBy(key).agg(F.percentile(F.abs(F.col("residual") - F.col("_med")), 0.5).alias("residual_mad"))
    spread = dec.groupBy(key).agg(F.stddev_pop("residual").alias("residual_std"), F.first("cycle").alias("cycle"))
    out = strengths(dec, key).join(spread, key).join(mad, key).join(trend_growth(dec, key, order), key)
    change = growth(F.col("trend_end"), F.col("trend_start"), percent=False)
    return out.withColumn("trend_change", F.coalesce(change, F.lit(0.0))).withColumn("endpoint_warning", F.col("n") < 3 * F.col("cycle")).drop("cycle", "growth_pct", "annualised_pct", "start", "end")


def scan(dec: DataFrame, freq: str = "monthly", high: float = HIGH, medium: float = MEDIUM, most: int | None = None,
         key: str = "series_id", order: str = "period") -> DataFrame:
    """Points whose residual share reaches ``medium``: level, direction, robust z, growth on last year, risks, rank by size.

    ``most`` is the report length per series; without it every point is kept.
    """
    lag = {"monthly": 12, "quarterly": 4, "annual": 1, "weekly": 52, "daily": 365, "hourly": 24 * 365}[freq]
    held = dec.withColumn("yoy", growth(F.col("value"), F.lag("value", lag).over(along(key, order)), percent=False))
    held = point_risks(robust_z(held, "residual_pct", "robust_z", key), freq, key, order)
    size = F.abs("residual_pct")
    out = held.filter(size >= medium)
    out = out.withColumn("level", F.when(size >= high, "high").otherwise("medium"))
    out = out.withColumn("direction", F.when(F.col("residual_pct") > 0, "above_expected").otherwise("below_expected"))
    out = out.withColumn("endpoint", F.array_contains("risks", "series_edge"))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(size.desc(), order)))
    return out if most is None else out.filter(F.col("rank") <= most)


def scale_bands(df: DataFrame, levels: int = 4, value: str = "value", key: str = "series_id", order: str = "period") -> DataFrame:
    """Detail bands between centred averages of doubling width, and the remaining smooth.

    A wavelet tree asks the same question (how much of the movement lives at which scale)
    with another filter; the figures are not those of a db4 transform.
    """
    out = df
    smooth: Column = F.col(value)
    for j in range(1, levels + 1):
        nxt = F.avg(value).over(centred(2**j, key, order))
        out = out.withColumn(f"band_{j}", smooth - nxt)
        smooth = nxt
    return out.withColumn("smooth", smooth)


def band_energy(bands: DataFrame, levels: int = 4, key: str = "series_id") -> DataFrame:
    names = [f"band_{j}" for j in range(1, levels + 1)] + ["smooth"]
    sums = bands.groupBy(key).agg(*[F.sum(F.col(c) * F.col(c)).alias(c) for c in names])
    total = sum((F.col(c) for c in names[1:]), F.col(names[0]))
    return sums.select(key, *[(F.col(c) / (total + 1e-12)).alias(f"{c}_share") for c in names])


def reconstruction_error(vectors: DataFrame, k: int = 8, vector: str = "vector") -> DataFrame:
    """Mean squared distance of each window vector from its projection on the first k principal axes.

    Stands where a trained autoencoder would: windows unlike the usual ones reconstruct
    badly. The covariance is summed over the partitions; only the axes reach the driver.
    """
    size = F.size(vector)
    held = vectors.withColumn("_x", array_to_vector(F.col(vector)))
    model = PCA(k=k, inputCol="_x", outputCol="_p").fit(held)
    # the axes are orthonormal: what is lost is the squared length less that of the projection
    square = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v)
    projected = model.transform(held).withColumn("_a", vector_to_array("_p"))
    return projected.withColumn("error", F.greatest(square(F.col(vector)) - square(F.col("_a")), F.lit(0.0)) / size).drop("_a", "_p", "_x")


def min_max(value: str, key: str = "series_id") -> Column:
    w = whole(key)
    lo = F.min(value).over(w)
    return (F.col(value) - lo) / (F.max(value).over(w) - lo + 1e-12)


def fuse_scores(df: DataFrame, error: str, deviation: str, quantile: float = 0.90, key: str = "series_id") -> DataFrame:
    """Half the scaled error plus half the scaled robust distance of |deviation|; flagged above the series' quantile."""
    held = df.withColumn("_a", F.abs(deviation))
    med = held.groupBy(key).agg(F.percentile("_a", 0.5).alias("_med"))
    held = held.join(med, key)
    mad = held.groupBy(key).agg((F.percentile(F.abs(F.col("_a") - F.col("_med")), 0.5) + 1e-8).alias("_mad"))
    held = held.join(mad, key).withColumn("_z", F.abs(F.col("_a") - F.col("_med")) / (1.4826 * F.col("_mad")))
    held = held.withColumn("score", 0.5 * min_max(error, key) + 0.5 * min_max("_z", key))
    limit = held.groupBy(key).agg(F.percentile("score", quantile).alias("threshold"))
    return held.join(limit, key).withColumn("is_anomaly", (F.col("score") > F.col("threshold")).cast("int")).drop("_a", "_med", "_mad", "_z")
