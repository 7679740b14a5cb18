"""Weather and calendar effects out of daily series, and the decoupled signal."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import degree_days
from ..session import stage
from . import stl
from .decompose import scale_bands
from .joins import nearest_start
from .windows import remove_climatology, rolling_median_deviation

SPAN = 21  # days around the festival with their own effect


def daily_inputs(daily: DataFrame, holidays: DataFrame, festivals: DataFrame, temperature: Callable[[Column], Column], base: float = 18.0) -> DataFrame:
    """(series_id, period, value, log_value, cdd, hdd, is_weekend, is_holiday, days_to_start).

    Calendar facts are worked out once per calendar day and joined as a small dimension.
    """
    days = daily.select("period").distinct()
    near = nearest_start(days, "period", festivals, "first_day")
    named = holidays.select(F.col("day").alias("period"), F.lit(1).alias("is_holiday"))
    temp = temperature(F.col("period"))
    hdd, cdd = degree_days(temp, base - 8, base + 6)
    facts = near.join(named, "period", "left").select(
        "period", cdd.alias("cdd"), hdd.alias("hdd"), (F.weekday("period") >= 5).cast("int").alias("is_weekend"),
        F.coalesce("is_holiday", F.lit(0)).alias("is_holiday"), "days_to_start")
    positive = F.col("value") > 0
    held = daily.select("series_id", "period", "value", F.when(positive, F.ln("value")).alias("log_value"), F.when(F.coalesce(~positive, F.lit(True)), "value is not positive").alias("reason"))
    return held.join(facts, "period", "left")


def remove_confounders(df: DataFrame, key: str = "series_id", order: str = "period") -> DataFrame:
    """Adds weather_effect, calendar_effect, economic_signal and r_squared; rows without a log value keep NULL there.

    Least squares of the log value on degree days, weekend, holiday and one mark per day
    around the festival. The marks are fixed effects: sums of squares and products per (series, mark),
    combined before the shuffle, are all a fit needs, so a task solves one system of four
    per series, and what it found is joined back. Constant columns get no weight (minimum-norm solution).
    """
    known = ["cdd", "hdd", "is_weekend", "is_holiday"]
    mark = F.when(F.abs("days_to_start") <= SPAN, F.col("days_to_start"))
    held = df.withColumn("_mark", mark.cast("int"))
    terms = {"y": F.col("log_value")} | {c: F.col(c).cast("double") for c in known}
    names = list(terms)
    pairs = [(p, q) for i, p in enumerate(names) for q in names[i:]]
    cells = held.filter("log_value IS NOT NULL").groupBy(key, "_mark").agg(
        F.count("*").cast("double").alias("n"), *[F.sum(v).alias(f"s_{c}") for c, v in terms.items()], *[F.sum(terms[p] * terms[q]).alias(f"p_{p}_{q}") for p, q in pairs])
    # at most 2 * SPAN + 2 cells of a series are gathered
    gathered = cells.groupBy(key).agg(F.collect_list(F.struct("_mark", "n", *[c for c in cells.columns if c[:2] in ("s_", "p_")])).alias("cells"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, found in zip(pdf[key], pdf["cells"]):
                base = sorted(found, key=lambda c: (c["_mark"] is not None, c["_mark"] or 0))
                n = np.array([c["n"] for c in base])
                sums = np.array([[c[f"s_{t}"] for t in names] for c in base])
                cross = np.zeros((len(names), len(names)))
                for i, p in enumerate(names):
                    for j, q in enumerate(names):
                        name = f"p_{p}_{q}" if i <= j else f"p_{q}_{p}"
                        cross[i, j] = sum(c[name] for c in base)
                within = cross - (sums / n[:, None]).T @ sums
                scale = np.sqrt(np.maximum(np.diag(within)[1:], 1e-300))
                flat = np.diag(within)[1:] <= 1e-10 * np.maximum(np.diag(cross)[1:], 1e-300)
                use = np.flatnonzero(~flat)
                beta = np.zeros(len(known))
                if len(use):
                    beta[use] = np.linalg.lstsq(within[1:, 1:][np.ix_(use, use)] / np.outer(scale[use], scale[use]), within[1:, 0][use] / scale[use], rcond=1e-10)[0] / scale[use]
                level = (sums[:, 0] - sums[:, 1:] @ beta) / n
                rest = within[0, 0] - 2 * beta @ within[1:, 0] + beta @ within[1:, 1:] @ beta
                total = cross[0, 0] - sums[:, 0].sum() ** 2 / n.sum()
                rows.append((k, *beta, {int(c["_mark"]): float(v - level[0]) for c, v in zip(base, level) if c["_mark"] is not None}, 1 - rest / total if total > 0 else 0.0))
            yield pd.DataFrame(rows, columns=[key, *[f"b_{c}" for c in known], "marks", "r_squared"])

    kind = dict(df.dtypes)[key]
    coefs = gathered.mapInPandas(solve, f"{key} {kind}, " + ", ".join(f"b_{c} double" for c in known) + ", marks map<int,double>, r_squared double")
    out = held.join(coefs, key, "left")
    fitted = lambda some: reduce(lambda a, b: a + b, [F.col(f"b_{c}") * F.col(c) for c in some])
    there = F.col("log_value").isNotNull()
    weather = F.when(there, fitted(known[:2]))
    calendar = F.when(there, fitted(known[2:]) + F.coalesce(F.element_at("marks", F.col("_mark")), F.lit(0.0)))
    out = out.withColumn("weather_effect", weather).withColumn("calendar_effect", calendar)
    signal = F.col("log_value") - F.col("weather_effect") - F.col("calendar_effect")
    return out.select(*df.columns, "weather_effect", "calendar_effect", signal.alias("economic_signal"), F.when(there, F.col("r_squared")).alias("r_squared"))


def decouple(df: DataFrame, period: int = 7, key: str = "series_id", order: str = "period") -> DataFrame:
    """Effects removed, yearly profile removed, weekly decomposition, detail bands, distance from the long median. Days without a signal are left out of all of them and come back with their reason."""
    every = stage(remove_confounders(df, key, order))
    signal = every.filter("economic_signal IS NOT NULL")
    flat = remove_climatology(signal.select(key, order, "log_value", "weather_effect", "calendar_effect", "economic_signal"), "economic_signal", key=key, order=order)
    flat = stage(flat.withColumn("economic_signal", F.col("adjusted")).drop("adjusted", "climatology"))
    cycle = max(period, 7)
    parts = stl.stl(flat, stl.cycle_spans(cycle), 2 * cycle, log=False, value="economic_signal").select(
        key, order, F.col("trend").alias("economic_trend"), F.col("seasonal").alias("seasonal_residual"), F.col("residual").alias("economic_residual"))
    joined = flat.join(parts, [key, order]).withColumn("fluctuation", F.col("economic_signal") - F.col("economic_trend"))
    banded = scale_bands(joined, 4, "fluctuation", key, order).withColumnRenamed("band_1", "high_frequency").drop("band_2", "band_3", "band_4", "smooth", "fluctuation")
    out = rolling_median_deviation(banded, "economic_signal", key=key, order=order).drop("baseline").withColumnRenamed("deviation", "economic_deviation")
    lost = every.filter("economic_signal IS NULL").select(key, order, "reason")
    return out.withColumn("reason", F.lit(None).cast("string")).unionByName(lost, allowMissingColumns=True)
