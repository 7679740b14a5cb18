"""Regressions per series: temperature response, rolling stages, and the feature matrix they use."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import degree_days
from ..functions.periods import quarter_month
from ..session import stage
from ..sources.csv import keep_first, parse_csv_lines, rename_columns
from . import calendar as cal
from . import windows as wn
from .least_squares import finite_values, student_p, sweep
from .series import along, calendar_labels
from .stl import by_series, whole_series

# Comfort base, heating and cooling thresholds in degrees Celsius.
BASE, HEAT_BELOW, COOL_ABOVE = 18.0, 10.0, 25.0
# Features known after the first, second and third month of a quarter.
STAGES = {
    "stage_1": ["prev_gdp", "month1_yoy", "month1_cap_rate"],
    "stage_2": ["prev_gdp", "month1_yoy", "month2_yoy", "month2_cap_rate"],
    "stage_3": ["prev_gdp", "month1_yoy", "month2_yoy", "month3_yoy"],
}


def _huber(x: np.ndarray, y: np.ndarray, epsilon: float = 1.35, alpha: float = 1e-4, rounds: int = 200) -> tuple[np.ndarray, bool]:
    """Coefficients (intercept first) and scale jointly, by alternating weighted least squares and the scale equation, and whether they settled."""
    penalty = np.diag([0.0] + [alpha] * (x.shape[1] - 1))
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    scale = max(np.median(np.abs(y - x @ beta)), 1e-12)
    for _ in range(rounds):
        off = np.abs(y - x @ beta)
        far = off > epsilon * scale
        room = len(y) - epsilon**2 * far.sum()
        if room > 0 and (~far).any():
            scale = max(math.sqrt((off[~far] ** 2).sum() / room), 1e-12)
        w = np.where(off > epsilon * scale, epsilon * scale / np.maximum(off, 1e-300), 1.0)
        new = np.linalg.lstsq(x.T @ (w[:, None] * x) + scale * penalty, x.T @ (w * y), rcond=None)[0]
        if np.allclose(new, beta, rtol=1e-10, atol=1e-12):
            return new, True
        beta = new
    return beta, False


def _solve(m: dict[str, np.ndarray], method: str, both: bool, months: bool) -> tuple[np.ndarray, list[int], float, float]:
    """(coefficients, marked months, residual and total sum of squares) of one series from the sums of its months.

    Responses come first, month marks after; all sums are about the means of the series, so the intercept drops out.
    """
    names = ["a", "b"][:2 if both else 1]
    n = m["n"].sum()
    marks = [i for i, month in enumerate(m["month"]) if months and month > 1]
    size = len(names) + len(marks)
    xx, xy = np.zeros((size, size)), np.zeros(size)
    for i, p in enumerate(names):
        for j, q in enumerate(names):
            xx[i, j] = m[min(p, q) + max(p, q)].sum() - m[p].sum() * m[q].sum() / n
        xy[i] = m[p + "y"].sum() - m[p].sum() * m["y"].sum() / n
        for k, at in enumerate(marks, len(names)):
            xx[i, k] = xx[k, i] = m[p][at] - m[p].sum() * m["n"][at] / n
    for k, at in enumerate(marks, len(names)):
        xy[k] = m["y"][at] - m["n"][at] * m["y"].sum() / n
        for l, other in enumerate(marks, len(names)):
            xx[k, l] = m["n"][at] * (at == other) - m["n"][at] * m["n"][other] / n
    beta = np.linalg.solve(xx + np.eye(size), xy) if method == "ridge" else np.linalg.lstsq(xx, xy, rcond=1e-12)[0]
    total = m["yy"].sum() - m["y"].sum() ** 2 / n
    means = np.array([m[p].sum() for p in names] + [m["n"][at] for at in marks]) / n
    return np.concatenate([[m["y"].sum() / n - beta @ means], beta]), [int(m["month"][at]) for at in marks], total - 2 * beta @ xy + beta @ xx @ beta, total


def fit_temperature(df: DataFrame, method: str = "piecewise", months: bool = True, heat_below: float = HEAT_BELOW, cool_above: float = COOL_ABOVE,
                    key: str = "series_id", order: str = "period", value: str = "value", temp: str = "temp") -> DataFrame:
    """One row per series: method, n, intercept, heating, cooling or temperature slope, r_squared, month_coefs, converged.

    piecewise has separate heating and cooling slopes; linear, ridge (penalty 1) and huber
    have one. Month marks leave out January. Under 12 points the mean stands in.

    Least squares and ridge need sums per series and month only, which are combined before the shuffle; a task then solves one
    small system per series. Huber weighs single points and takes each series as a whole.
    """
    kinds = dict(df.dtypes)
    schema = f"{key} {kinds[key]}, method string, n long, intercept double, heating_coef double, cooling_coef double, temp_coef double, r_squared double, month_coefs map<int,double>, converged boolean"
    names = [f.split(" ")[0] for f in schema.split(", ")]
    both = method == "piecewise"

    def row(k, n: int, mean: float, beta: np.ndarray | None, marks: list[int], rest: float, total: float, converged: bool = True) -> dict:
        out = {key: k, "method": method, "n": n, "heating_coef": 0.0, "cooling_coef": 0.0, "temp_coef": 0.0, "r_squared": 0.0, "month_coefs": {}, "converged": converged}
        if beta is None:
            return out | {"method": "mean", "intercept": mean}
        slopes = {"heating_coef": beta[1], "cooling_coef": beta[2]} if both else {"temp_coef": beta[1]}
        return out | slopes | {"intercept": beta[0], "r_squared": 1 - rest / total if total > 0 else 0.0, "month_coefs": {m: float(b) for m, b in zip(marks, beta[2 + both:])}}

    def whole(k, pdf: pd.DataFrame) -> dict:
        y, t = pdf[value].to_numpy(float), pdf[temp].to_numpy(float)
        if len(y) < 12:
            return row(k, len(y), float(y.mean()), None, [], 0.0, 0.0)
        month = pd.to_datetime(pdf[order]).dt.month.to_numpy()
        marks = [m for m in range(2, 13) if months and (month == m).any()]
        x = np.hstack([np.ones((len(y), 1)), t[:, None], *[(month == m).astype(float)[:, None] for m in marks]])
        beta, converged = _huber(x, y)
        return row(k, len(y), 0.0, beta, marks, ((y - x @ beta) ** 2).sum(), ((y - y.mean()) ** 2).sum(), converged)

    def robust(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_series(batches, key):
            yield pd.DataFrame([whole(k, g) for k, g in pdf.groupby(key, sort=False)], columns=names)

    sums = ("month", "n", "y", "yy", "a", "aa", "ay", *(("b", "ab", "bb", "by") if both else ()))

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, cells in zip(pdf[key], pdf["cells"]):
                cells = sorted(cells, key=lambda c: c["month"])
                m = {s: np.array([c[s] for c in cells], float) for s in sums}
                n, mean = int(m["n"].sum()), float(m["y"].sum() / m["n"].sum())
                rows.append(row(k, n, mean, *(_solve(m, method, both, months) if n >= 12 else (None, [], 0.0, 0.0))))
            yield pd.DataFrame(rows, columns=names)

    pairs = df.select(key, order, F.col(value).cast("double").alias(value), temp).dropna(subset=[value, temp])
    if method == "huber":
        return by_series(pairs, key, order).mapInPandas(robust, schema)
    heat, cool = degree_days(F.col(temp), heat_below, cool_above)
    x = {"a": heat, "b": cool} if both else {"a": F.col(temp)}
    x["y"] = F.col(value)
    products = {p + q: x[p] * x[q] for p in x for q in x if p <= q} | x
    cells = pairs.groupBy(key, F.month(order).alias("month")).agg(F.count("*").alias("n"), *[F.sum(products[s]).alias(s) for s in sums if s in products])
    # at most twelve cells of a series are gathered
    return cells.groupBy(key).agg(F.collect_list(F.struct(*sums)).alias("cells")).mapInPandas(summed, schema)


def temperature_correct(df: DataFrame, model: DataFrame, heat_below: float = HEAT_BELOW, cool_above: float = COOL_ABOVE,
                        key: str = "series_id", value: str = "value", temp: str = "temp") -> DataFrame:
    """Adds temp_effect and corrected; rows without value or temperature are left out. Linear, ridge and huber subtract slope times temperature."""
    heat, cool = degree_days(F.col(temp), heat_below, cool_above)
    coefs = model.select(key, "heating_coef", "cooling_coef", "temp_coef")
    out = df.dropna(subset=[value, temp]).join(coefs, key)
    effect = F.col("heating_coef") * heat + F.col("cooling_coef") * cool + F.col("temp_coef") * F.col(temp)
    return out.withColumn("temp_effect", effect).withColumn("corrected", F.col(value) - F.col("temp_effect")).drop("heating_coef", "cooling_coef", "temp_coef")


def apply_corrections(daily: DataFrame, holidays: DataFrame, method: str = "piecewise", key: str = "series_id", order: str = "period", value: str = "value", temp: str = "temp") -> DataFrame:
    """Temperature, then holidays, then weekdays; every stage stays as a column."""
    step = temperature_correct(daily, fit_temperature(daily, method, key=key, order=order, value=value, temp=temp), key=key, value=value, temp=temp)
    step = stage(step.withColumnRenamed("corrected", "temp_corrected").drop("temp_effect"))
    named = holidays.select(F.col("day").alias(order), F.lit(True).alias("_h"))
    step = step.join(named, order, "left").withColumn("is_holiday", F.coalesce("_h", F.lit(False))).drop("_h")
    step = stage(cal.smooth_holidays(step, "is_holiday", "temp_corrected", "holiday_smoothed", key=key, order=order))
    step = cal.weekday_adjust(step, "holiday_smoothed", "weekday_adjusted", key, order)
    return step.withColumn("final_corrected", F.col("weekday_adjusted"))


def quarter_panel(monthly: DataFrame, gdp: DataFrame, key: str = "series_id", order: str = "period") -> DataFrame:
    """(key, quarter, prev_gdp, month1..3_yoy, month1..3_cap_rate, gdp).

    ``monthly`` carries yoy and cap_rate; ``gdp`` has one row per quarter start. Months are
    placed by conditional aggregation, so the pivot needs no list of values.
    """
    held = monthly.withColumn("quarter", F.to_date(F.date_trunc("quarter", order))).withColumn("_m", quarter_month(F.col(order)))
    cells = [F.max(F.when(F.col("_m") == m, F.col(c))).alias(f"month{m}_{name}") for m in (1, 2, 3) for c, name in (("yoy", "yoy"), ("cap_rate", "cap_rate"))]
    wide = held.groupBy(key, "quarter").agg(*cells)
    before = gdp.select(F.add_months("quarter", 3).alias("quarter"), F.col("gdp").alias("prev_gdp"))
    return wide.join(gdp.select("quarter", "gdp"), "quarter", "left").join(before, "quarter", "left").select(
        key, "quarter", "prev_gdp", *[f"month{m}_{n}" for n in ("yoy", "cap_rate") for m in (1, 2, 3)], "gdp")


def rolling_stages(panel: DataFrame, stages: Mapping[str, Sequence[str]] = STAGES, window: int = 9, key: str = "series_id", order: str = "quarter", target: str = "gdp") -> DataFrame:
    """Least squares on the ``window`` quarters before each quarter, per stage.

    (key, quarter, stage, prediction, actual, r_squared, rmse, n_train, train_start, train_end,
    coefficients, t_values, p_values). Quarters with too few complete rows, or features that depend on one another, are left out.

    All moments of a stage are sums over one row frame, and the system is solved by sweeping them in an array: one shuffle by series, no Python.
    """
    frame = along(key, order).rowsBetween(-window, -1)
    out = []
    for stage, features in stages.items():
        p = len(features)
        names = [*features, target]
        full = finite_values(names)
        x = [F.when(full, F.col(n).cast("double")) for n in names]
        sums = {f"_s{i}": F.sum(x[i]).over(frame) for i in range(p + 1)} | {f"_c{i}_{j}": F.sum(x[i] * x[j]).over(frame) for i in range(p + 1) for j in range(i, p + 1)}
        rows = panel.select(
            key, F.col(order).alias("quarter"), *names, finite_values(features).alias("_whole"), F.count(F.when(full, 1)).over(frame).cast("int").alias("n_train"), F.count(F.lit(1)).over(frame).alias("_rows"),
            F.min(order).over(frame).alias("train_start"), F.max(order).over(frame).alias("train_end"), *[c.alias(n) for n, c in sums.items()])
        rows = rows.filter(F.col("_whole") & (F.col("_rows") == window) & (F.col("n_train") >= p + 1))
        w = p + 1
        at = lambda i, j: f"_c{min(i, j)}_{max(i, j)}"
        moments = F.array(*[F.col(at(i, j)) - F.col(f"_s{i}") * F.col(f"_s{j}") / F.col("n_train") for i in range(w) for j in range(w)])
        rows = rows.select(key, "quarter", *names, "n_train", "train_start", "train_end", moments.alias("_moments"), *[(F.col(f"_s{i}") / F.col("n_train")).alias(f"_m{i}") for i in range(w)])
        rows = rows.withColumn("_swept", sweep(F.col("_moments"), p)).filter(F.get("_swept", F.lit(w * w - 1)).isNotNull())
        beta = [F.get("_swept", F.lit(i * w + p)) for i in range(p)]
        dof, rest = F.col("n_train") - p - 1, F.greatest(F.get("_swept", F.lit(w * w - 1)), F.lit(0.0))
        spread = F.when(dof > 0, rest / dof)
        inverse = lambda i, j: -F.get("_swept", F.lit(i * w + j))
        level = F.col(f"_m{p}") - sum((b * F.col(f"_m{i}") for i, b in enumerate(beta)), F.lit(0.0))
        around = sum((F.col(f"_m{i}") * F.col(f"_m{j}") * inverse(i, j) for i in range(p) for j in range(p)), F.lit(0.0))
        errors = [F.sqrt(spread * (1 / F.col("n_train") + around)), *[F.sqrt(spread * inverse(i, i)) for i in range(p)]]
        labels = ["const", *features]
        rows = rows.withColumns({"_b0": level} | {f"_b{i + 1}": b for i, b in enumerate(beta)} | {f"_e{i}": e for i, e in enumerate(errors)} | {"_dof": dof, "_rest": rest, "_spread": spread, "_total": F.get("_moments", F.lit(w * w - 1))})
        count, listed = range(p + 1), F.array(*[F.lit(n) for n in labels])
        rows = rows.withColumn("_t", F.array(*[F.when(F.col(f"_e{i}") > 0, F.col(f"_b{i}") / F.col(f"_e{i}")) for i in count]))
        out.append(rows.select(
            key, "quarter", F.lit(stage).alias("stage"), (F.col("_b0") + sum((F.col(f"_b{i + 1}") * F.col(f) for i, f in enumerate(features)), F.lit(0.0))).alias("prediction"),
            F.when(finite_values([target]), F.col(target)).alias("actual"), F.when(F.col("_total") > 0, 1 - F.col("_rest") / F.col("_total")).alias("r_squared"), F.sqrt("_spread").alias("rmse"), "n_train", "train_start", "train_end",
            F.map_from_arrays(listed, F.array(*[F.col(f"_b{i}") for i in count])).alias("coefficients"), F.map_from_arrays(listed, "_t").alias("t_values"),
            F.map_from_arrays(listed, F.transform("_t", lambda t: student_p(t, F.col("_dof")))).alias("p_values")))
    return reduce(lambda a, b: a.unionByName(b), out)


def coefficient_history(fits: DataFrame, key: str = "series_id") -> DataFrame:
    """One row per series, quarter, stage and coefficient."""
    return fits.select(key, "quarter", "stage", F.explode("coefficients").alias("name", "coefficient"), "t_values", "p_values").select(
        key, "quarter", "stage", "name", "coefficient", F.col("t_values")[F.col("name")].alias("t_value"), F.col("p_values")[F.col("name")].alias("p_value"))


def rolling_line(panel: DataFrame, stage: str, feature: str, window: int = 9, key: str = "series_id", order: str = "quarter", target: str = "gdp") -> DataFrame:
    """One-feature form of ``rolling_stages`` by window aggregates alone."""
    w = along(key, order).rowsBetween(-window, -1)
    pair = F.when(F.col(feature).isNotNull() & F.col(target).isNotNull(), 1)
    enough = (F.count(F.lit(1)).over(w) == window) & (F.count(pair).over(w) >= 3)
    slope, level = F.regr_slope(F.col(target), F.col(feature)).over(w), F.regr_intercept(F.col(target), F.col(feature)).over(w)
    out = panel.select(key, order, F.lit(stage).alias("stage"), F.col(target).alias("actual"), F.when(enough, slope).alias("slope"), F.when(enough, level + slope * F.col(feature)).alias("prediction"))
    return out.filter(F.col("prediction").isNotNull())


def feature_matrix(df: DataFrame, temp: str | None = "temp", shares: DataFrame | None = None, value: str = "value", key: str = "series_id", order: str = "period") -> DataFrame:
    """Growth, smoothing, increments, temperature, calendar labels, difference, and sector shares side by side.

    Every window partitions by the series, so the whole matrix takes one shuffle.
    """
    out = wn.cumulative_growth(df.select(key, order, F.col(value).alias("consumption"), *([temp] if temp else [])), "consumption", "consumption_cumulative_yoy", key, order)
    out = wn.net_increment(out, "consumption", key=key, order=order)
    out = out.select(
        "*", wn.lag_growth("consumption", 12, key, order).alias("consumption_yoy"), wn.lag_growth("consumption", 1, key, order).alias("consumption_mom"),
        *[wn.moving_average("consumption", w, True, key, order).alias(f"consumption_ma_{w}") for w in (3, 6, 12)],
        *[wn.rolling_stat("consumption", w, s, key, order).alias(f"roll_{w}_{s}") for w in (3, 6, 12) for s in ("mean", "std")],
        wn.difference("consumption", key, order).alias("consumption_diff"), *calendar_labels(F.col(order)), F.quarter(order).alias("season"))
    if temp:
        hdd, cdd = degree_days(F.col(temp), HEAT_BELOW, COOL_ABOVE)
        out = out.select("*", (F.col(temp) - BASE).alias("temperature_deviation"), hdd.alias("hdd"), cdd.alias("cdd"),
                         (F.col(temp) < HEAT_BELOW).cast("int").alias("is_heating_season"), (F.col(temp) > COOL_ABOVE).cast("int").alias("is_cooling_season"))
    return out.join(shares, order, "left") if shares is not None else out


def clean_lines(lines: DataFrame, text: str, schema: str, aliases: Mapping[str, list[str]], types: Mapping[str, str], columns: list[str],
                key: str = "series_id", order: str = "period", strategy: str = "interpolate", freq: str = "daily", sequence: str = "seq") -> DataFrame:
    """CSV text to a clean regular series: parse, rename, first of repeats, spine, fill, mark outliers, handle them."""
    from .joins import regular

    parsed = rename_columns(parse_csv_lines(lines, text, schema), aliases, types)
    once = keep_first(parsed, [key, order], sequence).drop(sequence)
    full = wn.auto_fill(regular(once, freq, key, order), columns, key, order, drop_above=100.0)
    for c in columns:
        full = wn.handle_outliers(wn.rolling_zscore_outlier(full, c, key=key, order=order), strategy, c, "is_outlier", key, order).drop("z", "is_outlier")
    return full
