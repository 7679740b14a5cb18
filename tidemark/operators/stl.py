"""Seasonal-trend decomposition by LOESS (Cleveland et al., 1990) for many series at once.

Spark partitions and sorts the points by series; one series is a calendar-long array, so
what a task holds at a time is bounded by the calendar. The fit is a numpy helper inside
the task that takes all series of equal length in a batch at once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Smoothing spans of the monthly and quarterly models.
MONTHLY = {"period": 12, "seasonal": 13, "trend": 21, "low_pass": 13}
QUARTERLY = {"period": 4, "seasonal": 7, "trend": 9, "low_pass": 5}
ANNUAL = {"period": 5, "seasonal": 7, "trend": 9, "low_pass": 7}
BATCH = 256  # series fitted as one matrix


def _loess(y: np.ndarray, span: int, at: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Local linear fits of rows of ``y`` (series x points, abscissae 1..n) at whole positions ``at``.

    All positions are fitted together: each has its window of the ``span`` nearest points.
    """
    n = y.shape[1]
    q = min(span, n)
    left = np.clip(np.floor(at).astype(int) - (q + 1) // 2, 0, n - q)
    idx = left[:, None] + np.arange(q)
    x = idx + 1.0
    dist = np.abs(x - at[:, None])
    reach = np.maximum(at - x[:, 0], x[:, -1] - at)
    if span > n:
        reach = reach + (span - n) // 2
    base = np.where(dist <= 0.999 * reach[:, None], np.where(dist <= 0.001 * reach[:, None], 1.0, (1 - (dist / np.maximum(reach, 1e-300)[:, None]) ** 3) ** 3), 0.0)
    w = base[None] if weights is None else base[None] * weights[:, idx]
    total = w.sum(2)
    usable = total > 0
    w = w / np.where(usable, total, 1.0)[..., None]
    centre = (w * x).sum(2)
    shift = at - centre
    spread = (w * (x - centre[..., None]) ** 2).sum(2)
    tilt = np.where((np.sqrt(spread) > 0.001 * (n - 1)) & (reach > 0), shift / np.where(spread > 0, spread, 1.0), 0.0)
    w = w * (tilt[..., None] * (x - centre[..., None]) + 1.0)
    out = (w * y[:, idx]).sum(2)
    # where robust weights leave nothing in the window, the point stands for itself
    return np.where(usable, out, y[:, at.astype(int) - 1])


def _mean_filter(x: np.ndarray, width: int) -> np.ndarray:
    c = np.cumsum(np.concatenate([np.zeros((len(x), 1)), x], axis=1), axis=1)
    return (c[:, width:] - c[:, :-width]) / width


def _seasonal_pass(d: np.ndarray, period: int, span: int, weights: np.ndarray | None) -> np.ndarray:
    """Each cycle position smoothed over the cycles and carried one cycle past both ends."""
    m, n = d.shape
    out = np.empty((m, n + 2 * period))
    sizes = [(n - p - 1) // period + 1 for p in range(period)]
    for k in sorted(set(sizes)):
        rows = [p for p in range(period) if sizes[p] == k]
        y = np.concatenate([d[:, p::period] for p in rows])
        w = None if weights is None else np.concatenate([weights[:, p::period] for p in rows])
        inner = _loess(y, span, np.arange(1.0, k + 1), w)
        # one step beyond either end uses the outermost window as it stands
        first = _edge(y, span, 0.0, 0, w, inner[:, 0])
        last = _edge(y, span, k + 1.0, max(0, k - span), w, inner[:, -1])
        full = np.concatenate([first[:, None], inner, last[:, None]], axis=1)
        for i, p in enumerate(rows):
            out[:, p::period] = full[i * m:(i + 1) * m]
    return out


def _edge(y: np.ndarray, span: int, at: float, left: int, weights: np.ndarray | None, fallback: np.ndarray) -> np.ndarray:
    n = y.shape[1]
    q = min(span, n)
    part = slice(left, left + q)
    x = np.arange(left, left + q) + 1.0
    reach = max(at - x[0], x[-1] - at)
    if span > n:
        reach += (span - n) // 2
    dist = np.abs(x - at)
    w = np.where(dist <= 0.999 * reach, np.where(dist <= 0.001 * reach, 1.0, (1 - (dist / reach) ** 3) ** 3), 0.0)[None]
    if weights is not None:
        w = w * weights[:, part]
    w = np.broadcast_to(w, (y.shape[0], q))
    total = w.sum(1)
    usable = total > 0
    w = w / np.where(usable, total, 1.0)[:, None]
    centre = (w * x).sum(1)
    spread = (w * (x - centre[:, None]) ** 2).sum(1)
    tilt = np.where(np.sqrt(spread) > 0.001 * (n - 1), (at - centre) / np.where(spread > 0, spread, 1.0), 0.0)
    w = w * (tilt[:, None] * (x - centre[:, None]) + 1.0)
    return np.where(usable, (w * y[:, part]).sum(1), fallback)


def odd_above(x: float) -> int:
    k = math.ceil(x)
    return k if k % 2 else k + 1


def complete(spans: dict[str, int]) -> dict[str, int]:
    """Trend and low-pass spans that follow from the others when not given."""
    period, seasonal = spans["period"], spans["seasonal"]
    return {"period": period, "seasonal": seasonal, "trend": spans.get("trend") or odd_above(1.5 * period / (1 - 1.5 / seasonal)),
            "low_pass": spans.get("low_pass") or odd_above(period + 1)}


def fits(spans: dict[str, int]) -> bool:
    """Spans must be odd and at least 3, and trend and low-pass longer than the cycle."""
    s = complete(spans)
    return s["period"] >= 2 and all(s[k] >= 3 and s[k] % 2 for k in ("seasonal", "trend", "low_pass")) and min(s["trend"], s["low_pass"]) > s["period"]


def decompose(y: np.ndarray, spans: dict[str, int], robust: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trend, seasonal, residual) of equally long series held as rows."""
    y = np.atleast_2d(np.asarray(y, dtype=float))
    if not fits(spans):
        raise ValueError(f"spans do not fit together: {spans}")
    s = complete(spans)
    period, n = s["period"], y.shape[1]
    every = np.arange(1.0, n + 1)
    level, cycle, weights = np.zeros_like(y), np.zeros_like(y), None
    for _ in range(16 if robust else 1):
        for _ in range(2 if robust else 5):
            c = _seasonal_pass(y - level, period, s["seasonal"], weights)
            low = _loess(_mean_filter(_mean_filter(_mean_filter(c, period), period), 3), s["low_pass"], every)
            cycle = c[:, period:period + n] - low
            level = _loess(y - cycle, s["trend"], every, weights)
        if robust:
            off = np.abs(y - level - cycle)
            limit = 6 * np.median(off, axis=1, keepdims=True)
            share = off / np.where(limit > 0, limit, 1.0)
            bisquare = np.where(share <= 0.001, 1.0, np.where(share <= 0.999, (1 - share**2) ** 2, 0.0))
            weights = np.where(limit > 0, bisquare, 1.0)
    return level, cycle, y - level - cycle


def short_spans(n: int) -> dict[str, int]:
    """Spans for a monthly series of fewer than 24 points."""
    period = min(12, max(2, n // 3))
    season = min(n - 1, 7)
    season -= season % 2 == 0
    level = min(n, 13)
    level -= level % 2 == 0
    if level <= period:
        level = odd_above(period + 2)
    return {"period": period, "seasonal": max(5, season), "trend": max(5, level), "low_pass": max(5, season)}


def fallback_spans(n: int) -> dict[str, int]:
    """Second attempt when the first spans do not fit together."""
    period = max(2, n // 4)
    return {"period": period, "seasonal": max(3, min(5, n - 1)), "trend": odd_above(period + 2), "low_pass": max(3, min(5, n - 1))}


def monthly_spans(n: int) -> list[dict[str, int]]:
    return [short_spans(n) if n < 24 else MONTHLY, fallback_spans(n)]


def cycle_spans(period: int) -> Callable[[int], list[dict[str, int]]]:
    """Spans by cycle length; the trend and low-pass spans follow from it."""
    season = 13 if period >= 12 else max(7, period + 1)
    return lambda n: [{"period": period, "seasonal": season + (season % 2 == 0)}]


def fixed_spans(spans: dict[str, int]) -> Callable[[int], list[dict[str, int]]]:
    return lambda n: [spans]


def by_series(df: DataFrame, key: str, order: str) -> DataFrame:
    """One series after the other within a partition.

    The number of partitions is stated, as otherwise tiny but slow-to-fit series would
    be merged by size into a few tasks.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, key).sortWithinPartitions(key, order)


def whole_series(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Regroup Arrow batches so that no series is cut; only the open series is carried on."""
    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if pdf.empty:
            continue
        open_one = pdf[key] == pdf[key].iloc[-1]
        rest = pdf[open_one]
        if not open_one.all():
            yield pdf[~open_one]
    if rest is not None and not rest.empty:
        yield rest


def stl(df: DataFrame, spans: Callable[[int], list[dict[str, int]]], least: int, log: bool | None = None, robust: bool = True,
        key: str = "series_id", order: str = "period", value: str = "value") -> DataFrame:
    """Decompose every series of at least ``least`` finite points.

    ``spans`` lists the settings to try for a length; the first that fits is used. ``log``
    None takes logs when every value is positive. Components are on the scale that was
    fitted; ``expected`` and ``residual_pct`` (share of |expected|) are on the original
    one. Series of one length in a batch are fitted together as a matrix.
    """
    kinds = dict(df.dtypes)
    schema = (f"{key} {kinds[key]}, {order} {kinds[order]}, value double, trend double, seasonal double, residual double, "
              "expected double, residual_pct double, use_log boolean, cycle int")

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_series(batches, key):
            groups: dict[tuple[int, bool], list[np.ndarray]] = {}
            values = pdf["value"].to_numpy(dtype=float)
            for at in pdf.groupby(key, sort=False).indices.values():
                positive = bool((values[at] > 0).all())
                groups.setdefault((len(at), positive if log is None else log and positive), []).append(at)
            for (n, use_log), members in groups.items():
                usable = [s for s in spans(n) if n >= max(least, 2 * s["period"]) and fits(s)]
                if not usable:
                    continue
                for part in (members[i:i + BATCH] for i in range(0, len(members), BATCH)):
                    at = np.stack(part)
                    y = values[at]
                    level, cycle, rest = decompose(np.log(y) if use_log else y, usable[0], robust)
                    expected = np.exp(level + cycle) if use_log else level + cycle
                    share = np.divide(y - expected, np.abs(expected), out=np.zeros_like(y), where=np.abs(expected) > 1e-12)
                    flat = pdf.iloc[at.ravel()]
                    yield pd.DataFrame({
                        key: flat[key].to_numpy(), order: flat[order].to_numpy(), "value": y.ravel(), "trend": level.ravel(), "seasonal": cycle.ravel(), "residual": rest.ravel(),
                        "expected": expected.ravel(), "residual_pct": share.ravel(), "use_log": use_log, "cycle": usable[0]["period"]})

    points = df.select(key, order, F.col(value).alias("value")).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    return by_series(points, key, order).mapInPandas(fit, schema)


def rejected(df: DataFrame, spans: Callable[[int], list[dict[str, int]]], least: int, key: str = "series_id", value: str = "value") -> DataFrame:
    """(key, n, reason) for every series that :func:`stl` leaves out: too few points, or none of its settings fits the length."""
    sizes = df.groupBy(key).agg(F.count_if(F.col(value).isNotNull() & ~F.isnan(value)).alias("n"))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fine = [any(n >= max(least, 2 * s["period"]) and fits(s) for s in spans(n)) for n in pdf["n"]]
            short = pdf[~np.array(fine, bool)]
            yield short.assign(reason=[f"no setting fits {n} points" for n in short["n"]])

    return sizes.mapInPandas(judge, f"{key} {dict(df.dtypes)[key]}, n long, reason string")
