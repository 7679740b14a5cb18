"""Decomposition against published component values; inputs are typed in."""

import numpy as np
import pytest

from tidemark.operators import decompose as dc
from tidemark.operators import stl

# 51 months from 2021-01, unit 10^8 kWh.
MONTHS = [
    465.5998, 256.1031, 447.4071, 433.6378, 452.5544, 478.0096, 562.7703, 561.889, 512.2877, 430.1101, 437.2489, 476.4931,
    431.338, 375.7401, 474.8464, 430.5708, 438.4435, 485.2202, 624.9475, 627.5656, 483.3107, 464.215, 449.4513, 513.6992,
    341.1477, 442.2964, 506.4951, 467.4495, 488.2146, 532.5154, 655.4505, 635.7354, 557.714, 496.797, 497.0234, 571.1593,
    551.6544, 354.7761, 540.4192, 508.683, 524.8685, 538.9814, 718.6396, 739.5127, 637.4285, 532.8752, 526.9564, 606.0565,
    485.8246, 460.3528, 580.978,
]
# 24 years from 2000, unit 10^4 kWh.
YEARS = [1377395, 1484439, 1620788, 1840333, 2072997, 2466661, 2705710, 2991293, 3107922, 3370545, 3736638, 3997431,
         4249554, 4626718, 4704973, 4951753, 5247863, 5569607, 6064005, 6215283, 6329425, 6835698, 7244555, 7472669]
SHORT = [269.44, 155.98, 143.87, 148.56, 163.99, 201.33, 208.47, 187.19, 160.44, 152.89, 165.39, 288.76, 162.21, 153.54]


def test_monthly_components():
    trend, season, rest = (x[0] for x in stl.decompose(np.array(MONTHS), stl.MONTHLY))
    assert trend[:3] == pytest.approx([452.6273, 454.5369, 456.4449], abs=1e-3)
    assert season[:3] == pytest.approx([-27.0036, -94.6457, -7.1157], abs=1e-3)
    assert trend[-1] == pytest.approx(587.4315, abs=1e-3) and rest[36] == pytest.approx(84.9755, abs=1e-3)
    assert (trend + season + rest) == pytest.approx(MONTHS)


def test_published_summary():
    trend, season, rest = (x[0] for x in stl.decompose(np.array(MONTHS), stl.MONTHLY))
    pct = np.abs(rest / trend * 100)
    assert ((pct >= 10).sum(), ((pct >= 6) & (pct < 10)).sum()) == (5, 5)
    assert (trend[-1] / trend[0] - 1) * 100 == pytest.approx(29.78, abs=0.01)
    assert 1 - rest.var() / (rest + trend).var() == pytest.approx(0.681, abs=1e-3)
    assert 1 - rest.var() / (rest + season).var() == pytest.approx(0.8539, abs=1e-3)


def test_annual_components():
    trend, season, _ = (x[0] for x in stl.decompose(np.array(YEARS, float), stl.ANNUAL))
    assert trend[0] == pytest.approx(1175914.46, abs=0.02) and season[0] == pytest.approx(202306.99, abs=0.02)
    assert trend[-1] == pytest.approx(7351298.24, abs=0.02)


def test_short_series_spans():
    assert stl.short_spans(14) == {"period": 4, "seasonal": 7, "trend": 13, "low_pass": 7}
    trend, season, _ = (x[0] for x in stl.decompose(np.array(SHORT), stl.short_spans(14)))
    assert trend[:2] == pytest.approx([165.048, 167.8027], abs=1e-3)
    assert season[:2] == pytest.approx([104.3741, -11.8252], abs=1e-3)


def test_spans_must_fit():
    with pytest.raises(ValueError):
        stl.decompose(np.array(MONTHS), {"period": 12, "seasonal": 13, "trend": 9})


def test_many_series_in_one_pass(spark, series):
    both = series(MONTHS, "x", start="2021-01-01").unionByName(series([v * 2 for v in MONTHS], "y", start="2021-01-01")).unionByName(series(SHORT, "short"))
    out = stl.stl(both, stl.fixed_spans(stl.MONTHLY), 24, log=False).toPandas().sort_values(["series_id", "period"])
    assert set(out.series_id) == {"x", "y"}
    x, y = (out[out.series_id == k].trend.to_numpy() for k in "xy")
    assert x[0] == pytest.approx(452.6273, abs=1e-3) and y == pytest.approx(2 * x)


def test_series_cut_across_batches(spark, series):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = stl.stl(series(MONTHS, "x"), stl.fixed_spans(stl.MONTHLY), 24, log=False)
        assert out.count() == len(MONTHS)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_classical_adds_up(series):
    out = dc.classical(series(MONTHS)).toPandas()
    assert (np.exp(out.trend + out.seasonal + out.residual)).to_numpy() == pytest.approx(out.value.to_numpy())
    assert out.groupby(out.period.map(lambda d: d.month)).seasonal.first().sum() == pytest.approx(0, abs=1e-9)


def test_strengths_within_bounds(series):
    row = dc.strengths(dc.classical(series(MONTHS))).first()
    assert 0 <= row.trend_strength <= 1 and 0 <= row.seasonal_strength <= 1


def test_windows_emptied_by_robust_weights_stay_finite():
    y = np.ones(60)
    y[20:45] = 50 + np.arange(25) * 7.0
    out = stl.decompose(y, {"period": 4, "seasonal": 7})
    assert all(np.isfinite(x).all() for x in out)
