"""Coefficient recovery and chains."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import diagnose as dg
from tidemark.operators import models as md
from tidemark.operators.least_squares import student_p


@pytest.fixture(scope="module")
def weather(spark):
    rng = np.random.default_rng(0)
    when = pd.date_range("2018-01-01", periods=72, freq="MS")
    temp = 17 + 14 * np.sin(2 * np.pi * (np.arange(72) - 3) / 12) + rng.normal(0, 2, 72)
    value = 1000 + 12 * np.maximum(0, 10 - temp) + 20 * np.maximum(0, temp - 25) + rng.normal(0, 1, 72)
    pdf = pd.DataFrame({"series_id": "a", "period": when.date, "value": value, "temp": temp})
    return pdf, spark.createDataFrame(pdf)


def test_piecewise_recovery(weather):
    row = md.fit_temperature(weather[1], months=False).first()
    assert row.heating_coef == pytest.approx(12, abs=0.5) and row.cooling_coef == pytest.approx(20, abs=0.5) and row.r_squared > 0.99


def test_correction_removes_the_effect(weather):
    out = md.temperature_correct(weather[1], md.fit_temperature(weather[1], months=False)).toPandas()
    assert abs(np.corrcoef(out.corrected, np.abs(out.temp - 17))[0, 1]) < 0.3


def test_huber_resists_outliers(spark):
    rng = np.random.default_rng(1)
    t = rng.uniform(0, 30, 120)
    y = 5 + 2 * t + rng.normal(0, 0.5, 120)
    y[:6] += 500
    df = spark.createDataFrame(pd.DataFrame({"series_id": "a", "period": pd.date_range("2020-01-01", periods=120).date, "value": y, "temp": t}))
    plain = md.fit_temperature(df, "linear", months=False).first().temp_coef
    robust = md.fit_temperature(df, "huber", months=False).first().temp_coef
    assert abs(robust - 2) < 0.05 < abs(plain - 2)


def test_few_points_fall_back_to_the_mean(weather):
    row = md.fit_temperature(weather[1].limit(5)).first()
    assert row.method == "mean" and row.temp_coef == 0


def test_rolling_stages_recover_coefficients(spark):
    rng = np.random.default_rng(7)
    n = 60
    yoy, cap = rng.normal(5, 3, n), rng.normal(2, 2, n)
    gdp = np.zeros(n)
    gdp[0] = 5
    for i in range(1, n):
        gdp[i] = 3 + 0.5 * gdp[i - 1] + 0.2 * yoy[i] + 0.1 * cap[i]
    when = pd.date_range("2005-01-01", periods=n, freq="QS").date
    pdf = pd.DataFrame({"series_id": "a", "quarter": when, "prev_gdp": np.r_[np.nan, gdp[:-1]], "month1_yoy": yoy, "month1_cap_rate": cap, "gdp": gdp})
    fits = md.rolling_stages(spark.createDataFrame(pdf), {"stage_1": ["prev_gdp", "month1_yoy", "month1_cap_rate"]})
    rows = fits.collect()
    # the first nine quarters train the first fit
    assert len(rows) == n - 9
    last = rows[-1]
    assert last.coefficients == pytest.approx({"const": 3, "prev_gdp": 0.5, "month1_yoy": 0.2, "month1_cap_rate": 0.1}, abs=1e-6)
    assert last.prediction == pytest.approx(last.actual)
    assert md.coefficient_history(fits).count() == 4 * len(rows)


@pytest.mark.parametrize("t, dof, want", [(2.0, 1, 0.295167), (2.0, 2, 0.183503), (2.5, 5, 0.054490), (1.0, 6, 0.355918), (3.0, 30, 0.005390), (0.0, 4, 1.0)])
def test_p_values(spark, t, dof, want):
    row = spark.createDataFrame([(t, dof)], "t double, dof int").select(student_p(F.col("t"), F.col("dof")).alias("p"), student_p(F.col("t"), F.lit(0)).alias("none")).first()
    assert row.p == pytest.approx(want, abs=1e-5) and row.none is None


def test_rolling_stages_leave_out_dependent_features(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, 12)
    pdf = pd.DataFrame({"series_id": "a", "quarter": pd.date_range("2010-01-01", periods=12, freq="QS").date, "u": x, "v": 2 * x, "w": np.where(np.arange(12) == 4, np.nan, x ** 2), "gdp": 1 + x})
    panel = spark.createDataFrame(pdf)
    assert md.rolling_stages(panel, {"twice": ["u", "v"]}).count() == 0
    rows = md.rolling_stages(panel, {"gap": ["u", "w"]}).collect()
    assert [r.n_train for r in rows] == [8, 8, 8] and all(r.coefficients == pytest.approx({"const": 1, "u": 1, "w": 0}, abs=1e-9) for r in rows)


def test_verdict_limits(spark):
    cols = "has_series boolean, endpoint_warning boolean, n_flags int, has_risks boolean, has_documents boolean, has_explanation boolean, has_economy boolean, residual_pct double, abort boolean, checked_quality boolean"
    rows = [(True, False, 0, False, True, True, True, 0.2, False, True), (True, False, 0, False, True, True, True, 0.01, False, True),
            (False, True, 5, True, False, False, False, None, False, False), (True, False, 0, False, True, False, True, None, True, True)]
    got = [(r.confidence, r.causal_status) for r in dg.verdict(spark.createDataFrame(rows, cols)).collect()]
    assert got == [(0.62, "candidate_cause"), (0.74, "observed"), (0.15, "observed"), (0.3, "data_quality_risk")]


def test_validation_splits(spark):
    rows = [(["a"], ["b"], 0.5, "observed"), ([], ["b"], 0.5, "observed"), (["a"], None, 1.5, "proven")]
    valid, rejected = dg.validate(spark.createDataFrame(rows, "counter_evidence array<string>, uncertainty array<string>, confidence double, causal_status string"))
    assert valid.count() == 1 and sorted(len(r.reasons) for r in rejected.collect()) == [1, 3]


def test_signatures_reach_their_causes(spark):
    events = spark.createDataFrame([("a", -0.2, -20.0, False, 48.0), ("b", 0.03, 3.0, False, 48.0), ("c", -0.1, -10.0, True, None)], "series_id string, mean_deviation double, magnitude_pct double, near_festival boolean, avg_pmi double")
    got = {r.series_id: (r.n_causes, r.top_cause, r.macro_note, r.confidence) for r in dg.diagnose_events(events, dg.seed_graph(spark)).collect()}
    assert got["a"] == (2, "制造业订单下滑/需求走弱", "confirms_weak_demand", "high")
    assert got["b"][2:] == ("directions_differ", "medium") and got["c"][2:] == ("no_macro_data", "low")
