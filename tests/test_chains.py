"""Chains that SQL cannot restate: effects planted in small series must come out again."""

import math

import numpy as np
import pandas as pd
import pytest
from conftest import column
from pyspark.sql import functions as F

from tidemark.operators import confounders as cf
from tidemark.operators import decompose as dc
from tidemark.operators import joins as jn
from tidemark.operators import models as md
from tidemark.operators import windows as wn
from tidemark.plans.calendars import SPRING_FESTIVAL, festival_ranges, holidays
from tidemark.plans.standins import temperature
from tidemark.session import shared_dir


def curve(day):
    return 17.0 + 12.0 * math.sin(2.0 * math.pi * (day.dayofyear - 110) / 365.25)


@pytest.fixture(scope="module")
def planted(spark):
    """Two years of log-linear load: weather, weekend and holiday effects, and a shock of 20 days."""
    days = pd.date_range("2022-01-01", "2023-12-31")
    temp = np.array([curve(d) for d in days])
    hol = {r.day for r in holidays(spark, SPRING_FESTIVAL).collect()}
    on_holiday = np.array([d.date() in hol for d in days])
    y = 5 + 0.02 * np.maximum(0, temp - 24) + 0.01 * np.maximum(0, 10 - temp) - 0.05 * (days.dayofweek >= 5) - 0.1 * on_holiday
    y = y + np.random.default_rng(0).normal(0, 0.001, len(days))
    shock = (days >= "2023-06-01") & (days <= "2023-06-20")
    y = y + np.where(shock, 0.15, 0)
    pdf = pd.DataFrame({"series_id": "a", "period": days.date, "value": np.exp(y)})
    inputs = cf.daily_inputs(spark.createDataFrame(pdf), holidays(spark, SPRING_FESTIVAL), festival_ranges(spark, SPRING_FESTIVAL), temperature)
    return inputs, shock


def test_confounders_are_removed(planted):
    out = cf.remove_confounders(planted[0]).toPandas().sort_values("period")
    calm = out[~planted[1]]
    assert np.ptp(calm.economic_signal) < 0.06 < np.ptp(calm.log_value)
    assert (out.economic_signal + out.weather_effect + out.calendar_effect).to_numpy() == pytest.approx(out.log_value.to_numpy())
    assert out.r_squared.iloc[0] > 0.5


def test_decoupled_shock_stands_out(planted):
    out = cf.decouple(planted[0]).toPandas().sort_values("period")
    deviation = out.economic_deviation.to_numpy()
    # the yearly profile takes up half of a shock seen in one year of two
    assert deviation[planted[1]].mean() > 0.05 and deviation[planted[1]].mean() > 3 * np.abs(deviation[~planted[1]]).mean()
    assert (out.economic_trend + out.seasonal_residual + out.economic_residual).to_numpy() == pytest.approx(out.economic_signal.to_numpy())


def test_correction_chain_keeps_every_stage(spark):
    days = pd.date_range("2023-01-01", periods=120)
    temp = np.array([curve(d) for d in days])
    y = 100 + 3 * np.maximum(0, 10 - temp) + np.where(days.dayofweek >= 5, -20, 0)
    df = spark.createDataFrame(pd.DataFrame({"series_id": "a", "period": days.date, "value": y, "temp": temp}))
    out = md.apply_corrections(df, holidays(spark, SPRING_FESTIVAL)).toPandas()
    assert len(out) == 120 and {"temp_corrected", "holiday_smoothed", "weekday_adjusted", "final_corrected"} <= set(out.columns)
    plain = out[~out.is_holiday]
    assert plain.holiday_smoothed.to_numpy() == pytest.approx(plain.temp_corrected.to_numpy())
    weekend = pd.to_datetime(plain.period).dt.dayofweek >= 5
    assert abs(plain[weekend].final_corrected.mean() - plain[~weekend].final_corrected.mean()) < 5


def test_reconstruction_error_finds_the_odd_window(series):
    rng = np.random.default_rng(4)
    y = np.sin(np.arange(300) * 2 * np.pi / 24) + rng.normal(0, 0.05, 300)
    y[150:156] += np.array([3, -3, 3, -3, 3, -3])
    df = series(list(y), step="day").withColumn("other", F.col("value") * 0.5)
    vectors = wn.sliding_vectors(df, ["value", "other"])
    assert vectors.count() == 271 and {r.n for r in vectors.select(F.size("vector").alias("n")).collect()} == {60}
    errors = dc.reconstruction_error(vectors, k=4).orderBy("period").toPandas().error.to_numpy()
    assert 120 <= int(errors.argmax()) <= 156 and errors.max() > 5 * np.median(errors)


def test_clean_lines(spark):
    lines = [("a,2024-01-01,10.0",), ("a,2024-01-01,99.0",), ("a,2024-01-02,12.0",), ("a,2024-01-04,16.0",), ("a,2024-01-05,",)]
    df = spark.createDataFrame([(i, *line) for i, line in enumerate(lines)], "seq int, line string")
    out = md.clean_lines(df, "line", "Sector string, Day date, Consumption double", {"series_id": ["sector"], "period": ["day"], "value": ["CONSUMPTION"], "seq": ["seq"]}, {}, ["value"])
    assert column(out, "value", "period") == [10.0, 12.0, 14.0, 16.0, 16.0]


def test_seeded_choice_is_repeatable(spark):
    df = spark.range(1000).select(jn.seeded_choice(F.array(F.lit("x"), F.lit("y"), F.lit("z")), F.col("id"), F.lit(1)).alias("c"), "id")
    first, second = (column(df, "c", "id") for _ in range(2))
    assert first == second and set(first) == {"x", "y", "z"} and min(first.count(c) for c in "xyz") > 250


class Conf:
    def __init__(self, value):
        self.value = value

    def get(self, key, default=None):
        return self.value if key == "spark.checkpoint.dir" else default


class Session:
    def __init__(self, session_value, core_value):
        self.conf = Conf(session_value)
        self.sparkContext = type("Context", (), {"getConf": lambda _: Conf(core_value)})()


@pytest.mark.parametrize("values", [("/shared/x", None), (None, "/shared/x")])
def test_shared_folder_follows_the_session(values):
    first, second = shared_dir(Session(*values)), shared_dir(Session(*values))
    assert first.startswith("/shared/x/") and first != second
