"""Hand-worked values for growth, filling, outliers and calendar operators."""

import math

import numpy as np
import pytest
from conftest import column
from pyspark.sql import functions as F

from tidemark.functions import numbers as num
from tidemark.functions import periods as per
from tidemark.functions import text as txt
from tidemark.operators import calendar as cal
from tidemark.operators import series as ser
from tidemark.operators import windows as wn


@pytest.mark.parametrize("method, given, want", [
    ("forward_fill", [1, None, None, 4, None, 6], [1, 1, 1, 4, 4, 6]),
    ("backward_fill", [None, 2, None, 4, None], [2, 2, 4, 4, 4]),
    ("linear_interp", [1, None, 3, None, 5], [1, 2, 3, 4, 5]),
    ("linear_interp", [None, 2, None, None, 8, None], [2, 2, 4, 6, 8, 8]),
    ("zero", [1, None, None, 4], [1, 0, 0, 4]),
    ("mean", [1, None, 5], [1, 3, 5]),
    ("median", [1, None, 5, 100], [1, 5, 5, 100]),
    ("no_such_method", [None, 1, None], [1, 1, 1]),
])
def test_fill(series, method, given, want):
    assert column(wn.fill(series(given), "value", method), "value", "period") == want


def test_time_interpolation_differs_from_rows(series):
    uneven = series([0, None, None, 31 + 29 + 31], step="month")
    by_time = column(wn.fill(uneven, "value", "time_interp"), "value", "period")
    assert by_time == pytest.approx([0, 31, 60, 91])


def test_seasonal_interpolation(series):
    n = np.arange(36)
    y = 10 * np.sin(n * 2 * np.pi / 12) + n * 0.5
    given = [None if i == 6 else v for i, v in enumerate(y)]
    got = column(wn.fill(series(given), "value", "seasonal_interp"), "value", "period")
    assert abs(got[6] - y[6]) < 3.0 and got[0] == pytest.approx(y[0])


def test_auto_fill_leaves_out_sparse_columns(spark, series):
    df = series([1, 2, None]).withColumn("keep", F.lit(1.0))
    assert wn.auto_fill(df, ["value", "keep"]).columns == ["series_id", "period", "keep"]


def test_growth(series):
    df = series([100, 110, 99, 0, 5])
    mom = column(df.withColumn("g", wn.lag_growth("value", 1)), "g", "period")
    assert mom[0] is None and mom[1:4] == pytest.approx([10, -10, -100]) and mom[4] is None


def test_rolling_statistics_follow_pandas(series):
    rng = np.random.default_rng(1)
    y = rng.normal(10, 3, 40)
    import pandas as pd

    for stat, width in (("mean", 6), ("std", 12), ("skew", 6), ("kurt", 12), ("skew", 3)):
        got = column(series(list(y)).withColumn("s", wn.rolling_stat("value", width, stat)), "s", "period")
        want = getattr(pd.Series(y).rolling(width, center=True, min_periods=min(3, width)), stat)()
        assert [math.nan if g is None else g for g in got] == pytest.approx(list(want), nan_ok=True)


def test_outliers_found(series):
    rng = np.random.default_rng(0)
    y = rng.normal(100, 10, 60)
    y[10], y[30] = 500, -50
    out = wn.rolling_zscore_outlier(series(list(y), step="day"))
    flags = column(out, "is_outlier", "period")
    assert flags[10] and sum(flags) <= 3
    smooth = column(wn.handle_outliers(out, "interpolate"), "value", "period")
    assert smooth[10] == pytest.approx((y[9] + y[11]) / 2)
    assert wn.handle_outliers(out, "remove").count() == 60 - sum(flags)
    with pytest.raises(ValueError):
        wn.handle_outliers(out, "other")


@pytest.mark.parametrize("kind", ["almon", "beta", "exponential", "equal"])
def test_lag_weights(kind):
    w = wn.lag_weights(30, kind)
    assert sum(w) == pytest.approx(1) and min(w) >= 0
    if kind != "equal":
        assert w[0] > w[-1]


def test_mixed_frequency_weighs_the_newest(series):
    df = series(list(range(1, 41)), step="day")
    got = {str(r.bucket): r.midas for r in wn.mixed_frequency(df, {"midas": [0.7, 0.3]}).collect()}
    assert got["2020-01-01"] == pytest.approx(0.7 * 31 + 0.3 * 30)
    old = {str(r.bucket): r.midas for r in wn.mixed_frequency(df, {"midas": [0.7, 0.3]}, newest_first=False).collect()}
    assert old["2020-01-01"] == pytest.approx(0.7 * 30 + 0.3 * 31)


def test_year_to_date_round_trip(series):
    y = [5.0, 7, 9, 4, 6, 8, 3, 2, 1, 5, 6, 7, 4, 5]
    ytd = series(y).withColumn("ytd", wn.year_to_date())
    assert column(wn.monthly_from_ytd(ytd, "ytd"), "single", "period") == pytest.approx(y)
    falling = series([5.0, 4.0]).withColumnRenamed("value", "ytd")
    assert column(wn.monthly_from_ytd(falling, "ytd"), "single", "period") == [5.0, None]


def test_degree_days(spark):
    df = spark.createDataFrame([(5.0,), (18.0,), (30.0,)], "t double")
    h, c = num.degree_days(F.col("t"))
    assert [tuple(r) for r in df.select(h, c).collect()] == [(13.0, 0.0), (0.0, 0.0), (0.0, 12.0)]


@pytest.mark.parametrize("flags, runs", [([0, 1, 1, 0, 1], 2), ([1, 0, 1, 0, 1, 0], 3), ([0, 0, 0, 0, 0], 0), ([1, 1, 1, 1, 1], 1)])
def test_runs(series, flags, runs):
    df = series(flags, step="day").withColumn("f", F.col("value") == 1)
    assert cal.islands(df, flag="f").count() == runs


def test_run_length_and_peak(series):
    df = series([0, 3, 9, 4, 0, 5], step="day").withColumn("f", F.col("value") > 0)
    rows = cal.islands(df, flag="f", aggs=[F.max("value").alias("peak")], least=2).collect()
    assert [(str(r.start), str(r.end), r.n, r.peak) for r in rows] == [("2020-01-02", "2020-01-04", 3, 9.0)]


def test_weekday_adjust_flattens_a_weekly_pattern(series):
    pattern = [1.0, 1.1, 1.2, 1.1, 1.0, 0.7, 0.6]
    df = series([100 * pattern[i % 7] for i in range(70)], step="day", start="2020-01-06")
    got = column(cal.weekday_adjust(df), "adjusted", "period")
    assert got == pytest.approx([got[0]] * 70)
    short = series([1.0, 2.0], step="day")
    assert column(cal.weekday_adjust(short), "adjusted", "period") == [1.0, 2.0]


def test_weekday_adjust_at_the_turn_of_the_year(series):
    # 2019-12-30 belongs to ISO week 1 of 2020
    df = series([10.0] * 21, step="day", start="2019-12-23")
    assert column(cal.weekday_adjust(df), "adjusted", "period") == pytest.approx([10.0] * 21)


def test_holiday_smoothing(series):
    df = series([10, 10, 10, 2, 2, 12, 12, 12], step="day").withColumn("h", F.col("value") == 2)
    got = column(cal.smooth_holidays(df, "h"), "smoothed", "period")
    assert got[3] == got[4] == pytest.approx(11.0) and got[:3] == [10, 10, 10]


@pytest.mark.parametrize("text, want", [
    ("2021-01", "2021-01-01"), ("2024Q3", "2024-07-01"), ("2024-Q3", "2024-07-01"), ("2021", "2021-01-01"), ("202101", "2021-01-01"), ("2024-01-15", "2024-01-15"),
    ("2021-1", "2021-01-01"), ("2021/7", "2021-07-01"), ("garbage", None), ("2024-13", None), ("", None), (None, None), ("NaT", None), ("2024-02-31", None),
    ("2024/01/15", "2024-01-15"), ("2024/1/5", "2024-01-05"), ("2024-1-5", "2024-01-05"), ("20240115", "2024-01-15"), ("2024-01-15T08:00:00.5", "2024-01-15"), ("2024-01-15 8:05", "2024-01-15"), ("20241340", None), ("2024/1-5", None)])
def test_parse_period(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(per.parse_period(F.col("t")).cast("date").cast("string")).first()[0]
    assert got == want


@pytest.mark.parametrize("text, want", [
    ("2025年1月用电为什么下降", "2025-01"), ("2024Q4 的情况", "2024Q4"), ("2024年第三季度", "2024Q3"), ("2024年2季度和2023年1月", "2024Q2"), ("最近怎么样", None), ("2024年13月", None), ("在2024-123里", None)])
def test_question_period(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(per.question_period(F.col("t"))).first()[0] == want


@pytest.mark.parametrize("text, want", [
    ("用电下降说明经济走弱", True), ("本次分析不支持「经济走弱」", False), ("不能说经济走弱。但是后来的数据足够长足够多足够久确实表明经济走弱", True), ("没有这句话", False), ("经济走弱", True)])
def test_asserted_phrase(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(txt.asserts_phrase(F.col("t"), "经济走弱")).first()[0] is want


def test_tokens_and_grams(spark):
    row = spark.createDataFrame([("Load 2024 用a电 量",)], "t string").select(txt.tokens(F.col("t")).alias("t"), txt.char_ngrams(F.lit("a b c")).alias("g")).first()
    assert row.t == ["load", "2024", "a", "用电", "电量"] and row.g == ["a", "b", "c", "ab", "bc"]


def test_decision_records(spark):
    replies = ['{"work": 0.4, "consumption": 0.1}', '{"work": 0.4}', '{"a": 0.1, "b": 1.2}', "no json", '{"a": 1, "b": 0, "c": 0}', None]
    df = ser.parse_decisions(spark.createDataFrame([(r,) for r in replies], "reply string"), "reply")
    assert [(r.work, round(r.consumption_steps, 6), r.invalid) for r in df.collect()] == [(0.4, 5.0, False)] + [(1.0, 25.0, True)] * 5


def test_climatology_is_removed(series):
    n = 365 * 3
    y = [100 + 10 * math.sin(2 * math.pi * i / 365) for i in range(n)]
    adjusted = column(wn.remove_climatology(series(y, step="day", start="2021-01-01")), "adjusted", "period")
    assert np.std(adjusted) < 0.1 * np.std(y)


def test_robust_z_of_constant_series(series):
    assert set(column(wn.robust_z(series([5, 5, 5])), "robust_z", "period")) == {0.0}


def test_plain_periods_read_as_all_others(spark):
    # plain months and dates take a short way, which must give what the patterns for all forms give
    texts = ["1998-07", "1998/7", "199807", "1998_12", "1998-13", "199800", "0000-01", "9999-12", "1998-07\n", " 1998-07 ", "1998-7-5", "1998/02/30", "1998.12.31", "1998-07/01",
             "1998-07-01 10:30", "19980701", "1998", "1998Q3", "1998-Q4", "١٩٩٨-07", "1998-07-", "", "nan", None, "19-07", "0000-00-00", "1998/12/31\n", "2024-2-29", "2023-2-29"]
    c = F.col("t")
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", per.parse_period(c).cast("string").alias("a"), per._any_period(F.trim(c)).cast("string").alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] and sum(r.a is not None for r in got) >= 14
