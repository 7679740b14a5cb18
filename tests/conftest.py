import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidemark.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_spark("tests", "local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def series(spark):
    """(series_id, period, value) from plain lists; periods step by month or by day from 2020-01-01."""
    def make(values, key="a", step="month", start="2020-01-01"):
        rows = [(key, i, None if v is None else float(v)) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, "series_id string, i int, value double")
        return df.selectExpr("series_id", f"cast(date'{start}' + make_{'ym' if step == 'month' else 'dt'}_interval({'0, i' if step == 'month' else 'i'}) as date) as period", "value")

    return make


def column(df, name, *order):
    return [r[name] for r in df.orderBy(*order).collect()]
