"""Small calendar dimensions. Their size is set by the years covered, not by the data, so they may be broadcast."""

from datetime import date

from pyspark.sql import DataFrame, SparkSession

# Public holidays with the same date every year.
FIXED_HOLIDAYS = {
    "元旦": [(1, 1)],
    "清明节": [(4, 4), (4, 5), (4, 6)],
    "劳动节": [(5, 1), (5, 2), (5, 3), (5, 4), (5, 5)],
    "国庆节": [(10, 1), (10, 2), (10, 3), (10, 4), (10, 5), (10, 6), (10, 7)],
}
# Spring festival breaks, first and last day.
SPRING_FESTIVAL = {
    2021: (date(2021, 2, 11), date(2021, 2, 17)),
    2022: (date(2022, 1, 31), date(2022, 2, 6)),
    2023: (date(2023, 1, 21), date(2023, 1, 27)),
    2024: (date(2024, 2, 10), date(2024, 2, 17)),
    2025: (date(2025, 1, 28), date(2025, 2, 4)),
}
# Stand-in breaks for the years of the test tables: new year's eve of each lunar year and six days after.
STANDIN_FESTIVAL = {
    1995: (date(1995, 1, 30), date(1995, 2, 5)),
    1996: (date(1996, 2, 18), date(1996, 2, 24)),
    1997: (date(1997, 2, 6), date(1997, 2, 12)),
    1998: (date(1998, 1, 27), date(1998, 2, 2)),
    1999: (date(1999, 2, 15), date(1999, 2, 21)),
    2000: (date(2000, 2, 4), date(2000, 2, 10)),
    2001: (date(2001, 1, 23), date(2001, 1, 29)),
}


def festival_ranges(spark: SparkSession, ranges: dict[int, tuple[date, date]] | None = None) -> DataFrame:
    rows = list((ranges or STANDIN_FESTIVAL).values())
    return spark.createDataFrame(rows, "first_day date, last_day date")


def _holiday_rows(ranges: dict[int, tuple[date, date]]) -> list[tuple[date, str]]:
    rows = {}
    for year, (lo, hi) in ranges.items():
        for name, days in FIXED_HOLIDAYS.items():
            for month, day in days:
                rows[date(year, month, day)] = name
        for k in range((hi - lo).days + 1):
            rows[date.fromordinal(lo.toordinal() + k)] = "春节"
    return sorted(rows.items())


def holidays(spark: SparkSession, ranges: dict[int, tuple[date, date]] | None = None) -> DataFrame:
    """(day, name) of every holiday in the years covered."""
    return spark.createDataFrame(_holiday_rows(ranges or STANDIN_FESTIVAL), "day date, name string")


HOLIDAY_SQL = "holidays(day, name) AS (VALUES " + ", ".join(f"(DATE '{d}', '{n}')" for d, n in _holiday_rows(STANDIN_FESTIVAL)) + ")"
FESTIVAL_SQL = "festivals(first_day, last_day) AS (VALUES " + ", ".join(f"(DATE '{a}', DATE '{b}')" for a, b in STANDIN_FESTIVAL.values()) + ")"
