"""Domain tables derived from the given ones, in Spark and as SQL common table expressions.

Money is summed in whole cents, so a sum does not depend on partition order.
Every series here is aggregated to one row per (series, period) with map-side
partial aggregation, so later windows see at most one row per calendar step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import Tables


def cents(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c * 100).cast("long")


def money(c: Column | str) -> Column:
    return F.sum(cents(c)).cast("double") / 100.0


def monthly(t: Tables, series: str = "o_orderpriority") -> DataFrame:
    """(series_id, period, value, n): order value per month."""
    return (
        t.orders.groupBy(F.col(series).alias("series_id"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("period"))
        .agg(money("o_totalprice").alias("value"), F.count("*").alias("n"))
    )


def daily(t: Tables, series: str = "o_orderpriority") -> DataFrame:
    return (
        t.orders.groupBy(F.col(series).alias("series_id"), F.to_date("o_orderdate").alias("period"))
        .agg(money("o_totalprice").alias("value"), F.count("*").alias("n"))
    )


def daily_total(t: Tables) -> DataFrame:
    """Daily order value by order status: fewer and fuller series than by priority.

    The key is a column of the data. A constant key would fold away and turn joins on it
    into cross joins.
    """
    return daily(t, "o_orderstatus")


def revenue() -> Column:
    """Line revenue in cents."""
    return F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("long")


def quarterly(t: Tables, series: str = "l_returnflag") -> DataFrame:
    """(series_id, period, value): revenue per quarter, the slow-moving economy table."""
    return (
        t.lineitem.groupBy(F.col(series).alias("series_id"), F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("period"))
        .agg((F.sum(revenue()).cast("double") / 100.0).alias("value"))
    )


def hourly(t: Tables) -> DataFrame:
    """(series_id, period, value, n): event value and count per hour and event type."""
    return (
        t.events.groupBy(F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").alias("period"))
        .agg(money("value").alias("value"), F.count("*").alias("n"))
    )


def temperature(day: Column) -> Column:
    """Noise-free yearly temperature curve in degrees Celsius."""
    return 17.0 + 12.0 * F.sin(2.0 * F.pi() * (F.dayofyear(day) - 110) / 365.25)


# --- the same tables as SQL -------------------------------------------------

MONTHLY = """monthly AS (
  SELECT o_orderpriority AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS period,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS value, count(*) AS n
  FROM orders GROUP BY 1, 2)"""

DAILY = """daily AS (
  SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS period,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS value, count(*) AS n
  FROM orders GROUP BY 1, 2)"""

DAILY_TOTAL = """daily_total AS (
  SELECT o_orderstatus AS series_id, CAST(o_orderdate AS DATE) AS period,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS value, count(*) AS n
  FROM orders GROUP BY 1, 2)"""

QUARTERLY = """quarterly AS (
  SELECT l_returnflag AS series_id, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS period,
         CAST(sum(CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS value
  FROM lineitem GROUP BY 1, 2)"""

HOURLY = """hourly AS (
  SELECT event_type AS series_id, date_trunc('hour', ts) AS period,
         CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS value, count(*) AS n
  FROM events GROUP BY 1, 2)"""

DAILY_GRID = DAILY + """,
daily_span AS (SELECT series_id, min(period) AS lo, max(period) AS hi FROM daily GROUP BY 1),
daily_spine AS (SELECT series_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS period FROM daily_span),
daily_grid AS (SELECT s.series_id, s.period, d.value FROM daily_spine s LEFT JOIN daily d USING (series_id, period))"""


def temperature_sql(day: str) -> str:
    return f"(17.0 + 12.0 * sin(2.0 * pi() * (dayofyear({day}) - 110) / 365.25))"


def r(expr: str, digits: int = 6) -> str:
    """SQL twin of ``rounded``."""
    return f"(floor(({expr}) * 1e{digits} + 0.5) / 1e{digits})"


def frame(width: int) -> str:
    """SQL frame of a centred window of ``width`` rows."""
    after = (width - 1) // 2
    return f"ROWS BETWEEN {width - 1 - after} PRECEDING AND {after} FOLLOWING"


W = "OVER (PARTITION BY series_id ORDER BY period)"
