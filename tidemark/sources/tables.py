"""Any table to a series in two phases: profile every column in one aggregate, then read the chosen ones."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import periods as per
from ..functions.numbers import finite
from .profile import PERIOD_NAMES, name_score, name_usable


class Choice(NamedTuple):
    """The columns a table is read by, None where it has none, and its number of rows."""

    period: str | None
    value: str | None
    n_rows: int


def _number(c: str) -> Column:
    return finite(F.col(f"`{c}`").cast("string").try_cast("double"))


def choose_columns(df: DataFrame, least: float = 0.8) -> Choice:
    """Period and main value of a table.

    A column named like a period wins, else the one whose texts parse as periods most often, if at least ``least`` do. Of the other
    columns the value is the best by name and variation among those that are numbers in half of the rows and vary. One aggregate over all
    columns; one row reaches the driver. Ties go to the first column for periods, to the lesser name for values.
    """
    plain = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("array", "map", "struct", "binary", "variant")]
    stats = []
    for c in plain:
        text, number = F.col(f"`{c}`").cast("string"), _number(c)
        stats.append(F.struct(F.count(text).alias("given"), F.count(per.parse_period(text)).alias("parsed"), F.count(number).alias("n"), F.stddev_samp(number).alias("sd"), F.abs(F.avg(number)).alias("mean")).alias(f"c{len(stats)}"))
    row = df.agg(F.count("*").alias("n_rows"), *stats).first()
    seen = {c: row[f"c{i}"] for i, c in enumerate(plain)}
    named = [c for c in plain if c.strip().lower() in PERIOD_NAMES]
    rated = sorted((-s["parsed"] / s["given"], i, c) for i, (c, s) in enumerate(seen.items()) if s["given"] and s["parsed"] >= least * s["given"])
    period = named[0] if named else rated[0][2] if rated else None

    def score(c: str) -> float:
        s = seen[c]
        return name_score(c) + 0.2 * min(s["sd"] / s["mean"] if s["mean"] > 1e-9 else s["sd"], 5.0)

    values = [c for c in plain if c != period and name_usable(c) and seen[c]["n"] >= max(3, 0.5 * row["n_rows"]) and (seen[c]["sd"] or 0) > 0]
    return Choice(period, min(values, key=lambda c: (-score(c), c)) if values else None, row["n_rows"])


def read_series(df: DataFrame, dataset: str, choice: Choice, unit: str | None = None, group: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(series, rejects) of one table by the columns of ``choice``.

    series: period, metric, industry, value, unit, source, one row per row that has both. rejects: source, reason, n, example, one row per reason;
    reasons are that the table has no period or no value column, or that a row's period or value is missing or unreadable. Together they account for every row.
    """
    empty = F.lit(None).cast("string")
    when = F.trim(F.col(f"`{choice.period}`").cast("string")) if choice.period else empty
    what = F.trim(F.col(f"`{choice.value}`").cast("string")) if choice.value else empty
    rows = df.select(
        per.parse_period(when).cast("date").alias("period"), (_number(choice.value) if choice.value else F.lit(None).cast("double")).alias("value"),
        when.alias("_when"), what.alias("_what"), (F.col(f"`{group}`").cast("string") if group else empty).alias("industry"))
    blank = lambda c: F.coalesce(F.lower(c).isin(*per.BLANKS), F.lit(True))
    if choice.period is None or choice.value is None:
        reason = F.lit(f"no {'period' if choice.period is None else 'value'} column")
    else:
        reason = (F.when(F.col("period").isNull(), F.when(blank(F.col("_when")), "period missing").otherwise("period unreadable"))
                  .when(F.col("value").isNull(), F.when(blank(F.col("_what")), "value missing").otherwise("value unreadable")))
    told = rows.withColumn("reason", reason)
    series = told.filter("reason IS NULL").select("period", F.lit(choice.value).cast("string").alias("metric"), "industry", "value", F.lit(unit).cast("string").alias("unit"), F.lit(dataset).alias("source"))
    example = F.when(F.col("reason").startswith("period"), F.col("_when")).when(F.col("reason").startswith("value"), F.col("_what"))
    return series, told.filter("reason IS NOT NULL").groupBy(F.lit(dataset).alias("source"), "reason").agg(F.count("*").alias("n"), F.min(example).alias("example"))


def auto_series(tables: Mapping[str, DataFrame], units: Mapping[str, str] | None = None, groups: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(series, rejects) of all ``tables`` by name, every one read by the columns that `choose_columns` finds in it."""
    parts = [read_series(df, name, choose_columns(df), (units or {}).get(name), (groups or {}).get(name)) for name, df in tables.items()]
    series, rejects = zip(*parts)
    return reduce(DataFrame.unionByName, series), reduce(DataFrame.unionByName, rejects)
