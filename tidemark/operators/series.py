"""Row-level operators on series tables: selection, sample guards, labels and risk tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import periods as per
from ..functions.numbers import finite


def whole(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys)


def along(keys: str | list[str] = "series_id", order: str = "period") -> WindowSpec:
    return Window.partitionBy(keys).orderBy(order)


def centred(width: int, keys: str | list[str] = "series_id", order: str = "period") -> WindowSpec:
    """Window of ``width`` rows around each row; an even width reaches one row further back."""
    after = (width - 1) // 2
    return along(keys, order).rowsBetween(-(width - 1 - after), after)


def select_points(df: DataFrame, time: str, value: str, indicator: tuple[str, str] | None = None,
                  start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows of one indicator with a finite value inside the closed range; all tests reach the scan."""
    out = df.filter(F.col(value).isNotNull() & ~F.isnan(value))
    if indicator:
        out = out.filter(F.col(indicator[0]) == indicator[1])
    if start:
        out = out.filter(F.col(time) >= F.lit(start).cast("timestamp_ntz"))
    if end:
        # the end day counts whole
        out = out.filter(F.col(time) < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz"))
    return out


def require_points(df: DataFrame, least: int, key: str = "series_id") -> tuple[DataFrame, DataFrame]:
    """(rows of long enough series, one row per rejected series with the reason)."""
    sizes = df.groupBy(key).agg(F.count("*").alias("n"))
    kept = df.join(sizes.filter(F.col("n") >= least).select(key), key, "left_semi")
    rejected = sizes.filter(F.col("n") < least).withColumn(
        "reason", F.concat(F.lit(f"needs {least} points, has "), F.col("n")))
    return kept, rejected


def calendar_labels(ts: Column) -> list[Column]:
    return [
        F.month(ts).alias("month"),
        F.quarter(ts).alias("quarter"),
        per.quarter_month(ts).alias("quarter_month"),
        (F.weekday(ts) >= 5).cast("int").alias("is_weekend"),
        F.dayofyear(ts).alias("day_of_year"),
    ]


def point_risks(df: DataFrame, freq: str, key: str = "series_id", order: str = "period", edge: int = 6) -> DataFrame:
    """Tag points whose value may be an artefact: series ends, year-end balancing, the first cycle."""
    cycle = per.CYCLE.get(freq, 1)
    asc = Window.partitionBy(key).orderBy(order)
    desc = Window.partitionBy(key).orderBy(F.col(order).desc())
    year_end = {"quarterly": (F.quarter(order) == 4, "q4_difference"), "monthly": (F.month(order) == 12, "december_balance")}
    out = df.withColumn("_i", F.row_number().over(asc)).withColumn("_j", F.row_number().over(desc))
    tags = [F.when((F.col("_i") == 1) | (F.col("_j") == 1), "series_edge")]
    if freq in year_end:
        tags.append(F.when(*year_end[freq]))
    tags.append(F.when(F.col("_i") <= cycle, "first_cycle"))
    return out.withColumn("risks", F.array_compact(F.array(*tags))).withColumn(
        "edge_flag", ((F.col("_i") <= edge) | (F.col("_j") <= edge)).cast("int")).drop("_i", "_j")


def parse_decisions(df: DataFrame, reply: str, step: float = 0.02) -> DataFrame:
    """Two-field JSON replies, both within [0, 1]; anything else becomes (1, 0.5) and is marked invalid."""
    fields = F.from_json(reply, "map<string,double>")
    parsed = df.withColumn("_v", F.map_values(fields))
    ok = F.coalesce((F.size("_v") == 2) & F.forall("_v", lambda x: x.between(0, 1)), F.lit(False))
    return (
        parsed.withColumn("invalid", ~ok)
        .withColumn("work", F.when(ok, F.get("_v", F.lit(0))).otherwise(1.0))
        .withColumn("consumption_steps", F.when(ok, F.get("_v", F.lit(1))).otherwise(0.5) / step)
        .drop("_v")
    )


def normalise(df: DataFrame, time: Column, value: Column, metric: str, group: Column | None = None,
              unit: str | None = None, source: str | None = None) -> DataFrame:
    """Any table as [period, metric, industry, value, unit, source]; rows without period or value are dropped."""
    return df.select(
        per.parse_period(time).cast("date").alias("period"),
        (group.cast("string") if group is not None else F.lit(metric)).alias("metric"),
        (group.cast("string") if group is not None else F.lit(None).cast("string")).alias("industry"),
        finite(value.try_cast("double")).alias("value"),
        F.lit(unit).cast("string").alias("unit"),
        F.lit(source).cast("string").alias("source"),
    ).dropna(subset=["period", "value"])
