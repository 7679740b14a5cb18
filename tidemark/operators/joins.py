"""Joins over time: spines, as-of, interval and nearest joins, and small graph look-ups.

Range conditions are turned into equi-joins on a calendar bucket. Each bucket of a hot
key is its own shuffle key, and adaptive skew handling may split it further; no side is
broadcast by hand unless it is a calendar-sized table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

STEP = {"hourly": "interval 1 hour", "daily": "interval 1 day", "weekly": "interval 7 days", "monthly": "interval 1 month",
        "quarterly": "interval 3 months", "annual": "interval 1 year"}


def spine(df: DataFrame, freq: str, key: str = "series_id", time: str = "period") -> DataFrame:
    """Every expected period between the first and last of each series."""
    span = df.groupBy(key).agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    return span.select(key, F.explode(F.sequence("_lo", "_hi", F.expr(STEP[freq]))).alias(time))


def regular(df: DataFrame, freq: str, key: str = "series_id", time: str = "period") -> DataFrame:
    """The series on its spine, NULL where a period is missing."""
    return spine(df, freq, key, time).join(df, [key, time], "left")


def missing_periods(df: DataFrame, freq: str, key: str = "series_id", time: str = "period") -> DataFrame:
    return spine(df, freq, key, time).join(df.select(key, time), [key, time], "left_anti")


def combine_sources(base: DataFrame, others: list[DataFrame], on: list[str]) -> DataFrame:
    """Left equi-joins in turn; each right side has one row per key."""
    out = base
    for other in others:
        out = out.join(other, on, "left")
    return out


def interval_join(points: DataFrame, spans: DataFrame, keys: list[str], time: str, start: str, end: str,
                  bucket: str = "month", how: str = "inner", end_open: bool = False) -> DataFrame:
    """Points falling in [start, end] (or [start, end)) of spans with the same keys.

    A span is repeated once per calendar bucket it touches, a point carries its own
    bucket, and (keys, bucket) is an ordinary equi-join key.
    """
    first = F.date_trunc(bucket, F.col(start))
    last = F.date_trunc(bucket, F.col(end))
    spread = spans.withColumn("_bucket", F.explode(F.sequence(first, last, F.expr(f"interval 1 {bucket}"))))
    left = points.withColumn("_bucket", F.date_trunc(bucket, F.col(time))).alias("p")
    right = spread.alias("s")
    upper = F.col(f"p.{time}") < F.col(f"s.{end}") if end_open else F.col(f"p.{time}") <= F.col(f"s.{end}")
    on = (F.col("p._bucket") == F.col("s._bucket")) & (F.col(f"p.{time}") >= F.col(f"s.{start}")) & upper
    for k in keys:
        on = on & (F.col(f"p.{k}") == F.col(f"s.{k}"))
    kept = [c for c in spans.columns if c not in keys]
    return left.join(right, on, how).select("p.*", *[F.col(f"s.{c}") for c in kept]).drop("_bucket")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str],
              bucket: str = "month", backfill: bool = True) -> DataFrame:
    """Latest right row at or before each left row; with ``backfill`` earlier left rows take the first right row.

    The right side becomes validity intervals; the left side is never sorted, so a key
    holding a third of all rows spreads over its time buckets. The right side is cut into
    the same buckets: each row ends where the next one of its bucket begins, the last of a bucket where the
    next bucket with rows begins, which a list of one row per key and bucket tells. So no key, and
    without ``keys`` not the whole right side, is sorted in one task. Several
    right rows at one instant: the greatest value tuple wins, as the last one sorted.
    """
    latest = right.groupBy(*keys, time).agg(F.max(F.struct(*values)).alias("_v")).withColumn("_b", F.date_trunc(bucket, time))
    firsts = latest.groupBy(*keys, "_b").agg(F.min(time).alias("_least"))
    along_buckets = Window.partitionBy(*keys).orderBy("_b")
    firsts = firsts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b").alias("_ob"), F.lead("_least").over(along_buckets).alias("_next"), (F.row_number().over(along_buckets) == 1).alias("_opens"), "_least")
    on = F.col("_b") == F.col("_ob")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    order = Window.partitionBy(*keys, "_b").orderBy(time)
    # both ends of the left side bound the first and the last interval
    ends = left.agg(F.struct(F.min(time).alias("lo"), F.max(time).alias("hi")).alias("s")).scalar()
    spans = (
        latest.withColumn("_then", F.lead(time).over(order)).join(firsts, on)
        .withColumn("_until", F.coalesce("_then", "_next"))
        .withColumn("_first", F.col("_opens") & (F.col(time) == F.col("_least")))
        .withColumn("_ends", ends)
        .withColumn("_from", F.when(F.col("_first") & F.lit(backfill), F.least(F.col(time), F.col("_ends.lo"))).otherwise(F.col(time)))
        # an interval that starts after the last left row is useless; one past the last row closes the open end
        .withColumn("_to", F.greatest(F.coalesce("_until", F.col("_ends.hi") + F.expr("interval 1 day")), F.col("_from")))
        .select(*keys, F.col("_from").cast("timestamp_ntz").alias("_from"), F.col("_to").cast("timestamp_ntz").alias("_to"), F.col(time).alias("matched"), "_v")
    )
    out = interval_join(left, spans, keys, time, "_from", "_to", bucket, "left", end_open=True)
    return out.select(*left.columns, F.col("matched"), *[F.col(f"_v.{v}").alias(v) for v in values])


def align(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows present on both sides with no missing value."""
    return a.join(b, keys, "inner").dropna(subset=columns)


def nearest_start(days: DataFrame, day: str, starts: DataFrame, start: str) -> DataFrame:
    """Signed days to the closest start of any year, the earlier one on a tie; NULL only if there is no start at all.

    Days and starts are laid on one axis, cut into decades. Within a decade the start before and the one after are
    carried along; the ends of a decade come from a list of one row per decade.
    """
    decade = lambda c: F.floor(F.year(c) / 10)
    marks = starts.select(F.col(start).cast("date").alias("_start")).filter("_start IS NOT NULL").distinct()
    axis = marks.groupBy(decade("_start").alias("_d")).agg(F.min("_start").alias("_lo"), F.max("_start").alias("_hi"))
    # one row per decade of the calendar
    every = days.select(decade(day).alias("_d")).union(axis.select("_d")).distinct().join(axis, "_d", "left")
    order = Window.orderBy("_d")
    ends = every.select(
        "_d", F.last("_hi", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_lo", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    laid = days.withColumns({"_at": F.col(day).cast("date"), "_start": F.lit(None).cast("date")}).unionByName(marks.withColumn("_at", F.col("_start")), allowMissingColumns=True)
    w = Window.partitionBy("_d").orderBy("_at")
    laid = laid.withColumn("_d", decade("_at")).withColumn("_back", F.max("_start").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    laid = laid.withColumn("_on", F.min("_start").over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing)))
    out = laid.filter("_start IS NULL").join(ends, "_d", "left")
    back, on = F.datediff("_at", F.coalesce("_back", "_before")), F.datediff("_at", F.coalesce("_on", "_after"))
    return out.select(*days.columns, F.when(on.isNull() | (back <= -on), back).otherwise(on).alias("days_to_start"))


def same_year_offset(days: DataFrame, day: str, starts: DataFrame, start: str, absent: int = 999, window: int = 15) -> DataFrame:
    """Days since the first start of the same calendar year, ``absent`` in years without one."""
    first = starts.groupBy(F.year(start).alias("_year")).agg(F.min(start).alias("_start"))
    out = days.withColumn("_year", F.year(day)).join(first, "_year", "left")
    offset = F.coalesce(F.datediff(F.col(day), F.col("_start")), F.lit(absent))
    return out.withColumn("days_to_start", offset).withColumn("near", F.abs("days_to_start") <= window).drop("_year", "_start")


def bracket_of(value: Column, brackets: list[tuple[float, float, str]]) -> Column:
    """Name of the closed bracket holding the value; brackets share end points and the later one wins."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for lo, hi, name in reversed(brackets):
        out = out.when(value.between(lo, hi), name)
    return out


def seeded_choice(options: Column, *identity: Column) -> Column:
    """Repeatable pick from an array, by a digest that any engine can compute."""
    digest = F.md5(F.concat_ws("|", *[c.cast("string") for c in identity]))
    return F.get(options, (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.size(options)).cast("int"))


def same_period_last_year(df: DataFrame, values: list[str], key: str = "series_id", time: str = "period") -> DataFrame:
    """Each period beside the same one a year earlier, by calendar and not by row position."""
    before = df.select(key, F.add_months(time, 12).alias(time), *[F.col(v).alias(f"{v}_last_year") for v in values])
    return df.join(before, [key, time], "left")


def named_triples(triples: DataFrame, nodes: DataFrame, relation: str | None = None, subject_part: str | None = None,
                  object_part: str | None = None) -> DataFrame:
    """Triples with names for ids; filters are a relation (any case) and name parts (any case)."""
    out = triples
    if relation:
        out = out.filter(F.upper("rel") == relation.upper())
    names = nodes.select("id", "name")
    out = (
        out.join(names.select(F.col("id").alias("src"), F.col("name").alias("_sn")), "src", "left")
        .join(names.select(F.col("id").alias("dst"), F.col("name").alias("_dn")), "dst", "left")
        .withColumn("subject_name", F.coalesce("_sn", "src")).withColumn("object_name", F.coalesce("_dn", "dst")).drop("_sn", "_dn")
    )
    if subject_part:
        out = out.filter(F.lower("subject_name").contains(subject_part.lower()))
    if object_part:
        out = out.filter(F.lower("object_name").contains(object_part.lower()))
    return out


def two_hops(triples: DataFrame, first: str, second: str) -> DataFrame:
    """(src, mid, dst): src -first-> mid -second-> dst, dst NULL where the second hop is missing.

    One row per path rather than a list per cause: no group is gathered in one place.
    """
    one = triples.filter(F.col("rel") == first).select("src", F.col("dst").alias("mid"))
    two = triples.filter(F.col("rel") == second).select(F.col("src").alias("mid"), "dst")
    return one.join(two, "mid", "left").select("src", "mid", "dst")
