"""Top-k, extremes, sampling of series ends, and unions of records and triples."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F


def top_absolute(df: DataFrame, value: str, k: int, least: float = 0.0, key: str = "series_id", order: str = "period") -> DataFrame:
    """The k largest |value| per series; each partition drops all but its own k before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.abs(value).desc(), order)
    return df.filter(F.abs(value) >= least).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def extremes(df: DataFrame, keys: list[str], by: str, tie: str, columns: Mapping[str, str]) -> DataFrame:
    """Values of the poorest and richest row per group, lowest ``tie`` first; partial aggregation throughout."""
    low, high = F.struct(by, tie), F.struct(F.col(by), -F.col(tie))
    aggs = [F.min_by(c, low).alias(f"poorest{s}") for s, c in columns.items()] + [F.max_by(c, high).alias(f"richest{s}") for s, c in columns.items()]
    return df.groupBy(*keys).agg(*aggs)


def head_tail(df: DataFrame, n: int = 4, key: str = "series_id", order: str = "period") -> DataFrame:
    first = F.row_number().over(Window.partitionBy(key).orderBy(order))
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))
    out = df.withColumn("_i", first).withColumn("_j", last).filter((F.col("_i") <= n) | (F.col("_j") <= n))
    return out.withColumn("is_head", F.col("_i") <= n).drop("_i", "_j")


def last_points(df: DataFrame, n: int = 13, key: str = "series_id", order: str = "period") -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("_j", F.row_number().over(w)).filter(F.col("_j") <= n).drop("_j")


def target_period(events: DataFrame, value: str, asked: Column, early: Column, key: str = "series_id", order: str = "period") -> DataFrame:
    """One period per series: the asked one, else the largest outside the early zone, else the largest."""
    is_asked = F.coalesce(F.col(order) == asked, F.lit(False))
    choice = F.when(is_asked, 0).when(~early, 1).otherwise(2)
    reason = F.when(is_asked, "asked").when(~early, "largest_after_first_cycle").otherwise("largest")
    w = Window.partitionBy(key).orderBy(choice, F.abs(value).desc(), order)
    return events.withColumn("reason", reason).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def anomaly_records(parts: list[DataFrame]) -> DataFrame:
    """Candidates of several kinds in one record shape; absent fields are NULL, the risk mark 0."""
    kept = [p.filter(F.col("severity") != "normal") for p in parts]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kept)
    return out.withColumn("annual_reconciliation_risk", F.coalesce("annual_reconciliation_risk", F.lit(0)))


def merge_triples(seed: DataFrame, extra: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all edges, parallel ones kept; distinct end points)."""
    edges = seed.unionByName(extra)
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return edges, ends


def union_first(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union without repeats; a row belongs to the earliest list that holds it."""
    tagged = [p.select(*keys, F.lit(i + 1).alias("source")) for i, p in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b), tagged).groupBy(*keys).agg(F.min("source").alias("source"))
