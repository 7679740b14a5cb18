"""Exact ranks, running totals and quantiles of groups too large for one task.

A plain window over a group sorts the whole group in one place. Here rows are first
collapsed to (group, value, count), cut into value ranges of about equal weight, and
summed in two levels: within each range, and over the short list of range totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

ROWS = 100_000  # rows that one range shall hold


def value_counts(df: DataFrame, keys: list[str], value: str, extra: dict[str, object] | None = None) -> DataFrame:
    """(keys, value, c, ...) with map-side combining; ``extra`` adds further aggregates."""
    more = [a.alias(n) for n, a in (extra or {}).items()]
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"), *more)


def _ranges(source: DataFrame, value: str, rows: int) -> list[float]:
    """Split points of about equal weight, one for every ``rows`` rows: only they come to the driver.

    Being literals in the plan they are the same in every stage and every retry.
    """
    ranges = max(1, -(-source.count() // rows))
    if ranges == 1:
        return [float("-inf"), float("inf")]
    probs = [i / ranges for i in range(1, ranges)]
    points = source.select(F.col(value).cast("double").alias("_x")).approxQuantile("_x", probs, 0.5 / ranges)
    return [float("-inf"), *sorted(set(points)), float("inf")]


def running(counts: DataFrame, keys: list[str], value: str, sums: list[str], source: DataFrame | None = None,
            rows: int = ROWS) -> DataFrame:
    """Adds ``before_<s>`` (sum over smaller values) and ``all_<s>`` (sum over the group) for each column in ``sums``.

    ``counts`` has one row per (keys, value). ``source`` is what the split points are
    sketched from, by default ``counts`` itself; a range holds about ``rows`` of its rows,
    so their number grows with the data.
    """
    splits = _ranges(source if source is not None else counts, value, rows)
    held = counts.withColumn("_x", F.col(value).cast("double"))
    if len(splits) > 2:
        held = Bucketizer(splits=splits, inputCol="_x", outputCol="_b", handleInvalid="keep").transform(held)
    else:
        held = held.withColumn("_b", F.lit(0.0))
    totals = held.groupBy(*keys, "_b").agg(*[F.sum(s).alias(s) for s in sums])
    below = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys)
    # one row per range and group reaches this window
    offsets = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b").alias("_ob"),
        *[F.coalesce(F.sum(s).over(below), F.lit(0)).alias(f"_off_{s}") for s in sums], *[F.sum(s).over(every).alias(f"all_{s}") for s in sums])
    on = F.col("_b") == F.col("_ob")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inner = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    within = held.select("*", *[F.coalesce(F.sum(s).over(inner), F.lit(0)).alias(f"_in_{s}") for s in sums])
    joined = within.join(offsets, on, "inner")
    return joined.select(*counts.columns, *[(F.col(f"_off_{s}") + F.col(f"_in_{s}")).alias(f"before_{s}") for s in sums], *[f"all_{s}" for s in sums])


def quantiles(df: DataFrame, keys: list[str], value: str, probs: Sequence[float], names: Sequence[str] | None = None) -> DataFrame:
    """(keys, n, q...): exact, linearly interpolated quantiles per group."""
    names = names or [f"q{int(p * 100):02d}" for p in probs]
    return quantiles_of_counts(value_counts(df, keys, value), keys, value, probs, names, df)


def quantiles_of_counts(counts: DataFrame, keys: list[str], value: str, probs: Sequence[float], names: Sequence[str], source: DataFrame | None = None) -> DataFrame:
    """:func:`quantiles` of rows that stand in ``counts`` as (keys, value, c); ``source`` as in :func:`running`."""
    placed = running(counts, keys, value, ["c"], source)
    aggs = []
    for p, name in zip(probs, names):
        h = (F.col("all_c") - 1) * p
        for tag, at in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            here = (F.col("before_c") <= at) & (at < F.col("before_c") + F.col("c"))
            aggs.append(F.max(F.when(here, F.col(value).cast("double"))).alias(f"_{tag}_{name}"))
    found = placed.groupBy(*keys).agg(F.first("all_c").alias("n"), *aggs)
    out = []
    for p, name in zip(probs, names):
        h = (F.col("n") - 1) * p
        out.append((F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (h - F.floor(h))).alias(name))
    return found.select(*keys, "n", *out)
