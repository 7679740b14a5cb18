"""Numeric clean-up, scaling and classification as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (strong, watch) limits on |x|; percent for load and flow, points for growth.
LOAD_LIMITS = (10.0, 6.0)
GROWTH_LIMITS = (5.0, 3.0)
FLOW_LIMITS = (10.0, 5.0)
ANNUAL_LIMITS = (10.0, 5.0)


def parse_number(value: Column) -> Column:
    """DOUBLE from text with thousands commas; blanks and dashes become NULL, other text fails the cast softly."""
    text = F.trim(F.regexp_replace(value.cast("string"), ",", ""))
    return F.when(~text.isin("", "--", "—", "-"), text).try_cast("double")


def finite(value: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def as_percent(value: Column) -> Column:
    """Shares up to 1.5 in size are taken as fractions and scaled by 100."""
    return F.when(F.abs(value) > 1.5, value).otherwise(value * 100)


def to_large_unit(value: Column, factor: float = 10_000.0) -> Column:
    return value / factor


def severity(value: Column, limits: tuple[float, float] = LOAD_LIMITS) -> Column:
    size = F.abs(value)
    return F.when(size >= limits[0], "strong").when(size >= limits[1], "watch").otherwise("normal")


def degree_days(temp: Column, heat_below: float = 18.0, cool_above: float = 18.0) -> tuple[Column, Column]:
    """(heating, cooling) degree days; the three usual variants differ only in the two thresholds."""
    zero = F.lit(0.0)
    return F.greatest(zero, heat_below - temp), F.greatest(zero, temp - cool_above)


def one_hot(value: Column, levels: Sequence[int], prefix: str) -> list[Column]:
    """One 0/1 column per level; a negative level is written with an m."""
    return [F.when(value == k, 1.0).otherwise(0.0).alias(f"{prefix}{'m' if k < 0 else ''}{abs(k)}") for k in levels]


def growth(new: Column, old: Column, percent: bool = True) -> Column:
    """(new - old) / |old|, NULL when the base is zero or missing."""
    rate = F.try_divide(new - old, F.abs(old))
    return rate * 100 if percent else rate


def share_of_variance(rest: Column, part: Column) -> Column:
    """Aggregate: strength of a component, 1 - Var(rest)/Var(rest + part) held within [0, 1]."""
    total = F.var_pop(rest + part)
    ratio = F.try_divide(F.var_pop(rest), F.when(total > 1e-12, total))
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - ratio)), F.lit(0.0))
