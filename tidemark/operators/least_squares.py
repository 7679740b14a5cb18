"""Least squares from moment sums, solved in column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A pivot below this share of its own sum of squares belongs to a feature that the others explain.
TOLERANCE = 1e-9


def finite_values(names: Sequence[str]) -> Column:
    """Whether every named column holds a finite number."""
    out = F.lit(True)
    for n in names:
        out = out & F.coalesce(~F.isnan(n) & (F.abs(n) < float("inf")), F.lit(False))
    return out


def sweep(moments: Column, size: int) -> Column:
    """Sweep the first ``size`` variables out of a square array of centred moments, row by row, the target being the last variable.

    In the result with w = size + 1, place i * w + size is the slope of variable i, the last place the residual sum of squares, and
    the negative of place i * w + j the inverse moment matrix. All places are null where features depend on one another.
    A fold over an array, so the plan stays small whatever the number of features.
    """
    w = size + 1

    def pivot(m: Column, k: Column) -> Column:
        d = F.get(m, k * (w + 1))
        d = F.when(d > TOLERANCE * F.get(moments, k * (w + 1)), d)

        def place(v: Column, at: Column) -> Column:
            i, j = F.floor(at / w).cast("int"), at % w
            return (F.when((i == k) & (j == k), -1.0 / d).when((i == k) | (j == k), v / d)
                    .otherwise(v - F.get(m, i * w + k) * F.get(m, k * w + j) / d))

        return F.transform(m, place)

    return F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), moments, pivot)


def student_p(t: Column, dof: Column) -> Column:
    """P(|T| > |t|) of Student's t with whole degrees of freedom, by the finite trigonometric series; null without degrees of freedom."""
    angle = F.atan(F.try_divide(F.abs(t), F.sqrt(F.greatest(dof, F.lit(0)))))
    cos, sin, odd = F.cos(angle), F.sin(angle), dof % 2 == 1
    first = F.when(odd, cos).otherwise(F.lit(1.0))
    steps = F.when(dof >= F.when(odd, 4).otherwise(3), F.sequence(F.when(odd, 2).otherwise(1), dof - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))

    def add(s: Column, j: Column) -> Column:
        term = s["term"] * cos * cos * j / (j + 1)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    series = F.aggregate(steps, F.struct(first.alias("term"), F.when(dof == 1, 0.0).otherwise(first).alias("total")), add)["total"]
    inside = F.when(odd, 2 / F.pi() * (angle + sin * series)).otherwise(sin * series)
    return F.when(dof >= 1, F.greatest(F.lit(0.0), 1 - inside))
