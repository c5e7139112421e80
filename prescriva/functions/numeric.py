"""Numbers and levels as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column, slope: float = 1.0) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(x * F.lit(-float(slope))))


def clipped(c: Column, low: Column | float, high: Column | float) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.when(c.isNull(), None).otherwise(F.greatest(F.least(c, as_column(high)), as_column(low)))


def min_max(c: Column, low: float, high: float) -> Column:
    """To [0, 1]; a constant column becomes 0."""
    return clipped((c - F.lit(float(low))) / F.lit(float(high - low) or 1.0), 0.0, 1.0)


def nearest_level(c: Column, levels: dict[str, float]) -> Column:
    """The label whose value is nearest; of equal distances the first label.

    The value goes through an array of one, so that a long expression is worked out once.
    """

    def label(v: Column) -> Column:
        options = F.array(*(F.struct(F.abs(v - F.lit(float(x))).alias("d"), F.lit(i).alias("i"), F.lit(k).alias("label")) for i, (k, x) in enumerate(levels.items())))
        return F.when(v.isNotNull() & ~F.isnan(v), F.array_min(options)["label"])

    return F.get(F.transform(F.array(c), label), F.lit(0))


def level_value(label: Column, levels: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for k, v in levels.items():
        out = F.when(label == k, float(v)).otherwise(out)
    return out


def next_level(label: Column, levels: dict[str, float]) -> Column:
    """The label of the next larger value; the best one stays."""
    ordered = sorted(levels, key=levels.get)
    out = F.lit(None).cast("string")
    for k, better in zip(ordered, [*ordered[1:], ordered[-1]], strict=True):
        out = F.when(label == k, better).otherwise(out)
    return out


def reaches(label: Column, goal: Column, levels: dict[str, float]) -> Column:
    return level_value(label, levels) >= level_value(goal, levels)


def within(value: Column, wanted: Column | float, tolerance: float) -> Column:
    return F.abs(value - wanted) <= F.lit(tolerance)


def all_within(pairs: list[tuple[Column, Column | float]], tolerance: float) -> Column:
    """Whether each value is within the tolerance of its goal."""
    out = F.lit(True)
    for value, wanted in pairs:
        out = out & within(value, wanted, tolerance)
    return out


def finite(c: Column) -> Column:
    """Not a number and infinities become null."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(math.inf)), c)
