"""Numbers that may be unknown: null in, null out (T8, T12, X-07, X-11)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """Double; null on a zero or unknown denominator."""
    return F.when(b != 0, a.cast("double") / b.cast("double"))


def pct_change(now: Column, before: Column) -> Column:
    return F.when(before != 0, (now - before) / F.abs(before))


def interpolate(value: Column, points: Sequence[tuple[float, float]]) -> Column:
    """Piecewise linear through (x, y), level beyond both ends."""
    out = F.when(value.isNull(), None).when(value <= points[0][0], float(points[0][1]))
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        out = out.when(value <= x1, y0 + (value - x0) / (x1 - x0) * (y1 - y0))
    return out.otherwise(float(points[-1][1]))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))
