"""Calendar periods: ISO weeks and months, half-open (P-01 to P-05)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def period_start(ts: Column, grain: str) -> Column:
    return F.date_trunc(grain, ts).cast("date")


def shift(start: Column, steps: int, grain: str) -> Column:
    """P-02: the period ``steps`` later (earlier if negative)."""
    return F.date_add(start, 7 * steps) if grain == "week" else F.add_months(start, steps)


def period_end(start: Column, grain: str) -> Column:
    return shift(start, 1, grain)


def year_before(start: Column, grain: str) -> Column:
    """P-03: 364 days back for weeks, the same month of last year for months."""
    return F.date_sub(start, 364) if grain == "week" else F.add_months(start, -12)


def label(start: Column, grain: str) -> Column:
    """``2026-W37`` with the ISO year, or ``2026-09``."""
    if grain == "week":
        return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), start), F.weekofyear(start))
    return F.date_format(start, "yyyy-MM")


def last_complete(latest_day: Column, grain: str, today: Column | None = None) -> Column:
    """P-04: the period of the latest day, one earlier if it isn't over."""
    start = period_start(latest_day, grain)
    last_day = F.date_sub(period_end(start, grain), 1)
    return F.when(last_day > F.least(latest_day, today if today is not None else latest_day), shift(start, -1, grain)).otherwise(start)


def calendar(latest: Column, n: int, grain: str) -> Column:
    """P-05: array of the ``n`` period starts that end with ``latest``."""
    step = F.expr("interval 7 days" if grain == "week" else "interval 1 month")
    return F.sequence(shift(latest, 1 - n, grain), latest, step)
