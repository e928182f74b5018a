"""A value that is worked out once, however often it is named."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value; outside of a lambda a long expression may be worked out again wherever it is named."""
    return F.get(F.transform(F.array(value), f), F.lit(0))
