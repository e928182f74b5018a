"""Anomalies of the latest point against a rolling baseline (X-01 to X-03, P-12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DIRECTIONS, AnalyticsConfig
from ..functions.numbers import pct_change


def severity(pct: Column, z: Column, cfg: AnalyticsConfig) -> Column:
    p, z = F.abs(pct), F.coalesce(F.abs(z), F.lit(0.0))
    return F.when((p >= cfg.high_pct) | (z >= cfg.high_z), "high").when((p >= cfg.alert_pct) | (z >= cfg.alert_z), "medium").otherwise("low")


def assessment(metric: Column, pct: Column) -> Column:
    up = [m for m, d in DIRECTIONS.items() if d == "up"]
    down = [m for m, d in DIRECTIONS.items() if d == "down"]
    good = (metric.isin(up) & (pct > 0)) | (metric.isin(down) & (pct < 0))
    return F.when(~metric.isin(up + down), "neutral").when(good, "favorable").otherwise("unfavorable")


def detect(points: DataFrame, cfg: AnalyticsConfig) -> DataFrame:
    """Rows of ``series`` in, one row per anomaly out.

    A metric's current point is its last known one; the baseline is the eight
    known ones before it. Reported if it is at least 8 % off the mean and
    either 15 % off or two population standard deviations.
    """
    back = F.row_number().over(W.partitionBy("store_id", "metric").orderBy(F.desc("period_start")))
    known = points.filter("value is not null").withColumn("back", back).filter(F.col("back") <= cfg.baseline + 1)
    base = F.when(F.col("back") > 1, F.col("value"))
    one = known.groupBy("store_id", "metric").agg(
        F.max(F.when(F.col("back") == 1, F.col("period_start"))).alias("period_start"),
        F.max(F.when(F.col("back") == 1, F.col("value"))).alias("value"),
        F.avg(base).alias("mean"),
        F.stddev_pop(base).alias("spread"),
        F.count(base).alias("points"),
    )
    pct = pct_change(F.col("value"), F.col("mean"))
    z = F.when((F.col("points") >= cfg.min_points) & (F.col("spread") > 1e-12), (F.col("value") - F.col("mean")) / F.col("spread"))
    scored = one.withColumn("pct", pct).withColumn("z", z)
    far = (F.abs("pct") >= cfg.alert_pct) | (F.coalesce(F.abs("z"), F.lit(0.0)) >= cfg.alert_z)
    return scored.filter((F.abs("pct") >= cfg.min_pct) & far).select(
        "store_id",
        "metric",
        "period_start",
        "value",
        "mean",
        "points",
        "pct",
        "z",
        F.when(F.col("pct") > 0, "up").otherwise("down").alias("direction"),
        severity(F.col("pct"), F.col("z"), cfg).alias("severity"),
        assessment(F.col("metric"), F.col("pct")).alias("assessment"),
    )
