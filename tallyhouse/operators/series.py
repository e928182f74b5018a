"""Dense time series, rolling means and comparisons (P-04 to P-11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import AnalyticsConfig
from ..functions import periods as P
from ..functions.numbers import pct_change, ratio

SERIES_MEASURES = ["revenue", "orders", "ad_spend", "clicks", "refunds"]


def store_periods(latest_day: DataFrame, cfg: AnalyticsConfig) -> DataFrame:
    """P-04: store_id, latest_day, period_start of the last complete period."""
    return latest_day.select("store_id", "latest_day", P.last_complete(F.col("latest_day"), cfg.grain).alias("period_start"))


def dense(facts: DataFrame, periods: DataFrame, cfg: AnalyticsConfig) -> DataFrame:
    """P-05, P-06: one row for each of the last periods, 0 where nothing happened."""
    days = periods.select("store_id", F.explode(P.calendar(F.col("period_start"), cfg.lookback, cfg.grain)).alias("period_start"))
    return days.join(facts, ["store_id", "period_start"], "left").fillna(0, [c for c in facts.columns[2:] if c not in ("payment_fees", "top5_revenue")])


def series(facts: DataFrame, periods: DataFrame, cfg: AnalyticsConfig) -> DataFrame:
    """P-06 in long form: store_id, metric, period_start, value (ratios may be null)."""
    c = F.col
    values = {
        "revenue": c("revenue").cast("double"),
        "orders": c("orders").cast("double"),
        "aov": ratio(c("revenue"), c("orders")),
        "ad_spend": c("ad_spend").cast("double"),
        "paid_clicks": c("clicks").cast("double"),
        "paid_conversion_rate": ratio(c("orders"), c("clicks")),
        "roas": ratio(c("revenue"), c("ad_spend")),
        "refunds": c("refunds").cast("double"),
    }
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), v.alias("value")) for n, v in values.items()])
    return dense(facts, periods, cfg).select("store_id", "period_start", F.inline(rows)).select("store_id", "metric", "period_start", "value")


def rolling_average(points: DataFrame, cfg: AnalyticsConfig) -> DataFrame:
    """P-07: mean of the known values at the last positions."""
    w = W.partitionBy("store_id", "metric").orderBy("period_start").rowsBetween(1 - cfg.rolling, 0)
    return points.withColumn("rolling", F.avg("value").over(w))


def comparisons(facts: DataFrame, periods: DataFrame, cfg: AnalyticsConfig) -> DataFrame:
    """P-09: the last complete period against the one before (wow or mom) and a year before (yoy)."""
    now = F.col("period_start")
    back = F.array(
        F.struct(F.lit("wow" if cfg.grain == "week" else "mom").alias("kind"), P.shift(now, -1, cfg.grain).alias("ref_start")),
        F.struct(F.lit("yoy").alias("kind"), P.year_before(now, cfg.grain).alias("ref_start")),
    )
    c = F.col
    values = {
        "revenue": c("revenue").cast("double"),
        "orders": c("orders").cast("double"),
        "aov": ratio(c("revenue"), c("orders")),
        "ad_spend": c("ad_spend").cast("double"),
        "paid_clicks": c("clicks").cast("double"),
        "paid_conversion_rate": ratio(c("orders"), c("clicks")),
        "roas": ratio(c("revenue"), c("ad_spend")),
        "refunds": c("refunds").cast("double"),
    }
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), v.alias("value")) for n, v in values.items()])
    has = (c("orders") > 0) | (c("ad_rows") > 0)
    long = facts.select("store_id", "period_start", has.alias("has_data"), F.inline(rows))
    empty = F.array(*[F.lit(n) for n in values])
    wanted = periods.select("store_id", "period_start", F.inline(back)).withColumn("metric", F.explode(empty))
    current = long.select("store_id", "period_start", "metric", F.col("value").alias("current"))
    before = long.select("store_id", F.col("period_start").alias("ref_start"), "metric", F.col("value").alias("reference"), "has_data")
    both = wanted.join(current, ["store_id", "period_start", "metric"], "left").join(before, ["store_id", "ref_start", "metric"], "left")
    available = F.coalesce(F.col("has_data"), F.lit(False))
    out = both.withColumn("available", available).withColumn("reference", F.when(F.col("available"), F.col("reference")))
    sums = ["revenue", "orders", "ad_spend", "paid_clicks", "refunds"]
    out = out.withColumn("current", F.when(F.col("metric").isin(sums), F.coalesce("current", F.lit(0.0))).otherwise(F.col("current")))
    return out.select(
        "store_id",
        "kind",
        "metric",
        "period_start",
        "ref_start",
        "available",
        "current",
        "reference",
        (F.col("current") - F.col("reference")).alias("delta"),
        pct_change(F.col("current"), F.col("reference")).alias("pct"),
    )


def negative_periods(facts: DataFrame, periods: DataFrame, cfg: AnalyticsConfig) -> DataFrame:
    """P-10: number and labels of the periods in the series with negative revenue."""
    bad = dense(facts, periods, cfg).filter("revenue < 0")
    return bad.groupBy("store_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list(P.label(F.col("period_start"), cfg.grain))), ", ").alias("labels"))


def period_profile(orders: DataFrame, cfg: AnalyticsConfig) -> DataFrame:
    """P-11: spanned periods, periods without orders, partial first and last one."""
    start = P.period_start(F.col("created_at"), cfg.grain)
    days = orders.groupBy("store_id").agg(
        F.min(F.to_date("created_at")).alias("first_day"), F.max(F.to_date("created_at")).alias("last_day"), F.countDistinct(start).alias("with_orders")
    )
    a, b = P.period_start(F.col("first_day"), cfg.grain), P.period_start(F.col("last_day"), cfg.grain)
    n = (F.date_diff(b, a) / 7 + 1) if cfg.grain == "week" else F.months_between(b, a) + 1
    return days.select(
        "store_id",
        "first_day",
        "last_day",
        n.cast("long").alias("spanned"),
        (n.cast("long") - F.col("with_orders")).alias("empty_periods"),
        (a < F.col("first_day")).alias("first_partial"),
        (F.date_sub(P.period_end(b, cfg.grain), 1) > F.col("last_day")).alias("last_partial"),
    )
