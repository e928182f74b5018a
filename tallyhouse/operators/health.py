"""Health score: six dimensions, weights renormalised over the known ones (X-11 to X-19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AnalyticsConfig
from ..functions.numbers import interpolate, ratio


def product_margin(products: DataFrame, cfg: AnalyticsConfig) -> DataFrame:
    """X-16 input: margin of products with known cost, null if they cover too little revenue."""
    known = F.sum(F.when(F.col("cogs").isNotNull(), F.col("revenue")))
    return products.groupBy("store_id", "period_start").agg(
        F.when(
            (known > 0) & (known.cast("double") / F.sum("revenue").cast("double") >= cfg.product_coverage),
            F.sum("gross_profit").cast("double") / known.cast("double"),
        ).alias("product_margin")
    )


def dimensions(periods: DataFrame, compared: DataFrame, profit: DataFrame, kpis: DataFrame, margins: DataFrame, field_quality: DataFrame, cfg: AnalyticsConfig) -> DataFrame:
    """One row per store and dimension: score (null if excluded) and weight."""
    growth = (
        compared.filter("metric = 'revenue' and pct is not null")
        .groupBy("store_id")
        .agg(F.coalesce(F.max(F.when(F.col("kind") != "yoy", F.col("pct"))), F.max(F.when(F.col("kind") == "yoy", F.col("pct")))).alias("growth"))
    )
    reliable = field_quality.groupBy("store_id").agg(F.avg((F.col("status") == "reliable").cast("double")).alias("reliable"))
    keys = ["store_id", "period_start"]
    wide = (
        periods.select(*keys)
        .join(growth, "store_id", "left")
        .join(profit.select(*keys, "full_margin", "partial_margin", "missing"), keys, "left")
        .join(kpis.select(*keys, "roas", "repeat_purchase_rate", "customer_concentration_top5"), keys, "left")
        .join(margins, keys, "left")
        .join(reliable, "store_id", "left")
    )
    blocked = F.array_contains("missing", "cogs") | F.array_contains("missing", "refunds")
    margin = F.coalesce(F.col("full_margin"), F.when(~blocked, F.col("partial_margin")))
    penalty = F.when(F.col("customer_concentration_top5") >= cfg.concentration, cfg.concentration_penalty).otherwise(0.0)
    scores: dict[str, Column] = {
        "revenue_growth": interpolate(F.col("growth"), cfg.growth_points),
        "profitability": interpolate(margin, cfg.margin_points),
        "marketing_efficiency": interpolate(F.col("roas"), cfg.roas_points),
        "customer_health": F.when(F.col("repeat_purchase_rate").isNotNull(), F.greatest(interpolate(F.col("repeat_purchase_rate"), cfg.repeat_points) - penalty, F.lit(0.0))),
        "product_health": interpolate(F.col("product_margin"), cfg.gross_margin_points),
        "data_quality": F.col("reliable") * 100,
    }
    rows = F.array(*[F.struct(F.lit(n).alias("dimension"), s.cast("double").alias("score"), F.lit(cfg.weights[n]).alias("weight")) for n, s in scores.items()])
    return wide.select("store_id", F.inline(rows))


def interpretation(score: Column) -> Column:
    return F.when(score.isNull(), "unknown").when(score >= 80, "healthy").when(score >= 60, "watch").when(score >= 40, "at_risk").otherwise("critical")


def health_score(dims: DataFrame) -> DataFrame:
    """X-18: weighted mean over known dimensions, half-even; null if none is known."""
    known = F.col("score").isNotNull()
    mean = ratio(F.sum(F.col("score") * F.col("weight")), F.sum(F.when(known, F.col("weight"))))
    out = dims.groupBy("store_id").agg(F.bround(F.round(mean, 9), 0).cast("long").alias("health_score"), F.count_if(known).alias("dimensions"))
    return out.withColumn("interpretation", interpretation(F.col("health_score")))
