"""Revenue change as clicks x conversion x order value (X-06 to X-10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import AnalyticsConfig
from ..functions import periods as P
from ..functions.numbers import clamp, pct_change, ratio
from ..schemas import MONEY, StoreTables

#: factor: (measure, what an unknown part of it costs in confidence)
PENALTIES = {"paid_clicks": 0.15, "paid_conversion_rate": 0.20, "aov": 0.05}


def two_periods(facts: DataFrame, periods: DataFrame, cfg: AnalyticsConfig) -> DataFrame:
    """Current and previous values of the decomposition, one row per store."""
    wanted = periods.select("store_id", "period_start", P.shift(F.col("period_start"), -1, cfg.grain).alias("previous_start"))
    c = F.col
    values = facts.select(
        "store_id",
        "period_start",
        c("revenue").cast("double").alias("revenue"),
        c("clicks").cast("double").alias("paid_clicks"),
        ratio(c("orders"), c("clicks")).alias("paid_conversion_rate"),
        ratio(c("revenue"), c("orders")).alias("aov"),
    )
    names = ["revenue", *PENALTIES]
    now = values.select("store_id", "period_start", *[F.col(n).alias(f"{n}_1") for n in names])
    before = values.select("store_id", F.col("period_start").alias("previous_start"), *[F.col(n).alias(f"{n}_0") for n in names])
    out = wanted.join(now, ["store_id", "period_start"], "left").join(before, ["store_id", "previous_start"], "left")
    return out.fillna(0.0, ["revenue_0", "revenue_1", "paid_clicks_0", "paid_clicks_1"])


def factors(facts: DataFrame, periods: DataFrame, cfg: AnalyticsConfig) -> DataFrame:
    """X-06, X-07: three factor rows per store, largest contribution first.

    contribution = ln(f1/f0) / ln(R1/R0); null if the factor is unknown or not
    positive, or revenue did not move; no rows if a revenue is not positive.
    """
    both = two_periods(facts, periods, cfg).filter("revenue_0 > 0 and revenue_1 > 0")
    whole = F.log(F.col("revenue_1") / F.col("revenue_0"))
    rows = []
    for name, penalty in PENALTIES.items():
        a, b = F.col(f"{name}_1"), F.col(f"{name}_0")
        part = F.when((F.col("revenue_1") != F.col("revenue_0")) & (a > 0) & (b > 0), F.log(a / b) / whole)
        confidence = F.coalesce(clamp(0.35 + 0.5 * F.when(part.isNotNull(), F.least(F.abs(part), F.lit(1.0))) - penalty, 0.1, 0.9), F.lit(0.1))
        rows.append(F.struct(F.lit(name).alias("factor"), a.alias("current"), b.alias("previous"), pct_change(a, b).alias("pct"), part.alias("contribution"), confidence.alias("confidence")))
    out = both.select("store_id", "period_start", "revenue_1", "revenue_0", F.inline(F.array(*rows)))
    rank = F.row_number().over(W.partitionBy("store_id").orderBy(F.desc_nulls_last(F.abs("contribution")), "factor"))
    return out.withColumn("rank", rank)


def primary_factor(parts: DataFrame) -> DataFrame:
    """X-08."""
    return parts.filter("contribution is not null").groupBy("store_id").agg(F.max_by("factor", F.abs("contribution")).alias("primary_factor"))


def product_contributors(t: StoreTables, periods: DataFrame, facts: DataFrame, cfg: AnalyticsConfig, top: int = 5) -> DataFrame:
    """X-09, J-06: the products whose line revenue moved most, and that move over the change of revenue."""
    at = P.period_start(F.col("created_at"), cfg.grain)
    lines = t.order_lines.join(periods.select("store_id", "period_start"), "store_id")
    lines = lines.withColumn("side", F.when(at == F.col("period_start"), 1).when(at == P.shift(F.col("period_start"), -1, cfg.grain), 0)).filter("side is not null")
    side = lambda k: F.coalesce(F.sum(F.when(F.col("side") == k, F.col("line_revenue"))), F.lit(0)).cast(MONEY)
    skus = lines.groupBy("store_id", "sku").agg(side(1).alias("current"), side(0).alias("previous")).withColumn("delta", (F.col("current") - F.col("previous")).cast(MONEY))
    # the filtered rank is cut before the shuffle, so no task ranks all SKUs of a store
    rank = F.row_number().over(W.partitionBy("store_id").orderBy(F.desc(F.abs("delta")), "sku"))
    moved = skus.withColumn("rank", rank).filter(F.col("rank") <= top)
    whole = two_periods(facts, periods, cfg).select("store_id", (F.col("revenue_1") - F.col("revenue_0")).alias("whole"))
    share = F.when(F.col("whole") != 0, F.col("delta").cast("double") / F.col("whole"))
    return moved.join(whole, "store_id", "left").select("store_id", "sku", "current", "previous", "delta", share.alias("contribution"), "rank")


def campaign_contributors(t: StoreTables, periods: DataFrame, cfg: AnalyticsConfig) -> DataFrame:
    """X-10, J-07: campaigns now and before, worst change of conversions first."""
    ads = t.ad_daily.join(periods.select("store_id", "period_start"), "store_id")
    at = P.period_start(F.col("day"), cfg.grain)
    ads = ads.withColumn("side", F.when(at == F.col("period_start"), 1).when(at == P.shift(F.col("period_start"), -1, cfg.grain), 0)).filter("side is not null")
    side = lambda c, k: F.coalesce(F.sum(F.when(F.col("side") == k, F.col(c))), F.lit(0)).cast("double")
    out = ads.groupBy("store_id", "campaign_id").agg(*[side(c, k).alias(f"{c}_{k}") for c in ("spend", "clicks", "conversions") for k in (1, 0)])
    cvr = lambda k: ratio(F.col(f"conversions_{k}"), F.col(f"clicks_{k}"))
    out = out.join(t.campaigns.select("store_id", "campaign_id", "name"), ["store_id", "campaign_id"], "left").withColumn("name", F.coalesce("name", "campaign_id"))
    out = out.withColumn("delta_conversions", F.col("conversions_1") - F.col("conversions_0")).withColumn("cvr_1", cvr(1)).withColumn("cvr_0", cvr(0)).withColumn("delta_cvr", cvr(1) - cvr(0))
    return out.withColumn("rank", F.row_number().over(W.partitionBy("store_id").orderBy("delta_conversions", "campaign_id")))
