"""Contribution profit from known and unknown components (X-04, X-05)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import AnalyticsConfig
from ..functions import periods as P
from ..schemas import MONEY, StoreTables


def refund_bounds(t: StoreTables, cfg: AnalyticsConfig, source: str | None = "shopify") -> DataFrame:
    """X-04 per refund: bounds of its share of product revenue, and whether it is undetermined."""
    refunds = t.refunds if source is None else t.refunds.filter(F.col("source") == source)
    orders = t.orders.select("store_id", "order_id", "subtotal", "total")
    both = refunds.join(orders, ["store_id", "order_id"], "left")
    tol = F.lit(cfg.money_tolerance).cast(MONEY)
    amount, sub, total = F.col("amount"), F.col("subtotal"), F.col("total")
    odd = sub.isNull() | total.isNull() | (sub < 0) | (total + tol < sub) | (amount > total + tol)
    low = F.greatest(F.lit(0).cast(MONEY), amount - (total - sub)).cast(MONEY)
    high = F.least(amount, sub).cast(MONEY)
    wide = F.coalesce(high - low > tol, F.lit(True))
    undetermined = F.coalesce(odd, F.lit(True)) | wide
    return both.select(
        "store_id",
        "refund_id",
        "order_id",
        "created_at",
        "amount",
        undetermined.alias("undetermined"),
        F.when(odd, F.lit(0).cast(MONEY)).otherwise(low).alias("low"),
        F.when(odd, amount).otherwise(high).alias("high"),
    )


def refund_basis(t: StoreTables, cfg: AnalyticsConfig) -> DataFrame:
    """X-04 per store and period: value (null if any refund is undetermined), low, high, counts."""
    rows = refund_bounds(t, cfg)
    open_ = F.count_if("undetermined")
    return rows.groupBy("store_id", P.period_start(F.col("created_at"), cfg.grain).alias("period_start")).agg(
        F.when(open_ == 0, F.sum("low")).cast("decimal(28,4)").alias("refund_cost"),
        F.sum("low").cast("decimal(28,4)").alias("refund_low"),
        F.sum("high").cast("decimal(28,4)").alias("refund_high"),
        open_.alias("undetermined"),
        F.count(F.lit(1)).alias("refund_count"),
    )


def profitability(facts: DataFrame, basis: DataFrame, cfg: AnalyticsConfig, shipping: DataFrame | None = None) -> DataFrame:
    """X-05: components, what is missing, full and partial profit and margin.

    Full profit needs all five components. Partial profit is revenue less the
    known ones; it needs revenue and one known component. ``shipping``
    (store_id, period_start, shipping_cost) is optional and normally unknown.
    """
    out = facts.join(basis, ["store_id", "period_start"], "left")
    out = out.join(shipping, ["store_id", "period_start"], "left") if shipping is not None else out.withColumn("shipping_cost", F.lit(None).cast("decimal(28,4)"))
    c = F.col
    complete = (c("line_revenue") > 0) & (c("covered_revenue").cast("double") / c("line_revenue").cast("double") >= cfg.cogs_complete)
    zero = F.lit(0).cast("decimal(28,4)")
    parts = {
        "cogs": F.when(complete, c("known_cogs")),
        "payment_fees": c("payment_fees"),
        "advertising": F.when(c("ad_rows") > 0, c("ad_spend")),
        "refunds": F.when(c("refund_count").isNull(), zero).otherwise(c("refund_cost")),
        "shipping": c("shipping_cost"),
    }
    out = out.withColumns({f"cost_{n}": e.cast("decimal(28,4)") for n, e in parts.items()})
    known = sum((F.coalesce(c(f"cost_{n}"), zero) for n in parts), zero)
    missing = F.array_compact(F.array(*[F.when(c(f"cost_{n}").isNull(), F.lit(n)) for n in parts]))
    out = out.withColumn("missing", missing).withColumn("known_costs", known.cast("decimal(28,4)"))
    out = out.withColumn("full_profit", F.when(F.size("missing") == 0, (c("revenue") - c("known_costs")).cast("decimal(28,4)")))
    some = (c("revenue") != 0) & (F.size("missing") < len(parts))
    out = out.withColumn("partial_profit", F.when(some, (c("revenue") - c("known_costs")).cast("decimal(28,4)")))
    margin = lambda p: F.when(c("revenue") != 0, c(p).cast("double") / c("revenue").cast("double"))
    return out.select(
        "store_id",
        "period_start",
        "revenue",
        *[f"cost_{n}" for n in parts],
        "refund_low",
        "refund_high",
        "undetermined",
        "missing",
        "full_profit",
        "partial_profit",
        margin("full_profit").alias("full_margin"),
        margin("partial_profit").alias("partial_margin"),
    )
