"""One row per store and period with every base measure (A-01 to A-15).

Orders, lines, refunds, payments and ads are each aggregated to (store,
period) before they meet, so the raw facts cross the network once, by their
own keys, and no window ever spans a store's raw rows. Orders cross once for
all: grouped by customer they give counts, sums and buyers alike. Only the
parts whose measures are asked for are computed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import periods as P
from ..schemas import MONEY, StoreTables

SUMS = ["revenue", "order_value", "refunds", "ad_spend", "line_revenue", "covered_revenue", "known_cogs"]
COUNTS = ["orders", "units", "clicks", "impressions", "ad_rows", "customers", "new_customers", "repeat_customers"]
UNKNOWN = ["payment_fees", "top5_revenue"]  # null if nothing is known


def customers(t: StoreTables) -> DataFrame:
    """A-08: one row per customer, over all history."""
    return t.orders.groupBy("store_id", "customer_id").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.sum("subtotal").cast(MONEY).alias("revenue"),
        F.min("created_at").alias("first_order_at"),
        F.max("created_at").alias("last_order_at"),
        F.min_by("customer_email", "created_at").alias("email"),
    )


def customer_periods(t: StoreTables, grain: str) -> DataFrame:
    """J-03, A-10: customers active in each period, whether new, and their orders and sums.

    One shuffle by customer serves the grouping and the window over a customer's
    periods; a customer's first period is that of the first order.
    """
    start = P.period_start(F.col("created_at"), grain)
    rows = t.orders.select("store_id", "customer_id", start.alias("period_start"), "subtotal", "total").repartition("store_id", "customer_id")
    active = rows.groupBy("store_id", "customer_id", "period_start").agg(
        F.count(F.lit(1)).alias("n"), F.sum("subtotal").cast(MONEY).alias("spent"), F.sum("total").cast(MONEY).alias("totals")
    )
    first = F.min("period_start").over(W.partitionBy("store_id", "customer_id"))
    return active.withColumn("is_new", F.col("period_start") == first)


def _order_part(t: StoreTables, grain: str) -> DataFrame:
    """Orders alone, where no measure of customers is asked for."""
    at = P.period_start(F.col("created_at"), grain).alias("period_start")
    return t.orders.groupBy("store_id", at).agg(F.count(F.lit(1)).alias("orders"), F.sum("subtotal").alias("revenue"), F.sum("total").alias("order_value"))


def _buyer_parts(t: StoreTables, grain: str, top: bool) -> list[DataFrame]:
    """Orders and buyers from one grouping by customer; ``top`` adds what the five largest spent."""
    active = customer_periods(t, grain)
    buyers = active.groupBy("store_id", "period_start").agg(
        F.sum("n").alias("orders"),
        F.sum("spent").alias("revenue"),
        F.sum("totals").alias("order_value"),
        F.count(F.lit(1)).alias("customers"),
        F.count_if("is_new").alias("new_customers"),
        F.count_if(F.col("n") > 1).alias("repeat_customers"),
    )
    if not top:
        return [buyers]
    rank = F.row_number().over(W.partitionBy("store_id", "period_start").orderBy(F.desc("spent"), "customer_id"))
    return [buyers, active.withColumn("rank", rank).filter("rank <= 5").groupBy("store_id", "period_start").agg(F.sum("spent").alias("top5_revenue"))]


def _line_part(t: StoreTables, grain: str, with_cost: bool) -> DataFrame:
    at = P.period_start(F.col("created_at"), grain).alias("period_start")
    if not with_cost:
        return t.order_lines.groupBy("store_id", at).agg(F.sum("quantity").alias("units"), F.sum("line_revenue").alias("line_revenue"))
    # a product's lines of a period are summed before they meet its cost
    sold = t.order_lines.groupBy("store_id", "sku", at).agg(F.sum("quantity").alias("units"), F.sum("line_revenue").cast(MONEY).alias("line_revenue"))
    costed = sold.join(t.products.select("store_id", "sku", "unit_cogs"), ["store_id", "sku"], "left")
    cost = F.col("units").cast("decimal(18,0)") * F.col("unit_cogs").cast("decimal(14,4)")
    return costed.groupBy("store_id", "period_start").agg(
        F.sum("units").alias("units"),
        F.sum("line_revenue").alias("line_revenue"),
        F.sum(F.when(F.col("unit_cogs").isNotNull(), F.col("line_revenue"))).alias("covered_revenue"),
        F.sum(cost).alias("known_cogs"),
    )


def period_facts(t: StoreTables, grain: str = "week", measures: set[str] | None = None) -> DataFrame:
    """store_id, period_start and all measures; sums and counts of nothing are 0.

    With ``measures`` only those are right; the others are 0 or null.
    """
    at = lambda c: P.period_start(F.col(c), grain).alias("period_start")
    asked = lambda *names: measures is None or bool(measures & set(names))
    parts = []
    if asked("customers", "new_customers", "repeat_customers", "top5_revenue"):
        parts += _buyer_parts(t, grain, asked("top5_revenue"))
    elif asked("orders", "revenue", "order_value"):
        parts.append(_order_part(t, grain))
    if asked("units", "line_revenue", "covered_revenue", "known_cogs"):
        parts.append(_line_part(t, grain, asked("covered_revenue", "known_cogs")))
    if asked("refunds"):
        parts.append(t.refunds.filter("source = 'shopify'").groupBy("store_id", at("created_at")).agg(F.sum("amount").alias("refunds")))
    if asked("payment_fees"):
        parts.append(t.payments.groupBy("store_id", at("created_at")).agg(F.sum("fee").alias("payment_fees")))
    if asked("ad_spend", "clicks", "impressions", "ad_rows"):
        parts.append(
            t.ad_daily.groupBy("store_id", at("day")).agg(
                F.sum("spend").alias("ad_spend"), F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.count(F.lit(1)).alias("ad_rows")
            )
        )
    names = [*SUMS, *COUNTS, *UNKNOWN]
    as_type = {c: "long" if c in COUNTS else "decimal(28,4)" for c in names}
    wide = [p.select("store_id", "period_start", *[(F.col(c) if c in p.columns else F.lit(None)).cast(as_type[c]).alias(c) for c in names]) for p in parts]
    merged = reduce(DataFrame.unionByName, wide).groupBy("store_id", "period_start")
    known = {c: F.sum(c).cast(as_type[c]) for c in names}
    return merged.agg(*[(known[c] if c in UNKNOWN else F.coalesce(known[c], F.lit(0).cast(as_type[c]))).alias(c) for c in names])


def latest_day(t: StoreTables) -> DataFrame:
    """A-14: last day with an order or an advertising row."""
    days = t.orders.select("store_id", F.to_date("created_at").alias("day")).unionByName(t.ad_daily.select("store_id", "day"))
    return days.groupBy("store_id").agg(F.max("day").alias("latest_day"))


def data_period(t: StoreTables) -> DataFrame:
    """A-15: first and last day over all facts."""
    days = t.ad_daily.select("store_id", "day")
    for df in (t.orders, t.payments, t.refunds):
        days = days.unionByName(df.select("store_id", F.to_date("created_at").alias("day")))
    return days.groupBy("store_id").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def product_performance(t: StoreTables, by: list[str] | None = None) -> DataFrame:
    """A-11, J-01 per SKU (and further columns of the lines): revenue, units, cost and margin if known."""
    keys = ["store_id", *(by or []), "sku"]
    cost = F.col("units").cast("decimal(18,0)") * F.col("unit_cogs").cast("decimal(14,4)")
    sold = t.order_lines.groupBy(*keys).agg(F.sum("line_revenue").cast(MONEY).alias("revenue"), F.sum("quantity").alias("units"))
    named = t.products.groupBy("store_id", "sku").agg(F.max("title").alias("title"), F.max("unit_cogs").alias("unit_cogs"))
    out = sold.join(named, ["store_id", "sku"], "left").select(*keys, "title", "revenue", "units", cost.cast(MONEY).alias("cogs"))
    profit = (F.col("revenue") - F.col("cogs")).cast(MONEY)
    return out.withColumn("gross_profit", profit).withColumn("margin", F.when(F.col("revenue") != 0, profit.cast("double") / F.col("revenue").cast("double")))


def campaign_performance(t: StoreTables) -> DataFrame:
    """A-12, J-05 per campaign: sums and ratios, null on a zero denominator."""
    sums = t.ad_daily.groupBy("store_id", "campaign_id").agg(
        F.sum("spend").cast(MONEY).alias("spend"),
        F.sum("clicks").alias("clicks"),
        F.sum("impressions").alias("impressions"),
        F.sum("conversions").alias("conversions"),
        F.sum("conversion_value").cast(MONEY).alias("value"),
    )
    div = lambda a, b: F.when(F.col(b) != 0, F.col(a).cast("double") / F.col(b).cast("double"))
    named = sums.join(t.campaigns.select("store_id", "campaign_id", "name"), ["store_id", "campaign_id"], "left")
    return named.withColumn("name", F.coalesce("name", "campaign_id")).select(
        "*", div("value", "spend").alias("roas"), div("spend", "clicks").alias("cpc"), div("conversions", "clicks").alias("cvr"), div("spend", "conversions").alias("cpa")
    )


def status_profile(t: StoreTables) -> DataFrame:
    """A-13: orders and revenue share per financial status."""
    by = t.orders.groupBy("store_id", "financial_status").agg(F.count(F.lit(1)).alias("orders"), F.sum("subtotal").cast(MONEY).alias("revenue"))
    total = F.sum("revenue").over(W.partitionBy("store_id")).cast("double")
    return by.withColumn("revenue_share", F.when(total != 0, F.col("revenue").cast("double") / total))
