"""Canonical tables. Every one leads with store_id; unknown stays null; a line carries its order's date."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(19,4)"
SCHEMAS = {
    "products": f"store_id string, sku string, product_ref string, title string, unit_cogs {MONEY}",
    "orders": (
        f"store_id string, order_id string, customer_id string, customer_email string, created_at timestamp, currency string, subtotal {MONEY}, "
        f"discount {MONEY}, shipping {MONEY}, tax {MONEY}, total {MONEY}, has_total boolean, financial_status string, cancelled boolean, draft boolean, source string"
    ),
    "order_lines": f"store_id string, order_id string, created_at timestamp, line_no int, sku string, title string, quantity long, unit_price {MONEY}, line_revenue {MONEY}",
    "payments": f"store_id string, payment_id string, created_at timestamp, amount {MONEY}, fee {MONEY}, net {MONEY}, status string, order_id string, customer_email string, source string",
    "refunds": f"store_id string, refund_id string, created_at timestamp, amount {MONEY}, order_id string, source string",
    "campaigns": "store_id string, campaign_id string, name string, channel string",
    "ad_daily": f"store_id string, campaign_id string, day date, spend {MONEY}, impressions long, clicks long, conversions double, conversion_value {MONEY}",
    "issues": "store_id string, source string, kind string, severity string, message string, count long",
}


@dataclass(frozen=True)
class StoreTables:
    """The canonical tables of all stores. ``issues`` is what reading them found."""

    orders: DataFrame
    order_lines: DataFrame
    products: DataFrame
    payments: DataFrame
    refunds: DataFrame
    campaigns: DataFrame
    ad_daily: DataFrame
    issues: DataFrame

    def only(self, store_id: str) -> StoreTables:
        """One store; the filter reaches the scans (F-04)."""
        return StoreTables(*(getattr(self, n).filter(F.col("store_id") == F.lit(store_id)) for n in self.__dataclass_fields__))


#: unit and definition of the KPIs.
METRICS = {
    "revenue": ("money", "sum of order subtotals after discounts"),
    "orders": ("count", "number of orders"),
    "units": ("count", "sum of line quantities"),
    "aov": ("money", "revenue per order"),
    "refunds": ("money", "refunds dated by their order"),
    "refund_rate": ("ratio", "refunds over order totals"),
    "ad_spend": ("money", "advertising spend"),
    "clicks": ("count", "paid clicks"),
    "paid_conversion_rate": ("ratio", "orders per paid click"),
    "new_customers": ("count", "customers whose first order ever is in the period"),
    "cac": ("money", "advertising spend per new customer"),
    "roas": ("ratio", "revenue over advertising spend"),
    "gross_margin": ("ratio", "margin of lines with known cost"),
    "cogs": ("money", "known cost of goods"),
    "payment_fees": ("money", "known payment fees"),
    "repeat_purchase_rate": ("ratio", "customers with several orders in the period"),
    "customer_concentration_top5": ("ratio", "revenue share of the five largest customers"),
}
