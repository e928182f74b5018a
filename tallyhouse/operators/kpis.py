"""The 17 KPIs in long form (K-01 to K-17), with quality and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import ratio
from ..schemas import METRICS


def kpi_columns() -> dict[str, Column]:
    """Each KPI as an expression over a row of period_facts; a user adds one by adding an entry."""
    c = F.col
    covered = c("covered_revenue")
    return {
        "revenue": c("revenue").cast("double"),
        "orders": c("orders").cast("double"),
        "units": c("units").cast("double"),
        "aov": ratio(c("revenue"), c("orders")),
        "refunds": c("refunds").cast("double"),
        "refund_rate": ratio(c("refunds"), c("order_value")),
        "ad_spend": c("ad_spend").cast("double"),
        "clicks": c("clicks").cast("double"),
        "paid_conversion_rate": ratio(c("orders"), c("clicks")),
        "new_customers": c("new_customers").cast("double"),
        "cac": F.when(c("ad_rows") > 0, ratio(c("ad_spend"), c("new_customers"))),
        "roas": ratio(c("revenue"), c("ad_spend")),
        "gross_margin": F.when(covered > 0, (covered - c("known_cogs")).cast("double") / covered.cast("double")),
        "cogs": F.when(covered > 0, c("known_cogs").cast("double")),
        "payment_fees": c("payment_fees").cast("double"),
        "repeat_purchase_rate": ratio(c("repeat_customers"), c("customers")),
        "customer_concentration_top5": ratio(c("top5_revenue"), c("revenue")),
    }


#: What each KPI is computed from.
NEEDS = {
    "revenue": {"revenue"},
    "orders": {"orders"},
    "units": {"units"},
    "aov": {"revenue", "orders"},
    "refunds": {"refunds"},
    "refund_rate": {"refunds", "order_value"},
    "ad_spend": {"ad_spend"},
    "clicks": {"clicks"},
    "paid_conversion_rate": {"orders", "clicks"},
    "new_customers": {"new_customers"},
    "cac": {"ad_spend", "ad_rows", "new_customers"},
    "roas": {"revenue", "ad_spend"},
    "gross_margin": {"covered_revenue", "known_cogs"},
    "cogs": {"covered_revenue", "known_cogs"},
    "payment_fees": {"payment_fees"},
    "repeat_purchase_rate": {"repeat_customers", "customers"},
    "customer_concentration_top5": {"top5_revenue", "revenue"},
}
#: What makes a period one with data: it has a row even if the asked measures are 0.
PRESENT = {"orders", "ad_rows"}


def kpis_wide(facts: DataFrame) -> DataFrame:
    return facts.select("store_id", "period_start", *[e.alias(n) for n, e in kpi_columns().items()])


def with_status(facts: DataFrame, field_quality: DataFrame, issues: DataFrame) -> DataFrame:
    """Facts with the field statuses and issue flags that KPI quality depends on."""
    fields = ["customer_identity", "payment_fees"]
    status = field_quality.groupBy("store_id").agg(*[F.max(F.when(F.col("field") == f, F.col("status"))).alias(f"q_{f}") for f in fields])
    kinds = ["subtotal_convention_contradiction", "subtotal_contract_unverified", "missing_order_total"]
    flags = issues.groupBy("store_id").agg(*[F.max((F.col("kind") == k).cast("int")).alias(f"i_{k}") for k in kinds])
    out = facts.join(status, "store_id", "left").join(flags, "store_id", "left")
    return out.fillna("unavailable", [f"q_{f}" for f in fields]).fillna(0, [f"i_{k}" for k in kinds])


def kpis_long(facts: DataFrame, field_quality: DataFrame, issues: DataFrame) -> DataFrame:
    """One row per store, period and KPI: value, unit, data_quality, notes, definition."""
    value = kpi_columns()
    coverage = ratio(F.col("covered_revenue"), F.col("line_revenue"))
    incomplete = lambda v: F.when(v.isNull(), "unavailable").otherwise("incomplete")
    margin = F.when(F.col("covered_revenue") <= 0, "unavailable").when(coverage >= 0.95, "reliable").otherwise("incomplete")
    reliable = F.lit("reliable")
    quality = {
        "revenue": F.when((F.col("revenue") < 0) | (F.col("i_subtotal_convention_contradiction") == 1), "incomplete").otherwise("reliable"),
        "orders": reliable,
        "units": reliable,
        "aov": F.when(value["aov"].isNull(), "unavailable").otherwise("reliable"),
        "refunds": reliable,
        "refund_rate": F.when(value["refund_rate"].isNull(), "unavailable").when(F.col("i_missing_order_total") == 1, "incomplete").otherwise("reliable"),
        "ad_spend": F.lit("incomplete"),
        "clicks": F.lit("incomplete"),
        "paid_conversion_rate": incomplete(value["paid_conversion_rate"]),
        "new_customers": F.col("q_customer_identity"),
        "cac": incomplete(value["cac"]),
        "roas": incomplete(value["roas"]),
        "gross_margin": margin,
        "cogs": margin,
        "payment_fees": F.col("q_payment_fees"),
        "repeat_purchase_rate": incomplete(value["repeat_purchase_rate"]),
        "customer_concentration_top5": F.col("q_customer_identity"),
    }
    notes = {
        "revenue": F.when(F.col("i_subtotal_contract_unverified") == 1, F.array(F.lit("subtotal_contract_unverified"))).otherwise(F.array().cast("array<string>")),
        "cac": F.when(F.col("ad_rows") == 0, F.array(F.lit("no_ad_data"))).otherwise(F.array().cast("array<string>")),
        "gross_margin": F.array(F.concat(F.lit("cost_coverage="), F.when(coverage.isNotNull(), F.format_string("%.0f%%", coverage * 100)).otherwise("unknown"))),
    }
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("metric"),
                v.alias("value"),
                F.lit(METRICS[n][0]).alias("unit"),
                quality[n].alias("data_quality"),
                notes.get(n, F.array().cast("array<string>")).alias("notes"),
                F.lit(METRICS[n][1]).alias("definition"),
            )
            for n, v in value.items()
        ]
    )
    return with_status(facts, field_quality, issues).select("store_id", "period_start", F.inline(rows))
