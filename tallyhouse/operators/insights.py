"""Findings and recommendations (X-20 to X-25, X-28, X-29): stable codes, English templates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import AnalyticsConfig
from ..functions.numbers import ratio

RECOMMENDATIONS = {
    "paid_clicks": "check budgets, bids and paused campaigns",
    "paid_conversion_rate": "check landing pages, stock and checkout",
    "aov": "check discounts, bundles and the product mix",
}
# Severities from the gravest, and the metrics that revenue is made of.
SEVERITIES = ["high", "medium", "low", "info"]
DECOMPOSED = ["orders", "aov", "paid_conversion_rate", "paid_clicks", "roas"]


def _row(df: DataFrame, kind: str, subject: Column, severity: Column, confidence: Column, value: Column, statement: Column) -> DataFrame:
    return df.select(
        "store_id", F.lit(kind).alias("kind"), subject.cast("string").alias("subject"), severity.alias("severity"), confidence.cast("double").alias("confidence"), value.cast("double").alias("value"), statement.alias("statement")
    )


def _pct(c: str) -> Column:
    return F.format_string("%+.1f%%", F.col(c) * 100)


def declines(anomalies: DataFrame, parts: DataFrame, primary: DataFrame) -> DataFrame:
    """X-20, first rule: a fall of revenue, with the factor that explains most of it."""
    fell = anomalies.filter("metric = 'revenue' and direction = 'down'").select("store_id", "severity", "pct")
    cause = parts.filter("contribution is not null").join(primary, "store_id").filter("factor = primary_factor").select("store_id", "factor", "confidence")
    led = fell.join(cause, "store_id", "left")
    return _row(led, "revenue_decline", F.coalesce("factor", F.lit("revenue")), F.col("severity"), F.coalesce("confidence", F.lit(0.4)), F.col("pct"), F.concat(F.lit("Revenue changed by "), _pct("pct")))


def findings(anomalies: DataFrame, parts: DataFrame, primary: DataFrame, profit: DataFrame, products: DataFrame, kpis: DataFrame, campaigns: DataFrame, cfg: AnalyticsConfig) -> DataFrame:
    """X-20: the six rules, one DataFrame each; all inputs are of the chosen period.

    A revenue decline takes in the anomalies of what revenue is made of. Other
    anomalies are "info" if favorable, "low" if neutral, else as severe as
    they are. Every product with a low margin is a finding.
    """
    r1 = declines(anomalies, parts, primary)
    told = r1.select("store_id", F.lit(True).alias("told"))
    others = anomalies.filter("metric <> 'revenue'").join(told, "store_id", "left").filter(F.col("told").isNull() | ~F.col("metric").isin(DECOMPOSED))
    level = F.when(F.col("assessment") == "favorable", "info").when(F.col("assessment") == "neutral", "low").otherwise(F.col("severity"))
    r2 = _row(others, "anomaly", F.col("metric"), level, F.lit(0.45), F.col("pct"), F.concat(F.col("metric"), F.lit(" changed by "), _pct("pct")))
    unknown = profit.filter("full_profit is null")
    r3 = _row(unknown, "profit_unavailable", F.array_join("missing", ","), F.lit("medium"), F.lit(0.9), F.size("missing"), F.concat(F.lit("Profit is unknown without "), F.array_join("missing", ", ")))
    low = products.filter((F.col("margin") < cfg.low_margin) & (F.col("revenue") > 0))
    r4 = _row(low, "low_margin_product", F.col("sku"), F.lit("medium"), F.lit(0.7), F.col("margin"), F.concat(F.lit("Product "), F.col("sku"), F.lit(" has a margin of "), _pct("margin")))
    top = kpis.filter(F.col("customer_concentration_top5") >= cfg.concentration)
    r5 = _row(top, "customer_concentration", F.lit("top5"), F.lit("medium"), F.lit(0.6), F.col("customer_concentration_top5"), F.lit("Five customers hold a large share of revenue"))
    best = campaigns.filter("delta_conversions > 0").groupBy("store_id").agg(F.max_by(F.struct("campaign_id", "delta_conversions"), F.struct("delta_conversions", "campaign_id")).alias("b"))
    r6 = _row(best, "campaign_opportunity", F.col("b.campaign_id"), F.lit("info"), F.lit(0.4), F.col("b.delta_conversions"), F.concat(F.lit("Campaign "), F.col("b.campaign_id"), F.lit(" gained conversions")))
    return reduce(DataFrame.unionByName, [r1, r2, r3, r4, r5, r6])


def ranked(found: DataFrame) -> DataFrame:
    """X-22, X-29: revenue decline first, then severity, then confidence; ids unique per store."""
    order = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    w = W.partitionBy("store_id").orderBy((F.col("kind") != "revenue_decline").cast("int"), order, F.desc("confidence"), "kind", "subject")
    same = F.row_number().over(W.partitionBy("store_id", "kind").orderBy("rank"))
    out = found.withColumn("rank", F.row_number().over(w)).withColumn("_n", same)
    return out.withColumn("item_id", F.when(F.col("_n") > 1, F.concat("kind", F.lit("-"), F.col("_n").cast("string"))).otherwise(F.col("kind"))).drop("_n")


def evidence(found: DataFrame, anomalies: DataFrame) -> DataFrame:
    """X-20, X-29: what each finding rests on, one row per anomaly, with ids that stay the same from run to run.

    A revenue decline rests on the anomaly of revenue and on all those of what
    revenue is made of, which are no findings of their own then.
    """
    seen = anomalies.select("store_id", F.concat(F.lit("anomaly-"), F.col("metric")).alias("evidence_id"), "metric", "direction", F.col("severity").alias("evidence_severity"), "value", "mean", "pct")
    items = found.select("store_id", "item_id", "kind", "subject")
    lead = items.filter("kind = 'revenue_decline'").join(seen.filter(F.col("metric").isin(["revenue", *DECOMPOSED])), "store_id")
    own = items.filter("kind = 'anomaly'").join(seen, "store_id").filter("subject = metric")
    return lead.unionByName(own).drop("kind", "subject")


def with_evidence(found: DataFrame, rests_on: DataFrame) -> DataFrame:
    """The findings with their evidence as a nested list, and the relative change of the first as impact."""
    item = F.struct("evidence_id", "metric", "direction", F.col("evidence_severity").alias("severity"), "value", "mean", "pct")
    of = rests_on.groupBy("store_id", "item_id").agg(F.sort_array(F.collect_list(item)).alias("evidence"))
    return found.join(of, ["store_id", "item_id"], "left").withColumn("impact", F.when(F.col("kind").isin("revenue_decline", "anomaly"), F.col("value")))


def recommendations(found: DataFrame, campaigns: DataFrame) -> DataFrame:
    """X-21: one text per revenue decline, with the worst campaign when conversion fell."""
    lead = found.filter("kind = 'revenue_decline'").select("store_id", F.col("subject").alias("factor"))
    worst = campaigns.filter("rank = 1 and delta_conversions < 0").select("store_id", "campaign_id")
    text = F.lit("review revenue drivers")
    for factor, advice in RECOMMENDATIONS.items():
        text = F.when(F.col("factor") == factor, advice).otherwise(text)
    also = F.when((F.col("factor") == "paid_conversion_rate") & F.col("campaign_id").isNotNull(), F.concat(F.lit("; worst campaign: "), F.col("campaign_id"))).otherwise("")
    return lead.join(worst, "store_id", "left").select("store_id", "factor", F.concat(text, also).alias("recommendation"))


def hypotheses(parts: DataFrame) -> DataFrame:
    """X-28: equal statements merged, their supports collected."""
    said = parts.filter("contribution is not null").select(
        "store_id",
        F.when(F.col("factor") == "paid_clicks", "traffic explains the change").otherwise("shopping behaviour explains the change").alias("statement"),
        "factor",
    )
    return said.groupBy("store_id", "statement").agg(F.array_join(F.array_sort(F.collect_set("factor")), ",").alias("supports"))


def limitations(profit: DataFrame, parts: DataFrame, dims: DataFrame, issues: DataFrame, periods: DataFrame) -> DataFrame:
    """X-24: ordered list without repeats, one row per store."""
    missing = profit.select("store_id", F.transform("missing", lambda m: F.concat(F.lit("cost unknown: "), m)).alias("a"))
    no_cause = periods.select("store_id").join(parts.select("store_id").distinct(), "store_id", "left_anti").select("store_id", F.array(F.lit("revenue change not decomposed")).alias("b"))
    out = dims.filter("score is null").groupBy("store_id").agg(F.array_sort(F.collect_list(F.concat(F.lit("not scored: "), F.col("dimension")))).alias("c"))
    warned = issues.filter("severity in ('warning', 'error')").groupBy("store_id").agg(F.array_sort(F.collect_set(F.concat(F.lit("issue: "), F.col("kind")))).alias("d"))
    all_ = periods.select("store_id")
    for part in (missing, no_cause, out, warned):
        all_ = all_.join(part, "store_id", "left")
    empty = F.array().cast("array<string>")
    return all_.select("store_id", F.array_distinct(F.concat(*[F.coalesce(c, empty) for c in "abcd"])).alias("limitations"))


def top_customers(orders: DataFrame, n: int = 5) -> DataFrame:
    """X-23, F-08: largest customers, pseudonymised."""
    by = orders.groupBy("store_id", "customer_id").agg(F.sum("subtotal").cast("decimal(28,4)").alias("revenue"), F.count(F.lit(1)).alias("orders"))
    by = by.withColumn("rank", F.row_number().over(W.partitionBy("store_id").orderBy(F.desc("revenue"), "customer_id"))).filter(F.col("rank") <= n)
    alias = F.concat(F.lit("cust_"), F.left(F.sha2(F.col("customer_id").cast("binary"), 256), F.lit(12)))
    return by.select("store_id", "rank", alias.alias("customer"), "revenue", "orders")


def executive_summary(kpis: DataFrame, score: DataFrame, found: DataFrame) -> DataFrame:
    """X-25: one sentence per part."""
    lead = found.filter("rank = 1").select("store_id", F.col("statement").alias("lead"))
    both = kpis.select("store_id", "revenue", "orders").join(score, "store_id", "left").join(lead, "store_id", "left")
    text = F.concat_ws(
        " ",
        F.concat(F.lit("Revenue "), F.format_number("revenue", 2), F.lit(" from "), F.col("orders").cast("long").cast("string"), F.lit(" orders.")),
        F.when(F.col("health_score").isNotNull(), F.concat(F.lit("Health score "), F.col("health_score").cast("string"), F.lit(" ("), F.col("interpretation"), F.lit(")."))),
        F.when(F.col("lead").isNotNull(), F.concat(F.col("lead"), F.lit("."))),
    )
    return both.select("store_id", text.alias("summary"))
