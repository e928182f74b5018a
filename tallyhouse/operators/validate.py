"""Checks between tables, reconciliation and grounding (V-series)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import AnalyticsConfig
from ..schemas import StoreTables

TOLERANCE = 0.011


def relational_checks(t: StoreTables) -> DataFrame:
    """V-01, J-13: failures of each relation between the canonical tables, per store.

    All relations to an order are counted in one grouping by order, to which
    every table sends rows already summed by order; the others in one grouping
    of each table.
    """
    c, tol = F.col, F.lit(TOLERANCE)
    keys = ["store_id", "order_id"]
    count, one = F.count(F.lit(1)), F.lit(1).cast("long")
    none = lambda kind: F.lit(None).cast(kind)
    money = "decimal(28,4)"
    # columns: what a table says of an order
    shape = {"o": "long", "undated": "long", "apart": "long", "discounted": money, "subtotal": money, "total": money, "l": "long", "bad_quantity": "long", "gross": money, "r": "long", "refunded": money, "p": "long", "low": money, "high": money}
    send = lambda df, **have: df.select(*keys, *[(have[n].cast(k) if n in have else none(k)).alias(n) for n, k in shape.items()])
    off = F.abs(c("subtotal") + c("shipping") + c("tax") - c("total")) > tol
    orders = send(t.orders, o=one, undated=c("created_at").isNull().cast("long"), apart=F.coalesce(off, F.lit(False)).cast("long"), discounted=c("discount"), subtotal=c("subtotal"), total=c("total"))
    lines = t.order_lines.groupBy(*keys).agg(count.alias("n"), F.count_if(c("quantity") <= 0).alias("bad"), F.sum("line_revenue").alias("g"))
    refunds = t.refunds.groupBy(*keys).agg(count.alias("n"), F.sum(F.when(c("source") == "shopify", c("amount"))).alias("a"))
    paid = t.payments.groupBy(*keys).agg(count.alias("n"), F.min("amount").alias("a"), F.max("amount").alias("b"))
    sent = [orders, send(lines, l=c("n"), bad_quantity=c("bad"), gross=c("g")), send(refunds, r=c("n"), refunded=c("a")), send(paid, p=c("n"), low=c("a"), high=c("b"))]
    by_order = reduce(DataFrame.unionByName, sent).groupBy(*keys).agg(*[F.sum(n).alias(n) if n not in ("low", "high", "discounted", "subtotal", "total") else F.max(n).alias(n) for n in shape])
    alone = c("o").isNull()
    known = ~alone
    when = lambda e: F.sum(F.when(F.coalesce(e, F.lit(False)), one))
    times = lambda e, n: F.sum(F.when(F.coalesce(e, F.lit(False)), c(n)))
    of_orders = {
        "unique_orders": when(c("o") > 1),
        "lines_have_order": times(alone, "l"),
        "refunds_have_order": times(alone, "r"),
        "payments_have_order": times(alone, "p"),
        "subtotal_is_lines_less_discount": when(known & (F.abs(c("gross") - c("discounted") - c("subtotal")) > tol)),
        "total_is_its_parts": F.sum("apart"),
        "refund_within_total": when(known & (c("refunded") > c("total") + tol)),
        "payment_is_total": when(known & ((F.abs(c("low") - c("total")) > tol) | (F.abs(c("high") - c("total")) > tol))),
        "quantity_positive": F.sum("bad_quantity"),
        "orders_dated": F.sum("undated"),
    }
    wide = by_order.groupBy("store_id").agg(*[F.coalesce(e, F.lit(0)).cast("long").alias(n) for n, e in of_orders.items()], F.max("o").alias("has_orders"))
    long = lambda df, names: df.select("store_id", F.inline(F.array(*[F.struct(F.lit(n).alias("check"), c(n).alias("failures")) for n in names])))
    # a product's lines and entries meet in one grouping by SKU
    sku = t.order_lines.groupBy("store_id", "sku").agg(count.alias("n")).select("store_id", "sku", c("n").alias("l"), none("long").alias("p"))
    sku = sku.unionByName(t.products.groupBy("store_id", "sku").agg(count.alias("n")).select("store_id", "sku", none("long").alias("l"), c("n").alias("p")))
    sku = sku.groupBy("store_id", "sku").agg(F.sum("l").alias("l"), F.sum("p").alias("p")).groupBy("store_id").agg(
        F.coalesce(when(c("p") > 1), F.lit(0)).alias("unique_products"), F.coalesce(times(c("p").isNull(), "l"), F.lit(0)).alias("lines_have_product")
    )
    again = lambda df, ks, name: df.groupBy("store_id", *ks).agg(count.alias("n")).groupBy("store_id").agg(F.count_if(c("n") > 1).alias(name))
    ads = t.ad_daily.join(t.campaigns.select("store_id", "campaign_id"), ["store_id", "campaign_id"], "left_anti").groupBy("store_id").agg(count.alias("ads_have_campaign"))
    parts = [
        long(wide, of_orders),
        long(sku, ["unique_products", "lines_have_product"]),
        long(again(t.order_lines, ["order_id", "line_no"], "unique_lines"), ["unique_lines"]),
        long(again(t.payments, ["payment_id"], "unique_payments"), ["unique_payments"]),
        long(ads, ["ads_have_campaign"]),
    ]
    names = [*of_orders, "unique_products", "lines_have_product", "unique_lines", "unique_payments", "ads_have_campaign"]
    stores = wide.filter("has_orders is not null").select("store_id", F.explode(F.array(*[F.lit(n) for n in names])).alias("check"))
    out = stores.join(reduce(DataFrame.unionByName, parts), ["store_id", "check"], "left").fillna(0, ["failures"])
    return out.withColumn("status", F.when(F.col("failures") == 0, "pass").otherwise("fail"))


def reconcile(ours: DataFrame, reference: DataFrame) -> DataFrame:
    """V-02: two long KPI tables (store_id, period_start, metric, value)."""
    both = ours.join(reference.withColumnRenamed("value", "reference"), ["store_id", "period_start", "metric"], "full_outer")
    close = F.abs(F.col("value") - F.col("reference")) <= 0.01 + 1e-9 * F.abs("reference")
    passed = F.when(F.col("value").isNull() & F.col("reference").isNull(), True).otherwise(F.coalesce(close, F.lit(False)))
    return both.withColumn("passed", passed)


def subtotal_convention(t: StoreTables, cfg: AnalyticsConfig, least: int = 10, share: float = 0.95) -> DataFrame:
    """V-04: are subtotals before or after discounts? Judged by the lines of discounted orders."""
    gross = t.order_lines.groupBy("store_id", "order_id").agg(F.sum("line_revenue").alias("gross"))
    tol = F.lit(cfg.money_tolerance)
    both = t.orders.filter("discount > 0").join(gross, ["store_id", "order_id"])
    by = both.groupBy("store_id").agg(
        F.count(F.lit(1)).alias("discounted"),
        F.count_if(F.abs(F.col("gross") - F.col("discount") - F.col("subtotal")) <= tol).alias("post"),
        F.count_if(F.abs(F.col("gross") - F.col("subtotal")) <= tol).alias("pre"),
    )
    enough = F.col("discounted") >= least
    verdict = F.when(enough & (F.col("post") >= share * F.col("discounted")), "post_discount").when(enough & (F.col("pre") >= share * F.col("discounted")), "pre_discount")
    return by.withColumn("convention", verdict.otherwise("undetermined"))


def customer_profile(customers: DataFrame, latest: DataFrame, inactive_days: int = 90) -> DataFrame:
    """V-05: customers, identified, repeat and top-5 shares, inactive customers."""
    # the filtered rank is cut before the shuffle, so no task ranks all customers of a store
    rank = F.row_number().over(W.partitionBy("store_id").orderBy(F.desc("revenue"), "customer_id"))
    largest = customers.select("store_id", "customer_id", "revenue").withColumn("rank", rank).filter("rank <= 5").groupBy("store_id").agg(F.sum("revenue").alias("top5"))
    by = customers.join(latest.select("store_id", "latest_day"), "store_id").groupBy("store_id").agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_if(~F.col("customer_id").startswith("guest:")).alias("identified"),
        F.count_if(F.col("n_orders") > 1).alias("repeat"),
        F.sum("revenue").alias("revenue"),
        F.count_if(F.date_diff(F.col("latest_day"), F.to_date("last_order_at")) > inactive_days).alias("inactive"),
    ).join(largest, "store_id", "left")
    d = lambda c: F.col(c).cast("double")
    return by.select(
        "store_id",
        "customers",
        (d("identified") / d("customers")).alias("identified_share"),
        (d("repeat") / d("customers")).alias("repeat_share"),
        F.when(F.col("revenue") != 0, d("top5") / d("revenue")).alias("top5_share"),
        "inactive",
    )


def report_checks(dims: DataFrame, scores: DataFrame, recommendations: DataFrame, found: DataFrame, profit: DataFrame) -> DataFrame:
    """V-06: the report agrees with itself, per store."""
    mean = F.sum(F.col("score") * F.col("weight")) / F.sum(F.when(F.col("score").isNotNull(), F.col("weight")))
    again = dims.groupBy("store_id").agg(F.bround(F.round(mean, 9), 0).cast("long").alias("again"))
    a = scores.join(again, "store_id", "left").select("store_id", F.lit("score_recomputed").alias("check"), F.col("health_score").eqNullSafe(F.col("again")).alias("passed"))
    loose = recommendations.join(found.select("store_id", F.col("subject").alias("factor")), ["store_id", "factor"], "left_anti").groupBy("store_id").agg(F.count(F.lit(1)).alias("n"))
    b = scores.select("store_id").join(loose, "store_id", "left").select("store_id", F.lit("recommendations_linked").alias("check"), F.col("n").isNull().alias("passed"))
    refused = F.col("full_profit").isNull() | (F.size("missing") == 0)
    c = profit.groupBy("store_id").agg(F.min(refused).alias("passed")).select("store_id", F.lit("profit_refused_without_costs").alias("check"), "passed")
    return a.unionByName(b).unionByName(c)


def classify_support(checks: DataFrame, currencies: DataFrame) -> DataFrame:
    """V-07: how far a store's data can be relied on, with reasons."""
    hard = ["unique_orders", "orders_dated", "lines_have_order"]
    by = checks.groupBy("store_id").agg(
        F.count_if((F.col("status") == "fail") & F.col("check").isin(hard)).alias("hard"),
        F.count_if(F.col("status") == "fail").alias("failed"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("status") == "fail", F.col("check")))), ",").alias("reasons"),
    )
    both = by.join(currencies.select("store_id", "verdict"), "store_id", "left")
    verdict = F.when(F.col("verdict") == "mixed", "INVALID").when(F.col("hard") > 0, "UNSUPPORTED").when(F.col("failed") > 0, "PARTIALLY_SUPPORTED").otherwise("SUPPORTED")
    return both.select("store_id", verdict.alias("support"), "failed", "reasons")


def evaluate(expected: DataFrame, observed: DataFrame, dead_band: float = 0.08) -> DataFrame:
    """V-08: expectations (store_id, metric, expected) against comparisons (store_id, metric, pct)."""
    seen = F.when(F.col("pct").isNull(), "unknown").when(F.col("pct") > dead_band, "up").when(F.col("pct") < -dead_band, "down").otherwise("flat")
    both = expected.join(observed.select("store_id", "metric", "pct"), ["store_id", "metric"], "left").withColumn("observed", seen)
    return both.withColumn("verdict", F.when(F.col("observed") == F.col("expected"), "MATCH").otherwise("KNOWN_GAP"))


#: What an expectation may compare a value with its threshold by.
COMPARISONS = {">=": lambda v, t: v >= t, "<=": lambda v, t: v <= t, ">": lambda v, t: v > t, "<": lambda v, t: v < t}


def evaluate_rules(rules: DataFrame, observed: DataFrame, dead_band: float = 0.08) -> DataFrame:
    """V-08: rules as data against observations as data, in one join.

    ``rules`` has store_id, kind, subject, op, expected and threshold;
    ``observed`` has store_id, kind, subject, value and text. Kinds: *direction*
    expects up, down, flat or unknown of a relative change; *presence* expects
    present or absent; *choice* expects a text; *threshold* expects the value
    to hold ``op`` against the threshold. What was not observed is unknown,
    absent, none, or no match. Adds observed and verdict (MATCH or KNOWN_GAP).
    """
    v, t = F.col("value"), F.col("threshold")
    both = rules.join(observed.withColumn("seen", F.lit(True)), ["store_id", "kind", "subject"], "left")
    change = F.when(v.isNull(), "unknown").when(v > dead_band, "up").when(v < -dead_band, "down").otherwise("flat")
    holds = F.lit(None).cast("boolean")
    for op, test in COMPARISONS.items():
        holds = F.when(F.col("op") == op, test(v, t)).otherwise(holds)
    is_ = lambda kind: F.col("kind") == kind
    saw = F.when(is_("direction"), change).when(is_("presence"), F.when(F.col("seen"), "present").otherwise("absent")).when(is_("choice"), F.coalesce("text", F.lit("none"))).when(is_("threshold"), F.when(holds, "holds").otherwise("fails"))
    want = F.when(is_("threshold"), "holds").otherwise(F.col("expected"))
    out = both.withColumn("observed", saw)
    return out.withColumn("verdict", F.when(F.col("observed") == want, "MATCH").otherwise("KNOWN_GAP")).drop("seen", "value", "text")


def scattered_blocks(rows: DataFrame, order_col: str, key: str, group: str, span: int = 1_000_000) -> DataFrame:
    """V-10: keys whose rows are not adjacent in file order, within each file (``group``).

    Files are looked at in stretches of ``span`` places, each by itself; then
    only the stretches' edges are held against each other, so a large file is
    many tasks. ``order_col`` is a number.
    """
    placed = rows.withColumn("_at", F.floor(F.col(order_col) / span))
    before = F.lag(key).over(W.partitionBy(group, "_at").orderBy(order_col))
    starts = placed.select(group, key, F.coalesce((before != F.col(key)).cast("long"), F.lit(1).cast("long")).alias("new"), F.lit(1).cast("long").alias("n"))
    edges = placed.groupBy(group, "_at").agg(F.min_by(key, order_col).alias("first"), F.max_by(key, order_col).alias("last"))
    joined = edges.withColumn("prior", F.lag("last").over(W.partitionBy(group).orderBy("_at"))).filter("prior = first")
    # a block that goes on over an edge was counted twice
    again = joined.select(group, F.col("first").alias(key), F.lit(-1).cast("long").alias("new"), F.lit(0).cast("long").alias("n"))
    return starts.unionByName(again).groupBy(group, key).agg(F.sum("new").alias("blocks"), F.sum("n").alias("rows")).filter("blocks > 1")


def parse_statistics(df: DataFrame, numbers: dict[str, Column]) -> DataFrame:
    """V-12: cells, unreadable and negative numbers per column; ``numbers`` maps a text column to its parse."""
    rows = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v"), e.cast("double").alias("n")) for c, e in numbers.items()]))
    return df.select(rows).groupBy("column").agg(F.count("v").alias("cells"), F.count_if(F.col("v").isNotNull() & F.col("n").isNull()).alias("unreadable"), F.count_if(F.col("n") < 0).alias("negative"))
