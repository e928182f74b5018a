"""Field coverage, consistency checks and profiles (Q-01 to Q-11)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AnalyticsConfig
from ..functions import parsing as N
from ..functions import redaction as R
from ..functions.numbers import ratio
from ..schemas import StoreTables
from ..sources import scratch


def status(coverage: Column, cfg: AnalyticsConfig) -> Column:
    """Q-01."""
    return F.when(coverage.isNull() | (coverage <= 0), "unavailable").when(coverage >= cfg.reliable, "reliable").otherwise("incomplete")


def field_quality(t: StoreTables, cfg: AnalyticsConfig) -> DataFrame:
    """Q-01, Q-02: covered, total, coverage and status of the tracked fields, one pass per table.

    Rejected order rows count as revenue that is not covered; a store with
    several currencies, or none, has no usable currency (Q-06).
    """

    def fields(df: DataFrame, covered: dict[str, Column]) -> DataFrame:
        counts = df.groupBy("store_id").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(e).alias(n) for n, e in covered.items()])
        return counts.select("store_id", F.inline(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("covered"), F.col("total").alias("total")) for n in covered])))

    c = F.col
    code = F.upper("currency")
    known = [
        fields(t.products, {"product_cogs": c("unit_cogs").isNotNull()}),
        fields(t.orders, {"order_revenue": c("subtotal").isNotNull(), "customer_identity": ~F.coalesce(c("customer_id"), F.lit("guest:")).startswith("guest:"), "currency": c("currency").isNotNull()}),
        fields(t.payments, {"payment_fees": c("fee").isNotNull()}),
        fields(t.ad_daily, {"ad_spend": c("spend").isNotNull()}),
    ]
    names = F.explode(F.array(*[F.lit(n) for n in ("product_cogs", "order_revenue", "customer_identity", "payment_fees", "ad_spend", "currency")]))
    mixed = t.orders.groupBy("store_id").agg((F.min(code) != F.max(code)).alias("mixed"))
    rejected = t.issues.filter("source = 'shopify' and kind in ('invalid_date', 'missing_order_id')").groupBy("store_id").agg(F.sum("count").alias("rejected"))
    found = reduce(DataFrame.unionByName, known)
    # stores are those of orders and advertising
    stores = found.filter("field in ('order_revenue', 'ad_spend')").select("store_id").distinct().withColumn("field", names)
    out = stores.join(found, ["store_id", "field"], "left").join(mixed, "store_id", "left").join(rejected, "store_id", "left").fillna(0, ["covered", "total", "rejected"])
    out = out.withColumn("total", F.when(c("field") == "order_revenue", c("total") + c("rejected")).otherwise(c("total")))
    coverage = ratio(c("covered"), c("total"))
    state = F.when((c("field") == "currency") & c("mixed"), "unavailable").when((c("field") == "currency") & (coverage > 0) & (coverage < 1), "incomplete").otherwise(status(coverage, cfg))
    return out.withColumn("coverage", coverage).withColumn("status", state).select("store_id", "field", "covered", "total", "coverage", "status")


def contract_of(cfg: AnalyticsConfig) -> Column:
    """Q-03 of one order: does total = subtotal + shipping (+ tax), or only without the discount?"""
    tol, c = F.lit(cfg.money_tolerance), F.col
    near = lambda e: F.abs(c("total") - e) <= tol
    post = near(c("subtotal") + c("shipping") + c("tax")) | near(c("subtotal") + c("shipping"))
    pre = near(c("subtotal") - c("discount") + c("shipping") + c("tax")) | near(c("subtotal") - c("discount") + c("shipping"))
    return (
        F.when(~c("has_total"), "no_total")
        .when(post & pre & (c("discount") > 0), "ambiguous")
        .when(post, "consistent")
        .when(pre, "contradiction")
        .otherwise("unreconstructible")
    )


def subtotal_contract(t: StoreTables, cfg: AnalyticsConfig) -> DataFrame:
    """Q-03: orders of each store by what their total says of their subtotal."""
    classed = t.orders.withColumn("contract", contract_of(cfg))
    return classed.groupBy("store_id", "contract").agg(
        F.count(F.lit(1)).alias("orders"), F.sum(F.when(F.col("contract") == "contradiction", F.col("discount")).otherwise(0)).cast("decimal(28,4)").alias("overstatement")
    )


def refund_totals(t: StoreTables, cfg: AnalyticsConfig) -> DataFrame:
    """Q-04, J-09: orders without total, refunds above their order's total."""
    above = t.refunds.filter("source = 'shopify'").join(t.orders.select("store_id", "order_id", "total"), ["store_id", "order_id"]).filter(F.col("amount") > F.col("total") + F.lit(cfg.money_tolerance))
    none = t.orders.groupBy("store_id").agg(F.count_if(~F.col("has_total")).alias("orders_without_total"))
    above = above.groupBy("store_id").agg(F.count(F.lit(1)).alias("refunds_above_total"), F.sum(F.col("amount") - F.col("total")).cast("decimal(28,4)").alias("excess"))
    return none.join(above, "store_id", "left").fillna(0, ["refunds_above_total"]).withColumn("excess", F.coalesce("excess", F.lit(0).cast("decimal(28,4)")))


def order_signals(t: StoreTables) -> DataFrame:
    """Q-05, J-10: counts and amounts of orders that are counted although odd."""
    refunded = t.refunds.select("store_id", "order_id").distinct().withColumn("refunded", F.lit(True))
    orders = t.orders.join(refunded, ["store_id", "order_id"], "left")
    c = F.col
    kinds = {
        "negative_subtotal": c("subtotal") < 0,
        "cancelled": c("cancelled"),
        "cancelled_unrefunded": c("cancelled") & c("refunded").isNull(),
        "unsettled": c("financial_status").isin(N.UNSETTLED),
        "zero_value": c("subtotal") == 0,
        "draft": c("draft"),
    }
    rows = F.inline(F.array(*[F.struct(F.lit(n).alias("signal"), F.coalesce(e, F.lit(False)).alias("hit")) for n, e in kinds.items()]))
    return (
        orders.select("store_id", "subtotal", rows)
        .groupBy("store_id", "signal")
        .agg(F.count_if("hit").alias("orders"), F.sum(F.when(c("hit"), c("subtotal")).otherwise(0)).cast("decimal(28,4)").alias("amount"))
    )


def currencies(t: StoreTables) -> DataFrame:
    """A-17, Q-06: codes per store and what they mean for sums of money."""
    by = t.orders.groupBy("store_id").agg(
        F.array_join(F.array_sort(F.collect_set(F.upper("currency"))), ",").alias("codes"),
        F.countDistinct(F.upper("currency")).alias("n"),
        F.count_if(F.col("currency").isNull()).alias("without"),
    )
    verdict = F.when(F.col("n") > 1, "mixed").when(F.col("n") == 0, "unknown").when(F.col("without") > 0, "incomplete").otherwise("coherent")
    return by.select("store_id", "codes", "n", "without", verdict.alias("verdict"))


def refund_reconciliation(t: StoreTables, cfg: AnalyticsConfig) -> DataFrame:
    """Q-07: refunds by source; a gap counts only if both are known."""
    by = t.refunds.groupBy("store_id").agg(*[F.coalesce(F.sum(F.when(F.col("source") == s, F.col("amount"))), F.lit(0)).cast("decimal(28,4)").alias(s) for s in ("shopify", "stripe")])
    gap = F.abs(F.col("shopify") - F.col("stripe")).cast("double") / F.greatest("shopify", "stripe").cast("double")
    both = (F.col("shopify") != 0) & (F.col("stripe") != 0)
    return by.withColumn("gap", F.when(both, gap)).withColumn("mismatch", F.coalesce(both & (gap > cfg.refund_gap), F.lit(False)))


def consistency_issues(t: StoreTables, cfg: AnalyticsConfig, negative: DataFrame | None = None) -> DataFrame:
    """Q-03 to Q-07 and P-10 as issue rows; ``count`` says how many orders, refunds or periods.

    Orders are read once for all their checks. ``negative`` has store_id and n,
    the periods of the series with negative revenue.
    """
    c = F.col
    contract = contract_of(cfg)
    tol = F.lit(cfg.money_tolerance)
    code = F.upper("currency")
    of_orders = t.orders.groupBy("store_id").agg(
        F.count_if(contract == "contradiction").alias("contradiction"),
        F.count_if(contract.isin("no_total", "ambiguous", "unreconstructible")).alias("unverified"),
        F.count_if(~c("has_total")).alias("no_total"),
        F.count_if(c("subtotal") < 0).alias("negative"),
        F.count_if(c("cancelled")).alias("cancelled"),
        F.count_if(c("financial_status").isin(N.UNSETTLED)).alias("unsettled"),
        F.count_if(c("subtotal") == 0).alias("zero"),
        F.count_if(c("draft")).alias("draft"),
        (F.min(code) != F.max(code)).cast("long").alias("mixed"),
        F.when(F.count(code) == 0, 1).otherwise(0).cast("long").alias("no_currency"),
    )
    gap = refund_reconciliation(t, cfg).select("store_id", F.col("mismatch").cast("long").alias("gap"))
    totals = t.orders.filter("has_total").select("store_id", "order_id", "total")
    above = t.refunds.filter("source = 'shopify'").join(totals, ["store_id", "order_id"]).filter(c("amount") > c("total") + tol).groupBy("store_id").agg(F.count(F.lit(1)).alias("above"))
    one = of_orders.join(gap, "store_id", "left").join(above, "store_id", "left")
    one = one.join(negative.select("store_id", F.col("n").alias("below")), "store_id", "left") if negative is not None else one.withColumn("below", F.lit(0).cast("long"))
    kinds = {
        "contradiction": ("shopify", "subtotal_convention_contradiction", "error"),
        "unverified": ("shopify", "subtotal_contract_unverified", "warning"),
        "no_total": ("shopify", "missing_order_total", "warning"),
        "above": ("shopify", "refund_exceeds_order_total", "warning"),
        "negative": ("shopify", "negative_subtotal", "warning"),
        "cancelled": ("shopify", "cancelled_orders_counted", "warning"),
        "unsettled": ("shopify", "unsettled_orders_counted", "warning"),
        "zero": ("shopify", "zero_value_orders_counted", "info"),
        "draft": ("shopify", "draft_orders_counted", "info"),
        "mixed": ("reconciliation", "currency_mismatch", "error"),
        "no_currency": ("shopify", "currency_absent", "warning"),
        "gap": ("reconciliation", "refund_mismatch", "warning"),
        "below": ("analytics", "negative_period_revenue", "warning"),
    }
    rows = F.inline(F.array(*[F.struct(F.lit(s).alias("source"), F.lit(k).alias("kind"), F.lit(v).alias("severity"), F.coalesce(c(n), F.lit(0)).cast("long").alias("count")) for n, (s, k, v) in kinds.items()]))
    return one.select("store_id", rows).filter(c("count") > 0).select("store_id", "source", "kind", "severity", c("kind").alias("message"), "count")


def issue_counts(issues: DataFrame) -> DataFrame:
    """A-16: equal issues collapse."""
    return issues.groupBy("store_id", "source", "kind", "severity", "message").agg(F.sum("count").alias("count"))


#: Distinct values of a column that are counted one by one.
DISTINCT_CAP = 200_000


def _cell_measures(c: Column, v: Column, kind: str) -> dict[str, Column]:
    """Tests of one column's cells, as texts ``v``; what the column's own type settles is not looked for in the texts."""
    never, always = F.lit(False), F.lit(True)
    tests = {
        "currency": F.regexp_like(v, F.lit("^[A-Z]{3}$")),
        "boolean": F.lower(v).isin("true", "false", "yes", "no", "0", "1"),
        "date": F.regexp_like(v, F.lit(r"^\d{4}-\d{2}-\d{2}")),
        "number": F.regexp_like(v, F.lit(r"^[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$")),
        "email": F.regexp_like(v, F.lit(f"^{R.EMAIL}$")),
    }
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return dict.fromkeys(tests, never) | {"boolean": c.isin(0, 1), "number": always}
    if kind in ("float", "double"):  # NaN is no value
        return dict.fromkeys(tests, never) | {"number": F.abs(c) < F.lit(float("inf"))}
    if kind == "date" or kind.startswith("timestamp"):
        return dict.fromkeys(tests, never) | {"date": tests["date"]}
    return tests


def column_profile(df: DataFrame, exact: bool = False, only: str | None = None) -> DataFrame:
    """Q-08 over the whole table: type by share of cells, missing and distinct count.

    Columns are measured side by side in one row. With ``exact`` every column's
    distinct values are then counted one by one, which shuffles each value once
    a task at most. Without, a sketch is taken in the first pass: columns with
    about ``DISTINCT_CAP`` or fewer are counted, and beyond, the sketch's
    estimate stands and ``exact`` is false. ``only`` is a condition on column
    and type: others are not counted, and their distinct count is null.
    """
    names = df.columns
    kinds = dict(df.dtypes)
    cells = df.select(*[N.null_if_token(F.col(f"`{c}`").cast("string")).alias(f"v{i}") for i, c in enumerate(names)], *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])

    def measures(i: int) -> Column:
        v = F.col(f"v{i}")
        share = lambda e: F.avg(F.when(v.isNotNull(), F.coalesce(e, F.lit(False)).cast("int")))
        sketched = F.lit(None).cast("long") if exact else F.approx_count_distinct(v, 0.02)
        tests = _cell_measures(F.col(f"c{i}"), v, kinds[names[i]])
        return F.struct(F.count(F.lit(1)).alias("rows"), F.count_if(v.isNull()).alias("missing"), sketched.alias("sketched"), *[share(e).alias(n) for n, e in tests.items()])

    wide = cells.agg(*[measures(i).alias(f"m{i}") for i in range(len(names))])
    long = wide.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("column"), F.col(f"m{i}").alias("m")) for i, c in enumerate(names)]))).select("i", "column", "m.*")
    kind = F.when(F.col("rows") == F.col("missing"), "empty")
    for name, least in (("currency", 0.9), ("boolean", 0.95), ("date", 0.9), ("number", 0.9)):
        kind = kind.when(F.col(name) > least, name)
    long = scratch.table(long.withColumn("type", kind.otherwise("text")), "profile")
    asked = long.filter(only) if only else long
    counted = [r.i for r in (asked if exact else asked.filter(F.col("sketched") <= 1.1 * DISTINCT_CAP)).select("i").collect()]  # a row for each column
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"v{i}").alias("v")) for i in counted]) if counted else F.array().cast("array<struct<i: int, v: string>>")
    values = cells.select(F.inline(pairs)).filter("v is not null")
    distinct = values.distinct().groupBy("i").agg(F.count(F.lit(1)).alias("distinct"))
    out = long.join(distinct, "i", "left").withColumn("exact", F.col("i").isin(counted) if counted else F.lit(False))
    known = F.when(F.col("exact"), F.coalesce("distinct", F.lit(0)))
    out = out.withColumn("distinct", known.when(F.expr(only), F.col("sketched")) if only else known.otherwise(F.col("sketched")))
    return out.select("column", "rows", "missing", "distinct", "type", "email", "exact")


def personal_columns(df: DataFrame, names: list[str] = ["email", "phone", "name", "address", "customer"]) -> DataFrame:
    """Q-10: columns that look personal by name or by content, all in one pass."""
    share = lambda c, shape: F.coalesce(F.avg(F.when(c.isNotNull(), F.regexp_like(c, F.lit(shape)).cast("int"))), F.lit(0.0))
    text = {c: F.col(f"`{c}`").cast("string") for c in df.columns}
    wide = df.agg(*[F.struct(share(v, R.EMAIL).alias("emails"), share(v, r"^\+?[0-9][0-9 ().-]{6,18}[0-9]$").alias("phones")).alias(f"m{i}") for i, v in enumerate(text.values())])
    by_name = [any(n in c.lower() for n in names) for c in text]
    rows = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(b).alias("by_name"), F.col(f"m{i}").alias("m")) for i, (c, b) in enumerate(zip(text, by_name))]))
    out = wide.select(rows).select("column", "by_name", "m.*")
    return out.withColumn("personal", F.col("by_name") | (F.col("emails") > 0.3) | (F.col("phones") > 0.5))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Q-09: how many rows repeat another one."""
    by = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n"))
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def granularity(profile: DataFrame, id_columns: list[str]) -> DataFrame:
    """Q-11: line items repeat an id, orders don't, aggregates repeat their dates."""
    ids = profile.filter(F.col("column").isin(id_columns)).withColumn("share", F.col("distinct") / F.col("rows"))
    dates = profile.filter("type = 'date'").agg(F.min(F.col("distinct") / F.col("rows")).alias("date_share"))
    best = ids.agg(F.max("share").alias("id_share"))
    guess = F.when(F.col("id_share") >= 0.95, "order").when(F.col("id_share") < 0.95, "line_item").when(F.col("date_share") < 0.3, "aggregated").otherwise("unknown")
    return best.join(dates).select("id_share", "date_share", guess.alias("granularity"))


def sensitive_scan(df: DataFrame, columns: list[str]) -> DataFrame:
    """Q-13: rows per column and kind with a sensitive string; never the string."""
    rows = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns]))
    cells = df.select(rows)
    kinds = {n: F.regexp_like("v", F.lit(p)) for n, p in R.SCANS.items()} | {"card": R.has_card(F.col("v"))}
    hits = F.inline(F.array(*[F.struct(F.lit(n).alias("kind"), F.coalesce(e, F.lit(False)).alias("hit")) for n, e in kinds.items()]))
    found = cells.select("column", hits).groupBy("column", "kind").agg(F.count_if("hit").alias("rows"))
    named = [c for c in columns if c.strip().lower() in R.SUSPICIOUS_NAMES]
    return found.withColumn("suspicious_name", F.col("column").isin(named) if named else F.lit(False))


def leaks(output: DataFrame, text_col: str, identifiers: DataFrame, id_col: str) -> DataFrame:
    """Q-18: outputs that hold a known identifier (5 characters or more, not all digits).

    The text is cut into tokens, so it meets the identifiers in an equi-join.
    """
    known = identifiers.select(F.col(id_col).alias("token")).filter("length(token) >= 5 and token not rlike '^[0-9]+$'").distinct()
    tokens = output.select(F.explode(F.array_distinct(F.regexp_extract_all(F.col(text_col), F.lit(r"[\w.@#:+-]+"), F.lit(0)))).alias("token"))
    return tokens.join(known, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
