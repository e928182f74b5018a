"""Exports to canonical rows: deduplication, rejects and issues (N-07, N-14 to N-21)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import parsing as N
from ..schemas import MONEY
from ..sources import scratch


def _first(df: DataFrame, keys: list[str], order: str = "row_no", last: bool = False) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order) if last else F.col(order)))
    return df.withColumn("_rank", rank)


def issues_of(df: DataFrame, source: str, kinds: dict[str, tuple[Column, str]]) -> DataFrame:
    """One issue row per store and kind that occurs."""
    counts = df.groupBy("store_id").agg(*[F.count_if(e).alias(f"n_{k}") for k, (e, _) in kinds.items()])
    return _counted(counts, source, {k: (F.col(f"n_{k}"), s) for k, (_, s) in kinds.items()})


def _counted(counts: DataFrame, source: str, kinds: dict[str, tuple[Column, str]]) -> DataFrame:
    """Issue rows of counts by store."""
    rows = F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(s).alias("severity"), e.alias("count")) for k, (e, s) in kinds.items()]))
    found = counts.select("store_id", rows).filter("count > 0")
    return found.select("store_id", F.lit(source).alias("source"), "kind", "severity", F.col("kind").alias("message"), "count")


def file_date_conventions(df: DataFrame, column: str) -> DataFrame:
    """N-07, N-08: one convention and issue per store and file; equal cells of a file are looked at once."""
    order = F.col("order")
    cells = df.groupBy("store_id", "file", F.col(f"`{column}`").alias("cell")).agg(F.count(F.lit(1)).alias("k"))
    # the count is asked for, or the optimizer takes the grouping away and looks at every row
    cells = cells.select("store_id", "file", F.when(F.col("k") > 0, N.slash_date_order(F.col("cell"))).alias("order"))
    out = cells.groupBy("store_id", "file").agg(N.date_convention(order).alias("convention"), F.count_if(order == "ambiguous").alias("open"))
    c = F.col("convention")
    issue = F.when(c == "conflict", "date_order_conflict").when(c == "ambiguous", "ambiguous_date_order").when(c.isin("day_first", "month_first") & (F.col("open") > 0), "date_order_inferred")
    return out.withColumn("issue", issue).drop("open")


def date_issues(conventions: DataFrame, source: str) -> DataFrame:
    """N-08 as issue rows: how many files of a store have each."""
    severity = F.when(F.col("issue") == "date_order_inferred", "info").otherwise("error")
    found = conventions.filter("issue is not null").groupBy("store_id", "issue").agg(F.count(F.lit(1)).alias("count"))
    return found.select("store_id", F.lit(source).alias("source"), F.col("issue").alias("kind"), severity.alias("severity"), F.col("issue").alias("message"), "count")


#: How intermediates are written: they are read a few times at most, and should be small on disk.
PACKED = {"compression": "zstd"}


def typed(cells: DataFrame, money: list[str], counts: list[str] = []) -> DataFrame:
    """The cells with their numbers read once: ``m_`` and ``i_`` columns in place of the texts, and ``bad_`` where a filled cell is no number.

    Written, so that all that is derived from them is planned over plain columns.
    """
    read = cells.withColumns({f"m_{c}": N.parse_money(F.col(c)) for c in [*money, *counts]})
    # from the number that was read: a text is not read again to ask whether it is one
    bad = {f"bad_{c}": F.coalesce(N.null_if_token(F.col(c)).isNotNull() & F.col(f"m_{c}").isNull(), F.lit(False)) for c in [*money, *counts]}
    whole = {f"i_{c}": F.bround(F.col(f"m_{c}"), 0).cast("long") for c in counts}
    # a stage of so many expressions is one method that is too long for the JVM to compile
    with scratch.settings(cells.sparkSession, codegen__wholeStage="false"):
        return scratch.table(read.withColumns(bad | whole).drop(*money, *counts, *[f"m_{c}" for c in counts]), "cells", **PACKED)


def refuse_unreadable(cells: DataFrame, source: str, numbers: dict[str, Column], kinds: dict[str, tuple[Column, str]] = {}) -> tuple[DataFrame, DataFrame, DataFrame]:
    """T9: rows of the files whose numbers can all be read, one issue per store and column with others, and the rows read of each store.

    ``numbers`` maps a column that ``typed`` has read to when it counts at all. One cell that
    is filled but no number refuses its whole file: half a file is a wrong sum. ``kinds`` are
    issues of the rows of the other files. The cells are read once for all of them. Files are
    numbered in the order of their paths, and ``row_no`` has the number: in a shuffle every
    row would bring its path along.
    """
    hits = {n: F.coalesce(when & F.col(f"bad_{n}"), F.lit(False)) for n, when in numbers.items()}
    counts = {"n_rows": F.count(F.lit(1))} | {f"bad_{n}": F.count_if(e) for n, e in hits.items()} | {f"n_{k}": F.count_if(e) for k, (e, _) in kinds.items()}
    facts = cells.groupBy("store_id", "file").agg(*[e.alias(n) for n, e in counts.items()])
    refused = F.greatest(*[F.col(f"bad_{n}") for n in hits], F.lit(0)) > 0
    # a row for each file
    files = scratch.table(facts.withColumns({"refused": refused, "file_at": F.row_number().over(W.orderBy("file"))}), "files")
    by_store = lambda df, names: df.groupBy("store_id").agg(*[F.sum(n).alias(n) for n in names])
    bad = by_store(files, [f"bad_{n}" for n in hits])
    rows = F.inline(F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"bad_{n}").alias("count")) for n in hits]))
    issues = bad.select("store_id", rows).filter("count > 0").select(
        "store_id", F.lit(source).alias("source"), F.lit("malformed_number").alias("kind"), F.lit("error").alias("severity"), F.concat(F.lit("malformed_number: "), F.col("column")).alias("message"), "count"
    )
    if kinds:
        issues = issues.unionByName(_counted(by_store(files.filter(~F.col("refused")), [f"n_{k}" for k in kinds]), source, {k: (F.col(f"n_{k}"), s) for k, (_, s) in kinds.items()}))
    ranks = files.filter(~F.col("refused")).select(F.col("store_id").alias("_store"), F.col("file").alias("_file"), "file_at")
    kept = cells.join(F.broadcast(ranks), F.col("store_id").eqNullSafe(F.col("_store")) & F.col("file").eqNullSafe(F.col("_file"))).drop("_store", "_file")
    if "row_no.file" in _fields(cells):
        kept = kept.withColumn("row_no", F.struct("file_at", "row_no.block", "row_no.line"))
    return kept.drop("file_at"), issues, by_store(files, ["n_rows"]).withColumnRenamed("n_rows", "rows_read")


def _fields(df: DataFrame) -> list[str]:
    return [f"{f.name}.{n}" for f in df.schema for n in getattr(f.dataType, "names", [])]


def with_timestamp(df: DataFrame, column: str, name: str, conventions: DataFrame | None = None) -> DataFrame:
    """N-05, N-09: two passes, the file's convention joined back to its rows."""
    return with_convention(df, column, name, conventions).drop("convention")


def with_convention(df: DataFrame, column: str, name: str, conventions: DataFrame | None = None) -> DataFrame:
    """``with_timestamp``, and the convention that it was read by; a row for each file is sent to the rows, which stay where they are."""
    found = file_date_conventions(df, column) if conventions is None else conventions
    return df.join(F.broadcast(found.select("store_id", "file", "convention")), ["store_id", "file"]).withColumn(name, N.parse_timestamp_utc(F.col(f"`{column}`"), F.col("convention")))


def normalize_orders(raw: DataFrame) -> dict[str, DataFrame]:
    """``order_tables`` of an export's rows."""
    return order_tables(order_cells(raw))


_HEADER_CELLS = ["s_subtotal", "s_discount", "s_shipping", "s_tax", "s_total", "s_refunded"]


def order_cells(raw: DataFrame) -> DataFrame:
    """Staged cells of line-item exports; ``raw`` has store_id, file, row_no and the export's columns as text."""
    g = lambda *names: N.first_present(raw, *names)
    cells = raw.select(
        "store_id",
        "file",
        "row_no",
        g("Name").alias("order_id"),
        g("Created at").alias("created"),
        g("Email").alias("email"),
        g("Financial Status").alias("status"),
        g("Currency").alias("currency"),
        *[g(c).alias(a) for c, a in (("Subtotal", "s_subtotal"), ("Discount Amount", "s_discount"), ("Shipping", "s_shipping"), ("Taxes", "s_tax"), ("Total", "s_total"), ("Refunded Amount", "s_refunded"), ("Lineitem quantity", "s_quantity"), ("Lineitem price", "s_price"))],
        g("Cancelled at").alias("cancelled_at"),
        g("Source").alias("channel"),
        g("Lineitem name").alias("title"),
        g("Lineitem sku").alias("sku"),
    )
    return typed(cells, [*_HEADER_CELLS, "s_price"], ["s_quantity"])


def order_tables(cells: DataFrame) -> dict[str, DataFrame]:
    """N-13 to N-18: orders, order_lines, refunds, issues, accepted_rows and rows_read of line-item exports.

    The header of an order is its first row with a readable date; earlier rows and
    all rows of orders without one are rejected, one ``invalid_date`` each. A
    file with an unreadable number is refused (of rows without an order id
    nothing is read, and header cells only of rows with a date). The cells are
    deleted when they are read.
    """
    named, dated = F.col("order_id").isNotNull(), F.col("order_id").isNotNull() & F.col("created").isNotNull()
    with scratch.short_shuffles(cells.sparkSession):
        kept, issues, read = refuse_unreadable(cells, "shopify", {"s_quantity": named, "s_price": named} | dict.fromkeys(_HEADER_CELLS, dated), {"missing_order_id": (~named, "error")})
        kept = kept.filter("order_id is not null")
        conventions = scratch.table(file_date_conventions(kept, "created"), "conventions")
        rows = scratch.table(_order_rows(with_timestamp(kept, "created", "created_at", conventions)), "order-rows", **PACKED)
        scratch.remove_table(cells)
    issues = issues.unionByName(date_issues(conventions, "shopify"))
    zero = F.lit(0).cast(MONEY)
    h = lambda c: F.col(f"header.{c}")
    headers = rows.filter("is_header")
    orders = headers.select(
        "store_id",
        "order_id",
        N.customer_key(h("email"), F.col("order_id")).alias("customer_id"),
        N.email_key(h("email")).alias("customer_email"),
        F.col("order_at").alias("created_at"),
        F.upper(h("currency")).alias("currency"),
        F.coalesce(h("m_s_subtotal"), zero).alias("subtotal"),
        F.coalesce(h("m_s_discount"), zero).alias("discount"),
        F.coalesce(h("m_s_shipping"), zero).alias("shipping"),
        F.coalesce(h("m_s_tax"), zero).alias("tax"),
        F.coalesce(h("m_s_total"), zero).alias("total"),
        h("m_s_total").isNotNull().alias("has_total"),
        F.coalesce(F.lower(h("status")), F.lit("unknown")).alias("financial_status"),
        h("cancelled_at").isNotNull().alias("cancelled"),
        F.coalesce(F.lower(h("channel")) == "shopify_draft_order", F.lit(False)).alias("draft"),
        F.lit("shopify").alias("source"),
    )
    order_lines = rows.filter("line_rank = 1").select(
        "store_id",
        "order_id",
        F.col("order_at").alias("created_at"),
        "line_no",
        F.col("key_sku").alias("sku"),
        "title",
        "quantity",
        "unit_price",
        (F.col("quantity").cast("decimal(10,0)") * F.col("unit_price").cast("decimal(14,4)")).cast(MONEY).alias("line_revenue"),
    )
    refunds = headers.filter(h("m_s_refunded") > 0).select("store_id", F.concat(F.lit("refund:"), F.col("order_id")).alias("refund_id"), F.col("order_at").alias("created_at"), h("m_s_refunded").alias("amount"), "order_id", F.lit("shopify").alias("source"))
    of_header = {"negative_refund": (h("m_s_refunded") < 0, "error"), "missing_email": (N.email_key(h("email")).isNull(), "warning"), "missing_currency": (h("currency").isNull(), "warning")}
    of_line = {"duplicate_line_item": (F.col("line_rank") > 1, "warning"), "missing_line_sku": ((F.col("line_rank") == 1) & F.col("no_sku"), "warning")}
    found = {"invalid_date": (F.col("rejected"), "error")} | of_line | {k: (F.col("is_header") & e, s) for k, (e, s) in of_header.items()}
    issues = issues.unionByName(issues_of(rows, "shopify", found))
    # an order's first line stands in its header's row
    accepted = headers.select("store_id").unionByName(rows.filter("line_no > 1").select("store_id")).groupBy("store_id").agg(F.count(F.lit(1)).alias("accepted_rows"))
    return {"orders": orders, "order_lines": order_lines, "refunds": refunds, "issues": issues, "accepted_rows": accepted, "rows_read": read}


def _order_rows(rows: DataFrame) -> DataFrame:
    """The rows of each order with what its header says, which of them is a header, rejected or a line, and the lines' numbers.

    Rows are shuffled once, by order. Only a row with a date can be a header,
    so the others do not carry the cells of one.
    """
    header = ["email", "status", "currency", "cancelled_at", "channel", "m_s_subtotal", "m_s_discount", "m_s_shipping", "m_s_tax", "m_s_total", "m_s_refunded"]
    own = rows.select(
        "store_id",
        "order_id",
        "row_no",
        "created_at",
        F.when(F.col("created_at").isNotNull(), F.struct(*header)).alias("header"),
        F.coalesce("sku", F.lit("UNKNOWN")).alias("key_sku"),
        F.col("sku").isNull().alias("no_sku"),
        F.coalesce("title", "sku", F.lit("unknown")).alias("title"),
        F.col("i_s_quantity").alias("quantity"),
        F.coalesce(F.col("m_s_price"), F.lit(0).cast(MONEY)).alias("unit_price"),
    )
    key, signature = ["store_id", "order_id"], ["key_sku", "quantity", "unit_price", "title"]
    # both windows take the rows in one order
    order = W.partitionBy(*key).orderBy(*signature, "row_no").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    alike = W.partitionBy(*key, *signature).orderBy("row_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    own = own.withColumn("head", F.min(F.when(F.col("created_at").isNotNull(), F.struct("row_no", "created_at"))).over(order))
    own = own.withColumn("rejected", F.col("head").isNull() | (F.col("row_no") < F.col("head.row_no")))
    line = ~F.col("rejected") & (F.col("quantity") > 0)
    own = own.withColumn("line_rank", F.when(line, F.count_if(line).over(alike)))
    number = F.count_if(F.col("line_rank") == 1).over(W.partitionBy(*key).orderBy("row_no").rowsBetween(W.unboundedPreceding, W.currentRow))
    is_header = F.coalesce(F.col("row_no") == F.col("head.row_no"), F.lit(False))
    return own.withColumn("line_no", F.when(F.col("line_rank") == 1, number).cast("int")).select(
        *key, F.col("head.created_at").alias("order_at"), is_header.alias("is_header"), F.when(is_header, F.col("header")).alias("header"), "rejected", "line_rank", "line_no", "key_sku", "no_sku", "title", "quantity", "unit_price"
    )


def normalize_products(raw: DataFrame) -> dict[str, DataFrame]:
    """``product_tables`` of an export's rows."""
    return product_tables(product_cells(raw))


def product_cells(raw: DataFrame) -> DataFrame:
    """Staged cells of product exports."""
    g = lambda *names: N.first_present(raw, *names)
    rows = raw.select("store_id", "row_no", g("SKU").alias("sku"), g("Product ID").alias("product_ref"), g("Title").alias("title"), g("Cost per item", "Cost", "COGS").alias("s_cost"), "file")
    return typed(rows, ["s_cost"])


def product_tables(cells: DataFrame) -> dict[str, DataFrame]:
    """S-02: last row of a SKU wins; a negative cost is unknown."""
    named, cost = F.col("sku").isNotNull(), F.col("m_s_cost")
    kinds = {"missing_sku": (~named, "warning"), "negative_cogs": (named & (cost < 0), "error")}
    rows, issues, read = refuse_unreadable(cells, "products", {"s_cost": named}, kinds)
    rows = rows.withColumn("cost", cost)
    last = _first(rows.filter("sku is not null"), ["store_id", "sku"], last=True).filter("_rank = 1")
    products = last.select("store_id", "sku", F.coalesce("product_ref", "sku").alias("product_ref"), F.coalesce("title", "sku").alias("title"), F.when(F.col("cost") >= 0, F.col("cost")).alias("unit_cogs"))
    return {"products": products, "issues": issues, "rows_read": read}


def normalize_payments(raw: DataFrame) -> dict[str, DataFrame]:
    """``payment_tables`` of an export's rows."""
    return payment_tables(payment_cells(raw))


_PAYMENT_CELLS = ["s_amount", "s_refunded", "s_fee", "s_net"]


def payment_cells(raw: DataFrame) -> DataFrame:
    """Staged cells of payment exports."""
    g = lambda *names: N.first_present(raw, *names)
    rows = raw.select(
        "store_id",
        "file",
        "row_no",
        g("id").alias("payment_id"),
        g("Created (UTC)", "Created", "created").alias("created"),
        g("Amount").alias("s_amount"),
        g("Amount Refunded", "amount_refunded").alias("s_refunded"),
        g("Fee", "fee").alias("s_fee"),
        g("Net", "net").alias("s_net"),
        F.coalesce(F.lower(g("Status")), F.lit("unknown")).alias("status"),
        g("order_id", "Order ID", "metadata.order_id").alias("order_id"),
        N.email_key(g("Customer Email", "customer_email", "Email")).alias("customer_email"),
    )
    return typed(rows, _PAYMENT_CELLS)


def payment_tables(cells: DataFrame) -> dict[str, DataFrame]:
    """N-19, N-20, N-22: first row of an id wins, even if its date is unreadable."""
    named = F.col("payment_id").isNotNull()
    with scratch.short_shuffles(cells.sparkSession):
        rows, refused, read = refuse_unreadable(cells, "stripe", dict.fromkeys(_PAYMENT_CELLS, named), {"missing_id": (~named, "error")})
        conventions = scratch.table(file_date_conventions(rows, "created"), "conventions")
        rows = rows.filter(named).withColumns({n: F.col(f"m_s_{n}") for n in ("refunded", "fee", "net")}).withColumn("amount", F.coalesce(F.col("m_s_amount"), F.lit(0).cast(MONEY)))
        rows = with_timestamp(rows, "created", "created_at", conventions).drop("created", "file", *[f"{k}_{n}" for k in ("m", "bad") for n in _PAYMENT_CELLS])
        rows = scratch.table(_first(rows, ["store_id", "payment_id"]), "payment-rows", **PACKED)
    refused = refused.unionByName(date_issues(conventions, "stripe"))
    good = rows.filter("_rank = 1 and created_at is not null")
    payments = good.select("store_id", "payment_id", "created_at", "amount", F.when(F.col("fee") >= 0, F.col("fee")).alias("fee"), "net", "status", "order_id", "customer_email", F.lit("stripe").alias("source"))
    refunds = good.filter("refunded > 0").select("store_id", F.concat(F.lit("refund:"), F.col("payment_id")).alias("refund_id"), "created_at", F.col("refunded").alias("amount"), "order_id", F.lit("stripe").alias("source"))
    first = F.col("_rank") == 1
    kinds = {
        "duplicate_payment": (~first, "warning"),
        "invalid_date": (first & F.col("created_at").isNull(), "error"),
        "negative_fee": (first & F.col("created_at").isNotNull() & (F.col("fee") < 0), "error"),
        "negative_refund": (first & F.col("created_at").isNotNull() & (F.col("refunded") < 0), "error"),
    }
    return {"payments": payments, "refunds": refunds, "issues": refused.unionByName(issues_of(rows, "stripe", kinds)), "rows_read": read}


def normalize_ads(raw: DataFrame) -> dict[str, DataFrame]:
    """``ad_tables`` of an export's rows."""
    return ad_tables(ad_cells(raw))


def ad_cells(raw: DataFrame) -> DataFrame:
    """Staged cells of advertising exports."""
    g = lambda *names: N.first_present(raw, *names)
    rows = raw.select(
        "store_id",
        "file",
        "row_no",
        g("Day").alias("day_text"),
        g("Campaign").alias("name"),
        F.coalesce(g("Campaign ID"), g("Campaign")).alias("campaign_id"),
        g("Cost").alias("s_cost"),
        g("Impressions").alias("s_impressions"),
        g("Clicks").alias("s_clicks"),
        g("Conversions").alias("s_conversions"),
        g("Conv. value", "Conversion value", "Total conv. value").alias("s_value"),
    )
    return typed(rows, ["s_cost", "s_conversions", "s_value"], ["s_impressions", "s_clicks"])


def ad_tables(cells: DataFrame) -> dict[str, DataFrame]:
    """N-21: first row of a campaign's day wins; blanks are 0; negative spend is dropped."""
    read = F.col("name").isNotNull() & F.col("day_text").isNotNull()
    rows, refused, read_of = refuse_unreadable(cells, "google_ads", dict.fromkeys(["s_cost", "s_impressions", "s_clicks", "s_conversions", "s_value"], read))
    m = lambda n: F.coalesce(F.col(f"m_{n}"), F.lit(0).cast(MONEY))
    count = lambda n: F.coalesce(F.col(f"i_{n}"), F.lit(0).cast("long"))
    rows = rows.withColumns({"spend": m("s_cost"), "impressions": count("s_impressions"), "clicks": count("s_clicks"), "conversions": m("s_conversions").cast("double"), "conversion_value": m("s_value")})
    conventions = scratch.table(file_date_conventions(rows, "day_text"), "conventions")
    issues = refused.unionByName(date_issues(conventions, "google_ads"))
    rows = scratch.table(with_timestamp(rows, "day_text", "at", conventions).withColumn("day", F.to_date("at")), "ad-rows")
    named = rows.filter("day is not null and name is not null")
    dated = _first(named, ["store_id", "campaign_id", "day"])
    good = dated.filter("_rank = 1 and spend >= 0")
    ads = good.select("store_id", "campaign_id", "day", "spend", "impressions", "clicks", "conversions", "conversion_value")
    # a campaign is known by all its dated rows, dropped ones included
    campaigns = named.groupBy("store_id", "campaign_id").agg(F.min_by("name", "row_no").alias("name"), F.lit("google_ads").alias("channel"))
    undated = {"invalid_date": (F.col("day").isNull(), "error"), "missing_campaign": (F.col("day").isNotNull() & F.col("name").isNull(), "error")}
    issues = issues.unionByName(issues_of(rows, "google_ads", undated))
    issues = issues.unionByName(issues_of(dated, "google_ads", {"duplicate_ad_row": (F.col("_rank") > 1, "warning"), "negative_spend": ((F.col("_rank") == 1) & (F.col("spend") < 0), "error")}))
    return {"ad_daily": ads, "campaigns": campaigns, "issues": issues, "rows_read": read_of}


def money_exactness_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """N-23: cells per column that decimal(19,4) can't hold as written."""
    rows = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns]))
    return df.select(rows).groupBy("column").agg(F.count("v").alias("cells"), F.count_if(~N.money_is_exact(F.col("v"))).alias("inexact"))
