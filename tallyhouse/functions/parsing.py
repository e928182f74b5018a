"""Parsing of export cells (N-01 to N-13, N-22 to N-24), as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .binding import once

# Cells that mean "missing", money signs, settled and unsettled payment states.
NULL_TOKENS = ["", "-", "--", "n/a", "na", "null", "none", "nan"]
MONEY_SIGNS = "[€$£  ]"
SUCCESSFUL = ["paid", "succeeded", "available", "captured"]
UNSETTLED = ["pending", "authorized", "partially_paid", "voided", "expired"]

MONEY = "decimal(19,4)"
_PLAIN = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"
#: As ``_PLAIN``, without a line break behind it.
_DIGITS = _PLAIN[:-1] + r"\z"
_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?( ?(Z|UTC|[+-]\d{2}:?\d{2}))?)?$"
# Dates with slashes, and the compact day that ISO 8601 also allows.
_SLASH = r"^(\d{1,2})/(\d{1,2})/(\d{4})(?:[ T](\d{1,2}):(\d{2})(?::(\d{2}))?)?$"
#: With what its cells must look like: a cell that fails to parse costs an exception, so others are not tried.
FORMATS = {"yyyyMMdd": r"^[+-]?\d{8,}$"}


def clean_headers(df: DataFrame) -> DataFrame:
    """N-01: names without blanks and byte-order mark."""
    return df.toDF(*[c.replace("﻿", "").strip() for c in df.columns])


def null_if_token(c: Column) -> Column:
    """N-02."""
    return F.when(~F.lower(F.trim(c)).isin(NULL_TOKENS), F.trim(c))


def parse_money(c: Column) -> Column:
    """N-03: decimal(19,4), null for a missing or malformed cell.

    Of comma and point, the later one is the decimal sign; a lone comma is one
    if one or two digits follow it. ``(x)`` is negative.
    """
    # one chain, each step used once: a cell is parsed hundreds of times in a plan
    mark = "\u0001"  # stands for the decimal comma
    s = F.regexp_replace(F.trim(c), MONEY_SIGNS, "")
    s = F.regexp_replace(F.regexp_replace(s, r"^\(-(.*)\)$", "$1"), r"^\(\+?(.*)\)$", "-$1")
    s = F.regexp_replace(s, r"^(.*\.[^.]*),([^,.]*)$", f"$1{mark}$2")
    s = F.regexp_replace(s, r"^([^.]*),([0-9]{1,2})$", f"$1{mark}$2")
    s = F.regexp_replace(F.regexp_replace(s, rf"\.(?=.*{mark})", ""), rf",(?!.*{mark})", "")
    # a plain number is left as it is by every step
    return F.when(F.regexp_like(F.trim(c), F.lit(_DIGITS)), F.trim(c).try_cast(MONEY)).otherwise(F.regexp_extract(F.translate(s, mark, "."), _PLAIN, 0).try_cast(MONEY))


def parse_int(c: Column) -> Column:
    """N-04: half-even."""
    return F.bround(parse_money(c), 0).cast("long")


def _slash_parts(c: Column) -> Column:
    """The numbers of one ``a/b/yyyy h:m:s`` cell, null for those that it leaves out; null for another cell."""
    parts = F.split(F.regexp_replace(c, _SLASH, "$1,$2,$3,$4,$5,$6"), ",")
    return F.when(F.regexp_like(c, F.lit(_SLASH)), F.transform(parts, lambda x: x.try_cast("int")))


def _order(n: Column) -> Column:
    """What the numbers of a slash date say about their order."""
    a, b = n[0], n[1]
    kind = F.when((a > 12) & (b > 12), "invalid").when(a > 12, "day_first").when(b > 12, "month_first").otherwise("ambiguous")
    return F.when(n.isNotNull(), kind)


def slash_date_order(c: Column) -> Column:
    """N-06: what one ``a/b/yyyy`` cell says about its order."""
    return once(_slash_parts(null_if_token(c)), _order)


def date_convention(kind: Column) -> Column:
    """N-07: aggregate of :func:`slash_date_order` over one file's column."""
    day, month, any_ = (F.max(F.when(kind == k, 1).otherwise(0)) for k in ("day_first", "month_first", "ambiguous"))
    return F.when((day == 1) & (month == 1), "conflict").when(day == 1, "day_first").when(month == 1, "month_first").when(any_ == 1, "ambiguous").otherwise("not_needed")


def parse_slash_date(c: Column, convention: Column) -> Column:
    """N-09: a cell's own evidence must agree with the column's convention."""
    return once(_slash_parts(null_if_token(c)), lambda n: _slash_date(n, convention))


def _slash_date(n: Column, convention: Column) -> Column:
    kind = _order(n)
    use = F.when(convention == "conflict", None).when(kind == "ambiguous", convention).when(kind == convention, kind)
    day, month = F.when(use == "day_first", n[0]).when(use == "month_first", n[1]), F.when(use == "day_first", n[1]).when(use == "month_first", n[0])
    return F.try_make_timestamp(n[2], month, day, F.coalesce(n[3], F.lit(0)), F.coalesce(n[4], F.lit(0)), F.coalesce(n[5], F.lit(0)).cast("decimal(8,6)"))


def parse_timestamp_utc(c: Column, convention: Column | None = None) -> Column:
    """N-05: ISO 8601 with or without a zone, then slash dates; else null."""
    return once(null_if_token(c), lambda v: _timestamp(v, convention))


def _timestamp(c: Column, convention: Column | None) -> Column:
    iso = F.regexp_replace(F.regexp_replace(c, r" (Z|UTC|[+-]\d{2}:?\d{2})$", "$1"), r"([+-]\d{2})(\d{2})$", "$1:$2")
    tries = [F.when(F.regexp_like(c, F.lit(_ISO)), iso).try_cast("timestamp"), *(F.when(F.regexp_like(c, F.lit(shape)), F.try_to_timestamp(c, F.lit(f))) for f, shape in FORMATS.items())]
    if convention is not None:
        tries.append(parse_slash_date(c, convention))
    return F.coalesce(*tries)


def is_unreadable(c: Column) -> Column:
    """A filled cell that is no number (T9)."""
    return null_if_token(c).isNotNull() & parse_money(c).isNull()


def is_successful(status: Column) -> Column:
    """N-22: a payment that was collected."""
    return F.coalesce(F.lower(F.trim(status)).isin(SUCCESSFUL), F.lit(False))


def first_present(df: DataFrame, *names: str) -> Column:
    """N-11: the first filled of those columns that exist."""
    have = [null_if_token(F.col(f"`{n}`")) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def email_key(c: Column) -> Column:
    """N-12."""
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def customer_key(email: Column, order_id: Column) -> Column:
    """N-13: the address, or the order as a guest."""
    return F.coalesce(email_key(email), F.concat(F.lit("guest:"), order_id.cast("string")))


def money_is_exact(c: Column) -> Column:
    """N-23: fits decimal(19,4) as written, and is no negative zero."""
    s = null_if_token(c)
    fits = F.regexp_like(s, F.lit(r"^[+-]?[0-9]{1,15}(\.[0-9]{1,4}0*)?$"))
    return fits & ~F.regexp_like(s, F.lit(r"^-0+(\.0+)?$"))


def redact_cell(c: Column) -> Column:
    """N-24: a cell as it may appear in a message."""
    return F.left(F.regexp_replace(c, r"[^@\s]+@[^@\s]+", "***@***"), F.lit(40))
