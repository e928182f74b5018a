"""What a round trip through exports leaves and moves on disk."""

import time
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyhouse.functions import parsing
from tallyhouse.operators import normalize
from tallyhouse.plans import table_queries  # noqa: F401
from tallyhouse.plans.queries import QUERIES
from tallyhouse.sources import exports, scratch, testdata


def _folders(path):
    return {p.name.rsplit("-", 1)[0] for p in path.iterdir() if any(p.rglob("part-*"))}


@pytest.mark.parametrize("name", ["s_export_round_trip", "q_file_validation"])
def test_files_and_what_they_were_made_from_are_gone(spark, sf_dir, tmp_path, monkeypatch, name):
    monkeypatch.setattr(scratch, "root", lambda spark: str(tmp_path))
    out = QUERIES[name](spark, sf_dir)
    # no snapshot, no order heads, no exports, no raw rows; a source's cells are kept where its tables read them
    assert _folders(tmp_path) == {"exports-files", "cells", "files", "conventions", "order-rows", "payment-rows", "ad-rows"}
    assert out.count() > 0


def test_shuffles_of_what_is_written_are_gone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "root", lambda spark: str(tmp_path))
    local = Path(spark.conf.get("spark.local.dir"))
    found = lambda: set(local.rglob("shuffle_*.data"))
    before = found()
    with scratch.short_shuffles(spark):
        made = scratch.table(spark.range(5000).repartition("id"), "made")
    until = time.time() + 20
    while found() - before and time.time() < until:
        time.sleep(0.2)
    assert not found() - before and made.count() == 5000
    scratch.remove_table(made)
    assert not list(tmp_path.glob("made-*"))


def test_rows_stay_where_they_are_for_their_file(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(scratch, "root", lambda spark: str(tmp_path))
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    rows = spark.createDataFrame([("s", "f", 1, "1/31/2024", False)], "store_id string, file string, row_no int, cell string, bad_n boolean")
    try:
        spark.conf.set(key, "-1")
        kept = normalize.refuse_unreadable(rows, "x", {"n": F.lit(True)})[0]
        plan = normalize.with_convention(kept, "cell", "at")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 2


def test_an_order_has_its_lines_with_it(spark, sf_dir):
    packed = testdata.packed_orders(spark, sf_dir)
    heads = testdata.order_heads(spark, sf_dir)
    assert packed.drop("lines").exceptAll(heads.select(*packed.drop("lines").columns)).count() == 0 and packed.count() == heads.count()
    # lines are shuffled once, for their sums and their list
    assert packed._jdf.queryExecution().executedPlan().toString().count("lineitem.parquet") == 1
    lines = testdata.read_stores(spark, sf_dir).order_lines.filter("store_id not like 'web-%'")
    assert packed.filter("lines is not null").select(F.explode("lines")).count() == lines.count()
    assert packed.filter("lines.line_no <> array_sort(lines.line_no)").count() == 0


def test_rows_of_orders_in_any_order(spark, tmp_path):
    head = "Name,Created at,Email,Subtotal,Lineitem quantity,Lineitem price,Lineitem sku,Lineitem name\n"
    first = "#2,,,,1,5,E,e\n#1,,,,9,1,A,a\n#1,2024-01-02,x@y.z,7,2,1,B,b\n#2,2024-01-05,,3,1,5,E,e\n#1,,,,2,1.00,B,b\n#1,,,,0,1,C,c\n,,,,1,1,N,n\n#3,soon,,,1,1,A,a\n"
    later = "#1,2024-01-09,q@y.z,8,2,1,B,b\n#1,,,,4,1,,\n#2,,,,1,5,E,other\n"
    for name, text in (("a", first), ("b", later)):
        (tmp_path / "s").mkdir(exist_ok=True)
        (tmp_path / "s" / f"{name}.csv").write_text(head + text)
    out = normalize.normalize_orders(exports.read_export(spark, f"{tmp_path}/*/*.csv"))
    assert {(r.order_id, r.customer_id, str(r.created_at)[:10], r.subtotal) for r in out["orders"].collect()} == {("#1", "x@y.z", "2024-01-02", Decimal("7.0000")), ("#2", "guest:#2", "2024-01-05", Decimal("3.0000"))}
    lines = sorted((r.order_id, r.line_no, r.sku, r.quantity, r.title, str(r.created_at)[:10]) for r in out["order_lines"].collect())
    assert lines == [("#1", 1, "B", 2, "b", "2024-01-02"), ("#1", 2, "UNKNOWN", 4, "unknown", "2024-01-02"), ("#2", 1, "E", 1, "e", "2024-01-05"), ("#2", 2, "E", 1, "other", "2024-01-05")]
    kinds = {r.kind: r["count"] for r in out["issues"].collect()}
    assert kinds == {"missing_order_id": 1, "invalid_date": 3, "duplicate_line_item": 2, "missing_line_sku": 1, "missing_email": 1, "missing_currency": 2}
    assert (out["accepted_rows"].first().accepted_rows, out["rows_read"].first().rows_read) == (4, 11)


def test_plain_numbers_are_read_as_others(spark):
    want = {"12": "12", " -3.5 ": "-3.5", "+7.": "7", ".5": "0.5", "1e5": None, "1.2.3": None, ".": None, "12\n": "12", "1,5": "1.5", "1,234.50": "1234.5", "(4)": "-4", "€ 9": "9", "1" * 16: None, "0.00005": "0.0001", "٣": None, "-": None, "": None}
    rows = spark.createDataFrame([(k,) for k in want], "t string").select("t", parsing.parse_money(F.col("t")).alias("m")).collect()
    assert {r.t: r.m for r in rows} == {k: None if v is None else Decimal(v).quantize(Decimal("0.0001")) for k, v in want.items()}
