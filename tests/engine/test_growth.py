"""Faults that showed on larger tables: what is sent to the driver, read again, estimated or sorted in one task."""

import random
import re

from pyspark.sql import functions as F

from tallyhouse.functions import redaction as R
from tallyhouse.operators import grounding, normalize, quality
from tallyhouse.plans import table_queries  # noqa: F401
from tallyhouse.plans.queries import QUERIES
from tallyhouse.schemas import SCHEMAS, StoreTables
from tallyhouse.sources import exports, snapshots


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _faults(spark):
    said = spark.createDataFrame([(1, "a", "Revenue was 100.00 EUR, up 20%. See [f1]."), (2, "a", "CAC was 7 due to rain.")], "id long, store string, text string")
    one = lambda value, schema: spark.createDataFrame([("a", value)], schema)
    return grounding.faults(
        grounding.claims(said, "id", "text", "store"), "id", one(100.0, "store_id string, value double"), one("f2", "store_id string, ref string"), one("cac", "store_id string, metric string"), one("EUR", "store_id string, currency string")
    )


def test_evidence_is_never_broadcast(spark):
    out = _faults(spark)
    assert "Broadcast" not in _plan(out) and "SortMergeJoin" in _plan(out)
    assert {(r.id, r.fault, r.claim) for r in out.collect()} == {(1, "ungrounded_number", "20"), (1, "unknown_reference", "f1"), (2, "ungrounded_number", "7"), (2, "unavailable_metric", "cac"), (2, "causal_claim", "due to")}


def test_only_quoted_forms_are_made(spark):
    values = spark.createDataFrame([("a", 1.25)], "store_id string, value double")
    got = {(r.unit, r.claim) for r in grounding.trusted_numbers(values, [("plain", 1), ("percent", 0), ("plain", 4)]).collect()}
    assert got == {("plain", "1.3"), ("percent", "125"), ("plain", "1.2500")}
    assert grounding.trusted_numbers(values, []).count() == 0


def test_texts_are_read_once_for_all_claims(spark):
    assert "regexp_extract_all" not in _plan(_faults(spark))


def test_numbers_are_found_as_with_backtracking():
    plain = r"(?<![\w.\[#-])[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]{1,4})?(?![\w.,]*[0-9])\s?%?|(?<![\w.\[#-])[0-9]+(?:\.[0-9]{1,4})?(?![\w.,]*[0-9])\s?%?"
    rng = random.Random(5)
    for _ in range(20_000):
        text = "".join(rng.choice("0123456789012,,.. %a-[") for _ in range(rng.randrange(1, 14)))
        assert re.findall(grounding.NUMBER, text) == re.findall(plain, text), text


def test_a_text_is_not_read_first_to_ask_whether_it_has_claims(spark):
    said = spark.createDataFrame([(1, "a", "Up 20%. Nothing here. Due to rain.")], "id long, store string, text string")
    found = grounding.claims(said, "id", "text", "store")
    optimized = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter (size(" not in optimized and "size(split" not in optimized and optimized.count("regexp_extract_all") == 2
    assert sorted((r.sentence, r.claim) for r in found.collect()) == [(1, "20"), (3, "due to")]


def test_cards_apart_by_one_character(spark):
    good, bad = "4111111111111111", "4111111111111112"
    texts = [good, f"{bad},{good}", f"{bad}, {good}", f"{good},{bad}", f"x{good}x", f"1{good}0000", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r.c for r in rows.select(R.has_card(F.col("text")).alias("c")).collect()] == [True, False, True, True, True, False, None]
    found = quality.sensitive_scan(rows, ["text"]).filter("kind = 'card'").collect()
    assert [r.rows for r in found] == [4]
    # masking takes every run
    assert spark.createDataFrame([(f"{bad},{good}",)], "t string").select(R.redact_sensitive(F.col("t"))).first()[0] == f"{bad},[card]"


def test_exact_profiles_beyond_the_cap(spark, monkeypatch):
    monkeypatch.setattr(quality, "DISTINCT_CAP", 500)
    rows = spark.range(20_000).select("id", (F.col("id") / 4).alias("d"), F.date_add(F.lit("2020-01-01"), (F.col("id") % 700).cast("int")).alias("day"), F.lit("x").alias("t"), (F.col("id") % 2).alias("b"))
    got = {r.column: (r.distinct, r.type, r.exact) for r in quality.column_profile(rows, exact=True).collect()}
    assert got == {"id": (20_000, "number", True), "d": (20_000, "number", True), "day": (700, "date", True), "t": (1, "text", True), "b": (2, "boolean", True)}
    some = {r.column: r.distinct for r in quality.column_profile(rows, exact=True, only="type = 'date' or `column` = 'id'").collect()}
    assert some == {"id": 20_000, "d": None, "day": 700, "t": None, "b": None}
    wide = {r.column: (r.distinct, r.exact) for r in quality.column_profile(rows, only="type = 'date'").collect()}
    assert wide["id"] == (None, False) and wide["day"][1] is False and abs(wide["day"][0] - 700) < 60


def test_types_of_columns_are_as_of_their_texts(spark):
    rows = spark.createDataFrame([(1, 0, float("nan"), True), (None, 1, 1e300, None), (3, 1, None, False)], "n long, z int, d double, b boolean")
    rows = rows.withColumns({"m": F.lit("2.50").cast("decimal(9,2)"), "at": F.to_timestamp(F.lit("2024-01-02 03:04:05")), "none": F.lit(None).cast("long")})
    texts = rows.select(*[F.col(c).cast("string").alias(c) for c in rows.columns])
    of = lambda df: {r.column: (r.type, r.missing, r.distinct) for r in quality.column_profile(df).collect()}
    assert of(rows) == of(texts)


def test_files_are_cut_only_at_line_breaks_outside_quotes():
    def plain(text, size=3):
        lines, data = exports._Lines(), text.encode()
        for i in range(0, len(data), size):
            lines.see(data[i : i + size])
        return lines.end()

    for text in ("a,b\n1,2\n", 'a,b\n"x, y",2\n"a ""b""",""\n', "a;b\r\n1;2\r\n", 'a\n"b";c\n"d"', ""):
        assert plain(text) and plain(text, 1000), text
    for text in ('a,b\n"x\ny",2\n', 'a,b\n"x\n', 'a\n5" pipe,"b\nc"\n', "a\rb\n", "a\r\nb\n", 'a\nx;a,";"b"\n'):
        assert not plain(text) and not plain(text, 1000), text


def test_plain_files_are_split_and_stay_in_order(spark, tmp_path):
    (tmp_path / "s").mkdir()
    rows = "".join(f"p{i},2026-01-01,{i},paid\n" for i in range(3000))
    (tmp_path / "s" / "pay.csv").write_text("id,Created,Amount,Status\n" + rows)
    (tmp_path / "s" / "pay2.csv").write_text('id,Created,Amount,Status\nq1,2026-01-01,1,"pa\nid"\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        raw = exports.open_exports(spark, f"{tmp_path}/*/*").raw["stripe"]
        got = raw.orderBy("row_no").select("id", "Status", "row_no.block").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.id for r in got] == [f"p{i}" for i in range(3000)] + ["q1"] and got[-1].Status == "pa\nid"
    assert len({r.block for r in got}) > 3


def test_a_snapshot_is_written_where_its_rows_are(spark, tmp_path):
    empty = {n: spark.createDataFrame([], s) for n, s in SCHEMAS.items()}
    rows = spark.range(0, 60, 1, 3).select(F.concat(F.lit("s"), (F.col("id") % 2).cast("string")).alias("store_id"), F.col("id").cast("string").alias("campaign_id"), F.lit("n").alias("name"), F.lit("c").alias("channel"))
    snapshots.write_snapshot(StoreTables(**empty | {"campaigns": rows}), str(tmp_path), "a")
    # each of the three tasks wrote its rows of both stores: nothing was shuffled for it
    assert len(list((tmp_path / "campaigns").rglob("part-*.parquet"))) == 6
    assert snapshots.load_snapshot(spark, str(tmp_path), "a").campaigns.count() == 60


def test_equal_dates_of_a_file_are_looked_at_once(spark):
    rows = spark.createDataFrame([("s", "f", "1/31/2024", i) for i in range(50)] + [("s", "g", "20240131", 1), ("s", "g", "2024013", 2)], "store_id string, file string, cell string, n int")
    out = normalize.with_convention(rows, "cell", "at")
    got = {(r.file, r.cell, r.convention, str(r.at)) for r in out.select("file", "cell", "convention", "at").collect()}
    assert got == {("f", "1/31/2024", "month_first", "2024-01-31 00:00:00"), ("g", "20240131", "not_needed", "2024-01-31 00:00:00"), ("g", "2024013", "not_needed", "None")}
    # cells are grouped before their order is told
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[store_id#\d+, file#\d+, cell#\d+\]", plan), plan


def test_equality_has_no_fixed_number_of_parts(spark, sf_dir):
    plan = _plan(QUERIES["l_equality"](spark, sf_dir))
    assert "RoundRobinPartitioning" not in plan and "REPARTITION_BY_COL" in plan
