"""Grounding of claims, rules as data, selection of ranks, packs, sealed streams."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tallyhouse import streaming
from tallyhouse.operators import grounding, insights, lineage, quality, validate
from tallyhouse.plans import analyze


def test_claims_are_typed(spark):
    text = "Revenue rose 12.5% to 1,204.50 EUR. See [fact-1] and [x_2]! CAC fell because of ads: $3 in v2.1, top5."
    rows = spark.createDataFrame([(1, "s", text), (2, "s", None), (3, "s", "")], "id long, store_id string, text string")
    got = {(r.sentence, r.kind, r.unit, r.claim) for r in grounding.claims(rows, "id", "text", "store_id").collect()}
    assert got == {
        (1, "number", "percent", "12.5"), (1, "number", "plain", "1204.50"), (1, "metric", None, "revenue"), (1, "currency", None, "EUR"),
        (2, "reference", None, "fact-1"), (2, "reference", None, "x_2"),
        (3, "metric", None, "cac"), (3, "number", "plain", "3"), (3, "currency", None, "USD"), (3, "cause", None, "because of"),
    }


def test_each_fault_and_none(spark):
    said = [
        (1, "a", "Revenue was 100.00 EUR, up 20%. See [f1]."),
        (2, "a", "Revenue was 101."),
        (3, "a", "See [f9]."),
        (4, "a", "CAC was 100."),
        (5, "a", "CAC is unknown. Orders were 100."),
        (6, "a", "It cost 100 USD."),
        (7, "a", "Sales fell due to rain."),
        (8, "b", "Revenue was 100.00 EUR, up 20%. See [f1]."),
        (9, "a", "Share 0.2, 20.0%, 20%, 0.20; not 20 or 0.2%."),
        (10, None, "Revenue was 7."),
    ]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    found = grounding.claims(frame(said, "id long, store string, text string"), "id", "text", "store")
    out = grounding.faults(
        found, "id", frame([("a", 100.0), ("a", 0.2), ("b", 5.0)], "store_id string, value double"), frame([("a", "f1")], "store_id string, ref string"),
        frame([("a", "cac")], "store_id string, metric string"), frame([("a", "EUR"), ("b", "GBP")], "store_id string, currency string"),
    )
    assert {(r.id, r.sentence, r.fault, r.claim) for r in out.collect()} == {
        (2, 1, "ungrounded_number", "101"), (3, 1, "unknown_reference", "f9"), (4, 1, "unavailable_metric", "cac"), (6, 1, "foreign_currency", "USD"), (7, 1, "causal_claim", "due to"),
        (8, 1, "ungrounded_number", "100.00"), (8, 1, "ungrounded_number", "20"), (8, 2, "unknown_reference", "f1"), (8, 1, "foreign_currency", "EUR"),
        (9, 1, "ungrounded_number", "20"), (9, 1, "ungrounded_number", "0.2"), (10, 1, "ungrounded_number", "7"),
    }


def test_rules_of_every_kind(spark):
    rules = [
        ("s", "direction", "orders", None, "up", None, "MATCH"), ("s", "direction", "aov", None, "flat", None, "MATCH"), ("s", "direction", "none", None, "unknown", None, "MATCH"), ("s", "direction", "aov", None, "up", None, "KNOWN_GAP"),
        ("s", "presence", "orders", None, "present", None, "MATCH"), ("s", "presence", "aov", None, "absent", None, "MATCH"), ("s", "presence", "aov", None, "present", None, "KNOWN_GAP"),
        ("s", "choice", "factor", None, "aov", None, "MATCH"), ("t", "choice", "factor", None, "none", None, "MATCH"), ("t", "choice", "factor", None, "aov", None, "KNOWN_GAP"),
        ("s", "threshold", "score", ">=", None, 60.0, "MATCH"), ("s", "threshold", "score", "<", None, 60.0, "KNOWN_GAP"), ("t", "threshold", "score", "<", None, 60.0, "KNOWN_GAP"),
    ]
    seen = [("s", "direction", "orders", 0.081, None), ("s", "direction", "aov", -0.08, None), ("s", "presence", "orders", 1.0, None), ("s", "choice", "factor", None, "aov"), ("s", "threshold", "score", 60.0, None)]
    table = spark.createDataFrame(rules, "store_id string, kind string, subject string, op string, expected string, threshold double, want string")
    got = validate.evaluate_rules(table, spark.createDataFrame(seen, "store_id string, kind string, subject string, value double, text string")).collect()
    assert len(got) == len(rules) and all(r.verdict == r.want for r in got)


@pytest.mark.parametrize("bins", [30, 1024])
def test_ranks_by_selection(spark, bins, monkeypatch):
    monkeypatch.setattr(lineage, "SELECT_BINS", bins)
    rng = random.Random(3)
    groups = {"few": [3.0], "two": [1.0, 2.0], "ties": [5.0] * 300 + [6.0] * 10, "hot": [rng.lognormvariate(0, 4) for _ in range(3000)], "wide": [-1e308, 1e308, 0.0, 5e-324, -5e-324], None: [float(i) for i in range(101)]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("few", None), ("none", None), ("few", float("nan"))]
    got = {r.k: r for r in lineage.percentiles(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()}
    assert set(got) == {*groups, "none"} and got["none"].n == 0 and got["none"].p95 is None
    for k, vs in groups.items():
        vs, r = sorted(vs), got[k]
        nearest = lambda p: vs[math.ceil(p * len(vs) / 100) - 1]
        lo, hi = vs[(len(vs) - 1) // 2], vs[len(vs) // 2]
        assert (r.n, r.p95, r.p99, r.min, r.max, r.p95_is_max) == (len(vs), nearest(95), nearest(99), vs[0], vs[-1], nearest(95) == vs[-1])
        assert r.median == pytest.approx(lo + (hi - lo) / 2)


def test_packs_keep_to_their_bytes(spark):
    sections = list(analyze.PACK_LIMITS)
    rows = [("big", s, f"{i:09d}", f'"é​{"x" * 3000} {s} {i} mail a@b.cd"') for s in sections for i in range(40)]
    rows += [("small", "facts", "a", "revenue 1.0"), ("small", "facts", "b", "orders 2.0")]
    items = spark.createDataFrame(rows, "store_id string, section string, place string, text string")
    for budget in (400, 5_000, analyze.PACK_BYTES):
        got = {r.store_id: r for r in analyze.packed(items, budget).collect()}
        for r in got.values():
            pack = json.loads(r.pack)
            assert len(r.pack.encode()) <= budget and list(pack) == sections
            for s in sections:
                assert r[f"{s}_included"] == len(pack[s]) <= min(r[f"{s}_total"], analyze.PACK_LIMITS[s])
                assert all(len(x) <= analyze.PACK_CHARS and "@" not in x for x in pack[s])
        assert json.loads(got["small"].pack)["facts"] == ["revenue 1.0", "orders 2.0"]
    full = json.loads(got["big"].pack)
    assert sum(map(len, full.values())) == sum(analyze.PACK_LIMITS.values())  # texts are cut, so all fit
    tight = json.loads({r.store_id: r for r in analyze.packed(items, 5_000).collect()}["big"].pack)
    sizes = [len(tight[s]) for s in sections]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) >= 8  # every section gets its first items


def test_folded_anomalies_stay_readable(spark):
    found = spark.createDataFrame([("s", "revenue_decline", "revenue_decline", "aov", -0.3), ("s", "anomaly", "anomaly", "refunds", 0.5), ("t", "anomaly", "anomaly", "orders", -0.4), ("t", "low_margin_product", "low_margin_product", "sku", 0.1)], "store_id string, item_id string, kind string, subject string, value double")
    seen = [("s", "revenue", -0.3), ("s", "orders", -0.2), ("s", "aov", -0.1), ("s", "refunds", 0.5), ("t", "orders", -0.4)]
    anomalies = spark.createDataFrame([(s, m, "down" if p < 0 else "up", "high", 1.0, 2.0, p) for s, m, p in seen], "store_id string, metric string, direction string, severity string, value double, mean double, pct double")
    rests = insights.evidence(found, anomalies)
    got = {(r.store_id, r.item_id): ([e.evidence_id for e in r.evidence] if r.evidence else None, r.impact) for r in insights.with_evidence(found, rests).collect()}
    assert got == {("s", "revenue_decline"): (["anomaly-aov", "anomaly-orders", "anomaly-revenue"], -0.3), ("s", "anomaly"): (["anomaly-refunds"], 0.5), ("t", "anomaly"): (["anomaly-orders"], -0.4), ("t", "low_margin_product"): (None, None)}


def test_distinct_counts_beyond_the_cap_are_estimates(spark, monkeypatch):
    monkeypatch.setattr(quality, "DISTINCT_CAP", 500)
    rows = spark.range(20_000).select(F.col("id").alias("many"), (F.col("id") % 300).alias("few"), F.lit(None).cast("string").alias("none"))
    got = {r.column: r for r in quality.column_profile(rows).collect()}
    assert (got["few"].distinct, got["few"].exact) == (300, True) and (got["none"].distinct, got["none"].type) == (0, "empty")
    assert not got["many"].exact and abs(got["many"].distinct - 20_000) < 1500


def _orders(spark, folder, name, days):
    rows = [("s", f"2026-01-{d:02d} 10:00:00", d * 10) for d in days]
    frame = spark.createDataFrame(rows, "store_id string, at string, v int").select("store_id", F.to_timestamp("at").alias("created_at"), F.col("v").cast("decimal(12,2)").alias("subtotal"))
    frame.coalesce(1).write.parquet(f"{folder}/{name}")


def test_closed_weeks_are_told_once(spark, tmp_path):
    schema = "store_id string, created_at timestamp, subtotal decimal(12,2)"
    kept = "store_id string, period_start date, revenue double, orders long"
    for name, days in (("a", [5, 6, 12]), ("b", [13, 20, 27])):
        _orders(spark, tmp_path / "in", name, days)
    stream = lambda: streaming.weekly_kpis(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*"))
    query = streaming.run_sealed(stream(), f"{tmp_path}/out", f"{tmp_path}/ck")
    want = {("2026-01-05", 110.0, 2), ("2026-01-12", 250.0, 2)}
    told = lambda: {(str(r.period_start), r.revenue, r.orders) for r in streaming.read_sealed(spark, f"{tmp_path}/out", kept).collect()}
    assert told() == want
    # the weeks of the 19th and the 26th are open: all that the state holds
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 2
    streaming.run_sealed(stream(), f"{tmp_path}/out", f"{tmp_path}/ck")  # restarted: nothing new
    streaming.run_sealed(stream(), f"{tmp_path}/out", f"{tmp_path}/other")  # without its checkpoint
    assert told() == want
    before = streaming.sealed(spark, f"{tmp_path}/out").count()
    write = streaming.sealing_writer(f"{tmp_path}/out")
    for _ in range(2):  # a batch that is replayed under another number
        write(streaming.read_sealed(spark, f"{tmp_path}/out", kept).filter("orders > 99").unionByName(spark.createDataFrame([("x", None, 1.0, 1)], kept)), 77)
    assert streaming.sealed(spark, f"{tmp_path}/out").count() == before + 1
    _orders(spark, tmp_path / "in", "c", [28, 31])
    streaming.run_sealed(stream(), f"{tmp_path}/out", f"{tmp_path}/ck")
    assert told() == want | {("None", 1.0, 1)}


