import datetime as dt
import math
from dataclasses import replace
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyhouse.config import AnalyticsConfig
from tallyhouse.operators import anomaly, facts, insights, kpis, profitability, quality, rootcause, series, validate
from tallyhouse.plans.analyze import PACK_LIMITS, Analysis, evidence_pack
from tallyhouse.schemas import SCHEMAS, StoreTables

D = Decimal
T = lambda day: dt.datetime(2026, 9, day, 12)


def make(spark, **rows) -> StoreTables:
    """Tables from short rows, each given to two stores."""
    out = {}
    for name, schema in SCHEMAS.items():
        names = [c.strip().split(" ")[0] for c in schema.replace("decimal(19,4)", "decimal").split(",")]
        data = [tuple({"store_id": s, **r}.get(n) for n in names) for r in rows.get(name, []) for s in ("s1", "s2")]
        out[name] = spark.createDataFrame(data, schema)
    return StoreTables(**out)


def order(i, day, subtotal, customer="c1", total=None, discount=0, **more):
    total = subtotal if total is None else total
    base = dict(order_id=str(i), customer_id=customer, created_at=T(day), currency="EUR", subtotal=D(subtotal), discount=D(discount), shipping=D(0), tax=D(0), total=D(total))
    return base | dict(has_total=True, financial_status="paid", cancelled=False, draft=False, source="shopify") | more


def line(i, n, sku, qty, price):
    return dict(order_id=str(i), created_at=T(7 + i), line_no=n, sku=sku, quantity=qty, unit_price=D(price), line_revenue=D(qty * price))


@pytest.fixture(scope="module")
def simple(spark):
    return make(
        spark,
        products=[dict(sku="A", title="a", unit_cogs=D(40)), dict(sku="B", title="b")],
        orders=[order(1, 8, 100), order(2, 9, 100, "c2")],
        order_lines=[line(1, 1, "A", 1, 100), line(2, 1, "B", 2, 50)],
        payments=[dict(payment_id=f"p{i}", created_at=T(8), amount=D(100), fee=D(f), status="paid", order_id=str(i), source="stripe") for i, f in ((1, "2.0"), (2, "2.5"))],
        ad_daily=[dict(campaign_id="x", day=dt.date(2026, 9, d), spend=D(50), clicks=100, impressions=1000, conversions=1.0, conversion_value=D(100)) for d in (8, 9)],
        campaigns=[dict(campaign_id="x", name="X", channel="search")],
    )


def test_simple_store(spark, simple):
    cfg = AnalyticsConfig()
    f = facts.period_facts(simple)
    rows = kpis.kpis_long(f, quality.field_quality(simple, cfg), simple.issues).collect()
    for store in ("s1", "s2"):
        v = {r.metric: (r.value, r.data_quality) for r in rows if r.store_id == store}
        assert len(v) == 17
        assert v["revenue"] == (200.0, "reliable") and v["orders"][0] == 2 and v["units"][0] == 3 and v["aov"][0] == 100
        assert v["roas"] == (2.0, "incomplete") and v["paid_conversion_rate"][0] == 0.01 and v["payment_fees"] == (4.5, "reliable")
        assert v["gross_margin"] == (0.6, "incomplete") and v["cac"][0] == 50.0 and v["new_customers"][0] == 2
        assert v["repeat_purchase_rate"][0] == 0.0 and v["customer_concentration_top5"][0] == 1.0
    notes = {r.metric: r.notes for r in rows if r.store_id == "s1"}
    assert notes["gross_margin"] == ["cost_coverage=50%"]


def test_unknown_is_not_zero(spark):
    t = make(spark, orders=[order(1, 8, 0, discount=100)])
    v = {r.metric: r.value for r in kpis.kpis_long(facts.period_facts(t), quality.field_quality(t, AnalyticsConfig()), t.issues).filter("store_id = 's1'").collect()}
    assert v["revenue"] == 0.0 and v["aov"] == 0.0 and v["ad_spend"] == 0.0
    assert all(v[m] is None for m in ("refund_rate", "cac", "roas", "gross_margin", "cogs", "payment_fees", "paid_conversion_rate", "customer_concentration_top5"))


def points(spark, values, metric="revenue"):
    start = dt.date(2026, 1, 5)
    rows = [(s, metric, start + dt.timedelta(7 * i), None if v is None else float(v)) for s in ("s1", "s2") for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "store_id string, metric string, period_start date, value double")


@pytest.mark.parametrize(
    "values, want",
    [
        ([100.0] * 8 + [60.0], ("down", "high", -0.4, None)),
        ([100.0, 102, 98, 101, 99, 103, 100, 101, 105], None),
        ([100.0, 101, 99, 100, 101, 99, 100, 100, 88], ("down", "high", -0.12, "z")),
        ([100.0] * 8 + [60.0, None], ("down", "high", -0.4, None)),
        ([None, None], None),
    ],
)
def test_anomalies(spark, values, want):
    got = anomaly.detect(points(spark, values), AnalyticsConfig()).collect()
    assert len(got) == (0 if want is None else 2)
    for r in got:
        assert (r.direction, r.severity, round(r.pct, 9)) == (want[0], want[1], pytest.approx(want[2]))
        assert (r.z is None) == (want[3] is None) and r.assessment == "unfavorable"


def test_rolling_average(spark):
    cfg = AnalyticsConfig(rolling=2)
    got = series.rolling_average(points(spark, [10.0, None, 20.0]), cfg).filter("store_id = 's1'").orderBy("period_start").collect()
    assert [r.rolling for r in got] == [10.0, 10.0, 20.0]


def test_contributions_sum_to_one(spark, simple):
    orders = simple.orders.unionByName(simple.orders.withColumn("order_id", F.concat(F.lit("n"), "order_id")).withColumn("created_at", F.expr("created_at + interval 7 days")).withColumn("subtotal", F.expr("cast(subtotal * 3 as decimal(19,4))")))
    last = simple.orders.limit(1).withColumn("order_id", F.lit("z")).withColumn("created_at", F.lit(dt.datetime(2026, 9, 20, 1))).select(*simple.orders.columns)
    ads = simple.ad_daily.unionByName(simple.ad_daily.withColumn("day", F.date_add("day", 7)).withColumn("clicks", F.col("clicks") * 2))
    ads = ads.unionByName(ads.filter("day = date'2026-09-15'").withColumn("day", F.lit(dt.date(2026, 9, 20))).withColumn("clicks", F.lit(1).cast("long")))
    a = Analysis(replace(simple, orders=orders.unionByName(last), ad_daily=ads))
    got = a.factors.filter("store_id = 's1'").collect()
    assert len(got) == 3 and math.isclose(sum(r.contribution for r in got), 1.0) and all(0.1 <= r.confidence <= 0.9 for r in got)


def test_contributors_are_shares_of_the_change_of_revenue(spark):
    t = make(
        spark,
        orders=[order(0, 7, 100), order(1, 14, 150, discount=50), order(2, 27, 1)],
        order_lines=[dict(line(0, 1, "A", 1, 100), created_at=T(7)), dict(line(1, 1, "A", 1, 120), created_at=T(14)), dict(line(1, 2, "B", 1, 80), created_at=T(14)), dict(line(2, 1, "A", 1, 1), created_at=T(27))],
    )
    cfg = AnalyticsConfig()
    periods = spark.createDataFrame([(s, dt.date(2026, 9, 14)) for s in ("s1", "s2")], "store_id string, period_start date")
    got = {r.sku: (float(r.delta), r.contribution) for r in rootcause.product_contributors(t, periods, facts.period_facts(t), cfg).filter("store_id = 's1'").collect()}
    assert got == {"B": (80.0, 1.6), "A": (20.0, 0.4)}  # revenue moved by 50, lines by 100


def test_direction_of_traffic_is_neutral(spark):
    got = anomaly.detect(points(spark, [100.0] * 8 + [60.0], "paid_clicks"), AnalyticsConfig()).collect()
    assert {r.assessment for r in got} == {"neutral"}


def test_findings_rules(spark, simple):
    cfg = AnalyticsConfig()
    seen = [("revenue", -0.4, "down", "high", "unfavorable"), ("roas", -0.3, "down", "high", "unfavorable"), ("refunds", -0.5, "down", "high", "favorable"), ("ad_spend", 0.5, "up", "high", "neutral")]
    rows = [("s1", *r) for r in seen] + [("s2", *r) for r in seen if r[0] != "revenue"]
    anomalies = spark.createDataFrame(rows, "store_id string, metric string, pct double, direction string, severity string, assessment string")
    none = spark.createDataFrame([], "store_id string, factor string, contribution double, confidence double")
    primary = spark.createDataFrame([], "store_id string, primary_factor string")
    profit = spark.createDataFrame([("s1", 1.0, [])], "store_id string, full_profit double, missing array<string>")
    products = spark.createDataFrame([("s1", "A", 0.1, 5.0), ("s1", "B", 0.05, 5.0), ("s1", "C", 0.1, 0.0), ("s1", "D", 0.5, 9.0)], "store_id string, sku string, margin double, revenue double")
    kpi = spark.createDataFrame([("s1", 0.5)], "store_id string, customer_concentration_top5 double")
    campaigns = spark.createDataFrame([("s1", "x", 2.0)], "store_id string, campaign_id string, delta_conversions double")
    found = insights.ranked(insights.findings(anomalies, none, primary, profit, products, kpi, campaigns, cfg)).collect()
    of = lambda s: [(r.kind, r.subject, r.severity, r.confidence) for r in sorted(found, key=lambda r: r["rank"]) if r.store_id == s]
    assert of("s1") == [
        ("revenue_decline", "revenue", "high", 0.4),
        ("low_margin_product", "A", "medium", 0.7),
        ("low_margin_product", "B", "medium", 0.7),
        ("customer_concentration", "top5", "medium", 0.6),
        ("anomaly", "ad_spend", "low", 0.45),
        ("anomaly", "refunds", "info", 0.45),
        ("campaign_opportunity", "x", "info", 0.4),
    ]
    assert of("s2") == [("anomaly", "roas", "high", 0.45), ("anomaly", "ad_spend", "low", 0.45), ("anomaly", "refunds", "info", 0.45)]


def test_consistency_issues(spark):
    t = make(
        spark,
        orders=[
            order(1, 8, 100, discount=20, total=80),  # the total takes the discount off the subtotal
            order(2, 8, 50, total=99),
            order(3, 8, -5),
            order(4, 8, 10, cancelled=True, currency="USD"),
            order(5, 8, 10, financial_status="voided"),
            order(6, 8, 0, draft=True),
            order(7, 8, 10, has_total=False, total=0),
        ],
        refunds=[dict(refund_id="a", created_at=T(8), amount=D(60), order_id="5", source="shopify"), dict(refund_id="b", created_at=T(8), amount=D(20), order_id="5", source="stripe")],
    )
    cfg = AnalyticsConfig()
    negative = spark.createDataFrame([("s1", 2)], "store_id string, n long")
    found = quality.consistency_issues(t, cfg, negative)
    got = {(r.kind, r.severity): r["count"] for r in found.filter("store_id = 's1'").collect()}
    assert got == {
        ("subtotal_convention_contradiction", "error"): 1,
        ("subtotal_contract_unverified", "warning"): 2,
        ("missing_order_total", "warning"): 1,
        ("refund_exceeds_order_total", "warning"): 1,
        ("negative_subtotal", "warning"): 1,
        ("cancelled_orders_counted", "warning"): 1,
        ("unsettled_orders_counted", "warning"): 1,
        ("zero_value_orders_counted", "info"): 1,
        ("draft_orders_counted", "info"): 1,
        ("currency_mismatch", "error"): 1,
        ("refund_mismatch", "warning"): 1,
        ("negative_period_revenue", "warning"): 2,
    }
    fields = {r.field: r.status for r in quality.field_quality(t, cfg).filter("store_id = 's1'").collect()}
    assert fields["currency"] == "unavailable"
    rows = {r.metric: (r.data_quality, r.notes) for r in kpis.kpis_long(facts.period_facts(t), quality.field_quality(t, cfg), found).filter("store_id = 's1'").collect()}
    assert rows["revenue"] == ("incomplete", ["subtotal_contract_unverified"]) and rows["refund_rate"][0] == "incomplete"


def test_scattered_blocks_over_edges(spark):
    keys = "aabbbbacccdd" * 3
    rows = spark.createDataFrame([("f", i, k) for i, k in enumerate(keys)] + [("g", i, "x") for i in range(40)], "file string, at long, k string")
    blocks = [k for i, k in enumerate(keys) if i == 0 or keys[i - 1] != k]
    want = {(k, blocks.count(k), keys.count(k)) for k in set(keys) if blocks.count(k) > 1}
    for span in (1_000_000, 5, 1):
        assert {(r.k, r.blocks, r["rows"]) for r in validate.scattered_blocks(rows, "at", "k", "file", span).collect()} == want


def test_one_store_by_any_name(spark, simple):
    odd = replace(simple, orders=simple.orders.withColumn("store_id", F.when(F.col("store_id") == "s1", "o'brien").otherwise(F.col("store_id"))))
    assert odd.only("o'brien").orders.count() == 2 and odd.only("' or 1=1 --").orders.count() == 0


def test_refund_basis(spark):
    t = make(spark, orders=[order(1, 8, 100, total=130), order(2, 9, 50)], refunds=[dict(refund_id="r1", created_at=T(8), amount=D(30), order_id="1", source="shopify")])
    r = profitability.refund_basis(t, AnalyticsConfig()).filter("store_id = 's1'").first()
    assert (r.refund_cost, r.refund_low, r.refund_high, r.undetermined) == (None, D("0.0000"), D("30.0000"), 1)
    t = replace(t, refunds=t.refunds.withColumn("order_id", F.lit("2")))
    r = profitability.refund_basis(t, AnalyticsConfig()).filter("store_id = 's1'").first()
    assert (r.refund_cost, r.undetermined) == (D("30.0000"), 0)


def test_profit_needs_all_components(spark, simple):
    cfg = AnalyticsConfig()
    all_cost = replace(simple, products=simple.products.withColumn("unit_cogs", F.lit(40).cast("decimal(19,4)")))
    f = facts.period_facts(all_cost)
    basis = profitability.refund_basis(all_cost, cfg)
    r = profitability.profitability(f, basis, cfg).filter("store_id = 's1'").first()
    assert r.full_profit is None and r.missing == ["shipping"] and r.partial_profit == D("-24.5000")
    ship = f.select("store_id", "period_start", F.lit(10).cast("decimal(28,4)").alias("shipping_cost"))
    assert profitability.profitability(f, basis, cfg, ship).filter("store_id = 's1'").first().full_profit == D("-34.5000")


def test_report_and_pack(spark, simple):
    a = Analysis(simple)
    both = a.report().collect()
    assert {r.store_id for r in both} == {"s1", "s2"} and len({r.report for r in both}) == 1
    assert all(0 <= r.health_score <= 100 for r in a.score.collect())
    for r in evidence_pack(a).collect():
        assert all(r[f"{n}_included"] <= min(limit, r[f"{n}_total"]) for n, limit in PACK_LIMITS.items()) and len(r["pack"].encode()) <= 64_000


def test_repartitioning_changes_nothing(spark, simple):
    other = StoreTables(*[getattr(simple, n).repartition(7) for n in SCHEMAS_ORDER])
    a, b = facts.period_facts(simple), facts.period_facts(other)
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0


SCHEMAS_ORDER = list(StoreTables.__dataclass_fields__)


def test_plans_have_no_python_and_no_window_by_store_over_facts(spark, sf_dir):
    from tallyhouse.sources.testdata import read_stores

    t = read_stores(spark, sf_dir)
    plan = facts.period_facts(t)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert all("period_start" in x for x in plan.splitlines() if x.strip(" +-:").startswith("Window "))
