import pytest
from pyspark.sql import functions as F

from tallyhouse.functions import parsing
from tallyhouse.operators import normalize
from tallyhouse.sources import exports, snapshots
from tallyhouse.sources.testdata import read_stores

ORDERS = """Name,Email,Financial Status,Created at,Currency,Subtotal,Discount Amount,Shipping,Taxes,Total,Refunded Amount,Lineitem quantity,Lineitem name,Lineitem price,Lineitem sku
#1,A@x.de,paid,2026-09-07 10:00:00 +0200,eur,150,0,0,0,150,0,1,"Thing, red",100,A
#1,,,,,,,,,,,2,Bolt,25,B
#2,,pending,2026-09-08,eur,45,5,0,0,45,10,1,Thing,50,A
#2,,,,,,,,,,,1,Thing,50,A
#3,,paid,31/02/2026,eur,9,0,0,0,9,0,1,Thing,9,A
"""
PRODUCTS = "SKU,Title,Cost per item\nA,Old,1\nA,Thing,40\nB,Bolt,\nC,Nut,-5\n,None,3\n"
STRIPE = "id,Created (UTC),Amount,Amount Refunded,Fee,Net,Status,Customer Email,order_id\nch_1,2026-09-07,150,0,4.5,145.5,Paid,a@x.de,#1\nch_2,2026-09-08,45,10,1.2,43.8,paid,,#2\nch_2,2026-09-08,45,10,1.2,43.8,paid,,#2\nch_3,2026-09-08,9,-5,,,failed,,\n"
ADS = "Day,Campaign,Cost,Clicks,Impressions,Conversions,Conv. value\n2026-09-07,Brand,10.5,5,100,1,50\n2026-09-07,Brand,11,6,100,1,50\nbad,Brand,1,1,1,1,1\n2026-09-08,Brand,-3,1,1,1,1\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("exports")
    for store in ("s1", "s2"):
        for name, text in (("orders", ORDERS), ("products", PRODUCTS), ("stripe", STRIPE), ("ads", ADS)):
            path = root / name / store
            path.mkdir(parents=True)
            (path / "export.csv").write_text(text)
    bad = root / "mixed"
    bad.mkdir()
    (bad / "a.csv").write_bytes(b"\xef\xbb\xbfDay;Campaign;Cost\n2026-01-01;x;1\n")
    (bad / "b.csv").write_bytes("id,Amount,Status\n1,2,caf\xe9\n".encode("latin-1"))
    (bad / "c.xlsx").write_bytes(b"PK\x03\x04rest")
    (bad / "d.csv").write_bytes(b"order_id,order_date,customer_id\n1,2,3\n")
    (bad / "e.csv").write_bytes(b"\xff\xfea\x00")
    return str(root)


def test_triage(spark, folder):
    got = {r.path.rsplit("/", 1)[1]: r for r in exports.triage_files(spark, f"{folder}/mixed/*").collect()}
    assert (got["a.csv"].source, got["a.csv"].delimiter, got["a.csv"].encoding) == ("google_ads", ";", "UTF-8")
    assert (got["b.csv"].source, got["b.csv"].encoding) == ("stripe", "windows-1252")
    assert got["c.xlsx"].refused == "xlsx_or_zip" and got["e.csv"].refused == "utf16"
    assert got["d.csv"].source is None and got["d.csv"].refused is None


def test_files_to_tables_in_one_step(spark, tmp_path):
    (tmp_path / "in" / "s").mkdir(parents=True)
    (tmp_path / "in" / "s" / "ads.csv").write_bytes("Day;Campaign;Cost\n2026-01-01;Caf\xe9 \x80;1,50\n".encode("latin-1"))
    (tmp_path / "in" / "s" / "orders.csv").write_text(ORDERS)
    (tmp_path / "in" / "s" / "x.xlsx").write_bytes(b"PK\x03\x04rest")
    (tmp_path / "in" / "s" / "other.csv").write_text("order_id,order_date\n1,2\n")
    t = exports.load_exports(spark, f"{tmp_path}/in/*/*")
    assert [(r.name, float(r.spend)) for r in t.campaigns.join(t.ad_daily, ["store_id", "campaign_id"]).collect()] == [("Café €", 1.5)]
    assert t.orders.count() == 2
    assert {(r.kind, r.message) for r in t.issues.filter("kind in ('refused_file', 'missing_source')").collect()} == {
        ("refused_file", "xlsx_or_zip"), ("refused_file", "unknown_columns"), ("missing_source", "no stripe export"), ("missing_source", "no shopify_products export"),
    }
    raw, _ = exports.read_exports(spark, f"{tmp_path}/in/*/*")
    got = {r.source: (r.rows_read, r.accepted_rows, r.verdict, str(r.first_day), r.currency) for r in exports.validate_exports(raw).collect()}
    assert got == {"google_ads": (1, 1, "valid", "2026-01-01", None), "shopify_orders": (5, 3, "valid_with_issues", "2026-09-07", "EUR")}


def test_one_order_in_two_encodings_counts_once(spark, tmp_path):
    row = "Name,Email,Created at,Currency,Subtotal,Total,Lineitem quantity,Lineitem name,Lineitem price,Lineitem sku\n#1,a@x.de,2026-01-0{day},eur,{v},{v},1,Gr\u00f6\u00dfe,{v},A\n"
    pay = "id,Created (UTC),Amount,Status,Customer Email\np1,2026-01-0{day},{v},paid,gr\u00fcn@x.de\n"
    ads = "Day,Campaign,Cost\n2026-01-01,Gr\u00f6\u00dfe,{v}\n"
    goods = "SKU,Title,Cost per item\nA,Gr\u00f6\u00dfe {v},{v}\n"
    folder = tmp_path / "in" / "s"
    folder.mkdir(parents=True)
    for name, text in (("orders", row), ("payments", pay), ("ads", ads), ("goods", goods)):
        (folder / f"{name}_1.csv").write_text(text.format(v=100, day=1), encoding="utf-8")
        (folder / f"{name}_2.csv").write_bytes(text.format(v=70, day=2).encode("windows-1252"))
        (folder / f"{name}_0.csv").write_bytes(text.replace(",", ";").format(v=50, day=3).encode("windows-1252"))
    t = exports.load_exports(spark, f"{tmp_path}/in/*/*")
    assert [(r.order_id, float(r.subtotal), str(r.created_at)[:10]) for r in t.orders.collect()] == [("#1", 50.0, "2026-01-03")]
    assert [float(r.amount) for r in t.payments.collect()] == [50.0] and [float(r.spend) for r in t.ad_daily.collect()] == [50.0]
    assert [(r.title, float(r.unit_cogs)) for r in t.products.collect()] == [("Größe 70", 70.0)]
    assert {(r.kind, r["count"]) for r in t.issues.collect()} == {("duplicate_payment", 2), ("duplicate_ad_row", 2)}


def test_missing_sources_are_judged_by_store(spark, tmp_path):
    for store, names in {"a": ["orders", "stripe"], "b": ["orders"], "c": ["bad"], "d": ["ads"]}.items():
        (tmp_path / store).mkdir()
        for name in names:
            (tmp_path / store / f"{name}.csv").write_text({"orders": ORDERS, "stripe": STRIPE, "ads": ADS, "bad": "x,y\n1,2\n"}[name])
    t = exports.load_exports(spark, f"{tmp_path}/*/*")
    missing = {(r.store_id, r.source, r.severity) for r in t.issues.filter("kind = 'missing_source'").collect()}
    have = {("a", "shopify_orders"), ("a", "stripe"), ("b", "shopify_orders"), ("d", "google_ads")}
    assert missing == {(x, s, "error" if s == "shopify_orders" else "warning") for x in "abcd" for s in exports.SIGNATURES if (x, s) not in have}


def test_title_and_total_rows(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "ads.csv").write_bytes("Campaign report\r\nJanuary; all\r\n\r\nDay;Campaign;Cost\r\n2026-01-01;\"Caf\xe9; x\";1,50\r\nTotal;;9\r\n".encode("windows-1252"))
    (tmp_path / "s" / "pay.csv").write_text(STRIPE.replace("Created (UTC)", "Created").replace("Fee", "created_local"))
    found = exports.open_exports(spark, f"{tmp_path}/*/*")
    t = exports.load_exports(spark, f"{tmp_path}/*/*")
    assert [(r.campaign_id, float(r.spend), str(r.day)) for r in t.ad_daily.collect()] == [("Café; x", 1.5, "2026-01-01")]
    got = {r.source: (r.title_rows, r.date_column, r.other_date_columns, r.total_rows) for r in exports.format_probes(found).collect()}
    assert got == {"google_ads": (3, None, None, 1), "stripe": (0, "Created", "created_local", None)}


def test_triage_reads_in_blocks(spark, tmp_path, monkeypatch):
    import hashlib

    import pyarrow as pa

    monkeypatch.setattr(exports, "BLOCK", 7)
    texts = {"a": "id,Amount,Status\n" + "é€😀" * 5000, "b": "x" * 9000, "c": "é" * 20 + "é"[:1]}
    raw = {k: v.encode() for k, v in texts.items()} | {"d": b"ab\xe9\x81" * 10, "e": "é".encode()[:1], "f": b""}
    for name, data in raw.items():
        (tmp_path / name).write_bytes(data)
    names = [f"file:{tmp_path}/{n}" for n in raw]
    batch = pa.RecordBatch.from_arrays([pa.array(names), pa.array([len(x) for x in raw.values()])], ["path", "length"])
    got = next(exports._scan(iter([batch]))).to_pylist()
    assert [r["sha256"] for r in got] == [hashlib.sha256(x).hexdigest() for x in raw.values()]
    assert [r["head"] for r in got] == [x[:8192] for x in raw.values()]
    assert [(r["utf8"], r["undefined"]) for r in got][2:] == [(True, False), (False, True), (False, False), (True, False)]


def test_orders(spark, folder):
    out = normalize.normalize_orders(exports.read_export(spark, f"{folder}/orders/*/*.csv"))
    for store in ("s1", "s2"):
        own = {k: v.filter(F.col("store_id") == store).collect() for k, v in out.items()}
        assert {r.order_id: (float(r.subtotal), r.customer_id) for r in own["orders"]} == {"#1": (150.0, "a@x.de"), "#2": (45.0, "guest:#2")}
        assert sorted((r.order_id, r.sku, r.quantity) for r in own["order_lines"]) == [("#1", "A", 1), ("#1", "B", 2), ("#2", "A", 1)]
        assert [(r.order_id, float(r.amount)) for r in own["refunds"]] == [("#2", 10.0)]
        assert {(r.kind, r.severity): r["count"] for r in own["issues"]} == {("invalid_date", "error"): 1, ("duplicate_line_item", "warning"): 1, ("missing_email", "warning"): 1}
        assert own["accepted_rows"][0].accepted_rows == 3


def test_products_payments_ads(spark, folder):
    p = normalize.normalize_products(exports.read_export(spark, f"{folder}/products/*/*.csv"))
    assert {r.sku: (r.title, r.unit_cogs and float(r.unit_cogs)) for r in p["products"].filter("store_id = 's1'").collect()} == {"A": ("Thing", 40.0), "B": ("Bolt", None), "C": ("Nut", None)}
    s = normalize.normalize_payments(exports.read_export(spark, f"{folder}/stripe/*/*.csv"))
    assert s["payments"].filter("store_id = 's1'").count() == 3 and s["refunds"].filter("store_id = 's1'").count() == 1
    assert {r.kind for r in s["issues"].collect()} == {"duplicate_payment", "negative_refund"}
    a = normalize.normalize_ads(exports.read_export(spark, f"{folder}/ads/*/*.csv"))
    assert [(float(r.spend), r.clicks) for r in a["ad_daily"].filter("store_id = 's1'").collect()] == [(10.5, 5)]
    assert {r.kind for r in a["issues"].collect()} == {"invalid_date", "duplicate_ad_row", "negative_spend"}


def test_load_stores_reports_missing_sources(spark, folder):
    t = exports.load_stores(spark, {"shopify_orders": f"{folder}/orders/*/*.csv", "google_ads": f"{folder}/ads/*/*.csv"})
    assert {(r.source, r.kind) for r in t.issues.filter("kind = 'missing_source'").collect()} == {("stripe", "missing_source"), ("shopify_products", "missing_source")}
    assert t.orders.count() == 4 and t.products.count() == 0


def test_unreadable_number_refuses_the_file(spark, tmp_path):
    good = ORDERS.replace("#1", "#8").replace("#2", "#9")
    for name, text in (("bad", ORDERS.replace(",150,0,0,0,150,", ",abc,0,0,0,150,")), ("bad2", ORDERS.replace(",2,Bolt", ",xx,Bolt")), ("good", good)):
        (tmp_path / "orders" / "s1").mkdir(parents=True, exist_ok=True)
        (tmp_path / "orders" / "s1" / f"{name}.csv").write_text(text)
    out = normalize.normalize_orders(exports.read_export(spark, f"{tmp_path}/orders/*/*.csv"))
    assert {r.order_id for r in out["orders"].collect()} == {"#8", "#9"}
    bad = {r.message: r["count"] for r in out["issues"].filter("kind = 'malformed_number' and severity = 'error'").collect()}
    assert bad == {"malformed_number: s_subtotal": 1, "malformed_number: s_quantity": 1}


def test_issues_of_the_sources(spark, tmp_path):
    texts = {
        "orders": "Name,Email,Created at,Currency,Subtotal,Total,Lineitem quantity,Lineitem price,Lineitem sku,Source\n#1,,1/2/2020,,10,,1,5,,Draft orders\n,,13/2/2020,,1,,1,1,A,\n#2,a@b.c,13/2/2020,eur,10,7,1,5,B,shopify_draft_order\n",
        "ads": "Day,Campaign,Cost\n2026-01-01,,5\n2026-01-01,x,5\n2026-01-01,x,6\n",
        "stripe": "id,Created,Amount,Status\n,2026-01-01,1,paid\np1,2026-01-01,,Captured\n",
        "products": "SKU,Title,COGS\n,none,1\nA,,-2\n",
    }
    for name, text in texts.items():
        (tmp_path / name / "s").mkdir(parents=True)
        (tmp_path / name / "s" / "f.csv").write_text(text)
    read = lambda n: exports.read_export(spark, f"{tmp_path}/{n}/*/*.csv")
    o = normalize.normalize_orders(read("orders"))
    kinds = lambda out: {(r.kind, r.severity): r["count"] for r in out["issues"].collect()}
    assert kinds(o) == {("missing_order_id", "error"): 1, ("missing_email", "warning"): 1, ("missing_currency", "warning"): 1, ("missing_line_sku", "warning"): 1, ("date_order_inferred", "info"): 1}
    rows = {r.order_id: (float(r.total), r.has_total, r.draft) for r in o["orders"].collect()}
    assert rows == {"#1": (0.0, False, False), "#2": (7.0, True, True)}
    assert kinds(normalize.normalize_ads(read("ads"))) == {("missing_campaign", "error"): 1, ("duplicate_ad_row", "warning"): 1}
    paid = normalize.normalize_payments(read("stripe"))
    assert kinds(paid) == {("missing_id", "error"): 1}
    assert [(float(r.amount), r.ok) for r in paid["payments"].select("amount", parsing.is_successful(F.col("status")).alias("ok")).collect()] == [(0.0, True)]
    p = normalize.normalize_products(read("products"))
    assert kinds(p) == {("missing_sku", "warning"): 1, ("negative_cogs", "error"): 1}
    assert [(r.sku, r.title, r.unit_cogs) for r in p["products"].collect()] == [("A", "A", None)]


def test_snapshots(spark, sf_dir, tmp_path):
    t = read_stores(spark, sf_dir)
    root = str(tmp_path / "snap")
    snapshots.write_snapshot(t, root, "a")
    back = snapshots.load_snapshot(spark, root, "a")
    assert t.orders.exceptAll(back.orders.select(*t.orders.columns)).count() == 0
    with pytest.raises(ValueError, match="not completed"):
        snapshots.load_snapshot(spark, root, "b")
    assert [(r.snapshot_id, r.stores) for r in snapshots.list_snapshots(spark, root).collect()] == [("a", t.orders.select("store_id").distinct().count())]
    # what another attempt left behind is not read
    t.campaigns.write.partitionBy("store_id").parquet(f"{root}/campaigns/snapshot_id=a/attempt=crashed")
    assert snapshots.load_snapshot(spark, root, "a").campaigns.count() == t.campaigns.count()
    attempt = snapshots.list_snapshots(spark, root).first().attempt
    twice = t.campaigns.limit(1)
    for _ in range(2):  # an even number of equal rows
        twice.write.mode("append").partitionBy("store_id").parquet(f"{root}/campaigns/snapshot_id=a/attempt={attempt}")
    with pytest.raises(ValueError, match="differs"):
        snapshots.load_snapshot(spark, root, "a")
