"""PROD, DIM-3, ALERT-4..7, REG, stock maths — the reference's numbers."""

import datetime as dt

from pyspark.sql import functions as F

from tillcast import schemas
from tillcast.operators import alerts, products, registry
from tillcast.operators.daily import daily_sales, merge_daily

AS_OF = dt.date(2024, 3, 1)


def seed(spark):
    prods = spark.createDataFrame([(1, "TEST1", "Test Product", None, None, 50, 7, 20, 10.0)], schemas.PRODUCTS)
    daily = spark.createDataFrame([(1, AS_OF, 5, 75, 1, 15)],
                                  "product_id long, sale_date date, total_quantity long, total_revenue int, "
                                  "transaction_count long, avg_unit_price int").select(
        "product_id", "sale_date", "total_quantity", F.col("total_revenue").cast(schemas.SUM_MONEY).alias("total_revenue"),
        "transaction_count", F.col("avg_unit_price").cast(schemas.MONEY).alias("avg_unit_price"))
    return prods, daily


def test_product_list_and_lookup(spark):
    prods, daily = seed(spark)
    rows = products.product_list(prods, daily).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["current_stock"], r["lead_time_days"], r["safety_stock"], r["total_quantity"]) == (50, 7, 20, 5)
    assert products.lookup(prods, product_id=1).count() == 1
    assert products.lookup(prods, product_id=999).count() == 0
    assert products.lookup(prods, stock_code="TEST1").count() == 1


def test_stock_maths(spark):
    r = spark.range(1).select(
        products.reorder_point(F.lit(7), F.lit(10.0), F.lit(20)).alias("rop"),
        products.stock_status(F.lit(10), F.lit(20), F.lit(7), F.lit(10.0)).alias("s1"),
        products.stock_status(F.lit(25), F.lit(20), F.lit(7), F.lit(10.0)).alias("s2"),
        products.stock_status(F.lit(100), F.lit(20), F.lit(7), F.lit(10.0)).alias("s3"),
        products.reorder_quantity(F.lit(320), F.lit(50)).alias("q1"),
        products.reorder_quantity(F.lit(320), F.lit(400)).alias("q2")).first()
    assert r["rop"] == 90
    assert (r["s1"], r["s2"], r["s3"]) == ("critical", "low", "healthy")
    assert (r["q1"], r["q2"]) == (270, 0)


def test_pagination(spark):
    prods = spark.createDataFrame([(i, f"C{i}", f"d{i}", None, "A" if i % 2 else "B", 1, 7, 0, 1.0) for i in range(1, 8)],
                                  schemas.PRODUCTS)
    daily = spark.createDataFrame([(i, AS_OF, i, i * 10, 1, 1) for i in range(1, 8)],
                                  "product_id long, sale_date date, total_quantity long, total_revenue long, "
                                  "transaction_count long, avg_unit_price long")
    listing = products.product_list(prods, daily)
    page2 = products.product_page(listing, 2, 3).collect()
    assert [r["product_id"] for r in page2] == [4, 3, 2]
    pc = products.page_count(listing, 3).first()
    assert (pc["total"], pc["pages"]) == (7, 3)
    assert products.product_list(prods, daily, abc_class="a").count() == 4


def test_alert_regenerate_keeps_resolved(spark):
    old = spark.createDataFrame([
        (1, 1, "reorder_needed", "low", "m", 1, 1.0, 1.0, True, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)),
        (2, 2, "slow_mover", "high", "m", None, None, 0.0, False, dt.datetime(2024, 1, 1), None)], schemas.ALERTS)
    new = spark.createDataFrame([(3, "stockout_risk", "medium", "m", None, None, 0.5)],
                                "product_id long, alert_type string, severity string, message string, "
                                "reorder_qty long, reorder_point double, current_velocity double")
    out = alerts.regenerate(old, new, "2024-03-01 00:00:00")
    got = sorted((r["product_id"], r["is_resolved"]) for r in out.collect())
    assert got == [(1, True), (3, False)]
    resolved = alerts.resolve(out, spark.createDataFrame([(r["alert_id"],) for r in out.filter("product_id = 3").collect()],
                                                         "alert_id long"), dt.datetime(2024, 3, 2))
    assert resolved.filter("is_resolved").count() == 2
    counts = alerts.open_alert_counts(out).collect()
    assert [(r["alert_type"], r["alert_count"]) for r in counts] == [("stockout_risk", 1)]


def test_reorder_alert_numbers(spark):
    rows = [(1, AS_OF - dt.timedelta(days=i), q) for i, q in enumerate([10, 20, 30])]
    daily = spark.createDataFrame(rows, "product_id long, sale_date date, total_quantity long")
    a = alerts.reorder_alerts(daily, as_of=AS_OF).first()
    # avg 20, sample sd 10: ROP = 140 + 1.65*10*sqrt(7)
    assert a["severity"] == "medium" and a["reorder_qty"] == 210
    assert abs(a["reorder_point"] - round(140 + 16.5 * 7 ** 0.5, 2)) < 1e-9
    assert a["message"] == "Order at 183.7 units: 20.0 a day are sold and supply takes 7 days"


def test_registry_delete_active(spark):
    reg = spark.createDataFrame([
        (1, "a.csv", 1, 1, 1, 0, "completed", False, None, dt.datetime(2024, 1, 1), None),
        (2, "b.csv", 1, 1, 1, 0, "completed", False, None, dt.datetime(2024, 1, 2), None),
        (3, "c.csv", 1, 1, 1, 0, "completed", True, None, dt.datetime(2024, 1, 3), None)], schemas.UPLOADS)
    tx = spark.createDataFrame([("i", 1, 1, 1, 1, dt.datetime(2024, 1, 1), None, None, False, 1),
                                ("j", 2, 1, 1, 1, dt.datetime(2024, 1, 1), None, None, False, 3)],
                               "invoice_no string, product_id long, quantity int, unit_price int, revenue int, "
                               "invoice_date timestamp, customer_id string, country string, is_return boolean, upload_id long")
    prods = spark.createDataFrame([(1, "A", None, None, None, 0, 7, 0, 1.0), (2, "B", None, None, None, 0, 7, 0, 1.0)],
                                  schemas.PRODUCTS)
    reg2, tx2, kept, orphans = registry.delete_upload(reg, tx, prods, 3)
    assert [r["upload_id"] for r in reg2.filter("is_active").collect()] == [2]
    assert [r["product_id"] for r in orphans.collect()] == [2]
    assert kept.count() == 1 and tx2.count() == 1
    assert registry.set_active(reg, 1).filter("is_active").count() == 1
    reg3 = registry.register_upload(reg, 4, "d.csv", 10, dt.datetime(2024, 1, 4))
    assert [r["upload_id"] for r in reg3.filter("is_active").collect()] == [4]
    assert registry.set_status(reg3, 4, "failed", "x" * 600).filter("upload_id = 4").first()["error_message"] == "x" * 500


def test_daily_merge_additive(spark):
    tx = spark.createDataFrame([
        ("1", 1, 2, 100, 200, dt.datetime(2024, 1, 1), False, 1),
        ("2", 1, 3, 300, 900, dt.datetime(2024, 1, 1), False, 2)],
        "invoice_no string, product_id long, quantity int, unit_price int, revenue int, invoice_date timestamp, "
        "is_return boolean, upload_id long").select(
        "invoice_no", "product_id", "quantity", F.col("unit_price").cast(schemas.MONEY).alias("unit_price"),
        F.col("revenue").cast(schemas.LINE_MONEY).alias("revenue"), "invoice_date", "is_return", "upload_id")
    m = merge_daily(daily_sales(tx, 1), daily_sales(tx, 2)).first()
    assert (m["total_quantity"], float(m["total_revenue"]), m["transaction_count"]) == (5, 1100.0, 2)
    assert float(m["avg_unit_price"]) == 300.0
