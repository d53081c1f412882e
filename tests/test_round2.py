"""Global positions over wide rows, mixed landing folders, sheets with odd
headers, replayed micro-batches, saved runs, cascades and appended alerts."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tillcast import schemas
from tillcast.operators import alerts, context, exports, forecasting, registry
from tillcast.operators.ordered import global_prefix
from tillcast.plans.ingest import ingest_upload, merged_daily
from tillcast.sources.erp_sheet import erp_report, erp_rows, map_erp_sheet, sheet_fallback
from tillcast.operators.cleaning import clean_log
from tillcast.sources.landing import cell_schema, map_rows, read_cells
from tillcast.streaming.ingest_stream import merged_daily as stream_daily, process_batch, quality_report

HEADER = "InvoiceNo,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country\n"


def write(path, text, encoding="utf-8"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(text.encode(encoding))


def products(spark):
    return spark.createDataFrame([(1, "A", "a", None, None, 0, 7, 0, 1.0)], schemas.PRODUCTS)


@pytest.mark.parametrize("buckets", [2, 4, 8])
def test_global_positions_of_wide_rows(spark, buckets):
    df = spark.range(20_000, numPartitions=7).select(
        F.xxhash64("id").alias("k"), F.concat(F.lit("payload "), F.col("id").cast("string")).alias("text"),
        F.col("id").alias("v"), (F.col("id") % 7).alias("w"))
    rows = global_prefix(df, [F.col("k").asc()], sum_cols=["v"], buckets=buckets).collect()
    assert len(rows) == 20_000
    rows.sort(key=lambda r: r["k"])
    assert [r["_pos"] for r in rows] == list(range(1, 20_001))
    assert rows[-1]["cum_v"] == sum(range(20_000)) and rows[9]["cum_v"] == sum(r["v"] for r in rows[:10])
    assert all(r["text"] == f"payload {r['v']}" for r in rows)


def test_every_landed_file_has_an_outcome(spark, scratch):
    land, out = f"{scratch}/land", f"{scratch}/out"
    write(f"{land}/a.csv", HEADER + "1,A,x,2,2024-01-01,1.50,c,UK\n")
    write(f"{land}/b.csv", "Country,unit_price,quantity,Order ID,Product ID,description,customer_id,invoice_date\n"
                           "UK,7.5,3,2,B1,second,c,2024-01-02\n")
    write(f"{land}/c.csv", "﻿InvoiceNo,StockCode,Description,InvoiceDate,Price,CustomerID,Country,Extra\n"
                           '3,C,"two\nlines",2024-01-03,2.0,c,UK,e\n')
    write(f"{land}/latin.csv", HEADER + "4,A,caf\xe9,1,2024-01-04,1.0,c,UK\n", "latin-1")
    write(f"{land}/bad.csv", "InvoiceNo,StockCode\n1,A\n")
    write(f"{land}/twice.csv", HEADER.replace("Price", "Price,Sales") + "1,A,x,2,2024-01-01,1,1,c,UK\n")
    write(f"{land}/d.txt", "hello")
    write(f"{land}/sheet.xlsx", "PK\x03\x04rest")
    res = ingest_upload(spark, land, 1, products(spark), out)
    assert res.status == "completed", res.error
    files = {os.path.basename(r["path"]): (r["outcome"], r["reason"]) for r in spark.read.parquet(res.files_path).collect()}
    assert {k: v[0] for k, v in files.items()} == {
        "a.csv": "accepted", "b.csv": "accepted", "c.csv": "accepted", "latin.csv": "accepted", "bad.csv": "refused",
        "twice.csv": "refused", "d.txt": "rejected", "sheet.xlsx": "unsupported"}
    assert files["bad.csv"][1].startswith("Missing required columns") and "Price" in files["twice.csv"][1]
    facts = {r["invoice_no"]: r for r in spark.read.parquet(res.facts_path).collect()}
    codes = {r["stock_code"]: r["product_id"] for r in spark.read.parquet(res.products_path).collect()} | {"A": 1}
    assert (facts["2"]["product_id"], facts["2"]["quantity"], float(facts["2"]["unit_price"])) == (codes["B1"], 3, 7.5)
    assert (facts["3"]["product_id"], facts["3"]["quantity"]) == (codes["C"], 1)
    assert facts.keys() == {"1", "2", "3", "4"}
    row = spark.read.parquet(res.uploads_path).first()
    assert (row["status"], row["row_count"], row["valid_rows"], row["error_message"]) == ("completed", 4, 4, None)
    # A smaller limit refuses by size, none lifts it.
    none = ingest_upload(spark, land, 2, products(spark), out, max_mb=0)
    assert none.status == "failed" and "Larger than 0 MB" in none.error
    assert ingest_upload(spark, land, 3, products(spark), out, max_mb=None).status == "completed"


def test_failures_are_recorded(spark, scratch):
    res = ingest_upload(spark, f"{scratch}/nowhere", 5, products(spark), f"{scratch}/out")
    assert res.status == "failed" and res.error
    row = spark.read.parquet(res.uploads_path).filter("upload_id = 5").first()
    assert row["status"] == "failed" and row["error_message"]
    write(f"{scratch}/land/x.csv", HEADER + "1,A,x,2,junk,1.50,c,UK\n")
    assert ingest_upload(spark, f"{scratch}/land", 6, products(spark), f"{scratch}/out").status == "failed"


def test_first_row_of_a_code_follows_the_file(spark, scratch):
    write(f"{scratch}/land/x.csv", HEADER + "9,N,first,1,2024-05-05,9.0,c,UK\n1,N,second,1,2024-01-01,1.0,c,UK\n")
    res = ingest_upload(spark, f"{scratch}/land", 1, products(spark), f"{scratch}/out")
    assert spark.read.parquet(res.products_path).first()["description"] == "first"


def test_a_line_of_the_largest_price_and_quantity_counts(spark, scratch):
    write(f"{scratch}/land/x.csv", HEADER + "1,A,x,100000,2024-01-01,100000,c,UK\n")
    res = ingest_upload(spark, f"{scratch}/land", 1, products(spark), f"{scratch}/out")
    assert float(merged_daily(spark, res.daily_path).first()["total_revenue"]) == 1e10


def test_too_many_columns_are_refused(spark, scratch):
    names = ["InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "Price", "Customer ID", "Country"] + [f"x{i}" for i in range(60)]
    write(f"{scratch}/land/x.csv", ",".join(names) + "\n" + ",".join("1" for _ in names) + "\n")
    m = map_rows(read_cells(spark, f"{scratch}/land"))
    assert m.refused.first()["reason"].startswith("More than") and m.rows.count() == 0
    assert len(cell_schema()) == 65


SHEET = "file string, row_idx long, " + ", ".join(f"c{i} string" for i in range(9))


def test_sheets_with_blank_and_repeated_headers(spark):
    rows = [("f1", 0, "Title", *[None] * 8),
            ("f1", 1, "Bill No", "Item", "Item Name", "Qty", "Bill Date", "Taxable Amt", "Customer Name", None, "Qty"),
            ("f1", 2, "B1", "=I1", "=cmd()", "2", "2024-01-05", "301", " Ravi ", "x", "99"),
            ("f1", 3, "B2", "I2", "Socks", "1", "2024-01-06", "-5", "Asha", None, None),
            ("f2", 0, "Order ID", "Product ID", "Product Name", "Order Date", "Sales", "Customer ID", "Country", None, None),
            ("f2", 1, "O1", "P1", "Chair", "08/11/2017", "261.96", "c", "US", None, None)]
    sheet = spark.createDataFrame(rows, SHEET)
    out, unmatched = map_erp_sheet(sheet)
    got = out.collect()
    assert [(r["InvoiceNo"], r["StockCode"], r["Description"], r["Quantity"], r["Customer ID"]) for r in got] == [("B1", "I1", "cmd()", 2.0, "Ravi")]
    assert [r["file"] for r in unmatched.collect()] == ["f2"]
    assert [(r["type"], r["affected_rows"]) for r in erp_report(erp_rows(sheet)[0]).collect()] == [("invalid_price", 1)]
    row = clean_log(sheet_fallback(sheet), file_col="_file").accepted.first()
    assert (row["InvoiceNo"], row["StockCode"], row["Quantity"], row["Price"], str(row["InvoiceDate"])[:10]) == ("O1", "P1", 1.0, 261.96, "2017-11-08")


def raw_batch(spark, path):
    """A micro-batch as the stream hands it over."""
    from tillcast.sources.landing import cell_columns, csv_options
    return csv_options(spark.read).csv(path).select(*cell_columns())


def test_replayed_batch_with_a_later_one_present(spark, scratch):
    out = f"{scratch}/out"
    write(f"{scratch}/b0/x.csv", HEADER + "1,N,n,2,2024-01-01,1.50,c,UK\n")
    write(f"{scratch}/b1/y.csv", "Country,Price,Quantity,InvoiceNo,StockCode,Description,Customer ID,InvoiceDate\nUK,2,3,2,N,n,c,2024-01-01\n")
    write(f"{scratch}/b1/z.csv", HEADER + "3,M,m,1,2024-01-02,1.00,c,UK\n")
    write(f"{scratch}/b1/q.txt", "x")
    for i in (0, 1):
        process_batch(raw_batch(spark, f"{scratch}/b{i}"), i, products(spark), out)
    ids = lambda: sorted((r["stock_code"], r["product_id"], r["batch_id"]) for r in spark.read.parquet(f"{out}/products").collect())
    daily = lambda: sorted(tuple(r) for r in stream_daily(spark, out).collect())
    before = ids(), daily()
    assert before[0] == [("M", 3, 1), ("N", 2, 0)]
    assert [(r[0], r[2]) for r in before[1]] == [(2, 5), (3, 1)]
    process_batch(raw_batch(spark, f"{scratch}/b0"), 0, products(spark), out)
    process_batch(raw_batch(spark, f"{scratch}/b1"), 1, products(spark), out)
    assert (ids(), daily()) == before
    assert quality_report(spark, out).filter("type = 'file_refused'").first()["message"].startswith("q.txt")


def test_session_needs_a_shared_folder_on_a_cluster(monkeypatch):
    from tillcast import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())


NOW = dt.datetime(2024, 3, 1)


def forecasts(spark, rows):
    return spark.createDataFrame([(p, r, dt.date(2024, 3, d), float(q), 0.0, 9.0) for p, r, d, q in rows],
                                 "product_id long, model_run_id long, forecast_date date, predicted_quantity double, lower_bound double, upper_bound double")


def test_saved_run_keeps_its_other_products(spark, scratch):
    path = f"{scratch}/fc"
    forecasting.save_forecasts(forecasts(spark, [(1, 1, 1, 5), (2, 1, 1, 6), (1, 2, 1, 7)]), path)
    forecasting.save_forecasts(forecasts(spark, [(1, 1, 1, 50), (1, 1, 2, 51)]), path)
    got = sorted((r["product_id"], r["model_run_id"], r["forecast_date"].day, r["predicted_quantity"]) for r in spark.read.parquet(path).collect())
    assert got == [(1, 1, 1, 50.0), (1, 1, 2, 51.0), (1, 2, 1, 7.0), (2, 1, 1, 6.0)]


def test_runs_record_settings_and_failures(spark):
    metrics = spark.createDataFrame([(1, 1.0, 2.0, 3.0)], "product_id long, mae double, rmse double, mape double")
    ok = forecasting.run_record(1, metrics, "gbt", 30, NOW, NOW)
    bad = forecasting.run_record(2, metrics.limit(0), "gbt", 30, NOW, NOW, status="failed", error="no rows")
    runs = ok.unionByName(bad)
    assert '"maxIter": 200' in ok.first()["parameters"]
    row = forecasting.run_by_id(runs, 2).first()
    assert (row["status"], row["error_message"], row["products_trained"]) == ("failed", "no rows", 0)
    fc = forecasts(spark, [(1, 1, 1, 5), (1, 1, 9, 6), (1, 2, 1, 7)])
    got = forecasting.read_forecasts(fc, runs, products=products(spark), as_of=dt.date(2024, 3, 1), horizon_days=7).collect()
    assert [(r["stock_code"], r["predicted_quantity"], r["mae"]) for r in got] == [("A", 5.0, 1.0)]


def test_delete_cascade(spark):
    reg = spark.createDataFrame([(i, f"f{i}", None, 1, 1, 0, "completed", i == 2, None, NOW + dt.timedelta(days=i), None) for i in (1, 2)], schemas.UPLOADS)
    tx = spark.createDataFrame([("1", 1, 2, 1.0, 2.0, NOW, "c", "UK", False, 1), ("2", 5, 3, 1.0, 3.0, NOW, "c", "UK", False, 2)],
                               "invoice_no string, product_id long, quantity int, unit_price double, revenue double, invoice_date timestamp, "
                               "customer_id string, country string, is_return boolean, upload_id long")
    dim = spark.createDataFrame([(1, "A"), (5, "E")], "product_id long, stock_code string")
    insights = spark.createDataFrame([("h",)], "context_hash string")
    out = registry.delete_upload_cascade(reg, tx, dim, 2, {"forecasts": forecasts(spark, [(1, 1, 1, 5), (5, 1, 1, 5)])}, insights)
    assert [r["product_id"] for r in out["orphans"].collect()] == [5]
    assert [r["product_id"] for r in out["forecasts"].collect()] == [1]
    assert out["insights"].count() == 0
    assert [(r["product_id"], r["total_quantity"]) for r in out["daily"].collect()] == [(1, 2)]
    assert registry.upload_status(out["uploads"], 1).first()["is_active"] and registry.upload_status(reg, 9).count() == 0


def test_appended_alert_leaves_the_others(spark):
    new = spark.createDataFrame([(1, "anomaly", "low", "m", None, None, None)],
                                "product_id long, alert_type string, severity string, message string, reorder_qty long, reorder_point double, current_velocity double")
    first = alerts.regenerate(None, new, "2024-01-01 00:00:00")
    both = alerts.append_alerts(first, new, "2024-01-02 00:00:00")
    assert both.count() == 2 and both.filter("NOT is_resolved").count() == 2
    assert alerts.append_alerts(both, new, "2024-01-02 00:00:00").count() == 2


def test_context_fields_are_sorted_and_prompts_of_all_kinds(spark):
    import json
    kpis = spark.createDataFrame([(10.0, 2, 5.0)], "total_revenue double, total_transactions long, avg_order_value double")
    counts = spark.createDataFrame([("reorder_needed", "low", 3)], "alert_type string, severity string, alert_count long")
    top = spark.createDataFrame([("A", "a", "A", 10.0, 2), ("B", "b", "B", 20.0, 1)], "stock_code string, description string, abc_class string, revenue double, quantity long")
    abc = spark.createDataFrame([("A", 1)], "abc_class string, product_count long")
    trend = spark.createDataFrame([(dt.date(2024, 1, 1), 10.0)], "date date, revenue double")
    doc = context.context_document(kpis, counts, top, abc, trend)
    parsed = json.loads(doc.first()["context"])
    assert [x["stock_code"] for x in parsed["top_10_products"]] == ["B", "A"]

    def check(x):
        if isinstance(x, dict):
            assert list(x) == sorted(x)
        for y in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
            check(y)

    check(parsed)
    pay = context.forecast_payload(forecasts(spark, [(1, 1, 2, 6), (1, 1, 1, 5)]), products(spark))
    prompts = context.prompt_rows(pay, doc, "forecast_explain").collect()
    body = json.loads(prompts[0]["payload"])
    assert [d["predicted"] for d in body["forecast"]] == [5.0, 6.0] and body["product"]["stock_code"] == "A"
    hashes = {context.prompt_rows(pay, doc, k).first()["context_hash"] for k in context.TASKS}
    assert len(hashes) == 3


def test_id_lists():
    assert exports.parse_id_list("1, 2,x, 3") == [1, 2, 3]
    assert exports.parse_id_list("") is None and exports.parse_id_list(None) is None and exports.parse_id_list("x") == []


def test_fact_build_splits_a_hot_code(spark):
    """FACT-1 without a broadcast: the partition of a code that holds most rows
    is split by the adaptive skew join, and no row is lost."""
    from tillcast.operators import catalogue
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        n = 60_000
        code = F.when(F.col("id") % 3 != 0, F.lit("HOT")).otherwise(F.concat(F.lit("C"), (F.col("id") % 500).cast("string")))
        clean = spark.range(n, numPartitions=8).select(
            F.col("id").cast("string").alias("InvoiceNo"), code.alias("StockCode"), F.lit("d").alias("Description"), F.lit(1.0).alias("Quantity"),
            F.lit(2.0).alias("Price"), F.lit(NOW).alias("InvoiceDate"), F.sha2(F.col("id").cast("string"), 256).alias("Customer ID"),
            F.lit("UK").alias("Country"), F.lit(False).alias("is_return"))
        dim = spark.createDataFrame([("HOT", 0)] + [(f"C{i}", i + 1) for i in range(500)], "stock_code string, product_id long")
        facts = catalogue.build_facts(clean, dim, 1)
        assert len(facts.select("invoice_no", "product_id", "customer_id").distinct().collect()) == n
        facts.collect()
        assert "SortMergeJoin(skew=true)" in facts._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
