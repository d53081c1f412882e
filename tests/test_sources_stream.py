"""GATE-1/2, SRC-1/2/3, JOB-1, STR-1/2."""

import datetime as dt
import os

from pyspark.sql import functions as F

from tillcast import schemas
from tillcast.functions.text import sanitize_filename
from tillcast.plans.ingest import ingest_upload, merged_daily
from tillcast.sources.erp_sheet import map_erp_sheet
from tillcast.sources.files import file_gate, read_raw_log
from tillcast.streaming.ingest_stream import merged_daily as stream_daily, quality_report, start_ingest_stream

HEADER = "InvoiceNo,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country\n"


def write(path, data: bytes):
    with open(path, "wb") as f:
        f.write(data)


def test_file_gate(spark, scratch):
    d = os.path.join(scratch, "landing")
    os.makedirs(d)
    write(os.path.join(d, "good.csv"), (HEADER + "1,A,x,1,2024-01-01,1.0,c,UK\n").encode())
    write(os.path.join(d, "latin.csv"), (HEADER + "1,A,caf\xe9,1,2024-01-01,1.0,c,UK\n").encode("latin-1"))
    write(os.path.join(d, "sheet.xlsx"), b"PK\x03\x04rest")
    write(os.path.join(d, "fake.xlsx"), b"not a zip")
    write(os.path.join(d, "notes.txt"), b"hello")
    g = {os.path.basename(r["path"]): r for r in file_gate(spark, d).collect()}
    assert g["good.csv"]["reason"] is None and g["good.csv"]["encoding"] == "UTF-8"
    assert g["latin.csv"]["reason"] is None and g["latin.csv"]["encoding"] == "ISO-8859-1"
    assert g["sheet.xlsx"]["reason"] is None
    assert g["fake.xlsx"]["reason"] == "Content is not what the extension says"
    assert g["notes.txt"]["reason"].startswith("Extension is none of")
    big = file_gate(spark, d, max_mb=0).filter(F.col("path").endswith("good.csv")).first()
    assert big["reason"] == "Larger than 0 MB"
    raw = read_raw_log(spark, os.path.join(d, "latin.csv"), "ISO-8859-1").first()
    assert raw["Description"] == "café" and raw["_file"].endswith("latin.csv")


def test_sanitize_filename(spark):
    r = spark.createDataFrame([("../../etc/pa ss;wd.csv",), ("x" * 300 + ".csv",)], "p string").select(
        sanitize_filename(F.col("p")).alias("f")).collect()
    assert r[0]["f"] == "pa_ss_wd.csv"
    assert len(r[1]["f"]) == 244 and r[1]["f"].endswith(".csv")


def test_erp_sheet(spark):
    rows = [("f1", 0, "Sales Report", None, None, None, None, None, None),
            ("f1", 1, "Bill No", "Item", "Item Name", "Qty", "Bill Date", "Taxable Amt", "Customer Name"),
            ("f1", 2, "B1", "I1", "Shirt", "2", "2024-01-05", "301", "Ravi"),
            ("f1", 3, "B2", "I2", "Socks", "0", "2024-01-06", "50", "Asha"),
            ("f1", 4, None, None, "Subtotal", "2", None, "351", None),
            ("f2", 0, "a", "b", "c", "d", "e", "f", "g")]
    sheet = spark.createDataFrame(rows, "file string, row_idx long, c0 string, c1 string, c2 string, c3 string, "
                                        "c4 string, c5 string, c6 string")
    out, unmatched = map_erp_sheet(sheet)
    got = sorted((r["InvoiceNo"], r["StockCode"], r["Price"], r["Country"]) for r in out.collect())
    assert got == [("B1", "I1", 150.5, "India"), ("B2", "I2", 50.0, "India")]
    assert [r["file"] for r in unmatched.collect()] == ["f2"]


def _land(d, name, lines):
    os.makedirs(d, exist_ok=True)
    write(os.path.join(d, name), (HEADER + "".join(lines)).encode())


def _products(spark):
    return spark.createDataFrame([(1, "A", "a", None, None, 0, 7, 0, 1.0)], schemas.PRODUCTS)


def test_batch_ingest(spark, scratch):
    land = os.path.join(scratch, "land")
    _land(land, "u1.csv", ["1,A,x,2,2024-01-01,1.50,c,UK\n", "2,B,y,3,2024-01-01,2.00,c,UK\n",
                           "3,=B,y,1,2024-01-02,2.00,c,UK\n", "4,C,z,1,2024-01-02,-1,c,UK\n"])
    res = ingest_upload(spark, land, 1, _products(spark), os.path.join(scratch, "out"))
    assert res.status == "completed"
    daily = {(r["product_id"], str(r["sale_date"])): r for r in merged_daily(spark, res.daily_path).collect()}
    assert daily[(1, "2024-01-01")]["total_quantity"] == 2
    new_ids = {r["stock_code"]: r["product_id"] for r in spark.read.parquet(res.products_path).collect()}
    assert new_ids == {"B": 2}
    assert daily[(2, "2024-01-02")]["total_quantity"] == 1
    rep = res.report.collect()
    assert [(r["type"], r["affected_rows"]) for r in rep] == [("invalid_price", 1)]


def test_stream_ingest_is_replay_safe(spark, scratch):
    land = os.path.join(scratch, "land")
    out = os.path.join(scratch, "out")
    _land(land, "a.csv", ["1,A,x,2,2024-01-01,1.50,c,UK\n"])
    _land(land, "b.csv", ["2,A,x,3,2024-01-01,2.00,c,UK\n", "3,N,n,1,2024-01-03,1.00,c,UK\n"])
    cols = schemas.RAW_LOG_COLUMNS
    start_ingest_stream(spark, land, cols, _products(spark), out, files_per_trigger=1).awaitTermination()
    first = sorted(tuple(r) for r in stream_daily(spark, out).collect())
    # second run: nothing new, nothing changes
    start_ingest_stream(spark, land, cols, _products(spark), out, files_per_trigger=1).awaitTermination()
    assert sorted(tuple(r) for r in stream_daily(spark, out).collect()) == first
    a = [r for r in first if r[0] == 1][0]
    assert a[2] == 5 and a[4] == 2           # quantity 2 + 3 over two batches, two lines
    assert quality_report(spark, out).filter("fatal").count() == 0


def test_stream_reads_each_file_in_its_own_encoding(spark, scratch):
    land = os.path.join(scratch, "land")
    _land(land, "utf.csv", ["1,U,th\u00e9 \ufffd,2,2024-01-01,1.50,c,UK\n"])
    write(os.path.join(land, "latin 1.csv"), (HEADER + "2,L,caf\xe9,3,2024-01-01,2.00,c,UK\n3,A,x,1,2024-01-01,2.00,c,UK\n").encode("latin-1"))
    out, batch = os.path.join(scratch, "out"), os.path.join(scratch, "batch")
    start_ingest_stream(spark, land, None, _products(spark), out).awaitTermination()
    names = lambda p: {r["stock_code"]: r["description"] for r in spark.read.parquet(p).collect()}
    got = names(os.path.join(out, "products"))
    assert got["L"].lower() == "caf\xe9" and "\ufffd" in got["U"]
    assert got == names(ingest_upload(spark, land, 1, _products(spark), batch).products_path)
    assert sum(r["total_quantity"] for r in stream_daily(spark, out).collect()) == 6
