"""CLEAN-1..13 on the reference's own cases plus date, scrub and price edges."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tillcast.functions.dates import parse_mixed_timestamp
from tillcast.functions.text import scrub_formula, strip_ws
from tillcast.operators.cleaning import clean_log

COLS = ["InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "Price", "CustomerID", "Country"]


def frame(spark, rows, cols=COLS):
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in cols))


def test_valid_rows(spark):
    df = frame(spark, [("536365", "85123A", "WHITE HANGING HEART T-LIGHT HOLDER", "6", "12/1/2010 8:26", "2.55", "17850", "United Kingdom"),
                       ("536365", "71053", "WHITE METAL LANTERN", "6", "12/1/2010 8:26", "3.39", "17850", "United Kingdom")])
    res = clean_log(df)
    assert res.report.count() == 0
    out = res.accepted.collect()
    assert len(out) == 2
    assert "InvoiceDate" in res.accepted.columns and "revenue" in res.accepted.columns
    assert out[0]["InvoiceDate"] == dt.datetime(2010, 1, 12, 8, 26)
    assert {r["StockCode"] for r in out} == {"85123A", "71053"}


def test_missing_columns_is_fatal(spark):
    res = clean_log(frame(spark, [("536365", "85123A")], ["InvoiceNo", "StockCode"]))
    assert res.accepted.count() == 0
    rep = res.report.collect()
    assert len(rep) == 1 and rep[0]["fatal"] is True
    assert "Missing required columns" in rep[0]["message"]


def test_extreme_quantity(spark):
    rows = [(f"53636{i}", c, "x", q, "12/1/2010 8:26", p, "17850", "UK")
            for i, (c, q, p) in enumerate([("85123A", "-6", "2.55"), ("71053", "10", "3.39"), ("12345", "100001", "1.0")])]
    res = clean_log(frame(spark, rows))
    assert res.accepted.count() == 2
    rep = res.report.collect()
    assert len(rep) == 1 and rep[0]["fatal"] is False and rep[0]["affected_rows"] == 1
    assert res.accepted.filter(F.col("is_return")).count() == 1


def test_alternate_schema_defaults_quantity(spark):
    cols = ["Order ID", "Product ID", "Product Name", "Order Date", "Sales", "Customer ID", "Country"]
    df = frame(spark, [("CA-2017-152156", "FUR-BO-10001798", "Bush Somerset Collection Bookcase", "08/11/2017",
                        "261.96", "CG-12520", "United States")], cols)
    res = clean_log(df)
    assert res.report.count() == 0
    r = res.accepted.collect()
    assert len(r) == 1
    assert r[0]["Quantity"] == 1 and r[0]["InvoiceNo"] == "CA-2017-152156"
    assert r[0]["StockCode"] == "FUR-BO-10001798" and r[0]["Price"] == 261.96
    assert r[0]["InvoiceDate"] == dt.datetime(2017, 11, 8)


def test_null_code_dropped(spark):
    df = frame(spark, [("536365", "85123A", "A", "6", "12/1/2010 8:26", "2.55", "17850", "UK"),
                       ("536366", None, "B", "10", "12/1/2010 8:26", "3.39", "17850", "UK")])
    res = clean_log(df)
    out = res.accepted.collect()
    assert len(out) == 1 and out[0]["StockCode"] == "85123A"
    assert res.report.collect()[0]["type"] == "null_values"


def test_ambiguous_aliases_are_fatal(spark):
    df = frame(spark, [("1", "A", "d", "1", "2010-01-01", "1", "2", "3", "c")],
               ["InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "Price", "UnitPrice", "CustomerID", "Country"])
    res = clean_log(df)
    assert res.fatal and res.fatal[0]["type"] == "ambiguous_columns"


@pytest.mark.parametrize("raw,expected", [
    ("12/1/2010 8:26", dt.datetime(2010, 1, 12, 8, 26)),
    ("25/12/2010", dt.datetime(2010, 12, 25)),
    ("12/25/2010", dt.datetime(2010, 12, 25)),
    ("08/11/2017", dt.datetime(2017, 11, 8)),
    ("2010-12-25 10:11:12", dt.datetime(2010, 12, 25, 10, 11, 12)),
    ("2010-12-25", dt.datetime(2010, 12, 25)),
    ("junk", None),
])
def test_date_rules(spark, raw, expected):
    got = spark.createDataFrame([(raw,)], "s string").select(parse_mixed_timestamp(F.col("s")).alias("t")).first()["t"]
    assert got == expected


def test_unparseable_date_fails_the_file(spark):
    df = frame(spark, [("1", "A", "d", "1", "junk", "1", "2", "UK"), ("2", "B", "d", "1", "2010-01-01", "1", "2", "UK")])
    res = clean_log(df)
    assert res.accepted.count() == 0
    rep = {r["type"]: r for r in res.report.collect()}
    assert rep["date_parse_error"]["fatal"] is True


@pytest.mark.parametrize("raw,plain,strict", [
    ("=SUM(1)", "SUM(1)", "SUM(1)"),
    (" \t=x\n", "x", "x"),
    ("= =x", " =x", "x"),
    ("a=b", "a=b", "a=b"),
    ("@cmd", "cmd", "cmd"),
    ("  FRANCE  ", "FRANCE", "FRANCE"),
    (" x　", "x", "x"),
])
def test_scrub(spark, raw, plain, strict):
    r = spark.createDataFrame([(raw,)], "s string").select(
        scrub_formula(F.col("s")).alias("p"), scrub_formula(F.col("s"), strict=True).alias("q"),
        strip_ws(F.col("s")).alias("w")).first()
    assert r["p"] == plain and r["q"] == strict and r["w"] == raw.strip()


@pytest.mark.parametrize("price,kept", [("-0.01", False), ("0", True), ("100000", True), ("100000.01", False)])
def test_price_limits(spark, price, kept):
    res = clean_log(frame(spark, [("1", "A", "d", "1", "2010-01-01", price, "2", "UK")]))
    assert (res.accepted.count() == 1) == kept


def test_summary_invariant(spark):
    rows = [("1", "A", "d", "1", "2010-01-01", "1", "2", "UK"), (None,) * 8,
            ("2", None, "d", "1", "2010-01-01", "1", "2", "UK"), ("3", "B", "d", "1", "2010-01-01", "-5", "2", "UK")]
    s = clean_log(frame(spark, rows)).summary.first()
    assert s["row_count"] == 4 and s["valid_rows"] == 1 and s["invalid_rows"] == 2 and s["empty_rows"] == 1
    assert s["valid_rows"] + s["invalid_rows"] + s["empty_rows"] == s["row_count"]


def test_fractional_quantity_notice(spark):
    res = clean_log(frame(spark, [("1", "A", "d", "2.5", "2010-01-01", "2", "2", "UK"),
                                  ("2", "B", "d", "3", "2010-01-01", "2", "2", "UK")]))
    rep = res.report.collect()
    assert [(r["type"], r["affected_rows"], r["fatal"]) for r in rep] == [("fractional_quantity", 1, False)]
    assert res.summary.first()["invalid_rows"] == 0 and res.accepted.count() == 2
