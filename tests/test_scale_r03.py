"""What keeps the large loads and forecasts bounded: nothing is dealt out by file, landed files stay
below the gate's limit, and a product's days are made where they are used."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tillcast.functions.dates import parse_mixed_timestamp
from tillcast.operators import catalogue, features, training
from tillcast.plans import catalog
from tillcast.sources.erp_sheet import erp_rows, sheet_fallback
from tillcast.sources.landing import map_rows, stage_cells
from tillcast.streaming import ingest_stream

SF = "/root/testdata/sf0.001"
LOG = ["InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "Price", "Customer ID", "Country"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _daily(spark, products=40, days=100):
    return spark.range(products).crossJoin(spark.range(0, days, 2).toDF("d")).select(
        F.col("id").alias("product_id"), F.date_add(F.lit("2001-01-01").cast("date"), F.col("d").cast("int")).alias("sale_date"),
        (F.col("d") % 5 + 1).alias("total_quantity"), F.lit(1.0).cast("decimal(18,2)").alias("total_revenue"))


def _sheet(spark):
    names = spark.createDataFrame([("s.csv", 0, *LOG)], "file string, row_idx long, " + ", ".join(f"c{i} string" for i in range(8)))
    return names.unionByName(spark.range(1, 500).select(
        F.lit("s.csv").alias("file"), F.col("id").alias("row_idx"),
        *[F.lit(v).alias(f"c{i}") for i, v in enumerate(("1", "A", "a", "2", "2001-01-01", "3", "c", "X"))]))


def test_sheet_rows_are_not_dealt_by_file(spark):
    rows = sheet_fallback(_sheet(spark))
    assert rows.count() == 499
    assert "hashpartitioning" not in _plan(rows)


def test_erp_rows_are_not_dealt_by_file(spark):
    names = ["Bill No", "Item", "Item Name", "Qty", "Bill Date", "Taxable Amt", "Customer Name"]
    header = spark.createDataFrame([("e.xlsx", 1, *names)], "file string, row_idx long, " + ", ".join(f"c{i} string" for i in range(7)))
    bills = spark.range(2, 300).select(F.lit("e.xlsx").alias("file"), F.col("id").alias("row_idx"), *[
        F.lit(v).alias(f"c{i}") for i, v in enumerate(("1", "A", "a", "2", "2001-01-01", "3", "c"))])
    rows, _ = erp_rows(header.unionByName(bills))
    assert rows.count() == 298
    assert "hashpartitioning" not in _plan(rows)


def test_first_row_without_a_number_is_the_header(spark):
    cells = spark.createDataFrame([(LOG, None), (["1", "A", "a", "2", "2001-01-01", "3", "c", "X"], 1)], "cells array<string>, id long")
    cells = cells.select(F.lit("f").alias("_file"), F.struct(F.lit(0).cast("long").alias("block"), "id").alias("_row"), "cells")
    assert [r["StockCode"] for r in map_rows(cells, width=None).rows.collect()] == ["A"]


def test_wide_files_are_read_once(spark, scratch):
    os.makedirs(f"{scratch}/in")
    with open(f"{scratch}/in/w.csv", "w") as f:
        f.write(",".join([f"extra {i}" for i in range(92)] + LOG) + "\n" + ",".join(["0"] * 92 + list("12345678")) + "\n")
    from tillcast.sources.files import file_gate
    from tillcast.sources.landing import same_path
    wanted = file_gate(spark, f"{scratch}/in").select(same_path(F.col("path")).alias("_path"), "encoding", "columns")
    assert [r["columns"] for r in wanted.collect()] == [100]
    cells = stage_cells(spark, f"{scratch}/in", wanted, f"{scratch}/cells")
    assert len(os.listdir(f"{scratch}/cells")) == 1
    assert map_rows(cells, width=None).rows.first()["Country"] == "8"


def test_compacted_stream_lands_more_files_not_larger_ones(spark, monkeypatch):
    if not os.path.isdir(SF):
        pytest.skip("driver tables not available")
    seen = []
    start = ingest_stream.start_ingest_stream
    monkeypatch.setattr(ingest_stream, "start_ingest_stream", lambda s, landing, *a, **k: (seen.append(landing), start(s, landing, *a, **k))[1])
    monkeypatch.setattr(catalog, "FILE_ROWS", 400, raising=False)
    assert catalog.q_stream_compacted(spark, SF).count() > 0
    folder = seen[0].removeprefix("file:")
    assert sum(f.endswith(".csv") for f in os.listdir(folder)) > 6


def test_stream_never_broadcasts_the_catalogue(spark, scratch, monkeypatch):
    os.makedirs(f"{scratch}/in")
    with open(f"{scratch}/in/a.csv", "w") as f:
        f.write(",".join(LOG) + "\n1,A,a,2,2001-01-01,3,c,X\n")
    plans, build = [], catalogue.build_facts
    monkeypatch.setattr(catalogue, "build_facts", lambda *a: (plans.append(_plan(build(*a))), build(*a))[1])
    base = spark.createDataFrame([], catalog.RetailData(spark, SF).products.schema)
    ingest_stream.start_ingest_stream(spark, f"{scratch}/in", None, base, f"{scratch}/out").awaitTermination()
    assert plans and all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in plans)


def test_series_are_made_by_as_many_tasks_as_the_session_has_partitions(spark):
    frame = features.model_frame(_daily(spark))
    assert frame.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert frame.count() == 40 * (99 - 28)


def test_training_stores_no_row_per_day(spark, scratch, monkeypatch):
    sizes, keep = {}, training._stored

    def stored(df, name):
        out = keep(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(training, "_stored", stored)
    daily = _daily(spark, days=300)
    run = training.run_training(daily, f"{scratch}/store", 1, None, "seasonal_naive", horizon=7, at=dt.datetime(2001, 11, 5))
    assert run.status == "completed"
    assert max(sizes.values()) <= daily.count()


def test_shuffles_get_partitions_with_the_facts(spark, monkeypatch):
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    monkeypatch.setattr(catalog, "TASK_ROWS", 500, raising=False)
    try:
        n = catalog._data(spark, SF).table("lineitem").count()
        assert int(spark.conf.get(key)) >= n // 500 > int(before)
    finally:
        spark.conf.set(key, before)


def test_superstore_rows_are_parsed_once(spark):
    plan = _plan(catalog.q_clean_superstore(spark, SF))
    assert "Join" not in plan and "try_make_timestamp" not in plan


def test_dates_day_first_then_month_first(spark):
    texts = ["12/1/2010", "12/25/2010", "31/4/2010", "29-2-2000 8:05", "1/13/2001 23:59:58", "13/13/2001", "0/5/2001", "5/0/2001", "2001-02-03"]
    got = [r[0] and r[0].strftime("%Y-%m-%d %H:%M:%S") for r in
           spark.createDataFrame([(t,) for t in texts], "t string").select(parse_mixed_timestamp(F.col("t"))).collect()]
    assert got == ["2010-01-12 00:00:00", "2010-12-25 00:00:00", None, "2000-02-29 08:05:00", "2001-01-13 23:59:58", None, None, None,
                   "2001-02-03 00:00:00"]
