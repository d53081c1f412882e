"""Loads of any width, headers that come again, staged cleaning with observed
counts, compacted streams and their live counts."""

import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from tillcast import schemas
from tillcast.operators import cleaning
from tillcast.plans.ingest import ingest_upload
from tillcast.sources import landing
from tillcast.sources.erp_sheet import fallback_sheets
from tillcast.streaming import ingest_stream as st

HEADER = "InvoiceNo,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country\n"


def write(path, text, encoding="utf-8"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(text.encode(encoding))


@pytest.fixture
def products(spark):
    return spark.createDataFrame([(1, "A", "a", None, None, 0, 7, 0, 1.0)], schemas.PRODUCTS)


def wide(n, needed_last=True, rows=2):
    extra, names = [f"x{i}" for i in range(n)], HEADER.strip().split(",")
    values = lambda k: [str(k), "A", "a", "2", "2024-01-01", "1.50", "c", "UK"]
    line = lambda a, b: ",".join(a + b if needed_last else b + a) + "\n"
    return line(extra, names) + "".join(line(["."] * n, values(k)) for k in range(rows))


def test_any_width_loads(spark, scratch, products):
    """70, 300 and 1,100 columns beside narrow files and one whose rows are longer than its header."""
    land = f"{scratch}/land"
    write(f"{land}/w70.csv", wide(70, needed_last=False))
    write(f"{land}/w300.csv", wide(300))
    write(f"{land}/w1100.csv", wide(1100))
    write(f"{land}/narrow.csv", HEADER + "9,A,a,2,2024-01-01,1.50,c,UK\n")
    write(f"{land}/long.csv", HEADER + "8,A,a,2,2024-01-01,1.50,c,UK" + ",." * 80 + "\n")
    write(f"{land}/latin.csv", wide(90).replace(",A,a,", ",A,caf\xe9,"), "latin-1")
    res = ingest_upload(spark, land, 1, products, f"{scratch}/out")
    assert res.status == "completed", res.error
    assert spark.read.parquet(res.facts_path).count() == 10
    outcomes = {os.path.basename(r["path"]): r["outcome"] for r in spark.read.parquet(res.files_path).collect()}
    assert set(outcomes.values()) == {"accepted"} and len(outcomes) == 6


def test_header_that_comes_again_is_a_row(spark, scratch, products):
    land = f"{scratch}/land"
    write(f"{land}/a.csv", HEADER + "1,A,a,2,2024-01-01,1.50,c,UK\n" + HEADER + "2,A,a,2,2024-01-01,1.50,c,UK\n")
    res = ingest_upload(spark, land, 1, products, f"{scratch}/out")
    assert res.status == "failed" and "not dates" in res.error
    row = spark.read.parquet(res.uploads_path).first()
    assert (row["row_count"], row["valid_rows"], row["invalid_rows"]) == (3, 2, 1)


def test_wide_files_of_a_stream(spark, scratch, products, monkeypatch):
    """Files beyond the stream's width, and not UTF-8, are read again; names come in small chunks."""
    monkeypatch.setattr(st, "NAMES", 2)
    land, out = f"{scratch}/land", f"{scratch}/out"
    for i in range(5):
        write(f"{land}/w{i}.csv", wide(70 + 100 * i))
    write(f"{land}/n.csv", HEADER + "9,A,caf\xe9,2,2024-01-01,1.50,c,UK\n", "latin-1")
    st.start_ingest_stream(spark, land, None, products, out).awaitTermination()
    assert st.merged_daily(spark, out).first()["total_quantity"] == 22


def log(spark, rows):
    names = [*cleaning.REQUIRED_COLUMNS, "_file"]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in names))


ROWS = [("1", "A", "a", "2", "2024-01-01", "1.5", "c", "UK", "f"), ("2", None, "a", "2", "2024-01-01", "1.5", "c", "UK", "f"),
        ("3", "A", "a", "2", "2024-01-01", "-1", "c", "UK", "f"), ("4", "A", "a", "200000", "2024-01-01", "1", "c", "UK", "f"),
        ("5", "A", "a", "2.5", "2024-01-01", "1", "c", "UK", "f"), (None,) * 8 + ("f",), ("6", "A", "a", "2", "junk", "1", "c", "UK", "g"),
        ("7", "A", "a", "1", "2024-01-02", "1", "c", "UK", "g")]


@pytest.mark.parametrize("rows", [ROWS, ROWS[:6], []])
@pytest.mark.parametrize("file_col", ["_file", None])
def test_staged_cleaning_equals_plain(spark, scratch, rows, file_col):
    raw = log(spark, rows)
    a, b = cleaning.clean_log(raw, file_col=file_col), cleaning.clean_staged(raw, f"{scratch}/stage", file_col=file_col)
    every = lambda df: sorted([tuple(r) for r in df.drop("_seq").collect()], key=str)
    assert every(a.accepted) == every(b.accepted)
    assert every(a.report) == every(b.report.select(*a.report.columns)) and every(a.summary) == every(b.summary)
    assert every(a.rows) == every(b.rows)


def test_staged_cleaning_scans_once(spark, scratch):
    """Every raw row is evaluated once, and report, summary and fatal check read nothing of the stage."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(x):
        read.add(1)
        return x

    raw = log(spark, ROWS).withColumn("Country", seen("Country"))
    res = cleaning.clean_staged(raw, f"{scratch}/stage", file_col="_file")
    assert read.value == len(ROWS)
    shutil.move(f"{scratch}/stage", f"{scratch}/elsewhere")
    assert {r["type"]: r["affected_rows"] for r in res.report.collect()} == {
        "null_values": 2, "invalid_price": 1, "extreme_quantity": 1, "date_parse_error": 1, "fractional_quantity": 1}
    assert res.summary.first().asDict() == {"row_count": 8, "valid_rows": 3, "invalid_rows": 4, "empty_rows": 1}
    shutil.move(f"{scratch}/elsewhere", f"{scratch}/stage")
    assert sorted(r["InvoiceNo"] for r in res.accepted.collect()) == ["1", "5"] and read.value == len(ROWS)


def test_filters_stay_above_the_parse(spark):
    """The date parse is written once in the optimised plan, whatever is filtered."""
    rows, _ = cleaning.checked_rows(log(spark, ROWS))
    plan = rows.filter("reject_reason IS NULL AND NOT _bad_date").select("InvoiceNo")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("make_timestamp") <= 2 and plan.count("try_cast") <= 16


def test_refused_sheets_are_returned(spark):
    sheet = spark.createDataFrame([("a", 0, "x", "y"), ("a", 1, "1", "2"), ("b", 0, None, None)], "file string, row_idx long, c0 string, c1 string")
    m = fallback_sheets(sheet)
    assert m.rows.count() == 0 and {r["_file"] for r in m.refused.collect()} == {"a", "b"}


def stream_of(spark, scratch, products, n=4, live=None):
    land, out = f"{scratch}/land", f"{scratch}/out"
    for i in range(n):
        write(f"{land}/{i}.csv", HEADER + f"{i},A,a,{i + 1},2024-01-01,{i + 1}.00,c,UK\n{i}x,A,a,1,2024-01-0{i + 2},-1,c,UK\n{i}y,,a,1,2024-01-01,1,c,UK\n")
        os.utime(f"{land}/{i}.csv", (1_700_000_000 + i, 1_700_000_000 + i))       # the order of the batches
    st.start_ingest_stream(spark, land, None, products, out, files_per_trigger=1, live=live).awaitTermination()
    return out


def daily(spark, out):
    return sorted(map(tuple, st.merged_daily(spark, out).collect()))


def test_compaction_keeps_the_table(spark, scratch, products):
    """Days that cross batches, folded step by step; a replay and a failed fold change nothing."""
    out = stream_of(spark, scratch, products)
    want = daily(spark, out)
    assert want[0][2] == 1 + 2 + 3 + 4 and str(want[0][5]) == "4.00"
    assert st.compact_daily(spark, out, 0) == 0 and daily(spark, out) == want
    assert st.compact_daily(spark, out) == 2 and daily(spark, out) == want
    assert st.compact_daily(spark, out, 1) == 2                       # never backwards
    # Batch 1 is replayed after it was folded.
    shutil.copytree(f"{out}/_cells/batch_id=1", f"{scratch}/cells")
    cells = spark.read.parquet(f"{scratch}/cells")
    again = cells.withColumn("_row", F.col("_row.block"))
    st.process_batch(again, 1, products, out)
    assert daily(spark, out) == want
    # A fold that fails before it comes into force: the earlier one holds, the next call repairs.
    real = st._folds
    version = real(spark, out)[0]
    os.makedirs(f"{out}/daily_folded/v{version + 1}")
    write(f"{out}/daily_folded/v{version + 1}/part-x.parquet", "half a file")
    assert daily(spark, out) == want
    assert st.compact_daily(spark, out, 3) == 3 and daily(spark, out) == want
    # Folded partitions are not read any more.
    shutil.rmtree(f"{out}/daily_parts/batch_id=0")
    assert daily(spark, out) == want


def test_live_counts_equal_the_report(spark, scratch, products):
    live = st.LiveQuality()
    try:
        out = stream_of(spark, scratch, products, live=live)
        report = {(r["batch_id"], r["type"]): r["affected_rows"] for r in st.quality_report(spark, out).collect()}
        until = time.time() + 30                       # progress events follow the batches
        while time.time() < until and not all("landed_rows" in b for b in list(live.batches.values())):
            time.sleep(0.2)
        assert len(live.batches) == 4
        for b, seen in live.batches.items():
            assert seen["landed_rows"] == 4 and seen["row_count"] == 3       # the header is no row
            assert {k: v for (i, k), v in report.items() if i == b} == {k: seen[k] for k in ("invalid_price", "null_values")}
    finally:
        spark.streams.removeListener(live)


def test_width_of_the_first_read():
    assert len(landing.cell_schema()) == landing.MAX_COLUMNS + 1 and len(landing.cell_schema(300)) == 301
