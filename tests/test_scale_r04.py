"""What the findings of round 3 left to scale: the booster's tasks, tables of a row per file, the tasks of joins."""

import os

import pytest
from pyspark import StorageLevel
from pyspark.sql import functions as F

from tillcast import session
from tillcast.operators import forecasting
from tillcast.plans import catalog
from tillcast.sources.erp_sheet import sheet_fallback, sheet_outcomes
from tillcast.sources.files import file_gate
from tillcast.sources.landing import same_path, stage_cells

SF = "/root/testdata/sf0.001"
LOG = ["InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "Price", "Customer ID", "Country"]


def test_booster_reads_all_rows_in_a_task_a_core(spark, monkeypatch):
    """With a task for every shuffle partition, starting tasks took most of the booster's time."""
    seen = {}

    class Booster:
        def __init__(self, **params):
            pass

        def fit(self, rows):
            seen["tasks"], seen["rows"] = rows.rdd.getNumPartitions(), rows.count()

    monkeypatch.setattr(forecasting, "GBTRegressor", Booster)
    rows = spark.range(0, 6400, 1, 64).select(F.array(F.col("id").cast("double")).alias("features"), F.lit(1.0).alias("y"))
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    cores = spark.sparkContext.defaultParallelism
    forecasting.fit_pooled(rows, {})
    assert seen == {"tasks": min(cores, 64), "rows": 6400}
    monkeypatch.setattr(forecasting, "FIT_ROWS", 200)
    forecasting.fit_pooled(rows, {})
    rows.unpersist()
    assert seen == {"tasks": max(32, min(cores, 64)), "rows": 6400}


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, -1)
    yield
    spark.conf.set(key, before)


def _sheet(spark, n=300):
    names = spark.createDataFrame([("s.csv", 0, *LOG)], "file string, row_idx long, " + ", ".join(f"c{i} string" for i in range(8)))
    return names.unionByName(spark.range(1, n).select(
        F.lit("s.csv").alias("file"), F.col("id").alias("row_idx"),
        *[F.lit(v).alias(f"c{i}") for i, v in enumerate(("1", "A", "a", "2", "2001-01-01", "3", "c", "X"))]))


def test_rows_are_not_dealt_by_file_without_planned_broadcasts(spark, no_broadcast):
    """The session may allow the planner no broadcast: all rows of a sheet went to one task then."""
    rows = sheet_fallback(_sheet(spark))
    assert rows.count() == 299
    assert "SortMergeJoin" not in rows._jdf.queryExecution().executedPlan().toString()
    out = sheet_outcomes(_sheet(spark)).collect()
    assert [(r["outcome"], r["data_rows"]) for r in out] == [("fallback", 299)]


def test_many_files_are_left_to_the_planner(spark, monkeypatch):
    monkeypatch.setattr(session, "FEW_ROWS", 3)
    hinted = lambda n: "ResolvedHint" in session.few(spark.range(n))._jdf.queryExecution().analyzed().toString()
    assert hinted(3) and not hinted(4)


def test_files_are_read_as_wide_as_their_first_line(spark, scratch):
    """64 columns were read and stored for a file of two; a header longer than its first line looks is read again."""
    os.makedirs(f"{scratch}/in")
    for name, text in (("a.csv", "x,y\n1,2\n3,4,5\n"), ("b.csv", '"p\nq",' + ",".join(f"k{i}" for i in range(9)) + "\n1,2\n")):
        with open(f"{scratch}/in/{name}", "w") as f:
            f.write(text)
    gate = file_gate(spark, f"{scratch}/in")
    wanted = gate.select(same_path(F.col("path")).alias("_path"), "encoding", "columns")
    assert sorted(r["columns"] for r in wanted.collect()) == [1, 2]
    cells = stage_cells(spark, f"{scratch}/in", wanted, f"{scratch}/cells").select(
        F.substring_index("_file", "/", -1).alias("f"), F.size("cells").alias("n"), F.array_compact("cells").alias("c")).collect()
    assert {r["n"] for r in cells if r["f"] == "a.csv"} == {3}
    assert sorted(tuple(r["c"]) for r in cells if r["f"] == "a.csv") == [("1", "2"), ("3", "4", "5"), ("x", "y")]
    assert {len(r["c"]) for r in cells if r["f"] == "b.csv"} == {2, 10}


def test_oversized_and_foreign_files_keep_their_verdict(spark, scratch):
    for name, size in (("big.csv", 3 << 20), ("small.csv", 10), ("no.txt", 10), ("fake.xlsx", 10)):
        with open(f"{scratch}/{name}", "w") as f:
            f.write("a,b\n" + "x" * size)
    got = {r["filename"]: (r["reason"] and r["reason"][:6], r["columns"], r["encoding"]) for r in file_gate(spark, scratch, max_mb=1).collect()}
    assert got == {"big.csv": ("Larger", None, "ISO-8859-1"), "small.csv": (None, 2, "UTF-8"),
                   "no.txt": ("Extens", None, None), "fake.xlsx": ("Conten", None, None)}


def test_joined_facts_are_not_put_together_into_large_tasks(spark):
    """Adaptive execution coalesced the partitions made for 500,000 facts each up to 64 MB compressed."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    try:
        for given, want in (("64MB", str(16 << 20)), ("67108864b", str(16 << 20)), ("8m", "8m")):
            spark.conf.set(key, given)
            catalog._data(spark, SF)
            assert spark.conf.get(key) == want
    finally:
        spark.conf.set(key, before)
    assert [session.byte_count(x) for x in ("7", "2k", "3 MiB", "1g")] == [7, 2048, 3 << 20, 1 << 30]
