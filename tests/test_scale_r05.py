"""What the findings of round 4 left to scale: micro-batches, the disk and the passes of loads and training runs."""

from pyspark.sql import functions as F

from tillcast.operators import catalogue
from tillcast.plans import catalog
from tillcast.sources.tpch import RetailData, raw_log_from_facts

SF = "/root/testdata/sf0.001"


def test_files_of_the_stream_follow_the_facts(spark):
    """A file for every shuffle partition and source file made a micro-batch of a few thousand rows at 1 GB."""
    d = RetailData(spark, SF)
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    raw = raw_log_from_facts(d.tx, dealt=False)
    rows = {r["_file"]: r["count"] for r in raw.groupBy("_file").count().collect()}
    try:
        for partitions in ("8", "40"):
            spark.conf.set(key, partitions)
            whole, cut = catalog._landing(spark, d, 1_000_000), catalog._landing(spark, d, max(rows.values()) // 3 + 1)
            files = lambda base: spark.read.format("binaryFile").load(base).select("path").collect()
            assert len(files(whole)) == len(rows)
            assert 2 * len(rows) < len(files(cut)) <= 3 * len(rows)
            for base in (whole, cut):
                landed = spark.read.option("header", True).csv(base)
                assert {r["file"]: r["count"] for r in landed.groupBy("file").count().collect()} == rows
                # A product's rows of a source file lie in one landed file.
                code = F.ltrim(F.col("StockCode"), F.lit("="))
                lies = landed.select("file", code.alias("code"), F.input_file_name().alias("at")).filter("code IS NOT NULL")
                apart = lies.groupBy("file", "code").agg(F.count_distinct("at").alias("n")).filter("n > 1")
                assert apart.isEmpty()
    finally:
        spark.conf.set(key, before)


def test_a_batch_without_new_products_orders_nothing(spark, scratch, monkeypatch):
    from tillcast.streaming.ingest_stream import merged_daily, start_ingest_stream
    d = RetailData(spark, SF)
    landing = catalog._landing(spark, d, 1_000_000)
    calls, real = [], catalogue.assign_ids
    monkeypatch.setattr(catalogue, "assign_ids", lambda *a, **k: calls.append(1) or real(*a, **k))
    run = lambda products, out: start_ingest_stream(spark, landing + "/file=*", None, products, out, files_per_trigger=16).awaitTermination()
    run(d.products, scratch + "/known")
    assert not calls
    run(d.products.filter("product_id % 2 = 0"), scratch + "/new")
    assert calls
    total = lambda out: merged_daily(spark, out).agg(F.sum("total_quantity"), F.sum("transaction_count")).first()
    assert total(scratch + "/known") == total(scratch + "/new")


def test_tables_of_a_load_are_stored_small(spark, scratch):
    """Cells, staging and facts were written with the default codec; at 6 GB the loads ran out of disk."""
    from tillcast.plans.ingest import ingest_upload
    from tillcast.session import stored
    d = RetailData(spark, SF)
    res = ingest_upload(spark, catalog._landing(spark, d, 1_000_000), 1, d.products, scratch)
    assert res.status == "completed"
    for table in ("cells", "staging", "facts", "daily_parts"):
        names = [r["path"] for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{scratch}/{table}").select("path").collect()]
        assert names and all(".zstd." in x for x in names), names
    assert all(".zstd." in x for x in stored(spark.range(3), "three").inputFiles())
