"""Stored KPI cube: equal to the direct KPIs, mergeable by upload, read without the facts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tillcast import schemas
from tillcast.operators import analytics, cube


def facts(spark, n=600, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        q = r.choice([1, 2, 5, -3, 0])
        at = dt.datetime(2024, 1, 1) + dt.timedelta(days=r.randint(0, 40), minutes=r.choice([0, 0, 1, 600, 1439]))
        rows.append((f"i{r.randint(0, 150)}" if r.random() < 0.7 else "hot", r.randint(1, 9), q, float(r.randint(1, 900)) / 100,
                     at, r.choice(["UK", "FR", None]), q < 0, r.choice([1, 2, 3])))
    df = spark.createDataFrame(rows, "invoice_no string, product_id long, quantity int, p double, invoice_date timestamp, country string, is_return boolean, upload_id long")
    return df.withColumn("unit_price", F.col("p").cast(schemas.MONEY)).withColumn("revenue", (F.col("unit_price") * F.col("quantity")).cast(schemas.LINE_MONEY))


@pytest.fixture(scope="module")
def tx(spark):
    return facts(spark)


@pytest.fixture(scope="module")
def built(spark, tx, tmp_path_factory):
    return cube.build_cube(tx, str(tmp_path_factory.mktemp("cube")))


@pytest.mark.parametrize("span", [(None, None), ("2024-01-10", "2024-01-20"), ("2024-01-10", None), (None, "2024-01-20"), ("2030-01-01", "2030-01-05")])
@pytest.mark.parametrize("scope", ["reference", "consistent"])
def test_kpis_equal_direct(spark, tx, built, span, scope):
    products = spark.range(7).select(F.col("id").alias("product_id"))
    want = analytics.kpis(tx, products, *span, scope=scope).first()
    assert cube.kpis(built, products, *span, scope=scope).first().asDict() == want.asDict()


def test_facts_are_read_once(spark, tx, scratch):
    """A fact row is evaluated once by the build, never by the queries."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def seen(q):
        read.add(1)
        return q

    counted = tx.withColumn("quantity", seen("quantity"))
    c = cube.build_cube(counted, scratch)
    assert read.value == 600
    products = spark.range(7).select(F.col("id").alias("product_id"))
    cube.kpis(c, products).collect(), cube.top_country(c).collect(), cube.unique_invoices(c).collect()
    assert read.value == 600


def test_uploads_build_apart_and_again(spark, tx, built, scratch):
    """One upload at a time, one of them twice: the same cube; other partitions keep their files."""
    import glob
    for u in (1, 2, 3):
        cube.build_cube(tx, scratch, [u])
    before = {f for u in (1, 3) for f in glob.glob(f"{scratch}/*/upload_id={u}/*.parquet")}
    c = cube.build_cube(tx, scratch, [2])
    assert before == {f for u in (1, 3) for f in glob.glob(f"{scratch}/*/upload_id={u}/*.parquet")}
    cols = ["level", *cube.KEYS, *cube.SUMS, "first_at", "last_at"]
    rows = lambda df: sorted(map(tuple, df.select(*cols).collect()), key=str)
    assert rows(c.cube) == rows(built.cube)


def test_sketches_estimate_any_range(spark, scratch):
    """Within three standard errors (1.6 % each) of the exact count, for single days and their unions."""
    days = spark.range(60_000).select(F.concat(F.lit("i"), (F.col("id") % 23_456).cast("string")).alias("invoice_no"), F.lit(1).alias("product_id"), F.lit(1).alias("quantity"),
                                      F.lit(1).cast(schemas.MONEY).alias("unit_price"), F.lit(1).cast(schemas.LINE_MONEY).alias("revenue"),
                                      F.expr("timestamp '2024-01-01' + make_dt_interval(int(id % 30))").alias("invoice_date"), F.lit("UK").alias("country"),
                                      F.lit(False).alias("is_return"), (F.col("id") % 3).alias("upload_id"))
    c = cube.build_cube(days, scratch)
    for span in ((None, None), ("2024-01-03", "2024-01-03"), ("2024-01-05", "2024-01-11")):
        r = cube.unique_invoices(c, *span).first()
        assert r["exact"] > 1000 and abs(r["estimate"] - r["exact"]) <= 0.048 * r["exact"]
    products = spark.range(1).select(F.col("id").alias("product_id"))
    k = cube.kpis(c, products, approx_distinct=True).first()
    assert abs(k["unique_invoices"] - 23_456) <= 0.048 * 23_456


def test_empty(spark, tx, scratch):
    c = cube.build_cube(tx.limit(0), scratch)
    products = spark.range(1).select(F.col("id").alias("product_id"))
    assert cube.kpis(c, products).first().asDict() == analytics.kpis(tx.limit(0), products).first().asDict()
