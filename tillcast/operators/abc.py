"""ABC-1..3 and DIM-4: Pareto classification of products by revenue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.functions.numeric import py_round
from tillcast.operators.analytics import product_revenue
from tillcast.operators.ordered import global_prefix

# Class limits on the cumulative revenue share (percent).
A_LIMIT = 80
B_LIMIT = 95


def abc_analysis(tx: DataFrame, products: DataFrame, buckets: int | None = None) -> DataFrame:
    """ABC-1: revenue per product (sale lines, all uploads), ordered by
    revenue desc (ties: product_id), cumulative share; A ≤ 80 %, B ≤ 95 %,
    else C (the product crossing 80 % is B).

    The running sum is a two-pass global prefix (see ``ordered``): no single
    partition ever holds all products.  Sums stay exact decimals until the
    final division.
    """
    rev = product_revenue(tx, products).select("product_id", "total_revenue")
    ranked = global_prefix(rev, [F.col("total_revenue").desc(), F.col("product_id").asc()],
                           sum_cols=["total_revenue"], total_col="_n", buckets=buckets)
    total = F.col("total_total_revenue").cast("double")
    share = F.col("total_revenue").cast("double")
    cum_pct = F.when(total != 0, F.col("cum_total_revenue").cast("double") / total * 100).otherwise(0.0)
    dims = products.select("product_id", "stock_code", "description")
    return ranked.join(dims, "product_id").select(
        "product_id", "stock_code", "description",
        F.when(cum_pct <= A_LIMIT, "A").when(cum_pct <= B_LIMIT, "B").otherwise("C").alias("abc_class"),
        share.alias("total_revenue"),
        F.when(total != 0, py_round(share / total * 100, 4)).otherwise(0.0).alias("revenue_pct"),
        py_round(cum_pct, 2).alias("cumulative_pct"),
        F.col("_pos").alias("revenue_rank"),
    )


def abc_summary(abc: DataFrame) -> DataFrame:
    """ABC-2: per class the product count and Σrevenue_pct (1 dp); classes
    without products show 0 (outer join from the three-row class list)."""
    spark = abc.sparkSession
    classes = spark.createDataFrame([("A",), ("B",), ("C",)], "abc_class string")
    per = abc.groupBy("abc_class").agg(F.count(F.lit(1)).alias("product_count"),
                                       F.sum("revenue_pct").alias("_pct"))
    return classes.join(per, "abc_class", "left").select(
        "abc_class",
        F.coalesce(F.col("product_count"), F.lit(0)).cast("long").alias("product_count"),
        F.coalesce(py_round(F.col("_pct"), 1), F.lit(0.0)).alias("revenue_pct"))


def write_back_classes(products: DataFrame, abc: DataFrame) -> DataFrame:
    """DIM-4: products with abc_class replaced by the new classification
    (unchanged where the product got no class)."""
    new = abc.select("product_id", F.col("abc_class").alias("_new_class"))
    return (products.join(new, "product_id", "left")
            .withColumn("abc_class", F.coalesce(F.col("_new_class"), F.col("abc_class")))
            .drop("_new_class"))


def abc_distribution(products: DataFrame) -> DataFrame:
    """ABC-3: product count per non-null class on the dimension."""
    return (products.filter(F.col("abc_class").isNotNull())
            .groupBy("abc_class").agg(F.count(F.lit(1)).alias("product_count")))
