"""SLOW-1/2 (IQR slow movers) and ANOM-1 (z-score sales anomalies)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillcast.functions.numeric import py_round
from tillcast.operators.ordered import exact_quantiles


def as_of_date(daily: DataFrame, as_of: _dt.date | str | None = None) -> Column:
    """'Today' for the whole computation: given, or the last sale date in the
    data (scalar subquery, evaluated once)."""
    if as_of is not None:
        return F.lit(str(as_of)).cast("date")
    return daily.agg(F.max("sale_date")).scalar()


def velocity(daily: DataFrame, lookback_days: int, as_of: Column) -> DataFrame:
    """Per product over the last ``lookback_days`` days: mean daily quantity
    (over days with a row), total, number of days, last sale date."""
    recent = daily.filter(F.col("sale_date") >= F.date_sub(as_of, lookback_days))
    return recent.groupBy("product_id").agg(
        F.avg(F.col("total_quantity").cast("double")).alias("avg_daily_sales"),
        F.sum("total_quantity").cast("long").alias("total_sales"),
        F.count(F.lit(1)).alias("active_days"),
        F.max("sale_date").alias("last_sale_date"),
    )


def iqr_lower_bound(per: DataFrame, col: str = "avg_daily_sales", approx: bool = False,
                    accuracy: int = 100_000) -> Column:
    """Scalar Q1 − 1.5·IQR of ``col`` across products.

    Exact by default (numpy/``quantile_cont`` interpolation, computed
    distributed; see ``ordered.exact_quantiles``).  ``approx=True`` uses
    ``percentile_approx`` (one mergeable sketch per partition, relative rank
    error 1/accuracy) for catalogues where an exact rank pass is not wanted.
    """
    if approx:
        q = per.agg(F.percentile_approx(col, [0.25, 0.75], accuracy).alias("q"))
        q1, q3 = F.col("q")[0], F.col("q")[1]
        return q.select(q1 - F.lit(1.5) * (q3 - q1)).scalar()
    q = exact_quantiles(per, col, [0.25, 0.75], tie_break="product_id")
    return q.select(F.col("q_0") - F.lit(1.5) * (F.col("q_1") - F.col("q_0"))).scalar()


def slow_movers(daily: DataFrame, products: DataFrame | None = None, lookback_days: int = 30,
                as_of: _dt.date | str | None = None, approx_quartiles: bool = False) -> DataFrame:
    """SLOW-1 / SLOW-2 (one implementation, column superset).

    Flags products whose mean daily quantity over the lookback is at or below
    Q1 − 1.5·IQR across products.  severity: high when 0, medium below half
    the bound, else low.  Sorted by velocity.
    """
    today = as_of_date(daily, as_of)
    per = velocity(daily, lookback_days, today)
    if products is not None:
        per = per.join(products.select("product_id", "stock_code", "description"), "product_id")
    bound = iqr_lower_bound(per, approx=approx_quartiles)
    v = F.col("avg_daily_sales")
    extra = ["stock_code", "description"] if products is not None else []
    return (per.filter(v <= bound)
            .select("product_id", *extra,
                    py_round(v, 4).alias("avg_daily_sales"),
                    "total_sales", "active_days", "last_sale_date",
                    F.datediff(today, F.col("last_sale_date")).cast("long").alias("days_since_last_sale"),
                    py_round(bound, 4).alias("threshold"),
                    F.when(v == 0, "high").when(v < bound / 2, "medium").otherwise("low").alias("severity"),
                    F.lit(lookback_days).alias("lookback_days"))
            .orderBy("avg_daily_sales", "product_id"))


def sales_anomalies(daily: DataFrame, z_threshold: float = 3.0, min_days: int = 10) -> DataFrame:
    """ANOM-1: days whose quantity is more than ``z_threshold`` population
    standard deviations from the product's mean (products with ≥ min_days
    rows and σ > 0).

    A window partitioned by product: daily rows per product are bounded by
    the number of calendar days, so even the hottest product is a small
    group; one shuffle on product_id.
    """
    w = Window.partitionBy("product_id")
    q = F.col("total_quantity").cast("double")
    x = (daily.select("product_id", "sale_date", q.alias("quantity"))
         .withColumn("_n", F.count(F.lit(1)).over(w))
         .withColumn("_mean", F.avg("quantity").over(w))
         .withColumn("_sd", F.stddev_pop("quantity").over(w)))
    z = F.abs((F.col("quantity") - F.col("_mean")) / F.col("_sd"))
    return (x.filter((F.col("_n") >= min_days) & (F.col("_sd") > 0) & (z > z_threshold))
            .select("product_id", "sale_date", "quantity",
                    py_round(z, 2).alias("z_score"),
                    F.when(F.col("quantity") > F.col("_mean"), "spike").otherwise("drop").alias("direction")))
