"""TS-1..7, FC-1/2/6: per-product daily series, features, split, metrics.

Everything after the daily aggregate is one shuffle on product_id: the
densify step is a window (lead to the next sale day + ``sequence``), and the
lag / rolling / split windows reuse the same partitioning and ordering.  A
product's series is bounded by the number of calendar days, so even the
hottest product is a small, bounded group.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillcast.functions.numeric import py_round

# Model inputs, in the reference's order.
FEATURE_COLUMNS = [
    "day_of_week", "day_of_month", "week_of_year", "month", "quarter",
    "is_weekend", "year", "lag_1", "lag_7", "lag_14", "lag_28",
    "rolling_7_mean", "rolling_14_mean", "rolling_28_mean", "rolling_7_std",
    "trend_signal",
]
LAGS = (1, 7, 14, 28)
ROLLING = (7, 14, 28)
MIN_DAILY_ROWS = 30        # FC-1
MIN_SERIES_DAYS = 60       # FC-2
TEST_SHARE = 0.2           # TS-7


def _series_window():
    return Window.partitionBy("product_id").orderBy("ds")


def eligible_products(daily: DataFrame, product_ids: Sequence[int] | None = None,
                      min_rows: int = MIN_DAILY_ROWS) -> DataFrame:
    """FC-1: the given ids, or products with at least ``min_rows`` daily rows."""
    if product_ids:
        return (daily.select("product_id").distinct()
                .filter(F.col("product_id").isin([int(i) for i in product_ids])))
    return (daily.groupBy("product_id").agg(F.count(F.lit(1)).alias("daily_rows"))
            .filter(F.col("daily_rows") >= min_rows))


def densify(daily: DataFrame, as_of=None, partitions: int | None = None) -> DataFrame:
    """TS-1: every calendar day between a product's first and last sale;
    missing days get y = 0 and revenue = 0; negative y is clipped to 0;
    days after ``as_of`` are dropped.  Output: product_id, ds, y, revenue.

    ``lead`` gives each sale day the next one; ``sequence`` + ``posexplode``
    fill the gap after it — no calendar table and no join.

    A few sale days become thousands of rows, so the products are dealt to a fixed
    number of ``partitions`` (default: the session's): coalesced by the bytes of the sale
    days, the series of all products would be made, and used, by a task or two."""
    w = Window.partitionBy("product_id").orderBy("sale_date")
    n = partitions or int(daily.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = daily.select("product_id", "sale_date", "total_quantity", "total_revenue").repartition(n, "product_id")
    x = x.select("product_id", "sale_date", "total_quantity", "total_revenue",
                 F.lead("sale_date").over(w).alias("_next"))
    last = F.coalesce(F.date_sub(F.col("_next"), 1), F.col("sale_date"))
    x = x.select("product_id", "total_quantity", "total_revenue",
                 F.posexplode(F.sequence(F.col("sale_date"), last)).alias("_i", "ds"))
    first = F.col("_i") == 0
    out = x.select(
        "product_id", "ds",
        F.when(first, F.greatest(F.col("total_quantity").cast("double"), F.lit(0.0))).otherwise(0.0).alias("y"),
        F.when(first, F.col("total_revenue").cast("double")).otherwise(0.0).alias("revenue"))
    if as_of is not None:
        out = out.filter(F.col("ds") <= F.lit(str(as_of)).cast("date"))
    return out


def long_enough(series: DataFrame, min_days: int = MIN_SERIES_DAYS) -> DataFrame:
    """FC-2: keep products whose densified series has ≥ ``min_days`` days.  Counted in the
    order that the features need, so the series is made and sorted once."""
    n = F.count(F.lit(1)).over(_series_window().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return series.filter(F.col("product_id").isNotNull()).withColumn("_days", n).filter(F.col("_days") >= min_days).drop("_days")


def calendar_features(series: DataFrame) -> DataFrame:
    """TS-2: day_of_week (Mon = 0), day_of_month, ISO week, month, quarter,
    is_weekend, year."""
    d = F.col("ds")
    return series.withColumns({
        "day_of_week": F.weekday(d),
        "day_of_month": F.dayofmonth(d),
        "week_of_year": F.weekofyear(d),
        "month": F.month(d),
        "quarter": F.quarter(d),
        "is_weekend": (F.weekday(d) >= 5).cast("int"),
        "year": F.year(d),
    })


def lag_features(series: DataFrame) -> DataFrame:
    """TS-3: y lagged 1, 7, 14, 28 days."""
    w = _series_window()
    return series.withColumns({f"lag_{k}": F.lag("y", k).over(w) for k in LAGS})


def rolling_features(series: DataFrame) -> DataFrame:
    """TS-4/5: means of the previous 7/14/28 days (at least one value), the
    sample σ of the previous 7 (0 below two values), trend_signal = y −
    rolling_7_mean (same-day, as the reference trains) and the leak-free
    ``trend_signal_lag`` = lag_1 − rolling_7_mean used for the model."""
    w = _series_window()
    cols = {f"rolling_{k}_mean": F.avg("y").over(w.rowsBetween(-k, -1)) for k in ROLLING}
    cols["rolling_7_std"] = F.coalesce(F.stddev_samp("y").over(w.rowsBetween(-7, -1)), F.lit(0.0))
    out = series.withColumns(cols)
    out = out.withColumn("trend_signal", F.col("y") - F.col("rolling_7_mean"))
    if "lag_1" in out.columns:
        out = out.withColumn("trend_signal_lag", F.col("lag_1") - F.col("rolling_7_mean"))
    return out


def engineer_features(series: DataFrame) -> DataFrame:
    """TS-2..6: all features; rows without lag_28 are dropped."""
    f = rolling_features(lag_features(calendar_features(series)))
    return f.filter(F.col("lag_28").isNotNull())


def split_train_test(features: DataFrame, test_share: float = TEST_SHARE) -> DataFrame:
    """TS-7: per product, the first int(n·0.8) rows (time order) are train,
    the rest test.  Adds ``is_test``."""
    w = _series_window()
    n = F.count(F.lit(1)).over(Window.partitionBy("product_id"))
    cut = F.floor(n * F.lit(1.0 - test_share))
    return (features.withColumn("_idx", F.row_number().over(w))
            .withColumn("is_test", F.col("_idx") > cut).drop("_idx"))


def model_frame(daily: DataFrame, product_ids: Sequence[int] | None = None, as_of=None) -> DataFrame:
    """FC-1 → TS-1 → FC-2 → TS-2..7: the training/test frame of every
    eligible product (one shuffle on product_id after the daily aggregate)."""
    elig = eligible_products(daily, product_ids)
    series = long_enough(densify(daily.join(elig.select("product_id"), "product_id", "left_semi"), as_of))
    return split_train_test(engineer_features(series))


def error_metrics(pred: DataFrame, actual: str = "y", predicted: str = "prediction",
                  by: Sequence[str] = ("product_id",), extra: Sequence[Column] = ()) -> DataFrame:
    """FC-6: MAE, RMSE, MAPE (rows with a zero actual skipped; NULL when all
    are zero), rounded to 4 decimals, per group; ``extra`` aggregates of the same pass behind them."""
    e = F.col(actual) - F.col(predicted)
    ape = F.when(F.col(actual) != 0, F.abs(e / F.col(actual)))
    return pred.groupBy(*by).agg(
        py_round(F.avg(F.abs(e)), 4).alias("mae"),
        py_round(F.sqrt(F.avg(e * e)), 4).alias("rmse"),
        py_round(F.avg(ape) * 100, 4).alias("mape"),
        F.count(F.lit(1)).alias("test_rows"), *extra,
    )
