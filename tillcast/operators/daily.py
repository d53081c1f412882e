"""DAILY-1..3: the per-product daily sales pre-aggregate."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast import schemas
from tillcast.sources.tpch import cents_to_money, money_to_cents


def sales_lines(tx: DataFrame) -> DataFrame:
    """Rows that count as sales: not a return and a positive quantity."""
    return tx.filter(~F.col("is_return") & (F.col("quantity") > 0))


def daily_sales(tx: DataFrame, upload_id: int | None = None) -> DataFrame:
    """DAILY-1: per (product, day) Σquantity, Σrevenue, count and the mean
    unit price (rounded half-up to cents) over sale lines of one upload (or
    all uploads when ``upload_id`` is None).

    One hash aggregate with map-side partial aggregation: a hot product is
    pre-summed in every input partition before the shuffle, so skew in the
    fact does not reach the reducers.
    """
    t = sales_lines(tx)
    if upload_id is not None:
        t = t.filter(F.col("upload_id") == F.lit(upload_id))
    cents = money_to_cents(F.col("unit_price"))
    g = t.groupBy("product_id", F.to_date("invoice_date").alias("sale_date")).agg(
        F.sum("quantity").cast("long").alias("total_quantity"),
        F.sum("revenue").cast(schemas.SUM_MONEY).alias("total_revenue"),
        F.count(F.lit(1)).alias("transaction_count"),
        F.sum(cents).alias("_price_cents"),
    )
    return average_price(g)


def average_price(g: DataFrame) -> DataFrame:
    """Daily rows whose mean price is the half-up rounded share of ``_price_cents`` in ``transaction_count``."""
    half_up = F.expr("(2 * _price_cents + transaction_count) div (2 * transaction_count)")
    return g.select("product_id", "sale_date", "total_quantity", "total_revenue", "transaction_count",
                    cents_to_money(half_up).alias("avg_unit_price"))


def merge_daily(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """DAILY-2: additive upsert.  On a (product, day) present in both, add
    quantity, revenue and count; the incoming batch's avg_unit_price wins.

    A union + one aggregate (no MERGE statement, one shuffle).  Chaining
    several loads works because each load gets a higher sequence number.
    """
    cols = ["product_id", "sale_date", "total_quantity", "total_revenue",
            "transaction_count", "avg_unit_price"]
    both = current.select(*cols, F.lit(0).alias("_seq")).unionByName(
        incoming.select(*cols, F.lit(1).alias("_seq")))
    return merge_sequenced(both)


def merge_sequenced(rows: DataFrame) -> DataFrame:
    """Fold daily rows tagged with a load sequence ``_seq`` (higher = newer)."""
    return rows.groupBy("product_id", "sale_date").agg(
        F.sum("total_quantity").cast("long").alias("total_quantity"),
        F.sum("total_revenue").cast(schemas.SUM_MONEY).alias("total_revenue"),
        F.sum("transaction_count").cast("long").alias("transaction_count"),
        F.max_by("avg_unit_price", "_seq").alias("avg_unit_price"),
    )


def product_history(daily: DataFrame, product_id: int | None = None,
                    start: _dt.date | str | None = None,
                    end: _dt.date | str | None = None) -> DataFrame:
    """DAILY-3: daily rows (of one product, or all), optional inclusive range,
    ordered by date."""
    d = daily
    if product_id is not None:
        d = d.filter(F.col("product_id") == F.lit(product_id))
    if start is not None:
        d = d.filter(F.col("sale_date") >= F.lit(start).cast("date"))
    if end is not None:
        d = d.filter(F.col("sale_date") <= F.lit(end).cast("date"))
    return d.orderBy("product_id", "sale_date")
