"""Dashboard analytics: KPI-1..4, TREND-1, TOP-1..2.

Every KPI of one row is computed in ONE aggregate pass over the facts
(conditional aggregates), plus scalar subqueries for the product count and
the top country.  Nothing is collected to the driver.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillcast.functions.dates import days_between_floor, period_label
from tillcast.functions.numeric import py_round
from tillcast.operators.daily import sales_lines


def _ts(d) -> Column:
    return F.lit(str(d)).cast("timestamp")


def top_country(tx: DataFrame) -> DataFrame:
    """KPI-2: the country with the most fact rows (ties: alphabetical).

    groupBy(country) has one row per country; ``min_by`` over (−count,
    country) picks the winner without a sort."""
    per = tx.groupBy("country").agg(F.count(F.lit(1)).alias("transaction_count"))
    return per.agg(
        F.min_by("country", F.struct((-F.col("transaction_count")).alias("k"), F.col("country"))).alias("country"),
        F.max("transaction_count").alias("transaction_count"))


def kpis(tx: DataFrame, products: DataFrame, start: _dt.date | str | None = None,
         end: _dt.date | str | None = None, scope: str = "reference",
         approx_distinct: bool = False) -> DataFrame:
    """KPI-1 (with KPI-3): one-row dashboard KPIs.

    ``scope='reference'``: the date range limits the sums only; returns, the
    date span and the top country use all rows; ``end`` is compared at
    midnight.  ``scope='consistent'``: everything is limited to the range and
    the end day is inclusive.

    growth_pct compares revenue in [start, end] with the preceding period of
    equal length (NULL without a range or without revenue before it).
    ``approx_distinct`` counts invoices with a HyperLogLog sketch instead of
    an exact distinct (which shuffles on invoice_no).
    """
    if scope not in ("reference", "consistent"):
        raise ValueError("scope must be 'reference' or 'consistent'")
    positive = F.col("quantity") > 0
    in_range = F.lit(True)
    prev_range = F.lit(False)
    if start is not None:
        in_range = in_range & (F.col("invoice_date") >= _ts(start))
    if end is not None:
        end_excl = (F.lit(str(end)).cast("date") + F.expr("INTERVAL 1 DAY")).cast("timestamp")
        in_range = in_range & ((F.col("invoice_date") < end_excl) if scope == "consistent"
                               else (F.col("invoice_date") <= _ts(end)))
    if start is not None and end is not None:
        start_d = _dt.date.fromisoformat(str(start)[:10])
        end_d = _dt.date.fromisoformat(str(end)[:10])
        length = (end_d - start_d).days + 1
        prev_start = start_d - _dt.timedelta(days=length)
        prev_range = (F.col("invoice_date") >= _ts(prev_start)) & (F.col("invoice_date") < _ts(start_d))
    sel = positive & in_range
    everywhere = F.lit(True) if scope == "reference" else in_range

    src = tx if scope == "reference" else tx.filter(in_range | prev_range)
    row = src.agg(
        F.sum(F.when(sel, F.col("revenue"))).alias("_rev"),
        F.sum(F.when(sel, F.col("quantity"))).alias("_units"),
        F.count_if(sel).alias("total_transactions"),
        # exact distinct needs a shuffle on invoice_no; the HLL sketch does not
        (F.approx_count_distinct(F.when(sel, F.col("invoice_no"))) if approx_distinct
         else F.count_distinct(F.when(sel, F.col("invoice_no")))).alias("unique_invoices"),
        F.count_if(everywhere & F.col("is_return")).alias("return_count"),
        F.sum(F.when(everywhere, F.col("revenue"))).alias("_net"),
        F.min(F.when(everywhere, F.col("invoice_date"))).alias("_dmin"),
        F.max(F.when(everywhere, F.col("invoice_date"))).alias("_dmax"),
        F.sum(F.when(positive & prev_range, F.col("revenue"))).alias("_prev"),
    )
    rev = F.coalesce(F.col("_rev").cast("double"), F.lit(0.0))
    n = F.col("total_transactions")
    days = F.when(F.col("_dmin").isNotNull(), days_between_floor(F.col("_dmax"), F.col("_dmin")) + 1).otherwise(1)
    prev = F.col("_prev").cast("double")
    country_src = tx if scope == "reference" else tx.filter(in_range)
    return row.select(
        rev.alias("total_revenue"),
        n.alias("total_transactions"),
        products.agg(F.count(F.lit(1))).scalar().alias("total_products"),
        F.coalesce(F.col("_units"), F.lit(0)).cast("long").alias("total_units_sold"),
        F.when(prev > 0, py_round((rev - prev) / prev * 100, 2)).alias("growth_pct"),
        py_round(rev / days, 4).alias("avg_daily_revenue"),
        py_round(F.when(n > 0, rev / n).otherwise(0.0), 4).alias("avg_order_value"),
        py_round(F.when(F.col("unique_invoices") > 0, rev / F.col("unique_invoices")).otherwise(0.0), 4)
        .alias("avg_invoice_value"),
        py_round(F.col("_net").cast("double"), 2).alias("net_revenue"),
        py_round(F.col("return_count") / F.when(n > 0, n).otherwise(1) * 100, 2).alias("return_rate_pct"),
        top_country(country_src).select("country").scalar().alias("top_country"),
        F.to_date("_dmin").alias("date_range_start"),
        F.to_date("_dmax").alias("date_range_end"),
        F.col("unique_invoices"),
        F.col("return_count"),
    )


def kpis_active(tx_scope: DataFrame, start=None, end=None) -> DataFrame:
    """KPI-4: KPIs of one upload (pass ``active_scope(tx, uploads)``).
    Returns are counted over the whole scope, not under the quantity filter
    (the reference's variant counted them under it and always got 0)."""
    sel = F.col("quantity") > 0
    if start is not None:
        sel = sel & (F.col("invoice_date") >= _ts(start))
    if end is not None:
        sel = sel & (F.col("invoice_date") <= _ts(end))
    rev = F.coalesce(F.sum(F.when(sel, F.col("revenue"))).cast("double"), F.lit(0.0))
    n = F.count_if(sel)
    return tx_scope.agg(
        rev.alias("total_revenue"),
        n.alias("total_transactions"),
        py_round(F.when(n > 0, rev / n).otherwise(0.0), 4).alias("avg_order_value"),
        F.count_if(F.col("is_return")).alias("return_count"),
    )


def revenue_trend(tx_scope: DataFrame, granularity: str = "daily") -> DataFrame:
    """TREND-1: revenue, units and line count per day / ISO week / %W week /
    month over sale lines, ordered by period."""
    return (sales_lines(tx_scope)
            .groupBy(period_label(F.col("invoice_date"), granularity).alias("period"))
            .agg(F.sum("revenue").cast("double").alias("revenue"),
                 F.sum("quantity").cast("long").alias("quantity"),
                 F.count(F.lit(1)).alias("transaction_count"))
            .orderBy("period"))


def product_revenue(tx: DataFrame, products: DataFrame) -> DataFrame:
    """Σrevenue and Σquantity of sale lines per product that exists in the
    dimension (the reference joins products before grouping)."""
    per = sales_lines(tx).groupBy("product_id").agg(
        F.sum("revenue").alias("total_revenue"),
        F.sum("quantity").cast("long").alias("total_quantity"))
    return per.join(products.select("product_id"), "product_id", "left_semi")


def top_products(tx_scope: DataFrame, products: DataFrame, n: int = 10) -> DataFrame:
    """TOP-1: top-n products by revenue with SQL RANK().

    Distributed top-k (TakeOrderedAndProject: each partition keeps n rows),
    then RANK over those n rows: every product ranked above a top-n product
    is itself in the top n, so the ranks equal the global ones without a
    single-partition window over all products.  The dimension join happens
    after the limit, on n rows.
    """
    if not 1 <= n <= 50:
        raise ValueError("n must be within 1..50")
    top = (product_revenue(tx_scope, products)
           .orderBy(F.col("total_revenue").desc(), F.col("product_id").asc()).limit(n))
    dims = products.select("product_id", "stock_code", "description", "abc_class")
    ranked = top.withColumn("rank", F.rank().over(Window.orderBy(F.col("total_revenue").desc())))
    return (ranked.join(dims, "product_id")
            .select(F.col("rank").cast("long").alias("rank"), "product_id", "stock_code", "description",
                    "abc_class", F.col("total_revenue").cast("double").alias("total_revenue"),
                    "total_quantity")
            .orderBy("rank", "product_id"))


def search_products(df: DataFrame, query: str | None) -> DataFrame:
    """TOP-2: literal case-insensitive contains on description or code."""
    if not query:
        return df
    q = F.lower(F.lit(query))
    return df.filter(F.contains(F.lower(F.col("description")), q) |
                     F.contains(F.lower(F.col("stock_code")), q))
