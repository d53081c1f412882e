"""PROD-1..5 and DIM-3: product catalogue views and stock maths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.operators.ordered import global_prefix

# Days of demand the reorder target covers.
TARGET_DAYS = 30


def product_sales(daily: DataFrame) -> DataFrame:
    """Per-product totals from the daily aggregate (aggregate first, then
    join the dimension: the shuffle carries one row per product-day, not
    per fact line)."""
    return daily.groupBy("product_id").agg(
        F.sum("total_revenue").alias("total_revenue"),
        F.sum("total_quantity").cast("long").alias("total_quantity"),
        F.avg(F.col("total_quantity").cast("double")).alias("avg_daily_sales"),
        F.max("sale_date").alias("last_sale_date"),
        F.count(F.lit(1)).alias("active_days"),
    )


def _filtered(products: DataFrame, abc_class: str | None, search: str | None) -> DataFrame:
    p = products
    if abc_class:
        p = p.filter(F.col("abc_class") == F.lit(abc_class.upper()))
    if search:
        if len(search) > 100:
            raise ValueError("search is limited to 100 characters")
        pat = f"%{search}%"  # unescaped, as LIKE: % and _ stay wildcards
        p = p.filter(F.col("stock_code").ilike(pat) | F.col("description").ilike(pat))
    return p


def product_list(products: DataFrame, daily: DataFrame, abc_class: str | None = None,
                 search: str | None = None) -> DataFrame:
    """PROD-1: products with sales (inner join), totals, mean daily quantity
    and last sale date; optional class and ILIKE search filters (applied to
    the dimension before the join).  Ordered by revenue desc, product_id."""
    p = _filtered(products, abc_class, search).select(
        "product_id", "stock_code", "description", "abc_class",
        "current_stock", "lead_time_days", "safety_stock")
    j = p.join(product_sales(daily).drop("active_days"), "product_id")
    return j.select(
        "product_id", "stock_code", "description", "abc_class", "current_stock", "lead_time_days",
        "safety_stock", F.col("total_revenue").cast("double").alias("total_revenue"), "total_quantity",
        "avg_daily_sales", "last_sale_date")


def product_page(listing: DataFrame, page: int = 1, limit: int = 50) -> DataFrame:
    """PROD-2: one page of the ordered list (top-k with offset)."""
    if page < 1 or not 1 <= limit <= 200:
        raise ValueError("page >= 1 and 1 <= limit <= 200")
    return (listing.orderBy(F.col("total_revenue").desc(), F.col("product_id").asc())
            .offset((page - 1) * limit).limit(limit))


def page_count(listing: DataFrame, limit: int = 50) -> DataFrame:
    """PROD-2: total rows and number of pages."""
    return listing.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.ceil(F.col("total") / F.lit(limit)).cast("long").alias("pages"))


def product_detail(products: DataFrame, daily: DataFrame) -> DataFrame:
    """PROD-3: every product with its sales summary, zero-filled when it has
    no sales (left join)."""
    s = product_sales(daily)
    return products.join(s, "product_id", "left").select(
        "product_id", "stock_code", "description", "abc_class", "current_stock", "lead_time_days",
        "safety_stock", "unit_cost",
        F.coalesce(F.col("total_revenue").cast("double"), F.lit(0.0)).alias("total_revenue"),
        F.coalesce(F.col("total_quantity"), F.lit(0)).cast("long").alias("total_quantity"),
        F.coalesce(F.col("avg_daily_sales"), F.lit(0.0)).alias("avg_daily_sales"),
        "last_sale_date",
        F.coalesce(F.col("active_days"), F.lit(0)).cast("long").alias("active_days"))


def page_bounds(listed: DataFrame, limit: int) -> DataFrame:
    """PROD-2 by key: of every page of ``limit`` products its number and first row
    (``total_revenue``, ``product_id``), from one distributed numbering of the list.
    Store it once; any page is then sought by ``seek_page`` without sorting the rows before it."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must be within 1..200")
    at = global_prefix(listed.select("total_revenue", "product_id"), [F.col("total_revenue").desc(), F.col("product_id").asc()], pos_col="_at")
    return at.filter((F.col("_at") - 1) % limit == 0).select(
        (F.floor((F.col("_at") - 1) / limit) + 1).cast("long").alias("page"), "total_revenue", "product_id")


def seek_page(listed: DataFrame, start: tuple, limit: int) -> DataFrame:
    """The page that starts at the row ``start`` = (total_revenue, product_id): a range
    filter on the key, which a table stored in that order prunes by its statistics, and the first ``limit`` rows."""
    revenue, product = start
    after = (F.col("total_revenue") < F.lit(revenue)) | ((F.col("total_revenue") == F.lit(revenue)) & (F.col("product_id") >= F.lit(product)))
    return listed.filter(after).orderBy(F.col("total_revenue").desc(), F.col("product_id").asc()).limit(limit)


def keyset_pages(listed: DataFrame, limit: int) -> DataFrame:
    """Every row of the list with the ``page`` of ``limit`` products it stands on."""
    at = global_prefix(listed, [F.col("total_revenue").desc(), F.col("product_id").asc()], pos_col="_at")
    return at.withColumn("page", (F.floor((F.col("_at") - 1) / limit) + 1).cast("long")).drop("_at")


def lookup(products: DataFrame, product_id: int | None = None, stock_code: str | None = None) -> DataFrame:
    """DIM-3: product by id or by stock code."""
    if product_id is not None:
        return products.filter(F.col("product_id") == F.lit(product_id))
    return products.filter(F.col("stock_code") == F.lit(stock_code))


def reorder_point(lead_time: Column, avg_daily: Column, safety: Column) -> Column:
    """PROD-5: int(lead·avg + safety)."""
    return F.floor(lead_time * avg_daily + safety).cast("long")


def stock_status(current: Column, safety: Column, lead_time: Column, avg_daily: Column) -> Column:
    """PROD-4: critical ≤ safety; low ≤ safety + avg·lead; else healthy."""
    return (F.when(current <= safety, "critical")
            .when(current <= safety + avg_daily * lead_time, "low")
            .otherwise("healthy"))


def reorder_quantity(target: Column, current: Column) -> Column:
    """PROD-5: max(0, target − current)."""
    return F.greatest(F.lit(0), target - current).cast("long")


def stock_report(products: DataFrame, daily: DataFrame) -> DataFrame:
    """PROD-4/5 for every product: status, reorder point, 30-day target and
    reorder quantity from the mean daily quantity."""
    d = product_detail(products, daily)
    avg = F.col("avg_daily_sales")
    target = F.floor(F.lit(TARGET_DAYS) * avg + F.col("safety_stock")).cast("long")
    return d.select(
        "product_id", "stock_code", "current_stock", "safety_stock", "lead_time_days",
        F.round(avg, 6).alias("avg_daily_sales"),
        stock_status(F.col("current_stock"), F.col("safety_stock"), F.col("lead_time_days"), avg)
        .alias("stock_status"),
        reorder_point(F.col("lead_time_days"), avg, F.col("safety_stock")).alias("reorder_point"),
        target.alias("target_stock"),
        reorder_quantity(target, F.col("current_stock")).alias("reorder_qty"))
