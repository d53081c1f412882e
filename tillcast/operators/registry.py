"""REG-1..6: the upload registry and dataset scoping.

The registry holds one row per landed file, so it is small; the fact table is
partitioned by ``upload_id`` so scoping to an upload prunes partitions.
Scalars (the active id) travel as scalar subqueries, which Spark evaluates
once and inlines as a literal — usable for partition pruning.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast import schemas


def _latest_id(reg: DataFrame) -> Column:
    """Scalar: id of the newest upload (uploaded_at, then id, descending)."""
    return reg.agg(F.max_by("upload_id", F.struct("uploaded_at", "upload_id"))).scalar()


def active_id(reg: DataFrame) -> Column:
    """Scalar: the active upload (first active one by id: 'LIMIT 1')."""
    return reg.filter(F.col("is_active")).agg(F.min("upload_id")).scalar()


def activate_latest(reg: DataFrame) -> DataFrame:
    """REG-6: when no upload is active, the newest becomes active."""
    any_active = reg.agg(F.max(F.col("is_active").cast("int"))).scalar()
    latest = _latest_id(reg)
    return reg.withColumn(
        "is_active",
        F.when(F.coalesce(any_active, F.lit(0)) == 1, F.col("is_active"))
         .otherwise(F.col("upload_id") == latest))


def register_upload(reg: DataFrame, upload_id: int, filename: str, file_size: int,
                    uploaded_at: _dt.datetime) -> DataFrame:
    """REG-1: append a pending upload and make it the only active one."""
    spark = reg.sparkSession
    new = spark.createDataFrame(
        [(upload_id, filename, file_size, None, None, None, "pending", True, None, uploaded_at, None)],
        schemas.UPLOADS)
    return reg.withColumn("is_active", F.lit(False)).unionByName(new)


def set_active(reg: DataFrame, upload_id: int) -> DataFrame:
    """REG-2: exactly one active upload.  The caller rebuilds daily_sales
    with ``daily_sales(tx, upload_id)`` (daily_sales is derived data)."""
    return reg.withColumn("is_active", F.col("upload_id") == F.lit(upload_id))


def set_status(reg: DataFrame, upload_id: int, status: str, error: str | None = None,
               at: _dt.datetime | None = None) -> DataFrame:
    """REG-4: status transition; error text kept to 500 characters."""
    if status not in schemas.UPLOAD_STATUSES:
        raise ValueError(f"unknown upload status {status!r}")
    hit = F.col("upload_id") == F.lit(upload_id)
    out = reg.withColumn("status", F.when(hit, F.lit(status)).otherwise(F.col("status")))
    if error is not None:
        out = out.withColumn("error_message",
                             F.when(hit, F.lit(error[:500])).otherwise(F.col("error_message")))
    if at is not None and status in ("completed", "failed"):
        out = out.withColumn("processed_at",
                             F.when(hit, F.lit(at).cast("timestamp")).otherwise(F.col("processed_at")))
    return out


def list_uploads(reg: DataFrame) -> DataFrame:
    """REG-4: newest first."""
    return reg.orderBy(F.col("uploaded_at").desc(), F.col("upload_id").desc())


def upload_status(reg: DataFrame, upload_id: int) -> DataFrame:
    """REG-4: one upload's status row, or no row."""
    return reg.filter(F.col("upload_id") == F.lit(upload_id)).select(
        "upload_id", "filename", "status", "row_count", "valid_rows", "invalid_rows", "is_active", "error_message", "processed_at")


def active_scope(tx: DataFrame, reg: DataFrame) -> DataFrame:
    """REG-5: facts of the active upload only."""
    return tx.filter(F.col("upload_id") == active_id(reg))


def delete_upload(reg: DataFrame, tx: DataFrame, products: DataFrame, upload_id: int):
    """REG-3: drop an upload's facts and the products no longer referenced;
    if it was active, the newest remaining upload becomes active.

    Returns ``(registry, facts, products, orphans)``.  Orphans are found with
    an anti join against the distinct remaining product ids (a semi/anti join
    is a shuffle on product_id, or a broadcast when AQE finds the distinct
    ids small)."""
    reg2 = reg.filter(F.col("upload_id") != F.lit(upload_id))
    reg2 = activate_latest(reg2)
    tx2 = tx.filter(F.col("upload_id") != F.lit(upload_id))
    used = tx2.select("product_id").distinct()
    kept = products.join(used, "product_id", "left_semi")
    orphans = products.join(used, "product_id", "left_anti")
    return reg2, tx2, kept, orphans


def delete_upload_cascade(reg: DataFrame, tx: DataFrame, products: DataFrame, upload_id: int,
                          dependents: dict[str, DataFrame] | None = None, insights: DataFrame | None = None) -> dict[str, DataFrame]:
    """REG-3 with everything that hangs on the upload.

    ``dependents`` (forecasts, alerts, ...) lose the rows of orphaned products
    by an anti join on product_id; ``insights`` (cached texts about the data
    as it was) are emptied; ``daily`` is built from the facts of the upload
    that is active afterwards.
    """
    from tillcast.operators.daily import daily_sales
    reg2, tx2, kept, orphans = delete_upload(reg, tx, products, upload_id)
    out = {"uploads": reg2, "facts": tx2, "products": kept, "orphans": orphans,
           "daily": daily_sales(active_scope(tx2, reg2))}
    gone = orphans.select("product_id")
    out |= {name: df.join(gone, "product_id", "left_anti") for name, df in (dependents or {}).items()}
    if insights is not None:
        out["insights"] = insights.limit(0)
    return out
