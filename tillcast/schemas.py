"""Explicit schemas of the stored retail tables.

Ids, counts and sums are LongType so nothing overflows at cluster scale;
money is DecimalType so sums are exact; sums are widened to (18,2) or more.
"""

from pyspark.sql import types as T

MONEY = T.DecimalType(10, 2)
# quantity and price may each reach 100,000, so a line needs 13 digits
LINE_MONEY = T.DecimalType(18, 2)
SUM_MONEY = T.DecimalType(18, 2)

# Column names of a raw transaction log, in the order a file usually has them.
RAW_LOG_COLUMNS = [
    "InvoiceNo", "StockCode", "Description", "Quantity",
    "InvoiceDate", "Price", "Customer ID", "Country",
]

RAW_LOG = T.StructType([T.StructField(c, T.StringType(), True) for c in RAW_LOG_COLUMNS])

UPLOADS = T.StructType([
    T.StructField("upload_id", T.LongType(), False),
    T.StructField("filename", T.StringType(), True),
    T.StructField("file_size", T.LongType(), True),
    T.StructField("row_count", T.LongType(), True),
    T.StructField("valid_rows", T.LongType(), True),
    T.StructField("invalid_rows", T.LongType(), True),
    T.StructField("status", T.StringType(), True),
    T.StructField("is_active", T.BooleanType(), True),
    T.StructField("error_message", T.StringType(), True),
    T.StructField("uploaded_at", T.TimestampType(), True),
    T.StructField("processed_at", T.TimestampType(), True),
])

PRODUCTS = T.StructType([
    T.StructField("product_id", T.LongType(), False),
    T.StructField("stock_code", T.StringType(), False),
    T.StructField("description", T.StringType(), True),
    T.StructField("category", T.StringType(), True),
    T.StructField("abc_class", T.StringType(), True),
    T.StructField("current_stock", T.IntegerType(), True),
    T.StructField("lead_time_days", T.IntegerType(), True),
    T.StructField("safety_stock", T.IntegerType(), True),
    T.StructField("unit_cost", T.DoubleType(), True),
])

TRANSACTIONS = T.StructType([
    T.StructField("invoice_no", T.StringType(), True),
    T.StructField("product_id", T.LongType(), False),
    T.StructField("quantity", T.IntegerType(), True),
    T.StructField("unit_price", MONEY, True),
    T.StructField("revenue", LINE_MONEY, True),
    T.StructField("invoice_date", T.TimestampType(), True),
    T.StructField("customer_id", T.StringType(), True),
    T.StructField("country", T.StringType(), True),
    T.StructField("is_return", T.BooleanType(), True),
    T.StructField("upload_id", T.LongType(), True),
])

DAILY_SALES = T.StructType([
    T.StructField("product_id", T.LongType(), False),
    T.StructField("sale_date", T.DateType(), False),
    T.StructField("total_quantity", T.LongType(), True),
    T.StructField("total_revenue", SUM_MONEY, True),
    T.StructField("transaction_count", T.LongType(), True),
    T.StructField("avg_unit_price", MONEY, True),
])

ALERTS = T.StructType([
    T.StructField("alert_id", T.LongType(), True),
    T.StructField("product_id", T.LongType(), False),
    T.StructField("alert_type", T.StringType(), False),
    T.StructField("severity", T.StringType(), False),
    T.StructField("message", T.StringType(), True),
    T.StructField("reorder_qty", T.LongType(), True),
    T.StructField("reorder_point", T.DoubleType(), True),
    T.StructField("current_velocity", T.DoubleType(), True),
    T.StructField("is_resolved", T.BooleanType(), True),
    T.StructField("created_at", T.TimestampType(), True),
    T.StructField("resolved_at", T.TimestampType(), True),
])

ML_RUNS = T.StructType([
    T.StructField("run_id", T.LongType(), False),
    T.StructField("model_name", T.StringType(), True),
    T.StructField("model_version", T.StringType(), True),
    T.StructField("training_start", T.TimestampType(), True),
    T.StructField("training_end", T.TimestampType(), True),
    T.StructField("products_trained", T.LongType(), True),
    T.StructField("mae", T.DoubleType(), True),
    T.StructField("rmse", T.DoubleType(), True),
    T.StructField("mape", T.DoubleType(), True),
    T.StructField("parameters", T.StringType(), True),
    T.StructField("artifact_path", T.StringType(), True),
    T.StructField("status", T.StringType(), True),
    T.StructField("error_message", T.StringType(), True),
    T.StructField("created_at", T.TimestampType(), True),
])

FORECASTS = T.StructType([
    T.StructField("product_id", T.LongType(), False),
    T.StructField("model_run_id", T.LongType(), False),
    T.StructField("forecast_date", T.DateType(), False),
    T.StructField("predicted_quantity", MONEY, True),
    T.StructField("lower_bound", MONEY, True),
    T.StructField("upper_bound", MONEY, True),
])

AI_INSIGHTS = T.StructType([
    T.StructField("insight_type", T.StringType(), True),
    T.StructField("context_hash", T.StringType(), False),
    T.StructField("prompt", T.StringType(), True),
    T.StructField("response", T.StringType(), True),
    T.StructField("model_used", T.StringType(), True),
    T.StructField("tokens_used", T.LongType(), True),
    T.StructField("created_at", T.TimestampType(), True),
])

# Closed enum domains (the reference keeps them as free text).
ALERT_TYPES = ("reorder_needed", "slow_mover", "stockout_risk", "anomaly")
SEVERITIES = ("low", "medium", "high")
ABC_CLASSES = ("A", "B", "C")
UPLOAD_STATUSES = ("pending", "processing", "completed", "failed")
