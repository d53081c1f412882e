"""Registered queries: each builds a DataFrame from the tables of one
scale-factor directory.  Names are the keys of ``__spark_entry__.queries()``;
the matching DuckDB SQL lives in ``tillcast.plans.oracle``.

Every query reads the whole given tables (no id subsets or row caps); limits
appear only where the feature is a top-k or a page.
"""

from __future__ import annotations

import datetime as dt
import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.operators import abc as abc_ops
from tillcast.operators import alerts as alert_ops
from tillcast.operators import cube as cube_ops
from tillcast.operators import analytics, daily as daily_ops, movement, products as prod_ops
from tillcast.operators import boosting, training
from tillcast.operators import catalogue, cleaning, context, exports, features, forecasting, registry
from tillcast.functions.numeric import compact_currency
from tillcast.functions.text import scrub_formula
from tillcast.session import byte_count, scratch_path, stored
from tillcast.sources.erp_sheet import map_erp_sheet, sheet_fallback, sheet_outcomes
from tillcast.sources.tpch import RetailData, erp_sheet_from_facts, missing_orders, raw_log_from_facts, superstore_log_from_facts

QueryFn = Callable[[SparkSession, str], DataFrame]

# Fixed parameters of the registered queries.
KPI_RANGE = ("2000-01-01", "2000-12-31")
SLOW_LOOKBACK_DAYS = 3650
TOP_N = 10
SEARCH_TERM = "ring"
RUN_AT = dt.datetime(2001, 11, 5)
#: Rows of a landed file, so that it stays below the gate's limit whatever the input.
FILE_ROWS, WIDE_FILE_ROWS = 500_000, 150_000
#: Facts a shuffle partition is to hold at most.
TASK_ROWS = 500_000
#: Shuffled bytes up to which adaptive execution may put partitions together for one task.
TASK_BYTES = 16 << 20
TREE_FEATURES = ("day_of_week", "lag_1", "lag_7", "lag_28", "rolling_7_mean")


def _data(spark: SparkSession, sf_dir: str) -> RetailData:
    """The tables; a shuffle gets a partition for every ``TASK_ROWS`` facts at least.  A fixed number
    would make the sorts and aggregates of one task grow with the input; adaptive execution coalesces
    what turns out small, up to its advisory size.  That counts compressed bytes: with 64 MB, facts
    that are sorted twice and summed by one task take ten times as much memory, so it is held at ``TASK_BYTES``."""
    d = RetailData(spark, sf_dir)
    n, key = _files(d, TASK_ROWS), "spark.sql.shuffle.partitions"
    if n > int(spark.conf.get(key)):
        spark.conf.set(key, n)
    advisory = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    if byte_count(spark.conf.get(advisory)) > TASK_BYTES:
        spark.conf.set(advisory, str(TASK_BYTES))
    return d


def _products_with_abc(d: RetailData, lines: DataFrame | None = None) -> DataFrame:
    """Products with their class; from the stored sums, or ``lines`` where nothing else reads those."""
    return abc_ops.write_back_classes(d.products, abc_ops.abc_analysis(d.sums if lines is None else lines, d.products))


def _daily_out(df: DataFrame) -> DataFrame:
    return df.select("product_id", "sale_date", "total_quantity",
                     F.col("total_revenue").cast("double").alias("total_revenue"),
                     "transaction_count", F.col("avg_unit_price").cast("double").alias("avg_unit_price"))


def q_daily_sales(spark, sf_dir):
    return _daily_out(_data(spark, sf_dir).daily)


def q_top_products(spark, sf_dir):
    d = _data(spark, sf_dir)
    return analytics.top_products(d.active_sums, _products_with_abc(d), TOP_N)


def q_top_products_search(spark, sf_dir):
    d = _data(spark, sf_dir)
    return analytics.search_products(analytics.top_products(d.active_sums, _products_with_abc(d), 50), SEARCH_TERM)


def _cube(d: RetailData, sketches: bool = False) -> cube_ops.Cube:
    """The stored cube, built from the facts once; the KPI queries read nothing else."""
    return cube_ops.build_cube(d.tx, scratch_path(d.spark, f"cube-{uuid.uuid4().hex}"), partitioned=False, sketches=sketches)


def q_kpis(spark, sf_dir):
    d = _data(spark, sf_dir)
    return cube_ops.kpis(_cube(d), d.products)


def q_kpis_range(spark, sf_dir):
    d = _data(spark, sf_dir)
    return cube_ops.kpis(_cube(d), d.products, *KPI_RANGE)


def q_kpis_consistent(spark, sf_dir):
    d = _data(spark, sf_dir)
    return cube_ops.kpis(_cube(d), d.products, *KPI_RANGE, scope="consistent")


def q_kpis_direct(spark, sf_dir):
    """KPI-1 straight from the facts, without a stored cube."""
    d = _data(spark, sf_dir)
    return analytics.kpis(d.tx, d.products, *KPI_RANGE)


def q_unique_invoices(spark, sf_dir):
    """KPI-3 per upload: exact, and whether the days' sketches come within 5 % of it."""
    u = cube_ops.unique_invoices(_cube(_data(spark, sf_dir), sketches=True), by=("upload_id",))
    near = F.abs(F.col("estimate") - F.col("exact")) <= 0.05 * F.col("exact")
    return u.select("upload_id", F.col("exact").alias("unique_invoices"), near.alias("sketch_within_5_pct"))


def q_kpis_active(spark, sf_dir):
    return analytics.kpis_active(_data(spark, sf_dir).active_lines)


def q_top_country(spark, sf_dir):
    return cube_ops.top_country(_cube(_data(spark, sf_dir)))


def _trend(granularity):
    def q(spark, sf_dir):
        return analytics.revenue_trend(_data(spark, sf_dir).active_lines, granularity)
    return q


def q_abc(spark, sf_dir):
    d = _data(spark, sf_dir)
    return abc_ops.abc_analysis(d.lines, d.products).drop("revenue_rank")


def q_abc_summary(spark, sf_dir):
    d = _data(spark, sf_dir)
    return abc_ops.abc_summary(abc_ops.abc_analysis(d.lines, d.products))


def q_abc_distribution(spark, sf_dir):
    return abc_ops.abc_distribution(_products_with_abc(_data(spark, sf_dir)))


def q_slow_movers(spark, sf_dir):
    d = _data(spark, sf_dir)
    return movement.slow_movers(d.stored_daily, d.products, lookback_days=SLOW_LOOKBACK_DAYS)


def q_slow_movers_30(spark, sf_dir):
    d = _data(spark, sf_dir)
    return movement.slow_movers(d.stored_daily, d.products, lookback_days=30)


def q_anomalies(spark, sf_dir):
    return movement.sales_anomalies(_data(spark, sf_dir).daily, 3.0)


def q_product_list(spark, sf_dir):
    d = _data(spark, sf_dir)
    return prod_ops.product_page(prod_ops.product_list(_products_with_abc(d, d.lines), d.daily), 1, 50)


def q_product_list_all(spark, sf_dir):
    """PROD-1 without a page: every product."""
    d = _data(spark, sf_dir)
    return prod_ops.product_list(_products_with_abc(d, d.lines), d.daily)


def q_product_page2(spark, sf_dir):
    d = _data(spark, sf_dir)
    return prod_ops.product_page(prod_ops.product_list(_products_with_abc(d, d.lines), d.daily, abc_class="a"), 2, 20)


def q_product_search(spark, sf_dir):
    d = _data(spark, sf_dir)
    return prod_ops.product_list(_products_with_abc(d, d.lines), d.daily, search=SEARCH_TERM)


def q_product_pages(spark, sf_dir):
    d = _data(spark, sf_dir)
    return prod_ops.page_count(prod_ops.product_list(d.products, d.daily), 50)


def q_product_detail(spark, sf_dir):
    d = _data(spark, sf_dir)
    return prod_ops.product_detail(d.products, d.daily)


def q_product_history(spark, sf_dir):
    d = _data(spark, sf_dir)
    return _daily_out(daily_ops.product_history(d.daily, None, "2000-01-01", "2000-06-30"))


def q_stock_status(spark, sf_dir):
    d = _data(spark, sf_dir)
    return prod_ops.stock_report(d.products, d.daily)


def q_alerts_reorder(spark, sf_dir):
    return alert_ops.reorder_alerts(_data(spark, sf_dir).stored_daily)


def q_alerts_stockout(spark, sf_dir):
    return alert_ops.stockout_alerts(_data(spark, sf_dir).stored_daily)


def q_alerts_slow(spark, sf_dir):
    return alert_ops.slow_mover_alerts(_data(spark, sf_dir).stored_daily)


def q_alerts_all(spark, sf_dir):
    return alert_ops.generate_alerts(_data(spark, sf_dir).stored_daily)


def q_alert_counts(spark, sf_dir):
    d = _data(spark, sf_dir)
    alerts = alert_ops.regenerate(None, alert_ops.generate_alerts(d.stored_daily), "2001-11-05 00:00:00")
    return alert_ops.open_alert_counts(alerts)


def q_uploads(spark, sf_dir):
    return registry.list_uploads(_data(spark, sf_dir).uploads).select(
        "upload_id", "filename", "row_count", "status", "is_active")


def q_switch_active(spark, sf_dir):
    d = _data(spark, sf_dir)
    reg = registry.set_active(d.uploads, 3)
    scope = registry.active_scope(d.lines, reg)
    return _daily_out(daily_ops.daily_sales(scope))


def q_daily_merge(spark, sf_dir):
    """DAILY-2 over two loads that together hold every fact and overlap on
    (product, day): customers in countries A-J, then K-Z.  The merged table
    equals a single aggregate except for avg_unit_price, which the second
    load overwrites."""
    d = _data(spark, sf_dir)
    first = F.col("country") < F.lit("K")
    old = daily_ops.daily_sales(d.tx.filter(first))
    new = daily_ops.daily_sales(d.tx.filter(~first))
    return _daily_out(daily_ops.merge_daily(old, new))


def q_delete_upload_orphans(spark, sf_dir):
    d = _data(spark, sf_dir)
    latest = d.uploads.agg(F.max("upload_id")).first()[0]  # one scalar
    _, _, _, orphans = registry.delete_upload(d.uploads, d.lines, d.products, latest)
    return orphans.select("product_id", "stock_code")


def _clean(d: RetailData) -> cleaning.CleanResult:
    """The dirty log cleaned as a load does it: staged once, counts observed by that write."""
    return cleaning.clean_staged(raw_log_from_facts(d.tx), scratch_path(d.spark, f"clean-{uuid.uuid4().hex}"), file_col="_file")


def _clean_out(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("_file").alias("file"), F.col("InvoiceNo").alias("invoice_no"),
        F.col("StockCode").alias("stock_code"), F.col("Description").alias("description"),
        F.col("Quantity").alias("quantity"),
        F.date_format("InvoiceDate", "yyyy-MM-dd HH:mm:ss").alias("invoice_date"),
        F.col("Price").alias("price"), F.col("`Customer ID`").alias("customer_id"),
        F.col("Country").alias("country"), "is_return", "revenue")


def q_clean_accept(spark, sf_dir):
    return _clean_out(_clean(_data(spark, sf_dir)).accepted)


def q_clean_report(spark, sf_dir):
    return _clean(_data(spark, sf_dir)).report


def q_clean_summary(spark, sf_dir):
    return _clean(_data(spark, sf_dir)).summary


def q_clean_superstore(spark, sf_dir):
    d = _data(spark, sf_dir)
    res = cleaning.clean_staged(superstore_log_from_facts(d.tx), scratch_path(spark, f"clean-{uuid.uuid4().hex}"))
    return _clean_out(res.accepted.withColumn("_file", F.lit("superstore.csv")))


def _product_out(df: DataFrame) -> DataFrame:
    return df.select("product_id", "stock_code", "description", "unit_cost", "current_stock",
                     "lead_time_days", "safety_stock")


def q_product_upsert(spark, sf_dir):
    """DIM-1/2 from an empty catalogue: one product per code, first row wins,
    dense ids in code order."""
    acc = _clean(_data(spark, sf_dir)).accepted
    return _product_out(catalogue.assign_ids(catalogue.new_products(acc, None), None))


def q_product_upsert_incremental(spark, sf_dir):
    """DIM-1/2 for the latest file against the catalogue of all earlier files."""
    acc = _clean(_data(spark, sf_dir)).accepted
    latest = acc.agg(F.max("_upload_id")).scalar()
    existing = catalogue.assign_ids(catalogue.new_products(acc.filter(F.col("_upload_id") != latest), None), None)
    added = catalogue.new_products(acc.filter(F.col("_upload_id") == latest), existing)
    return _product_out(catalogue.assign_ids(added, existing))


def q_product_upsert_second(spark, sf_dir):
    """DIM-1/2 for all later files against the catalogue of the first file."""
    acc = _clean(_data(spark, sf_dir)).accepted
    first = acc.agg(F.min("_upload_id")).scalar()
    existing = catalogue.assign_ids(catalogue.new_products(acc.filter(F.col("_upload_id") == first), None), None)
    added = catalogue.new_products(acc.filter(F.col("_upload_id") != first), existing)
    return _product_out(catalogue.assign_ids(added, existing))


def q_alerts_slow_all_time(spark, sf_dir):
    """ALERT-3 over the whole history."""
    return alert_ops.slow_mover_alerts(_data(spark, sf_dir).stored_daily, lookback_days=SLOW_LOOKBACK_DAYS)


def q_missing_orders(spark, sf_dir):
    """The input contract behind ``lines``: rows of lineitem without order, customer or nation, counted."""
    d = _data(spark, sf_dir)
    gone = missing_orders(*[d.table(t) for t in ("lineitem", "orders", "customer", "nation")])
    return gone.agg(F.count(F.lit(1)).alias("missing"))


def q_fact_build(spark, sf_dir):
    d = _data(spark, sf_dir)
    facts = catalogue.build_facts(_clean(d).accepted, d.products, F.col("_upload_id"))
    return facts.select("invoice_no", "product_id", "quantity",
                        F.col("unit_price").cast("double").alias("unit_price"),
                        F.col("revenue").cast("double").alias("revenue"),
                        F.date_format("invoice_date", "yyyy-MM-dd HH:mm:ss").alias("invoice_date"),
                        "customer_id", "country", "is_return", "upload_id")


def _series(d: RetailData) -> DataFrame:
    elig = features.eligible_products(d.daily)
    return features.densify(d.daily.join(elig.select("product_id"), "product_id", "left_semi"))


def _model_frame(d: RetailData) -> DataFrame:
    return features.model_frame(d.daily)


def q_eligible_products(spark, sf_dir):
    return features.eligible_products(_data(spark, sf_dir).daily)


def q_densify(spark, sf_dir):
    return _series(_data(spark, sf_dir))


def q_calendar_features(spark, sf_dir):
    return features.calendar_features(_series(_data(spark, sf_dir))).drop("y", "revenue")


def q_lag_features(spark, sf_dir):
    return features.lag_features(_series(_data(spark, sf_dir))).drop("revenue")


def q_rolling_features(spark, sf_dir):
    r = features.rolling_features(_series(_data(spark, sf_dir)))
    return r.select("product_id", "ds", "y", "rolling_7_mean", "rolling_14_mean", "rolling_28_mean",
                    F.round("rolling_7_std", 6).alias("rolling_7_std"), "trend_signal")


def q_feature_split(spark, sf_dir):
    f = _model_frame(_data(spark, sf_dir))
    return f.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~F.col("is_test")).alias("train_rows"),
        F.count_if(F.col("is_test")).alias("test_rows"),
        F.min("ds").alias("first_ds"), F.max("ds").alias("last_ds"))


def q_metrics(spark, sf_dir):
    """FC-6 with the seasonal-naive predictor (y of 7 days before) on each
    product's test split, so SQL can check the metric arithmetic."""
    f = _model_frame(_data(spark, sf_dir)).filter(F.col("is_test"))
    return features.error_metrics(f.withColumn("prediction", F.col("lag_7")))


def _trained(d: RetailData) -> forecasting.TrainedForecast:
    return forecasting.train(d.stored_daily)


def q_forecast(spark, sf_dir):
    """FC-3..5: pooled GBT, 30-day recursive forecast with 95 % bands."""
    t = _trained(_data(spark, sf_dir))
    fc = forecasting.recursive_forecast(t.model, t.history, horizon=30)
    return forecasting.with_bands(fc, t.residual_sd)


def q_forecast_metrics(spark, sf_dir):
    return _trained(_data(spark, sf_dir)).metrics


def q_feature_importance(spark, sf_dir):
    return forecasting.feature_importance(_trained(_data(spark, sf_dir)).model)


def _alerts_table(d: RetailData) -> DataFrame:
    as_of = d.stored_daily.agg(F.max("sale_date")).scalar()
    new = alert_ops.generate_alerts(d.stored_daily)
    return alert_ops.regenerate(None, new, "2001-11-05 00:00:00").withColumn(
        "created_at", (as_of + F.expr("INTERVAL 1 DAY")).cast("timestamp"))


def q_context_kpis(spark, sf_dir):
    return context.context_kpis(_data(spark, sf_dir).sums)


def q_context_top10(spark, sf_dir):
    d = _data(spark, sf_dir)
    return context.context_top_products(d.sums, _products_with_abc(d))


def q_context_trend7(spark, sf_dir):
    d = _data(spark, sf_dir)
    return context.context_trend(d.active_lines, d.stored_daily)


def _context_parts(d: RetailData):
    kpis = context.context_kpis(d.sums)
    counts = alert_ops.open_alert_counts(_alerts_table(d))
    prods = _products_with_abc(d)
    top = context.context_top_products(d.sums, prods)
    return kpis, counts, top, abc_ops.abc_distribution(prods), context.context_trend(d.active_lines, d.stored_daily)


def q_context_json(spark, sf_dir):
    return context.context_document(*_context_parts(_data(spark, sf_dir)))


def q_context_prompts(spark, sf_dir):
    """CTX-8: one daily-summary prompt per day of the recent trend, sharing
    the context document; payload = the day."""
    d = _data(spark, sf_dir)
    parts = _context_parts(d)
    doc = context.context_document(*parts)
    days = parts[4].select(F.col("date").cast("string").alias("payload"))
    return context.prompt_rows(days, doc, "daily_summary").select(
        "payload", "insight_type", "context_hash", F.length("prompt").alias("prompt_chars"), "prompt")


def q_context_digest(spark, sf_dir):
    kpis, counts, top, _, _ = _context_parts(_data(spark, sf_dir))
    return context.context_digest(kpis, counts, top)


def q_alert_export(spark, sf_dir):
    d = _data(spark, sf_dir)
    return exports.alert_export(_alerts_table(d), d.products).withColumn(
        "created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


def q_forecast_export(spark, sf_dir):
    """SNK-1 over a trained run: forecasts table + run record → export rows."""
    d = _data(spark, sf_dir)
    t = _trained(d)
    banded = forecasting.with_bands(forecasting.recursive_forecast(t.model, t.history, 30), t.residual_sd)
    rows = forecasting.forecast_rows(banded, 1)
    now = dt.datetime(2001, 11, 5)
    runs = forecasting.run_record(1, t.metrics, "gbt", 30, now, now)
    as_of = d.daily.agg(F.max("sale_date")).scalar()
    return exports.forecast_export(rows, d.products, runs, as_of=as_of)


def _naive_store(d: RetailData, asked: DataFrame | None = None, daily: DataFrame | None = None) -> str:
    """A store with one run of the seasonal-naive model, which SQL can follow."""
    store = scratch_path(d.spark, f"models-{uuid.uuid4().hex}")
    run = training.run_training(d.stored_daily if daily is None else daily, store, 1, asked, "seasonal_naive", at=RUN_AT)
    if run.status != "completed":
        raise RuntimeError(f"training failed: {run.error}")
    return store


def _money_out(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in ("predicted_quantity", "lower_bound", "upper_bound")})


def q_forecast_naive(spark, sf_dir):
    """FC-4/5/8/9 with the seasonal-naive model: saved, then read with the product header."""
    d = _data(spark, sf_dir)
    t = training.read_store(spark, _naive_store(d))
    rows = forecasting.read_forecasts(t["forecasts"], t["runs"], "seasonal_naive", products=d.products)
    return _money_out(rows).select("product_id", "stock_code", "model_run_id", "forecast_date", "predicted_quantity", "lower_bound", "upper_bound")


def q_training_outcomes(spark, sf_dir):
    """FC-7 over every product, some of them with broken quantities: what became of each."""
    d = _data(spark, sf_dir)
    broken = d.stored_daily.withColumn("total_quantity", F.when(F.col("product_id") % 97 != 0, F.col("total_quantity")))
    t = training.read_store(spark, _naive_store(d, d.products.select("product_id"), broken))
    return t["outcomes"].select("product_id", "outcome", "reason", "days", "last_sale")


def q_training_run(spark, sf_dir):
    """FC-7/11: the run's record."""
    t = training.read_store(spark, _naive_store(_data(spark, sf_dir)))
    r = forecasting.list_runs(t["runs"], 1)
    return r.select("run_id", "model_name", "status", "products_trained", *[F.round(c, 3).alias(c) for c in ("mae", "rmse", "mape")])


def q_forecast_on_demand(spark, sf_dir):
    """FC-9/10: products with 32 daily rows or more are read first, then all eligible ones; a third read trains nothing."""
    d = _data(spark, sf_dir)
    store = scratch_path(spark, f"models-{uuid.uuid4().hex}")
    asked = features.eligible_products(d.stored_daily)
    for part in (asked.filter("daily_rows >= 32"), asked, asked):
        rows, run = training.forecasts_on_demand(d.stored_daily, store, part, "seasonal_naive", at=RUN_AT)
    if run is not None:
        raise RuntimeError("the third read trained again")
    return rows.groupBy("product_id", "model_run_id").agg(
        F.count(F.lit(1)).alias("n_days"), F.min("forecast_date").alias("first_date"), F.max("forecast_date").alias("last_date"))


def q_forecast_export_naive(spark, sf_dir):
    """SNK-1 over the stored run."""
    d = _data(spark, sf_dir)
    t = training.read_store(spark, _naive_store(d))
    return exports.forecast_export(t["forecasts"], d.products, t["runs"], as_of=d.daily.agg(F.max("sale_date")).scalar())


def q_boosted_tree(spark, sf_dir):
    """FC-3 per product: the first tree of two levels, every row and feature used."""
    f = features.model_frame(_data(spark, sf_dir).stored_daily).filter(~F.col("is_test"))
    m = boosting.fit(f, TREE_FEATURES, trees=1, depth=2, rate=0.3, subsample=1, colsample=1)
    return boosting.tree_nodes(m).withColumn("value", F.round("value", 6))


def q_sheet_outcomes(spark, sf_dir):
    """SRC-2/3: an ERP sheet per upload year, a sheet in another layout, and one that names none of the columns."""
    d = _data(spark, sf_dir)
    sheet = erp_sheet_from_facts(d.stored_tx)
    log = superstore_log_from_facts(d.stored_tx)
    cells = [f"c{i}" for i in range(7)]
    row = lambda name, at, df: df.toDF(*cells).select(F.lit(name).alias("file"), at.alias("row_idx"), *cells)
    top = F.lit(0).cast("long")
    rest = F.lit(1) + F.monotonically_increasing_id()
    header = spark.createDataFrame([tuple(log.columns)], ", ".join(f"{c} string" for c in cells))
    nameless = spark.createDataFrame([tuple(f"column {i}" for i in range(7))], header.schema)
    other = row("superstore.csv", rest, log).unionByName(row("superstore.csv", top, header))
    refused = row("notes.xlsx", rest, log).unionByName(row("notes.xlsx", top, nameless))
    return sheet_outcomes(stored(sheet.unionByName(other).unionByName(refused), "sheets"))


def _files(d: RetailData, rows: int) -> int:
    """Files or partitions of at most about ``rows`` rows that the facts fill (from the tables' footers)."""
    return -(-d.table("lineitem").count() // rows)


def _landing(spark: SparkSession, d: RetailData, file_rows: int | None = None) -> str:
    """Land the derived raw log as CSV files (one folder per source file) in
    the shared scratch area, as an upload would.  ``file_rows``: rows that a file is to hold, about;
    else every shuffle partition writes a file for each source file, however few rows it has of it."""
    base = scratch_path(spark, f"landing-{uuid.uuid4().hex}")
    raw = raw_log_from_facts(d.tx, dealt=False).drop("_upload_id").withColumnRenamed("_file", "file")
    # A product's rows of a year lie in one file, so that (product, day) never
    # meets in two micro-batches (DAILY-2 keeps the newest batch's price).
    by = ["file", F.ltrim(F.col("StockCode"), F.lit("="))]
    n = _files(d, FILE_ROWS)
    if file_rows is not None:
        sizes = [r["row_count"] for r in d.uploads.select("row_count").collect()]  # a row per source file
        parts = max(1, -(-max(sizes, default=0) // file_rows))
        raw = raw.repartition(parts * max(1, len(sizes)), "file", F.pmod(F.hash(by[1]), F.lit(parts)))
    else:
        raw = raw.repartition(*by) if n <= int(spark.conf.get("spark.sql.shuffle.partitions")) else raw.repartition(n, *by)
    raw.write.partitionBy("file").option("header", True).csv(base)
    return base


def q_ingest_daily(spark, sf_dir):
    """JOB-1 end to end: gate → CSV scan → clean → upsert → facts → daily."""
    from tillcast.plans.ingest import ingest_upload, merged_daily
    d = _data(spark, sf_dir)
    landing = _landing(spark, d)
    out = scratch_path(spark, f"ingest-{uuid.uuid4().hex}")
    res = ingest_upload(spark, landing, 1, d.products, out)
    if res.status != "completed":
        raise RuntimeError(f"ingest failed: {res.error}")
    return _daily_out(merged_daily(spark, res.daily_path))


def q_stream_daily(spark, sf_dir):
    """STR-1 with availableNow: the landed files as a stream, 16 files per
    micro-batch, daily table merged on read.  A file holds ``FILE_ROWS`` rows where the facts fill it: the number of
    batches follows the facts, not the session's shuffle partitions."""
    from tillcast.schemas import RAW_LOG_COLUMNS
    from tillcast.streaming.ingest_stream import merged_daily, start_ingest_stream
    d = _data(spark, sf_dir)
    landing = _landing(spark, d, FILE_ROWS)
    out = scratch_path(spark, f"stream-{uuid.uuid4().hex}")
    q = start_ingest_stream(spark, landing + "/file=*", RAW_LOG_COLUMNS, d.products, out, files_per_trigger=16)
    q.awaitTermination()
    return _daily_out(merged_daily(spark, out))


def q_stream_compacted(spark, sf_dir):
    """STR-1 with days that cross micro-batches: the landed files hold an invoice's rows each, so
    a (product, day) comes in several batches; the old ones are folded twice.  The price, which the newest batch sets, is left out."""
    from tillcast.schemas import RAW_LOG_COLUMNS
    from tillcast.streaming.ingest_stream import compact_daily, merged_daily, start_ingest_stream
    d = _data(spark, sf_dir)
    landing, out = (scratch_path(spark, f"{k}-{uuid.uuid4().hex}") for k in ("landing", "stream"))
    # Three batches, of as many files (two at least) as keep each below the gate's limit.
    a_batch = 2 * max(1, -(-_files(d, FILE_ROWS) // 6))
    raw_log_from_facts(d.tx).drop("_upload_id", "_file").repartition(3 * a_batch, "InvoiceNo").write.option("header", True).csv(landing)
    start_ingest_stream(spark, landing, RAW_LOG_COLUMNS, d.products, out, files_per_trigger=a_batch).awaitTermination()
    if compact_daily(spark, out, 0) != 0 or compact_daily(spark, out) != 1:
        raise RuntimeError("three batches were expected")
    return _daily_out(merged_daily(spark, out)).drop("avg_unit_price")


def q_ingest_layouts(spark, sf_dir):
    """JOB-1 over one folder whose files differ: even upload years have their
    columns in another order and under alias names.  Same result as one layout."""
    from tillcast.plans.ingest import ingest_upload, merged_daily
    d = _data(spark, sf_dir)
    landing = scratch_path(spark, f"landing-{uuid.uuid4().hex}")
    raw = raw_log_from_facts(d.stored_tx).withColumnRenamed("_file", "file")
    even = F.col("_upload_id") % 2 == 0
    raw.filter(~even).drop("_upload_id").write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("file").option("header", True).csv(landing)
    other = raw.filter(even).select("file", F.col("Customer ID").alias("customer_id"), F.col("Price").alias("UnitPrice"), "Country",
                                    F.col("InvoiceDate").alias("Order Date"), F.col("StockCode").alias("Product ID"), "Quantity",
                                    "Description", F.col("InvoiceNo").alias("invoice_no"))
    other.write.mode("append").option("maxRecordsPerFile", FILE_ROWS).partitionBy("file").option("header", True).csv(landing)
    res = ingest_upload(spark, landing, 1, d.products, scratch_path(spark, f"ingest-{uuid.uuid4().hex}"))
    if res.status != "completed":
        raise RuntimeError(f"ingest failed: {res.error}")
    return _daily_out(merged_daily(spark, res.daily_path))


def q_ingest_wide(spark, sf_dir):
    """JOB-1 over files with 78 columns more than they need, the needed ones last."""
    from tillcast.plans.ingest import ingest_upload, merged_daily
    d = _data(spark, sf_dir)
    landing = scratch_path(spark, f"landing-{uuid.uuid4().hex}")
    raw = raw_log_from_facts(d.tx).withColumnRenamed("_file", "file").drop("_upload_id")
    needed = [c for c in raw.columns if c != "file"]
    raw.select("file", *[F.lit(i).alias(f"extra {i}") for i in range(78)], *needed).write.option("maxRecordsPerFile", WIDE_FILE_ROWS).partitionBy("file").option("header", True).csv(landing)
    res = ingest_upload(spark, landing, 1, d.products, scratch_path(spark, f"ingest-{uuid.uuid4().hex}"))
    if res.status != "completed":
        raise RuntimeError(f"ingest failed: {res.error}")
    return _daily_out(merged_daily(spark, res.daily_path))


def q_ingest_repeated_header(spark, sf_dir):
    """JOB-1 over files whose header line comes again: its date is none, which fails the load; the report counts them."""
    from tillcast.plans.ingest import ingest_upload
    d = _data(spark, sf_dir)
    landing = scratch_path(spark, f"landing-{uuid.uuid4().hex}")
    raw = raw_log_from_facts(d.stored_tx).withColumnRenamed("_file", "file").drop("_upload_id")
    again = raw.select("file").distinct().select("file", *[F.lit(c).alias(c) for c in raw.columns if c != "file"])
    raw.unionByName(again).write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("file").option("header", True).csv(landing)
    res = ingest_upload(spark, landing, 1, d.products, scratch_path(spark, f"ingest-{uuid.uuid4().hex}"))
    return res.report.select("type", "message", "fatal", "affected_rows", F.lit(res.status).alias("status"))


def q_sheet_fallback(spark, sf_dir):
    """SRC-3: a sheet without a marker row goes through the standard cleaning."""
    log = superstore_log_from_facts(_data(spark, sf_dir).tx)
    cells = [f"c{i}" for i in range(len(log.columns))]
    file = F.lit("superstore.csv").alias("file")
    header = spark.createDataFrame([tuple(log.columns)], ", ".join(f"{c} string" for c in cells))
    sheet = log.toDF(*cells).select(file, (F.lit(1) + F.monotonically_increasing_id()).alias("row_idx"), *cells).unionByName(
        header.select(file, F.lit(0).cast("long").alias("row_idx"), *cells))
    rows = sheet_fallback(stored(sheet, "sheet"))
    return _clean_out(cleaning.clean_staged(rows, scratch_path(spark, f"clean-{uuid.uuid4().hex}"), file_col="_file").accepted)


def q_erp_mapping(spark, sf_dir):
    """SRC-2: ERP sheets (title, header, bills, subtotal) mapped to log rows."""
    rows, _ = map_erp_sheet(stored(erp_sheet_from_facts(_data(spark, sf_dir).stored_tx), "sheet"))
    return rows.select(
        "file", F.col("InvoiceNo").alias("invoice_no"), F.col("StockCode").alias("stock_code"),
        F.col("Description").alias("description"), F.col("Quantity").alias("quantity"),
        F.date_format("InvoiceDate", "yyyy-MM-dd HH:mm:ss").alias("invoice_date"), F.col("Price").alias("price"),
        F.col("`Customer ID`").alias("customer_id"), F.col("Country").alias("country"), "is_return", "revenue")


def q_context_parts(spark, sf_dir):
    """CTX-4/5: the figures of the context document, read back from its JSON; whether its hash is that of the text."""
    doc = context.context_document(*_context_parts(_data(spark, sf_dir)))
    schema = ("abc_distribution map<string,bigint>, alerts_summary array<struct<count:bigint,severity:string,type:string>>, "
              "kpis struct<avg_order_value:double,total_revenue:double,total_transactions:bigint>, "
              "recent_7day_revenue array<struct<date:string,revenue:double>>, "
              "top_10_products array<struct<abc_class:string,description:string,quantity:bigint,revenue:double,stock_code:string>>")
    j = doc.select(F.from_json("context", schema).alias("c"), (F.sha2("context", 256) == F.col("context_hash")).alias("same"))
    parts = F.concat(
        F.transform(F.map_entries("c.abc_distribution"), lambda x: _part("abc", x["key"], x["value"])),
        F.transform("c.alerts_summary", lambda x: _part("alerts", F.concat_ws("/", x["type"], x["severity"]), x["count"])),
        F.array(*[_part("kpis", F.lit(k), F.col(f"c.kpis.{k}")) for k in ("avg_order_value", "total_revenue", "total_transactions")]),
        F.transform("c.recent_7day_revenue", lambda x: _part("trend", x["date"], x["revenue"])),
        F.transform("c.top_10_products", lambda x: _part("top", F.concat_ws("/", x["stock_code"], x["abc_class"], x["description"]), x["revenue"])),
        F.array(_part("hash", F.lit("same"), F.col("same").cast("int"))))
    return j.select(F.explode(parts).alias("p")).select("p.*")


def _part(name: str, key, value):
    return F.struct(F.lit(name).alias("part"), key.cast("string").alias("item"), value.cast("double").alias("figure"))


def q_forecast_payloads(spark, sf_dir):
    """CTX-8, forecast explanation: the payload of every product's prompt read back, and whether the prompt holds it."""
    d = _data(spark, sf_dir)
    t = training.read_store(spark, _naive_store(d))
    payload = context.forecast_payload(t["forecasts"], d.products)
    doc = context.context_document(*_context_parts(d))
    prompts = context.prompt_rows(payload, doc, "forecast_explain")
    schema = ("forecast array<struct<date:string,lower:double,predicted:double,upper:double>>, "
              "product struct<stock_code:string,description:string,current_stock:int,lead_time_days:int>")
    j = prompts.select("product_id", F.from_json("payload", schema).alias("p"), F.contains("prompt", "payload").alias("in_prompt"))
    return j.select("product_id", "p.product.*", "in_prompt", F.explode("p.forecast").alias("f")).select(
        "product_id", "stock_code", "description", "current_stock", "lead_time_days", "in_prompt", "f.date", "f.lower", "f.predicted", "f.upper")


def q_question_prompts(spark, sf_dir):
    """CTX-8, questions: one prompt per product of the top 10, all over one context document, told apart by hash."""
    d = _data(spark, sf_dir)
    parts = _context_parts(d)
    asked = parts[2].select(F.concat(F.lit("How much of "), "stock_code", F.lit(" should be bought?")).alias("payload"))
    p = context.prompt_rows(asked, context.context_document(*parts), "product_qa")
    n = p.agg(F.count_distinct("context_hash")).scalar()
    return p.select("payload", "insight_type", F.contains("prompt", "payload").alias("in_prompt"), (n == 10).alias("own_hashes"))


def q_cache_cycle(spark, sf_dir):
    """CTX-6/7: an answer per product cached on its last sale day; half a day after the newest sale every product asks again."""
    d = _data(spark, sf_dir)
    key = F.sha2("stock_code", 256).alias("context_hash")
    last = d.stored_daily.groupBy("product_id").agg(F.max("sale_date").alias("d"), F.min("sale_date").alias("first"))
    rows = last.join(d.products, "product_id")
    entry = lambda at: rows.select(F.lit("qa").alias("insight_type"), key, F.lit("p").alias("prompt"), F.date_format(at, "yyyy-MM-dd").alias("response"),
                                   F.lit("m").alias("model_used"), F.lit(1).cast("long").alias("tokens_used"), F.col(at).cast("timestamp").alias("created_at"))
    cache = context.cache_upsert(entry("first"), entry("d"))
    newest = last.agg(F.max("d").alias("m")).first()["m"]          # one scalar
    hits, misses = context.cache_lookup(d.products.select("stock_code", key), cache, dt.datetime.combine(newest, dt.time(12)))
    return hits.select("stock_code", F.lit(True).alias("hit"), "response").unionByName(
        misses.select("stock_code", F.lit(False).alias("hit"), F.lit(None).cast("string").alias("response")))


def q_registry_cycle(spark, sf_dir):
    """REG-1/3/4: a new upload is registered and fails, the then newest other one is deleted, the newest left is active."""
    d = _data(spark, sf_dir)
    reg = registry.register_upload(d.uploads, 99, "new.csv", 10, RUN_AT)
    reg = registry.set_status(reg, 99, "failed", "no rows", RUN_AT)
    reg, _, _, _ = registry.delete_upload(reg, d.lines, d.products, 7)
    reg, _, _, _ = registry.delete_upload(reg, d.lines, d.products, 99)
    return registry.list_uploads(reg).select("upload_id", "filename", "status", "row_count", "is_active")


def q_delete_cascade(spark, sf_dir):
    """REG-3: all uploads but the first are deleted one after another; what each step orphans, and the forecasts that stay."""
    d = _data(spark, sf_dir)
    reg, facts, prods, gone = d.uploads, d.lines, d.products, None
    forecasts = prods.select("product_id", F.lit(1.0).alias("predicted"))
    for u in range(7, 1, -1):
        out = registry.delete_upload_cascade(reg, facts, prods, u, {"forecasts": forecasts})
        reg, facts, prods, forecasts = out["uploads"], out["facts"], out["products"], out["forecasts"]
        step = out["orphans"].select("product_id", F.lit(u).cast("long").alias("orphaned_with"))
        gone = step if gone is None else gone.unionByName(step)
    left = forecasts.select("product_id", F.lit(None).cast("long").alias("orphaned_with"))
    return gone.unionByName(left)


def q_alerts_resolved(spark, sf_dir):
    """ALERT-5/6/8: medium alerts are resolved, the same alerts are added again (none twice), the open ones listed."""
    d = _data(spark, sf_dir)
    fresh = alert_ops.generate_alerts(d.stored_daily)
    alerts = alert_ops.regenerate(None, fresh, "2001-11-05 00:00:00")
    done = alert_ops.resolve(alerts, alerts.filter(F.col("severity") == "medium"), RUN_AT)
    again = alert_ops.append_alerts(done, fresh, "2001-11-05 00:00:00")
    return again.groupBy("alert_type", "severity", "is_resolved").agg(
        F.count(F.lit(1)).alias("n"), F.count("resolved_at").alias("n_resolved_at"))


def q_alerts_listed(spark, sf_dir):
    """ALERT-5: the open reorder alerts with their products, up to the page's limit."""
    d = _data(spark, sf_dir)
    alerts = alert_ops.regenerate(None, alert_ops.stockout_alerts(d.stored_daily), "2001-11-05 00:00:00")
    return alert_ops.list_alerts(alerts, d.products, "stockout_risk", limit=500).select("product_id", "stock_code", "severity", "message", "is_resolved")


def q_revenue_labels(spark, sf_dir):
    """PROD-6: the revenue label of every product with sales."""
    rev = analytics.product_revenue(_data(spark, sf_dir).sums, _data(spark, sf_dir).products)
    return rev.select("product_id", compact_currency(F.col("total_revenue")).alias("label"))


def q_strict_scrub(spark, sf_dir):
    """CLEAN-11: descriptions behind a run of formula signs and blanks."""
    part = _data(spark, sf_dir).products
    dirty = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("= =", "+ @", "\t-\r=", " @ ")]), (F.col("product_id") % 4 + 1).cast("int")), "description", F.lit("  "))
    return part.select("product_id", scrub_formula(dirty, strict=True).alias("clean"))


def q_keyset_pages(spark, sf_dir):
    """PROD-2 by key: every page of 50 products, each sought from the last row of the page before."""
    d = _data(spark, sf_dir)
    listed = prod_ops.product_list(d.products, d.stored_daily)
    pages = prod_ops.keyset_pages(listed, 50)
    return pages.select("page", "product_id", "total_revenue")


QUERIES: dict[str, QueryFn] = {
    "daily_sales": q_daily_sales,
    "top_products": q_top_products,
    "top_products_search": q_top_products_search,
    "kpis": q_kpis,
    "kpis_range": q_kpis_range,
    "kpis_consistent": q_kpis_consistent,
    "kpis_active": q_kpis_active,
    "kpis_direct": q_kpis_direct,
    "unique_invoices": q_unique_invoices,
    "top_country": q_top_country,
    "trend_daily": _trend("daily"),
    "trend_weekly_iso": _trend("weekly"),
    "trend_weekly_w": _trend("weekly_w"),
    "trend_monthly": _trend("monthly"),
    "abc": q_abc,
    "abc_summary": q_abc_summary,
    "abc_distribution": q_abc_distribution,
    "slow_movers": q_slow_movers,
    "slow_movers_30": q_slow_movers_30,
    "anomalies": q_anomalies,
    "product_list": q_product_list,
    "product_list_all": q_product_list_all,
    "product_page2": q_product_page2,
    "product_search": q_product_search,
    "product_pages": q_product_pages,
    "product_detail": q_product_detail,
    "product_history": q_product_history,
    "stock_status": q_stock_status,
    "alerts_reorder": q_alerts_reorder,
    "alerts_stockout": q_alerts_stockout,
    "alerts_slow": q_alerts_slow,
    "alerts_all": q_alerts_all,
    "alert_counts": q_alert_counts,
    "uploads": q_uploads,
    "switch_active": q_switch_active,
    "daily_merge": q_daily_merge,
    "delete_upload_orphans": q_delete_upload_orphans,
    "clean_accept": q_clean_accept,
    "clean_report": q_clean_report,
    "clean_summary": q_clean_summary,
    "clean_superstore": q_clean_superstore,
    "product_upsert": q_product_upsert,
    "product_upsert_incremental": q_product_upsert_incremental,
    "product_upsert_second": q_product_upsert_second,
    "alerts_slow_all_time": q_alerts_slow_all_time,
    "missing_orders": q_missing_orders,
    "fact_build": q_fact_build,
    "eligible_products": q_eligible_products,
    "densify": q_densify,
    "calendar_features": q_calendar_features,
    "lag_features": q_lag_features,
    "rolling_features": q_rolling_features,
    "feature_split": q_feature_split,
    "metrics": q_metrics,
    "forecast": q_forecast,
    "forecast_metrics": q_forecast_metrics,
    "feature_importance": q_feature_importance,
    "context_kpis": q_context_kpis,
    "context_top10": q_context_top10,
    "context_trend7": q_context_trend7,
    "context_json": q_context_json,
    "context_digest": q_context_digest,
    "context_prompts": q_context_prompts,
    "alert_export": q_alert_export,
    "forecast_export": q_forecast_export,
    "ingest_daily": q_ingest_daily,
    "stream_daily": q_stream_daily,
    "ingest_layouts": q_ingest_layouts,
    "stream_compacted": q_stream_compacted,
    "sheet_fallback": q_sheet_fallback,
    "erp_mapping": q_erp_mapping,
    "forecast_naive": q_forecast_naive,
    "training_outcomes": q_training_outcomes,
    "training_run": q_training_run,
    "forecast_on_demand": q_forecast_on_demand,
    "forecast_export_naive": q_forecast_export_naive,
    "boosted_tree": q_boosted_tree,
    "sheet_outcomes": q_sheet_outcomes,
    "context_parts": q_context_parts,
    "forecast_payloads": q_forecast_payloads,
    "question_prompts": q_question_prompts,
    "cache_cycle": q_cache_cycle,
    "registry_cycle": q_registry_cycle,
    "delete_cascade": q_delete_cascade,
    "alerts_resolved": q_alerts_resolved,
    "alerts_listed": q_alerts_listed,
    "revenue_labels": q_revenue_labels,
    "strict_scrub": q_strict_scrub,
    "keyset_pages": q_keyset_pages,
    "ingest_wide": q_ingest_wide,
    "ingest_repeated_header": q_ingest_repeated_header,
}
