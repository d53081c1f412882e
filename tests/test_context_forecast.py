"""CTX-4..8, FC-3..11 and the driver contract."""

import datetime as dt

from pyspark.sql import functions as F

from tillcast import schemas
from tillcast.operators import context, forecasting

NOW = dt.datetime(2024, 3, 1, 12, 0)


def test_cache_ttl(spark):
    cache = spark.createDataFrame([
        ("product_qa", "h1", "p", "r1", "m", 1, NOW - dt.timedelta(hours=23)),
        ("product_qa", "h2", "p", "r2", "m", 1, NOW - dt.timedelta(hours=25))], schemas.AI_INSIGHTS)
    req = spark.createDataFrame([("h1",), ("h2",), ("h3",)], "context_hash string")
    hits, misses = context.cache_lookup(req, cache, NOW)
    assert [r["context_hash"] for r in hits.collect()] == ["h1"]
    assert sorted(r["context_hash"] for r in misses.collect()) == ["h2", "h3"]
    newer = spark.createDataFrame([("product_qa", "h1", "p", "r9", "m", 2, NOW)], schemas.AI_INSIGHTS)
    up = context.cache_upsert(cache, newer)
    assert up.count() == 2 and up.filter("context_hash = 'h1'").first()["response"] == "r9"


def test_context_document_is_canonical(spark):
    kpis = spark.createDataFrame([(10.0, 2, 5.0)], "total_revenue double, total_transactions long, avg_order_value double")
    counts = spark.createDataFrame([("reorder_needed", "low", 3)], "alert_type string, severity string, alert_count long")
    top = spark.createDataFrame([("A", "a", "A", 10.0, 2)], "stock_code string, description string, abc_class string, "
                                                            "revenue double, quantity long")
    abc = spark.createDataFrame([("A", 1)], "abc_class string, product_count long")
    trend = spark.createDataFrame([(dt.date(2024, 1, 1), 10.0)], "date date, revenue double")
    doc = context.context_document(kpis, counts, top, abc, trend).first()
    import hashlib
    import json
    parsed = json.loads(doc["context"])
    assert list(parsed) == sorted(parsed)
    assert parsed["kpis"]["total_revenue"] == 10.0 and parsed["abc_distribution"] == {"A": 1}
    assert doc["context_hash"] == hashlib.sha256(doc["context"].encode()).hexdigest()
    req = spark.createDataFrame([("why?",)], "payload string")
    p = context.prompt_rows(req, context.context_document(kpis, counts, top, abc, trend), "product_qa").first()
    assert "why?" in p["prompt"] and len(p["context_hash"]) == 64
    d = context.context_digest(kpis, counts, top).first()
    assert (d["active_alerts"], d["top_products_included"]) == (3, 1)


def test_forecast_end_to_end(spark, scratch):
    days = 200
    d0 = dt.date(2023, 1, 1)
    rows = []
    for p in (1, 2):
        for i in range(days):
            day = d0 + dt.timedelta(days=i)
            rows.append((p, day, 10 * p + (5 if day.weekday() >= 5 else 0), 1.0))
    rows += [(3, d0 + dt.timedelta(days=i), 3, 1.0) for i in range(59)]
    daily = spark.createDataFrame(rows, "product_id long, sale_date date, total_quantity long, total_revenue double")
    t = forecasting.train(daily, max_iter=10)
    fc = forecasting.with_bands(forecasting.recursive_forecast(t.model, t.history, horizon=30), t.residual_sd)
    out = fc.collect()
    assert len(out) == 60 and {r["product_id"] for r in out} == {1, 2}     # 59-day product excluded
    assert all(r["lower_bound"] <= r["predicted_quantity"] <= r["upper_bound"] and r["lower_bound"] >= 0 for r in out)
    m = {r["product_id"]: r for r in t.metrics.collect()}
    assert set(m) == {1, 2}
    # better than predicting each product's mean on its test rows
    pred = t.predictions.select("product_id", "y").collect()
    for p in (1, 2):
        ys = [r["y"] for r in pred if r["product_id"] == p]
        mean = sum(ys) / len(ys)
        assert m[p]["mae"] < sum(abs(y - mean) for y in ys) / len(ys)
    imp = forecasting.feature_importance(t.model).collect()
    assert len(imp) == len(forecasting.MODEL_FEATURES) and imp[0]["importance"] >= imp[-1]["importance"]
    path = scratch + "/model"
    forecasting.save_model(t.model, path)
    assert forecasting.load_model(path).numFeatures == len(forecasting.MODEL_FEATURES)
    # runs: two completed and one running for the same product; reads skip the running one
    rows_ = forecasting.forecast_rows(fc, 1).unionByName(forecasting.forecast_rows(fc, 2)).unionByName(
        forecasting.forecast_rows(fc, 3))
    runs = forecasting.run_record(1, t.metrics, "gbt", 30, NOW, NOW).unionByName(
        forecasting.run_record(2, t.metrics, "gbt", 30, NOW + dt.timedelta(hours=1), NOW + dt.timedelta(hours=1))
    ).unionByName(forecasting.run_record(3, t.metrics, "gbt", 30, NOW + dt.timedelta(hours=2),
                                         NOW + dt.timedelta(hours=2), status="running"))
    read = forecasting.read_forecasts(rows_, runs)
    assert {r["model_run_id"] for r in read.collect()} == {2}
    assert forecasting.list_runs(runs, 2).first()["run_id"] == 3
    forecasting.save_forecasts(rows_, scratch + "/fc")
    forecasting.save_forecasts(forecasting.forecast_rows(fc, 2), scratch + "/fc")   # replace run 2 only
    assert spark.read.parquet(scratch + "/fc").count() == 180
    t.release()


def test_driver_contract(spark):
    import __spark_entry__ as E
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 50
    df = E.entry(spark)
    assert df.columns == ["rank", "product_id", "stock_code", "description", "abc_class", "total_revenue",
                          "total_quantity"]
    assert df.count() > 0
