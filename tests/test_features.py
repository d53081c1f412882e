"""TS-1..7, FC-6, ANOM-1 and the distributed order statistics."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tillcast.operators import features, movement
from tillcast.operators.ordered import exact_quantiles, global_prefix

D0 = dt.date(2024, 1, 1)


def daily_df(spark, rows):
    return spark.createDataFrame(rows, "product_id long, sale_date date, total_quantity long, total_revenue double")


def test_densify_gap_and_clip(spark):
    d = daily_df(spark, [(1, D0, 3, 3.0), (1, D0 + dt.timedelta(days=5), -2, -2.0), (1, D0 + dt.timedelta(days=6), 4, 4.0)])
    s = features.densify(d).orderBy("ds").collect()
    assert len(s) == 7
    assert [r["y"] for r in s] == [3.0, 0, 0, 0, 0, 0.0, 4.0]
    assert s[5]["revenue"] == -2.0


def test_lags_rolling_split(spark):
    d = daily_df(spark, [(1, D0 + dt.timedelta(days=i), i + 1, 1.0) for i in range(40)])
    f = features.engineer_features(features.densify(d)).orderBy("ds")
    rows = f.collect()
    assert len(rows) == 12
    assert rows[0]["rolling_7_mean"] == 25.0 and rows[0]["lag_28"] == 1.0
    assert rows[0]["day_of_week"] == (D0 + dt.timedelta(days=28)).weekday()
    sp = features.split_train_test(f)
    assert sp.filter(~F.col("is_test")).count() == 9 and sp.filter("is_test").count() == 3


def test_rolling_std_matches_pandas(spark):
    import pandas as pd
    vals = [random.Random(7).randint(0, 9) for _ in range(30)]
    d = daily_df(spark, [(1, D0 + dt.timedelta(days=i), v, 0.0) for i, v in enumerate(vals)])
    got = [r["rolling_7_std"] for r in features.rolling_features(features.densify(d)).orderBy("ds").collect()]
    ref = pd.Series(vals, dtype=float).shift(1).rolling(7, min_periods=2).std().fillna(0).tolist()
    assert np.allclose(got, ref)


def test_metrics(spark):
    p = spark.createDataFrame([(1, 0.0, 1.0), (1, 2.0, 1.0), (1, 4.0, 5.0)], "product_id long, y double, prediction double")
    m = features.error_metrics(p).first()
    assert (m["mae"], m["rmse"], m["mape"]) == (1.0, 1.0, 37.5)


def test_anomalies(spark):
    rows = [(1, D0 + dt.timedelta(days=i), 10, 0.0) for i in range(12)] + [(1, D0 + dt.timedelta(days=12), 100, 0.0)]
    rows += [(2, D0 + dt.timedelta(days=i), 5, 0.0) for i in range(15)]
    rows += [(3, D0 + dt.timedelta(days=i), i, 0.0) for i in range(9)]
    out = movement.sales_anomalies(daily_df(spark, rows)).collect()
    assert [(r["product_id"], r["direction"]) for r in out] == [(1, "spike")]


def test_global_prefix_matches_single_window(spark):
    rnd = random.Random(1)
    data = [(i, rnd.randint(0, 50)) for i in range(500)]
    df = spark.createDataFrame(data, "id long, v long")
    got = global_prefix(df, [F.col("v").desc(), F.col("id")], sum_cols=["v"], total_col="n", buckets=7)
    ref = df.withColumn("rn", F.row_number().over(Window.orderBy(F.col("v").desc(), "id"))) \
            .withColumn("cs", F.sum("v").over(Window.orderBy(F.col("v").desc(), "id")
                                              .rowsBetween(Window.unboundedPreceding, 0)))
    j = got.join(ref, "id").collect()
    assert all(r["_pos"] == r["rn"] and r["cum_v"] == r["cs"] and r["n"] == 500 for r in j)


def test_exact_quantiles_match_numpy(spark):
    vals = [random.Random(3).random() * 100 for _ in range(101)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id long, v double")
    q = exact_quantiles(df, "v", [0.25, 0.75], tie_break="id", buckets=5).first()
    assert abs(q["q_0"] - np.percentile(vals, 25)) < 1e-9 and abs(q["q_1"] - np.percentile(vals, 75)) < 1e-9


def test_slow_movers_flags_low_velocity(spark):
    rows = [(p, D0 + dt.timedelta(days=i), 9 + p, 0.0) for p in range(1, 9) for i in range(5)]
    rows += [(9, D0, 0, 0.0)]
    out = movement.slow_movers(daily_df(spark, rows), lookback_days=30, as_of=D0 + dt.timedelta(days=5)).collect()
    assert [(r["product_id"], r["severity"]) for r in out] == [(9, "high")]


def test_global_prefix_without_exchange_reuse(spark):
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        df = spark.createDataFrame([(i, (i * 37) % 11) for i in range(200)], "id long, v long")
        got = global_prefix(df, [F.col("v"), F.col("id")], sum_cols=["v"], total_col="n", buckets=5).collect()
        ref = sorted(((r["v"], r["id"]) for r in df.collect()))
        pos = {r["id"]: r["_pos"] for r in got}
        assert [pos[i] for _, i in ref] == list(range(1, 201))
    finally:
        spark.conf.set("spark.sql.exchange.reuse", "true")


def test_slow_movers_approx_quartiles(spark):
    rows = [(p, D0 + dt.timedelta(days=i), 9 + p, 0.0) for p in range(1, 9) for i in range(5)] + [(9, D0, 0, 0.0)]
    out = movement.slow_movers(daily_df(spark, rows), lookback_days=30, as_of=D0 + dt.timedelta(days=5),
                               approx_quartiles=True).collect()
    assert [r["product_id"] for r in out] == [9]
