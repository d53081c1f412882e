"""The correctness gate in miniature: registered queries vs their DuckDB SQL
on the smallest driver tables (the full run is scripts/check_oracle.py)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

SF = "/root/testdata/sf0.001"
NAMES = ["daily_sales", "kpis_range", "top_products", "trend_weekly_w", "abc", "slow_movers", "anomalies",
         "product_page2", "stock_status", "alerts_all", "clean_report", "fact_build", "rolling_features",
         "metrics", "context_top10", "daily_merge", "erp_mapping"]


@pytest.fixture(scope="module")
def gate(spark):
    if not os.path.isdir(SF):
        pytest.skip("driver tables not available")
    import __spark_entry__ as E
    from check_oracle import compare, duck_connection
    return compare, duck_connection(SF), E.queries(), E.oracle_sql()


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, gate, name):
    compare, con, qs, sqls = gate
    status, detail = compare(spark, con, name, SF, qs, sqls)
    assert status == "OK", detail
