"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Each statement starts with the same adapter CTEs as
``tillcast.sources.tpch`` (money in integer cents) and then computes the
operator the plain relational way (global windows, quantile_cont, ...).
Rounding uses ``round_even`` (Python's ``round``) to match ``bround``.
"""

from __future__ import annotations

PRELUDE = """
WITH tx AS (
  SELECT CAST(l.l_orderkey AS VARCHAR) AS invoice_no,
         CAST(l.l_partkey AS BIGINT) AS product_id,
         CASE WHEN l.l_returnflag = 'R' THEN -CAST(l.l_quantity AS BIGINT)
              ELSE CAST(l.l_quantity AS BIGINT) END AS quantity,
         CAST(round(l.l_extendedprice * 100) AS BIGINT) // CAST(l.l_quantity AS BIGINT) AS unit_cents,
         l.l_shipdate AS invoice_date,
         CAST(o.o_custkey AS VARCHAR) AS customer_id,
         n.n_name AS country,
         (l.l_returnflag = 'R') AS is_return,
         CAST(year(l.l_shipdate) - 1994 AS BIGINT) AS upload_id
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
),
txr AS (SELECT *, unit_cents * quantity AS rev_cents FROM tx),
products AS (
  SELECT CAST(p_partkey AS BIGINT) AS product_id,
         'SKU' || CAST(p_partkey AS VARCHAR) AS stock_code,
         p_name AS description, p_type AS category,
         CAST(p_partkey * 37 % 200 AS INTEGER) AS current_stock,
         CAST(3 + p_partkey % 19 AS INTEGER) AS lead_time_days,
         CAST(p_partkey * 13 % 40 AS INTEGER) AS safety_stock,
         greatest(0.1, 0.4 * p_retailprice) AS unit_cost
  FROM part
),
sales AS (SELECT * FROM txr WHERE NOT is_return AND quantity > 0),
daily AS (
  SELECT product_id, CAST(invoice_date AS DATE) AS sale_date,
         CAST(SUM(quantity) AS BIGINT) AS total_quantity,
         SUM(rev_cents) AS rev_cents,
         CAST(COUNT(*) AS BIGINT) AS transaction_count,
         (2 * SUM(unit_cents) + COUNT(*)) // (2 * COUNT(*)) AS price_cents
  FROM sales GROUP BY 1, 2
),
active AS (
  SELECT upload_id FROM (SELECT upload_id, max(invoice_date) AS m FROM tx GROUP BY 1)
  ORDER BY m DESC, upload_id DESC LIMIT 1
),
ref_day AS (SELECT max(sale_date) AS d FROM daily),
prodrev AS (
  SELECT product_id, SUM(rev_cents) AS rc, SUM(quantity) AS q FROM sales
  WHERE product_id IN (SELECT product_id FROM products) GROUP BY 1
),
abc AS (
  SELECT product_id, rc,
         (CAST(SUM(rc) OVER (ORDER BY rc DESC, product_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) / 100)
           / (CAST(SUM(rc) OVER () AS DOUBLE) / 100) * 100 AS cum_pct,
         CAST(SUM(rc) OVER () AS DOUBLE) / 100 AS tot
  FROM prodrev
),
abc_cls AS (
  SELECT product_id, rc, cum_pct, tot,
         CASE WHEN cum_pct <= 80 THEN 'A' WHEN cum_pct <= 95 THEN 'B' ELSE 'C' END AS abc_class
  FROM abc
),
products_abc AS (
  SELECT p.*, a.abc_class FROM products p LEFT JOIN abc_cls a USING (product_id)
),
prodsales AS (
  SELECT product_id, SUM(rev_cents) AS rc, CAST(SUM(total_quantity) AS BIGINT) AS tq,
         AVG(CAST(total_quantity AS DOUBLE)) AS avg_daily_sales, max(sale_date) AS last_sale_date,
         CAST(COUNT(*) AS BIGINT) AS active_days
  FROM daily GROUP BY 1
)
"""


def _daily_cols(src: str) -> str:
    return f"""SELECT product_id, sale_date, total_quantity, CAST(rev_cents AS DOUBLE) / 100 AS total_revenue,
       transaction_count, CAST(price_cents AS DOUBLE) / 100 AS avg_unit_price FROM {src}"""


def _top(n: int) -> str:
    return f"""
SELECT CAST(rank() OVER (ORDER BY t.rc DESC) AS BIGINT) AS rank, t.product_id, p.stock_code, p.description,
       p.abc_class, CAST(t.rc AS DOUBLE) / 100 AS total_revenue, CAST(t.q AS BIGINT) AS total_quantity
FROM (
  SELECT product_id, SUM(rev_cents) AS rc, SUM(quantity) AS q FROM sales
  WHERE upload_id = (SELECT upload_id FROM active) AND product_id IN (SELECT product_id FROM products)
  GROUP BY 1 ORDER BY rc DESC, product_id LIMIT {n}
) t JOIN products_abc p USING (product_id)"""


def _kpis(start: str | None, end: str | None, scope: str) -> str:
    in_range = "TRUE"
    prev = "FALSE"
    if start:
        in_range += f" AND invoice_date >= TIMESTAMP '{start} 00:00:00'"
    if end:
        in_range += (f" AND invoice_date < CAST(DATE '{end}' + INTERVAL 1 DAY AS TIMESTAMP)" if scope == "consistent"
                     else f" AND invoice_date <= TIMESTAMP '{end} 00:00:00'")
    if start and end:
        prev = (f"invoice_date >= CAST(DATE '{start}' - (DATE '{end}' - DATE '{start}' + 1) * INTERVAL 1 DAY AS TIMESTAMP)"
                f" AND invoice_date < TIMESTAMP '{start} 00:00:00'")
    everywhere = "TRUE" if scope == "reference" else f"({in_range})"
    src = "txr" if scope == "reference" else f"(SELECT * FROM txr WHERE ({in_range}) OR ({prev}))"
    country_src = "txr" if scope == "reference" else f"(SELECT * FROM txr WHERE {in_range})"
    sel = f"quantity > 0 AND {in_range}"
    return f"""
, k AS (
  SELECT SUM(CASE WHEN {sel} THEN rev_cents END) AS rev_c,
         SUM(CASE WHEN {sel} THEN quantity END) AS units,
         CAST(COUNT(*) FILTER (WHERE {sel}) AS BIGINT) AS n,
         CAST(COUNT(DISTINCT CASE WHEN {sel} THEN invoice_no END) AS BIGINT) AS unique_invoices,
         CAST(COUNT(*) FILTER (WHERE {everywhere} AND is_return) AS BIGINT) AS return_count,
         SUM(CASE WHEN {everywhere} THEN rev_cents END) AS net_c,
         min(CASE WHEN {everywhere} THEN invoice_date END) AS dmin,
         max(CASE WHEN {everywhere} THEN invoice_date END) AS dmax,
         SUM(CASE WHEN quantity > 0 AND {prev} THEN rev_cents END) AS prev_c
  FROM {src}
),
kk AS (
  SELECT *, coalesce(CAST(rev_c AS DOUBLE) / 100, 0.0) AS rev,
         CAST(prev_c AS DOUBLE) / 100 AS prev,
         CASE WHEN dmin IS NOT NULL THEN CAST(floor((epoch(dmax) - epoch(dmin)) / 86400) AS BIGINT) + 1 ELSE 1 END AS days
  FROM k
),
ctry AS (
  SELECT country FROM (SELECT country, COUNT(*) AS c FROM {country_src} GROUP BY 1) ORDER BY c DESC, country LIMIT 1
)
SELECT rev AS total_revenue, n AS total_transactions,
       (SELECT CAST(COUNT(*) AS BIGINT) FROM products) AS total_products,
       CAST(coalesce(units, 0) AS BIGINT) AS total_units_sold,
       CASE WHEN prev > 0 THEN round_even((rev - prev) / prev * 100, 2) END AS growth_pct,
       round_even(rev / days, 4) AS avg_daily_revenue,
       round_even(CASE WHEN n > 0 THEN rev / n ELSE 0.0 END, 4) AS avg_order_value,
       round_even(CASE WHEN unique_invoices > 0 THEN rev / unique_invoices ELSE 0.0 END, 4) AS avg_invoice_value,
       round_even(CAST(net_c AS DOUBLE) / 100, 2) AS net_revenue,
       round_even(return_count / (CASE WHEN n > 0 THEN n ELSE 1 END) * 100, 2) AS return_rate_pct,
       (SELECT country FROM ctry) AS top_country,
       CAST(dmin AS DATE) AS date_range_start, CAST(dmax AS DATE) AS date_range_end,
       unique_invoices, return_count
FROM kk"""


def _trend(label: str) -> str:
    return f"""
SELECT {label} AS period, CAST(SUM(rev_cents) AS DOUBLE) / 100 AS revenue,
       CAST(SUM(quantity) AS BIGINT) AS quantity, CAST(COUNT(*) AS BIGINT) AS transaction_count
FROM sales WHERE upload_id = (SELECT upload_id FROM active)
GROUP BY 1 ORDER BY 1"""


def _velocity(days: int) -> str:
    return f"""
, per AS (
  SELECT d.product_id, AVG(CAST(total_quantity AS DOUBLE)) AS v, CAST(SUM(total_quantity) AS BIGINT) AS total_sales,
         CAST(COUNT(*) AS BIGINT) AS active_days, max(sale_date) AS last_sale_date
  FROM daily d WHERE sale_date >= (SELECT d FROM ref_day) - INTERVAL {days} DAY
  GROUP BY 1
)"""


SLOW_LOOKBACK_DAYS = 3650


def _slow(days: int) -> str:
    return _velocity(days) + f"""
, perp AS (SELECT per.*, p.stock_code, p.description FROM per JOIN products p USING (product_id)),
bound AS (SELECT quantile_cont(v, 0.25) - 1.5 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) AS b FROM perp)
SELECT product_id, stock_code, description, round_even(v, 4) AS avg_daily_sales, total_sales, active_days,
       last_sale_date, CAST(date_diff('day', last_sale_date, (SELECT d FROM ref_day)) AS BIGINT) AS days_since_last_sale,
       round_even((SELECT b FROM bound), 4) AS threshold,
       CASE WHEN v = 0 THEN 'high' WHEN v < (SELECT b FROM bound) / 2 THEN 'medium' ELSE 'low' END AS severity,
       {days} AS lookback_days
FROM perp WHERE v <= (SELECT b FROM bound)"""


REORDER = """
, r AS (
  SELECT product_id, AVG(CAST(total_quantity AS DOUBLE)) AS a,
         coalesce(stddev_samp(CAST(total_quantity AS DOUBLE)), 0.0) AS s
  FROM daily WHERE sale_date >= (SELECT d FROM ref_day) - INTERVAL 30 DAY GROUP BY 1
),
rr AS (SELECT *, a * 7 + 1.65 * s * sqrt(7.0) AS rop FROM r WHERE a > 0)
SELECT product_id, 'reorder_needed' AS alert_type,
       CASE WHEN a > 50 THEN 'high' WHEN a > 10 THEN 'medium' ELSE 'low' END AS severity,
       'Order at ' || printf('%.1f', round_even(rop, 1)) || ' units: '
         || printf('%.1f', round_even(a, 1)) || ' a day are sold and supply takes 7 days' AS message,
       CAST(greatest(1, round_even(a * 7 * 1.5, 0)) AS BIGINT) AS reorder_qty,
       round_even(rop, 2) AS reorder_point, round_even(a, 4) AS current_velocity
FROM rr WHERE rop >= 1"""

STOCKOUT = """
, s AS (
  SELECT product_id,
         AVG(CASE WHEN sale_date >= (SELECT d FROM ref_day) - INTERVAL 7 DAY THEN CAST(total_quantity AS DOUBLE) END) AS recent,
         AVG(CASE WHEN sale_date BETWEEN (SELECT d FROM ref_day) - INTERVAL 30 DAY AND (SELECT d FROM ref_day) - INTERVAL 8 DAY
                  THEN CAST(total_quantity AS DOUBLE) END) AS prior
  FROM daily WHERE sale_date >= (SELECT d FROM ref_day) - INTERVAL 30 DAY GROUP BY 1
),
ss AS (SELECT *, (prior - recent) / prior * 100 AS decline FROM s WHERE recent IS NOT NULL AND prior > 0)
SELECT product_id, 'stockout_risk' AS alert_type,
       CASE WHEN decline > 75 THEN 'high' ELSE 'medium' END AS severity,
       'Down by ' || printf('%.1f', round_even(decline, 1)) || ' %: ' || printf('%.1f', round_even(recent, 1))
         || ' units a day this week after ' || printf('%.1f', round_even(prior, 1)) AS message,
       CAST(NULL AS BIGINT) AS reorder_qty, CAST(NULL AS DOUBLE) AS reorder_point,
       round_even(recent, 4) AS current_velocity
FROM ss WHERE decline > 50"""

SLOW_ALERT = _velocity(30) + """
, bound AS (SELECT quantile_cont(v, 0.25) - 1.5 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) AS b FROM per)
SELECT product_id, 'slow_mover' AS alert_type, CASE WHEN v = 0 THEN 'high' ELSE 'medium' END AS severity,
       'Sells ' || CAST(round_even(v, 2) AS VARCHAR) || ' units a day, at most the limit of '
         || CAST(round_even((SELECT b FROM bound), 2) AS VARCHAR) AS message,
       CAST(NULL AS BIGINT) AS reorder_qty, CAST(NULL AS DOUBLE) AS reorder_point,
       round_even(v, 4) AS current_velocity
FROM per WHERE v <= (SELECT b FROM bound)"""


def _alerts_union() -> str:
    # The three bodies each add CTEs then a SELECT; fold them into CTEs.
    def split(body: str) -> tuple[str, str]:
        i = body.rfind("\nSELECT ")
        return body[:i], body[i + 1:]
    r_cte, r_sel = split(REORDER)
    s_cte, s_sel = split(STOCKOUT)
    w_cte, w_sel = split(SLOW_ALERT)
    return (r_cte + s_cte + w_cte +
            f", all_alerts AS (({r_sel}) UNION ALL ({s_sel}) UNION ALL ({w_sel}))\n")


PRODUCT_LIST = """
, listing AS (
  SELECT p.product_id, p.stock_code, p.description, p.abc_class, p.current_stock, p.lead_time_days, p.safety_stock,
         CAST(s.rc AS DOUBLE) / 100 AS total_revenue, s.tq AS total_quantity, s.avg_daily_sales, s.last_sale_date
  FROM products_abc p JOIN prodsales s USING (product_id)
)"""


RAW_LOG = r"""
, rawk AS (SELECT *, CAST(invoice_no AS BIGINT) % 50 AS k, CAST(product_id AS VARCHAR) AS pid FROM txr),
raw AS (
  SELECT 'sales_' || CAST(upload_id + 1994 AS VARCHAR) || '.csv' AS _file, upload_id AS _upload_id,
         invoice_no AS InvoiceNo,
         CASE WHEN k = 3 THEN NULL WHEN k = 4 THEN '=SKU' || pid ELSE 'SKU' || pid END AS StockCode,
         CASE WHEN k = 5 THEN '@cmd' ELSE 'part ' || pid END AS Description,
         CASE WHEN k = 2 THEN '200000' ELSE CAST(quantity AS VARCHAR) END AS Quantity,
         CASE WHEN k = 7 THEN strftime(invoice_date, '%d/%m/%Y') ELSE strftime(invoice_date, '%Y-%m-%d %H:%M:%S') END
           AS InvoiceDate,
         CASE WHEN k = 0 THEN 'abc' WHEN k = 1 THEN '-1' ELSE CAST(CAST(unit_cents AS DOUBLE) / 100 AS VARCHAR) END AS Price,
         customer_id AS CustomerID,
         CASE WHEN k = 6 THEN '  ' || country || '  ' ELSE country END AS Country
  FROM rawk
),
typed AS (
  SELECT *, coalesce(try_strptime(InvoiceDate, '%d/%m/%Y'), try_strptime(InvoiceDate, '%Y-%m-%d %H:%M:%S')) AS d,
         try_cast(trim(Quantity) AS DOUBLE) AS q, try_cast(trim(Price) AS DOUBLE) AS p
  FROM raw
),
reasons AS (
  SELECT *, CASE WHEN StockCode IS NULL OR d IS NULL OR q IS NULL OR p IS NULL THEN 'null_values'
                 WHEN p < 0 OR p > 100000 THEN 'invalid_price'
                 WHEN abs(q) > 100000 THEN 'extreme_quantity' END AS reason
  FROM typed
),
acc AS (
  SELECT _file, _upload_id, InvoiceNo,
         regexp_replace(trim(StockCode), '^[=+\-@	
]+', '') AS StockCode,
         regexp_replace(trim(Description), '^[=+\-@	
]+', '') AS Description,
         q AS Quantity, d AS InvoiceDate, p AS Price, nullif(trim(CustomerID), '') AS CustomerID,
         regexp_replace(trim(Country), '^[=+\-@	
]+', '') AS Country,
         q < 0 AS is_return, q * p AS revenue
  FROM reasons WHERE reason IS NULL
)
"""

CLEAN_OUT = """
SELECT _file AS file, InvoiceNo AS invoice_no, StockCode AS stock_code, Description AS description,
       Quantity AS quantity, strftime(InvoiceDate, '%Y-%m-%d %H:%M:%S') AS invoice_date, Price AS price,
       CustomerID AS customer_id, Country AS country, is_return, revenue
FROM acc"""

FIRST_ROWS = """
firsts AS (
  SELECT StockCode AS stock_code, Description AS d0, Price AS p0,
         row_number() OVER (PARTITION BY StockCode ORDER BY InvoiceDate NULLS FIRST, InvoiceNo NULLS FIRST,
                            Price NULLS FIRST, Description NULLS FIRST) AS rn
  FROM scope_rows
)"""

PRODUCT_OUT = """
SELECT CAST(base + row_number() OVER (ORDER BY stock_code) AS BIGINT) AS product_id, stock_code,
       nullif(substr(trim(d0), 1, 500), '') AS description, greatest(0.1, p0 * 0.4) AS unit_cost,
       0 AS current_stock, 7 AS lead_time_days, 0 AS safety_stock
FROM firsts WHERE rn = 1"""


SERIES = """
, elig AS (SELECT product_id, CAST(COUNT(*) AS BIGINT) AS daily_rows FROM daily GROUP BY 1 HAVING COUNT(*) >= 30),
rng AS (SELECT product_id, min(sale_date) AS lo, max(sale_date) AS hi FROM daily
        WHERE product_id IN (SELECT product_id FROM elig) GROUP BY 1),
cal AS (SELECT product_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS ds FROM rng),
dense AS (
  SELECT c.product_id, c.ds, coalesce(greatest(CAST(d.total_quantity AS DOUBLE), 0.0), 0.0) AS y,
         coalesce(CAST(d.rev_cents AS DOUBLE) / 100, 0.0) AS revenue
  FROM cal c LEFT JOIN daily d ON d.product_id = c.product_id AND d.sale_date = c.ds
),
feat AS (
  SELECT *, lag(y, 1) OVER w AS lag_1, lag(y, 7) OVER w AS lag_7, lag(y, 14) OVER w AS lag_14,
         lag(y, 28) OVER w AS lag_28,
         AVG(y) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS rolling_7_mean,
         AVG(y) OVER (w ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS rolling_14_mean,
         AVG(y) OVER (w ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS rolling_28_mean,
         coalesce(stddev_samp(y) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 0.0) AS rolling_7_std
  FROM dense WINDOW w AS (PARTITION BY product_id ORDER BY ds)
),
longp AS (SELECT product_id FROM dense GROUP BY 1 HAVING COUNT(*) >= 60),
mf AS (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY ds) AS idx,
         COUNT(*) OVER (PARTITION BY product_id) AS n
  FROM feat WHERE lag_28 IS NOT NULL AND product_id IN (SELECT product_id FROM longp)
),
mfs AS (SELECT *, idx > floor(n * CAST(0.8 AS DOUBLE)) AS is_test FROM mf)
"""


INGEST_DAILY = RAW_LOG + """
, f AS (
  SELECT p.product_id, CAST(a.InvoiceDate AS DATE) AS sale_date, CAST(trunc(a.Quantity) AS BIGINT) AS qty,
         CAST(a.revenue AS DECIMAL(12,2)) AS rev, CAST(round(CAST(a.Price AS DECIMAL(10,2)) * 100) AS BIGINT) AS pc,
         a.is_return
  FROM acc a JOIN products p ON a.StockCode = p.stock_code
),
g AS (
  SELECT product_id, sale_date, CAST(SUM(qty) AS BIGINT) AS total_quantity, SUM(rev) AS r,
         CAST(COUNT(*) AS BIGINT) AS transaction_count, (2 * SUM(pc) + COUNT(*)) // (2 * COUNT(*)) AS price_cents
  FROM f WHERE NOT is_return AND qty > 0 GROUP BY 1, 2
)
SELECT product_id, sale_date, total_quantity, CAST(r AS DOUBLE) AS total_revenue, transaction_count,
       CAST(price_cents AS DOUBLE) / 100 AS avg_unit_price
FROM g"""

TOP10_CTX = """
, ctx_top AS (
  SELECT p.stock_code, substr(coalesce(p.description, ''), 1, 50) AS description, p.abc_class,
         round_even(CAST(s.rc AS DOUBLE) / 100, 2) AS revenue, CAST(s.q AS BIGINT) AS quantity
  FROM (SELECT product_id, SUM(rev_cents) AS rc, SUM(quantity) AS q FROM sales GROUP BY 1) s
  JOIN products_abc p USING (product_id)
  ORDER BY s.rc DESC, p.stock_code LIMIT 10
)"""


SQL: dict[str, str] = {
    "daily_sales": _daily_cols("daily"),
    "top_products": _top(10),
    "top_products_search": f"""SELECT * FROM ({_top(50)}) x
WHERE contains(lower(description), 'ring') OR contains(lower(stock_code), 'ring')""",
    "kpis": _kpis(None, None, "reference"),
    "kpis_range": _kpis("2000-01-01", "2000-12-31", "reference"),
    "kpis_consistent": _kpis("2000-01-01", "2000-12-31", "consistent"),
    "kpis_active": """
SELECT coalesce(CAST(SUM(CASE WHEN quantity > 0 THEN rev_cents END) AS DOUBLE) / 100, 0.0) AS total_revenue,
       CAST(COUNT(*) FILTER (WHERE quantity > 0) AS BIGINT) AS total_transactions,
       round_even(CASE WHEN COUNT(*) FILTER (WHERE quantity > 0) > 0
             THEN coalesce(CAST(SUM(CASE WHEN quantity > 0 THEN rev_cents END) AS DOUBLE) / 100, 0.0)
                  / COUNT(*) FILTER (WHERE quantity > 0) ELSE 0.0 END, 4) AS avg_order_value,
       CAST(COUNT(*) FILTER (WHERE is_return) AS BIGINT) AS return_count
FROM txr WHERE upload_id = (SELECT upload_id FROM active)""",
    "top_country": """
SELECT country, transaction_count FROM (
  SELECT country, CAST(COUNT(*) AS BIGINT) AS transaction_count FROM txr GROUP BY 1
) ORDER BY transaction_count DESC, country LIMIT 1""",
    "trend_daily": _trend("strftime(invoice_date, '%Y-%m-%d')"),
    "trend_weekly_iso": _trend("strftime(invoice_date, '%G-%V')"),
    "trend_weekly_w": _trend("strftime(invoice_date, '%Y-%W')"),
    "trend_monthly": _trend("strftime(invoice_date, '%Y-%m')"),
    "abc": """
SELECT a.product_id, p.stock_code, p.description, a.abc_class, CAST(a.rc AS DOUBLE) / 100 AS total_revenue,
       CASE WHEN a.tot <> 0 THEN round_even((CAST(a.rc AS DOUBLE) / 100) / a.tot * 100, 4) ELSE 0.0 END AS revenue_pct,
       round_even(a.cum_pct, 2) AS cumulative_pct
FROM abc_cls a JOIN products p USING (product_id)""",
    "abc_summary": """
, a AS (
  SELECT abc_class, CASE WHEN tot <> 0 THEN round_even((CAST(rc AS DOUBLE) / 100) / tot * 100, 4) ELSE 0.0 END AS pct
  FROM abc_cls JOIN products USING (product_id)
),
classes AS (SELECT * FROM (VALUES ('A'), ('B'), ('C')) t(abc_class))
SELECT c.abc_class, CAST(COUNT(a.abc_class) AS BIGINT) AS product_count,
       coalesce(round_even(SUM(a.pct), 1), 0.0) AS revenue_pct
FROM classes c LEFT JOIN a USING (abc_class) GROUP BY 1""",
    "abc_distribution": """
SELECT abc_class, CAST(COUNT(*) AS BIGINT) AS product_count FROM products_abc
WHERE abc_class IS NOT NULL GROUP BY 1""",
    "slow_movers": _slow(3650),
    "slow_movers_30": _slow(30),
    "anomalies": """
, st AS (
  SELECT product_id, sale_date, CAST(total_quantity AS DOUBLE) AS quantity,
         COUNT(*) OVER w AS n, AVG(CAST(total_quantity AS DOUBLE)) OVER w AS m,
         stddev_pop(CAST(total_quantity AS DOUBLE)) OVER w AS sd
  FROM daily WINDOW w AS (PARTITION BY product_id)
)
SELECT product_id, sale_date, quantity, round_even(abs((quantity - m) / sd), 2) AS z_score,
       CASE WHEN quantity > m THEN 'spike' ELSE 'drop' END AS direction
FROM st WHERE n >= 10 AND sd > 0 AND abs((quantity - m) / sd) > 3""",
    "product_list": PRODUCT_LIST + """
SELECT * FROM listing ORDER BY total_revenue DESC, product_id LIMIT 50""",
    "product_list_all": PRODUCT_LIST + "SELECT * FROM listing",
    "product_page2": PRODUCT_LIST + """
SELECT * FROM listing WHERE abc_class = 'A' ORDER BY total_revenue DESC, product_id LIMIT 20 OFFSET 20""",
    "product_search": PRODUCT_LIST + """
SELECT * FROM listing WHERE stock_code ILIKE '%ring%' OR description ILIKE '%ring%'""",
    "product_pages": """
SELECT CAST(COUNT(*) AS BIGINT) AS total, CAST(ceil(COUNT(*) / 50) AS BIGINT) AS pages
FROM products p JOIN prodsales s USING (product_id)""",
    "product_detail": """
SELECT p.product_id, p.stock_code, p.description, CAST(NULL AS VARCHAR) AS abc_class, p.current_stock,
       p.lead_time_days, p.safety_stock, p.unit_cost,
       coalesce(CAST(s.rc AS DOUBLE) / 100, 0.0) AS total_revenue, coalesce(s.tq, 0) AS total_quantity,
       coalesce(s.avg_daily_sales, 0.0) AS avg_daily_sales, s.last_sale_date, coalesce(s.active_days, 0) AS active_days
FROM products p LEFT JOIN prodsales s USING (product_id)""",
    "product_history": _daily_cols("daily") + """
WHERE sale_date >= DATE '2000-01-01' AND sale_date <= DATE '2000-06-30' ORDER BY product_id, sale_date""",
    "stock_status": """
, d AS (
  SELECT p.product_id, p.stock_code, p.current_stock, p.safety_stock, p.lead_time_days,
         coalesce(s.avg_daily_sales, 0.0) AS a
  FROM products p LEFT JOIN prodsales s USING (product_id)
)
SELECT product_id, stock_code, current_stock, safety_stock, lead_time_days, round(a, 6) AS avg_daily_sales,
       CASE WHEN current_stock <= safety_stock THEN 'critical'
            WHEN current_stock <= safety_stock + a * lead_time_days THEN 'low' ELSE 'healthy' END AS stock_status,
       CAST(floor(lead_time_days * a + safety_stock) AS BIGINT) AS reorder_point,
       CAST(floor(30 * a + safety_stock) AS BIGINT) AS target_stock,
       CAST(greatest(0, CAST(floor(30 * a + safety_stock) AS BIGINT) - current_stock) AS BIGINT) AS reorder_qty
FROM d""",
    "alerts_reorder": REORDER,
    "alerts_stockout": STOCKOUT,
    "alerts_slow": SLOW_ALERT,
    "alerts_all": _alerts_union() + "SELECT * FROM all_alerts",
    "alert_counts": _alerts_union() + """
SELECT alert_type, severity, CAST(COUNT(*) AS BIGINT) AS alert_count FROM all_alerts
GROUP BY 1, 2 ORDER BY alert_count DESC, alert_type, severity""",
    "uploads": """
, u AS (SELECT upload_id, CAST(COUNT(*) AS BIGINT) AS row_count FROM tx GROUP BY 1)
SELECT upload_id, 'sales_' || CAST(upload_id + 1994 AS VARCHAR) || '.csv' AS filename, row_count,
       'completed' AS status, upload_id = (SELECT upload_id FROM active) AS is_active
FROM u""",
    "switch_active": """
, d3 AS (
  SELECT product_id, CAST(invoice_date AS DATE) AS sale_date, CAST(SUM(quantity) AS BIGINT) AS total_quantity,
         SUM(rev_cents) AS rev_cents, CAST(COUNT(*) AS BIGINT) AS transaction_count,
         (2 * SUM(unit_cents) + COUNT(*)) // (2 * COUNT(*)) AS price_cents
  FROM sales WHERE upload_id = 3 GROUP BY 1, 2
)
""" + _daily_cols("d3"),
    "daily_merge": """
, part_daily AS (
  SELECT product_id, CAST(invoice_date AS DATE) AS sale_date, CASE WHEN country < 'K' THEN 0 ELSE 1 END AS half,
         SUM(quantity) AS q, SUM(rev_cents) AS rc, COUNT(*) AS n,
         (2 * SUM(unit_cents) + COUNT(*)) // (2 * COUNT(*)) AS pc
  FROM sales GROUP BY 1, 2, 3
),
merged AS (
  SELECT product_id, sale_date, CAST(SUM(q) AS BIGINT) AS total_quantity, SUM(rc) AS rev_cents,
         CAST(SUM(n) AS BIGINT) AS transaction_count,
         coalesce(max(CASE WHEN half = 1 THEN pc END), max(CASE WHEN half = 0 THEN pc END)) AS price_cents
  FROM part_daily GROUP BY 1, 2
)
""" + _daily_cols("merged"),
    "clean_accept": RAW_LOG + CLEAN_OUT,
    "clean_report": RAW_LOG + """
SELECT reason AS type,
       CASE reason WHEN 'null_values' THEN CAST(COUNT(*) AS VARCHAR) || ' rows left out: stock code, date, quantity or price is missing'
                   WHEN 'invalid_price' THEN CAST(COUNT(*) AS VARCHAR) || ' rows left out: price below 0 or above 100000'
                   ELSE CAST(COUNT(*) AS VARCHAR) || ' rows left out: more than 100000 units' END AS message,
       FALSE AS fatal, CAST(COUNT(*) AS BIGINT) AS affected_rows
FROM reasons WHERE reason IS NOT NULL GROUP BY reason""",
    "clean_summary": RAW_LOG + """
SELECT CAST(COUNT(*) AS BIGINT) AS row_count, CAST(COUNT(*) FILTER (WHERE reason IS NULL) AS BIGINT) AS valid_rows,
       CAST(COUNT(*) FILTER (WHERE reason IS NOT NULL) AS BIGINT) AS invalid_rows, CAST(0 AS BIGINT) AS empty_rows
FROM reasons""",
    "clean_superstore": """
, ss AS (
  SELECT invoice_no, product_id, customer_id, country, rev_cents,
         coalesce(try_strptime(strftime(invoice_date, '%m/%d/%Y'), '%d/%m/%Y'),
                  try_strptime(strftime(invoice_date, '%m/%d/%Y'), '%m/%d/%Y')) AS d
  FROM txr
)
SELECT 'superstore.csv' AS file, invoice_no, 'SKU' || CAST(product_id AS VARCHAR) AS stock_code,
       'part ' || CAST(product_id AS VARCHAR) AS description, 1.0 AS quantity,
       strftime(d, '%Y-%m-%d %H:%M:%S') AS invoice_date, CAST(rev_cents AS DOUBLE) / 100 AS price,
       customer_id, country, FALSE AS is_return, CAST(rev_cents AS DOUBLE) / 100 AS revenue
FROM ss WHERE CAST(rev_cents AS DOUBLE) / 100 BETWEEN 0 AND 100000""",
    "product_upsert": RAW_LOG + ", scope_rows AS (SELECT * FROM acc),\n" + FIRST_ROWS
        + ", b AS (SELECT 0 AS base)\n" + PRODUCT_OUT.replace("FROM firsts", "FROM firsts, b"),
    "product_upsert_incremental": RAW_LOG + """
, latest AS (SELECT max(_upload_id) AS u FROM acc),
old_codes AS (SELECT DISTINCT StockCode FROM acc WHERE _upload_id <> (SELECT u FROM latest)),
scope_rows AS (SELECT * FROM acc WHERE _upload_id = (SELECT u FROM latest)
               AND StockCode NOT IN (SELECT StockCode FROM old_codes)),
""" + FIRST_ROWS + ", b AS (SELECT COUNT(*) AS base FROM old_codes)\n"
        + PRODUCT_OUT.replace("FROM firsts", "FROM firsts, b"),
    "fact_build": RAW_LOG + """
SELECT substr(a.InvoiceNo, 1, 20) AS invoice_no, p.product_id, CAST(trunc(a.Quantity) AS INTEGER) AS quantity,
       a.Price AS unit_price, CAST(CAST(a.revenue AS DECIMAL(12,2)) AS DOUBLE) AS revenue,
       strftime(a.InvoiceDate, '%Y-%m-%d %H:%M:%S') AS invoice_date, nullif(substr(a.CustomerID, 1, 20), '') AS customer_id,
       nullif(substr(a.Country, 1, 100), '') AS country, a.is_return, a._upload_id AS upload_id
FROM acc a JOIN products p ON trim(a.StockCode) = p.stock_code""",
    "eligible_products": SERIES + "SELECT product_id, daily_rows FROM elig",
    "densify": SERIES + "SELECT product_id, ds, y, revenue FROM dense",
    "calendar_features": SERIES + """
SELECT product_id, ds, CAST(isodow(ds) - 1 AS INTEGER) AS day_of_week, CAST(day(ds) AS INTEGER) AS day_of_month,
       CAST(week(ds) AS INTEGER) AS week_of_year, CAST(month(ds) AS INTEGER) AS month,
       CAST(quarter(ds) AS INTEGER) AS quarter, CAST(isodow(ds) >= 6 AS INTEGER) AS is_weekend,
       CAST(year(ds) AS INTEGER) AS year
FROM dense""",
    "lag_features": SERIES + "SELECT product_id, ds, y, lag_1, lag_7, lag_14, lag_28 FROM feat",
    "rolling_features": SERIES + """
SELECT product_id, ds, y, rolling_7_mean, rolling_14_mean, rolling_28_mean, round(rolling_7_std, 6) AS rolling_7_std,
       y - rolling_7_mean AS trend_signal
FROM feat""",
    "feature_split": SERIES + """
SELECT product_id, CAST(COUNT(*) AS BIGINT) AS n_rows, CAST(COUNT(*) FILTER (WHERE NOT is_test) AS BIGINT) AS train_rows,
       CAST(COUNT(*) FILTER (WHERE is_test) AS BIGINT) AS test_rows, min(ds) AS first_ds, max(ds) AS last_ds
FROM mfs GROUP BY 1""",
    "metrics": SERIES + """
SELECT product_id, round_even(AVG(abs(y - lag_7)), 4) AS mae, round_even(sqrt(AVG((y - lag_7) * (y - lag_7))), 4) AS rmse,
       round_even(AVG(CASE WHEN y <> 0 THEN abs((y - lag_7) / y) END) * 100, 4) AS mape,
       CAST(COUNT(*) AS BIGINT) AS test_rows
FROM mfs WHERE is_test GROUP BY 1""",
    "context_kpis": """
SELECT round_even(coalesce(CAST(SUM(rev_cents) AS DOUBLE) / 100, 0.0), 2) AS total_revenue,
       CAST(COUNT(*) AS BIGINT) AS total_transactions,
       round_even(coalesce(AVG(CAST(rev_cents AS DOUBLE) / 100), 0.0), 2) AS avg_order_value
FROM sales""",
    "context_top10": TOP10_CTX + "SELECT * FROM ctx_top",
    "context_trend7": """
SELECT CAST(invoice_date AS DATE) AS date, round_even(CAST(SUM(rev_cents) AS DOUBLE) / 100, 2) AS revenue,
       CAST(SUM(quantity) AS BIGINT) AS quantity
FROM sales WHERE upload_id = (SELECT upload_id FROM active)
  AND CAST(invoice_date AS DATE) >= (SELECT d FROM ref_day) - INTERVAL 7 DAY
GROUP BY 1 ORDER BY 1""",
    "context_digest": _alerts_union() + TOP10_CTX + """
SELECT round_even(coalesce(CAST(SUM(rev_cents) AS DOUBLE) / 100, 0.0), 2) AS total_revenue,
       (SELECT CAST(COUNT(*) AS BIGINT) FROM all_alerts) AS active_alerts,
       (SELECT CAST(COUNT(*) AS BIGINT) FROM ctx_top) AS top_products_included
FROM sales""",
    "alert_export": _alerts_union() + """
SELECT p.stock_code, p.description, a.alert_type, a.severity, a.message, a.reorder_qty, a.reorder_point,
       a.current_velocity, strftime(CAST((SELECT d FROM ref_day) + INTERVAL 1 DAY AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS created_at
FROM all_alerts a JOIN products p USING (product_id)""",
    "ingest_daily": INGEST_DAILY,
    "stream_daily": INGEST_DAILY,
    "ingest_layouts": INGEST_DAILY,
    "erp_mapping": """
SELECT 'erp_' || CAST(upload_id + 1994 AS VARCHAR) || '.xlsx' AS file, invoice_no,
       'SKU' || CAST(product_id AS VARCHAR) AS stock_code, 'part ' || CAST(product_id AS VARCHAR) AS description,
       CAST(quantity AS DOUBLE) AS quantity, strftime(CAST(CAST(invoice_date AS DATE) AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS invoice_date,
       round(CAST(rev_cents AS DOUBLE) / 100 / CAST(quantity AS DOUBLE), 2) AS price, customer_id, 'India' AS country,
       quantity < 0 AS is_return,
       CAST(quantity AS DOUBLE) * round(CAST(rev_cents AS DOUBLE) / 100 / CAST(quantity AS DOUBLE), 2) AS revenue
FROM txr
WHERE round(CAST(rev_cents AS DOUBLE) / 100 / CAST(quantity AS DOUBLE), 2) BETWEEN 0 AND 100000
  AND abs(quantity) <= 100000""",
    "delete_upload_orphans": """
SELECT product_id, stock_code FROM products
WHERE product_id NOT IN (SELECT product_id FROM tx WHERE upload_id <> (SELECT max(upload_id) FROM tx))""",
}


SQL["alerts_slow_all_time"] = SLOW_ALERT.replace(_velocity(30), _velocity(SLOW_LOOKBACK_DAYS))
SQL["missing_orders"] = """
SELECT CAST(COUNT(DISTINCT l_orderkey) AS BIGINT) AS missing FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey
                         JOIN nation ON c_nationkey = n_nationkey)"""
SQL["product_upsert_second"] = RAW_LOG + """
, frst AS (SELECT min(_upload_id) AS u FROM acc),
old_codes AS (SELECT DISTINCT StockCode FROM acc WHERE _upload_id = (SELECT u FROM frst)),
scope_rows AS (SELECT * FROM acc WHERE _upload_id <> (SELECT u FROM frst)
               AND StockCode NOT IN (SELECT StockCode FROM old_codes)),
""" + FIRST_ROWS + ", b AS (SELECT COUNT(*) AS base FROM old_codes)\n" + PRODUCT_OUT.replace("FROM firsts", "FROM firsts, b")
SQL["sheet_fallback"] = SQL["clean_superstore"]
SQL["kpis_direct"] = SQL["kpis_range"]
SQL["unique_invoices"] = """
SELECT upload_id, CAST(COUNT(DISTINCT invoice_no) AS BIGINT) AS unique_invoices, TRUE AS sketch_within_5_pct
FROM tx WHERE quantity > 0 GROUP BY 1"""


NAIVE = SERIES + """
, sd AS (SELECT product_id, stddev_pop(y - lag_7) AS sd FROM mfs WHERE is_test GROUP BY 1),
ends AS (SELECT product_id, max(ds) AS last FROM dense WHERE product_id IN (SELECT product_id FROM longp) GROUP BY 1),
steps AS (SELECT product_id, last, unnest(generate_series(1, 30)) AS h FROM ends),
naive AS (
  SELECT s.product_id, CAST(s.last + CAST(s.h AS INTEGER) AS DATE) AS forecast_date, round_even(d.y, 2) AS predicted_quantity,
         round_even(greatest(0.0, d.y - 1.96 * sd), 2) AS lower_bound, round_even(d.y + 1.96 * sd, 2) AS upper_bound
  FROM steps s JOIN dense d ON d.product_id = s.product_id AND d.ds = CAST(s.last - 6 + CAST((s.h - 1) % 7 AS INTEGER) AS DATE) JOIN sd ON sd.product_id = s.product_id)
"""
SQL["forecast_naive"] = NAIVE + """
SELECT product_id, stock_code, CAST(1 AS BIGINT) AS model_run_id, forecast_date, predicted_quantity, lower_bound, upper_bound
FROM naive JOIN products USING (product_id)"""
SQL["forecast_export_naive"] = NAIVE + """
SELECT stock_code, description, 'seasonal_naive' AS model, forecast_date, predicted_quantity, lower_bound AS lower_bound_95, upper_bound AS upper_bound_95
FROM naive JOIN products USING (product_id) WHERE forecast_date >= (SELECT max(sale_date) FROM daily)"""
SQL["training_run"] = SERIES + """
, m AS (SELECT product_id, round_even(AVG(abs(y - lag_7)), 4) AS mae, round_even(sqrt(AVG((y - lag_7) * (y - lag_7))), 4) AS rmse,
               round_even(AVG(CASE WHEN y <> 0 THEN abs((y - lag_7) / y) END) * 100, 4) AS mape
        FROM mfs WHERE is_test GROUP BY 1)
SELECT CAST(1 AS BIGINT) AS run_id, 'seasonal_naive' AS model_name, 'completed' AS status, CAST(COUNT(*) AS BIGINT) AS products_trained,
       round(AVG(mae), 3) AS mae, round(AVG(rmse), 3) AS rmse, round(AVG(mape), 3) AS mape FROM m"""
SQL["training_outcomes"] = """
, per AS (SELECT product_id, max(sale_date) AS last_sale, CAST(max(sale_date) - min(sale_date) + 1 AS BIGINT) AS days FROM daily GROUP BY 1),
r AS (SELECT p.product_id, coalesce(days, 0) AS days, last_sale,
             CASE WHEN days IS NULL THEN 'no sales' WHEN p.product_id % 97 = 0 THEN 'a quantity is not a finite number'
                  WHEN days < 60 THEN 'fewer than 60 days' END AS reason
      FROM products p LEFT JOIN per USING (product_id))
SELECT product_id, CASE WHEN reason IS NULL THEN 'trained' ELSE 'failed' END AS outcome, reason, CAST(days AS BIGINT) AS days, last_sale FROM r"""
SQL["forecast_on_demand"] = SERIES + """
, ends AS (SELECT product_id, max(ds) AS last FROM dense WHERE product_id IN (SELECT product_id FROM longp) GROUP BY 1),
first_run AS (SELECT COUNT(*) > 0 AS any_first FROM elig WHERE daily_rows >= 32)
SELECT e.product_id, CAST(CASE WHEN daily_rows >= 32 OR NOT (SELECT any_first FROM first_run) THEN 1 ELSE 2 END AS BIGINT) AS model_run_id,
       CAST(30 AS BIGINT) AS n_days, CAST(last + 1 AS DATE) AS first_date, CAST(last + 30 AS DATE) AS last_date
FROM ends e JOIN elig USING (product_id)"""


def _tree_level(src: str, name: str) -> str:
    """Best split of every (product, node) of ``src`` (product_id, node, g and b0..b4), as the boosting defines it."""
    score = lambda g, n: f"(greatest(abs({g}) - 0.1, 0.0) * greatest(abs({g}) - 0.1, 0.0) / ({n} + 1.0))"
    cells = " UNION ALL ".join(f"SELECT product_id, node, g, {i} AS f, b{i} AS bin FROM {src}" for i in range(5))
    return f""", {name}_h AS (SELECT product_id, node, f, bin, SUM(g) AS g, COUNT(*) AS n FROM ({cells}) GROUP BY ALL),
{name}_c AS (SELECT product_id, node, f, bin, SUM(g) OVER u AS gl, SUM(n) OVER u AS nl, SUM(g) OVER a AS ga, SUM(n) OVER a AS na
  FROM {name}_h WINDOW u AS (PARTITION BY product_id, node, f ORDER BY bin), a AS (PARTITION BY product_id, node, f)),
{name} AS (SELECT product_id, node, f, bin FROM (
  SELECT *, round({score("gl", "nl")} + {score("(ga - gl)", "(na - nl)")} - {score("ga", "na")}, 6) AS gain FROM {name}_c)
  WHERE nl >= 2 AND na - nl >= 2 AND gain > 0
  QUALIFY row_number() OVER (PARTITION BY product_id, node ORDER BY gain DESC, f, bin) = 1)"""


def _boosted_tree() -> str:
    names = ["day_of_week", "lag_1", "lag_7", "lag_28", "rolling_7_mean"]
    lohi = ", ".join(f"min({c}) AS lo{i}, max({c}) AS hi{i}" for i, c in enumerate(names))
    bins = ", ".join(f"CASE WHEN hi{i} > lo{i} THEN CAST(least(31, greatest(0, floor(({c} - lo{i}) / (hi{i} - lo{i}) * 32))) AS INTEGER) ELSE 0 END AS b{i}"
                     for i, c in enumerate(names))
    pick = "CASE s.f " + " ".join(f"WHEN {i} THEN b{i}" for i in range(5)) + " END"
    name = "CASE f " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(names)) + " END"
    value = "-sign(SUM(g)) * greatest(abs(SUM(g)) - 0.1, 0.0) / (COUNT(*) + 1.0) * 0.3"
    keep = ", ".join(f"b{i}" for i in range(5))
    return SERIES + f"""
, tr AS (SELECT product_id, y, CAST(isodow(ds) - 1 AS DOUBLE) AS day_of_week, lag_1, lag_7, lag_28, rolling_7_mean FROM mfs WHERE NOT is_test),
rg AS (SELECT product_id, AVG(y) AS base, {lohi} FROM tr GROUP BY 1),
n0 AS (SELECT product_id, 1 AS node, base - y AS g, {bins} FROM tr JOIN rg USING (product_id))
{_tree_level("n0", "s0")}
, n1 AS (SELECT n.product_id, CASE WHEN s.f IS NULL THEN 1 ELSE 2 + CAST({pick} > s.bin AS INTEGER) END AS node, g, {keep}
         FROM n0 n LEFT JOIN s0 s ON n.product_id = s.product_id),
n1o AS (SELECT * FROM n1 WHERE node >= 2)
{_tree_level("n1o", "s1")}
, n2 AS (SELECT n.product_id, CASE WHEN s.f IS NULL THEN n.node ELSE 2 * n.node + CAST({pick} > s.bin AS INTEGER) END AS node, g
         FROM n1 n LEFT JOIN s1 s ON n.product_id = s.product_id AND n.node = s.node)
SELECT product_id, node, {name} AS feature, bin, CAST(NULL AS DOUBLE) AS value FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1)
UNION ALL
SELECT product_id, node, NULL, NULL, round({value}, 6) FROM n2 GROUP BY 1, 2"""


SQL["boosted_tree"] = _boosted_tree()
SQL["ingest_wide"] = INGEST_DAILY
SQL["stream_compacted"] = INGEST_DAILY.replace(",\n       CAST(price_cents AS DOUBLE) / 100 AS avg_unit_price", "")
SQL["sheet_outcomes"] = """
SELECT 'erp_' || CAST(upload_id + 1994 AS VARCHAR) || '.xlsx' AS file, 'mapped' AS outcome, CAST(NULL AS VARCHAR) AS reason, CAST(COUNT(*) AS BIGINT) AS data_rows
FROM tx GROUP BY upload_id
UNION ALL SELECT 'superstore.csv', 'fallback', NULL, (SELECT COUNT(*) FROM tx)
UNION ALL SELECT 'notes.xlsx', 'refused', 'Missing required columns: Country, Customer ID, Description, InvoiceDate, InvoiceNo, Price, StockCode', 0"""
SQL["ingest_repeated_header"] = RAW_LOG + """
, again AS (SELECT CAST(COUNT(DISTINCT _file) AS BIGINT) AS n FROM reasons),
c AS (SELECT reason AS type, COUNT(*) AS n FROM reasons WHERE reason IS NOT NULL GROUP BY 1
      UNION ALL SELECT 'null_values', n FROM again),
t AS (SELECT type, CAST(SUM(n) AS BIGINT) AS n FROM c GROUP BY 1 UNION ALL SELECT 'date_parse_error', n FROM again)
SELECT type, CAST(n AS VARCHAR) || CASE type WHEN 'null_values' THEN ' rows left out: stock code, date, quantity or price is missing'
                   WHEN 'invalid_price' THEN ' rows left out: price below 0 or above 100000'
                   WHEN 'extreme_quantity' THEN ' rows left out: more than 100000 units'
                   ELSE ' values of InvoiceDate are not dates' END AS message,
       type = 'date_parse_error' AS fatal, n AS affected_rows, 'failed' AS status
FROM t"""


SQL["context_parts"] = _alerts_union() + TOP10_CTX + """
SELECT 'abc' AS part, abc_class AS item, CAST(COUNT(*) AS DOUBLE) AS figure FROM products_abc WHERE abc_class IS NOT NULL GROUP BY abc_class
UNION ALL SELECT 'alerts', alert_type || '/' || severity, CAST(COUNT(*) AS DOUBLE) FROM all_alerts GROUP BY alert_type, severity
UNION ALL SELECT 'kpis', 'total_revenue', round_even(CAST(SUM(rev_cents) AS DOUBLE) / 100, 2) FROM sales
UNION ALL SELECT 'kpis', 'total_transactions', CAST(COUNT(*) AS DOUBLE) FROM sales
UNION ALL SELECT 'kpis', 'avg_order_value', round_even(CAST(SUM(rev_cents) AS DOUBLE) / 100 / COUNT(*), 2) FROM sales
UNION ALL SELECT 'trend', strftime(CAST(invoice_date AS DATE), '%Y-%m-%d'), round_even(CAST(SUM(rev_cents) AS DOUBLE) / 100, 2)
  FROM sales WHERE upload_id = (SELECT upload_id FROM active) AND CAST(invoice_date AS DATE) >= (SELECT d FROM ref_day) - INTERVAL 7 DAY
  GROUP BY CAST(invoice_date AS DATE)
UNION ALL SELECT 'top', concat_ws('/', stock_code, abc_class, description), revenue FROM ctx_top
UNION ALL SELECT 'hash', 'same', 1.0"""
SQL["forecast_payloads"] = NAIVE + """
SELECT product_id, stock_code, description, current_stock, lead_time_days, TRUE AS in_prompt,
       strftime(forecast_date, '%Y-%m-%d') AS date, lower_bound AS lower, predicted_quantity AS predicted, upper_bound AS upper
FROM naive JOIN products USING (product_id)"""
SQL["question_prompts"] = TOP10_CTX + """
SELECT 'How much of ' || stock_code || ' should be bought?' AS payload, 'product_qa' AS insight_type, TRUE AS in_prompt, TRUE AS own_hashes FROM ctx_top"""
SQL["cache_cycle"] = """
, last AS (SELECT product_id, max(sale_date) AS d FROM daily GROUP BY 1)
SELECT stock_code, coalesce(CAST(d AS TIMESTAMP) >= CAST((SELECT max(d) FROM last) AS TIMESTAMP) - INTERVAL 12 HOUR, FALSE) AS hit,
       CASE WHEN CAST(d AS TIMESTAMP) >= CAST((SELECT max(d) FROM last) AS TIMESTAMP) - INTERVAL 12 HOUR THEN strftime(d, '%Y-%m-%d') END AS response
FROM products LEFT JOIN last USING (product_id)"""
SQL["registry_cycle"] = """
, u AS (SELECT upload_id, CAST(COUNT(*) AS BIGINT) AS row_count FROM tx WHERE upload_id <> 7 GROUP BY 1)
SELECT upload_id, 'sales_' || CAST(upload_id + 1994 AS VARCHAR) || '.csv' AS filename, 'completed' AS status, row_count,
       upload_id = (SELECT max(upload_id) FROM u) AS is_active FROM u"""
SQL["delete_cascade"] = """
, sold AS (SELECT product_id, min(upload_id) AS first_upload FROM tx GROUP BY 1)
SELECT product_id, CAST(CASE WHEN first_upload IS NULL THEN 7 WHEN first_upload > 1 THEN first_upload END AS BIGINT) AS orphaned_with
FROM products LEFT JOIN sold USING (product_id)"""
SQL["alerts_resolved"] = _alerts_union() + """
SELECT alert_type, severity, severity = 'medium' AS is_resolved, CAST(COUNT(*) AS BIGINT) AS n,
       CAST(CASE WHEN severity = 'medium' THEN COUNT(*) ELSE 0 END AS BIGINT) AS n_resolved_at FROM all_alerts GROUP BY 1, 2, 3"""
SQL["alerts_listed"] = _alerts_union() + """
SELECT product_id, stock_code, severity, message, FALSE AS is_resolved FROM all_alerts JOIN products USING (product_id) WHERE alert_type = 'stockout_risk'"""
SQL["revenue_labels"] = """
, r AS (SELECT product_id, CAST(SUM(rev_cents) AS DOUBLE) / 100 AS v FROM sales JOIN products USING (product_id) GROUP BY 1)
SELECT product_id, chr(8377) || CASE WHEN v >= 1e7 THEN printf('%.2fCr', v / 1e7) WHEN v >= 1e5 THEN printf('%.2fL', v / 1e5)
                            WHEN v >= 1e3 THEN printf('%.1fK', v / 1e3) ELSE printf('%.0f', v) END AS label FROM r"""
SQL["strict_scrub"] = "SELECT product_id, trim(description) AS clean FROM products"
SQL["keyset_pages"] = """
, l AS (SELECT product_id, CAST(SUM(rev_cents) AS DOUBLE) / 100 AS total_revenue FROM sales JOIN products USING (product_id) GROUP BY 1)
SELECT CAST((row_number() OVER (ORDER BY total_revenue DESC, product_id) - 1) // 50 + 1 AS BIGINT) AS page, product_id, total_revenue FROM l"""


def oracle_sql() -> dict[str, str]:
    return {k: PRELUDE + v for k, v in SQL.items()}
