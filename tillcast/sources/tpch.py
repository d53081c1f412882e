"""Adapter: the driver's TPC-H-style tables seen as a retail transaction log.

lineitem ⋈ orders ⋈ customer ⋈ nation becomes the sales fact, part becomes
the product dimension, and each shipping year becomes one uploaded file.
The same derivation is written in SQL in ``tillcast.plans.oracle`` so the
two engines see identical inputs.

Money is kept in integer cents until the end: ``unit_cents`` is the line
amount in cents integer-divided by the quantity, so unit price, revenue and
every sum are exact and no rounding tie can differ between engines.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast import schemas
from tillcast.session import stored

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# First shipping year of the generator; upload_id = year - BASE_YEAR.
BASE_YEAR = 1994


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents_to_money(cents: Column, dtype=schemas.MONEY) -> Column:
    """Exact integer cents → decimal money."""
    return (cents.cast("decimal(20,0)") / F.lit(100)).cast(dtype)


def money_to_cents(money: Column) -> Column:
    return (money * F.lit(100)).cast("long")


def sale_lines(lineitem: DataFrame) -> DataFrame:
    """The sales fact without customer and country: lineitem alone, no join
    and no shuffle.  Operators that need neither column read this one.

    Input contract: every line's order, customer and nation exist, so the
    lines are the rows of ``transactions`` (``missing_orders`` checks it).
    """
    return _facts(lineitem.select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"))


def missing_orders(lineitem: DataFrame, orders: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    """Order keys of lines that ``transactions`` would lose (must be empty)."""
    known = (orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
             .join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey"))
    return lineitem.select("l_orderkey").distinct().join(known, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")


def transactions(lineitem: DataFrame, orders: DataFrame, customer: DataFrame,
                 nation: DataFrame) -> DataFrame:
    """The sales fact (schema ``schemas.TRANSACTIONS``) from the TPC-H tables.

    nation has 25 rows by the TPC-H specification, so broadcasting it is
    bounded.  The other joins are left to the planner: broadcast where a side
    is measured small, else sort-merge on the order key with the skew split.
    Only the columns used are read.
    """
    nations = F.broadcast(nation.select("n_nationkey", "n_name"))
    cust = customer.select("c_custkey", "c_nationkey").join(
        nations, F.col("c_nationkey") == F.col("n_nationkey"))
    ords = orders.select("o_orderkey", "o_custkey").join(cust, F.col("o_custkey") == F.col("c_custkey"))
    li = lineitem.select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")
    return _facts(li.join(ords, F.col("l_orderkey") == F.col("o_orderkey")),
                  F.col("o_custkey").cast("string").alias("customer_id"), F.col("n_name").alias("country"))


def _facts(j: DataFrame, *customer: Column) -> DataFrame:
    qty = F.col("l_quantity").cast("long")
    is_return = F.col("l_returnflag") == F.lit("R")
    unit_cents = F.expr("cast(round(l_extendedprice * 100) as bigint) div cast(l_quantity as bigint)")
    signed_qty = F.when(is_return, -qty).otherwise(qty)
    return j.select(
        F.col("l_orderkey").cast("string").alias("invoice_no"),
        F.col("l_partkey").cast("long").alias("product_id"),
        signed_qty.cast("int").alias("quantity"),
        cents_to_money(unit_cents).alias("unit_price"),
        cents_to_money(unit_cents * signed_qty, schemas.LINE_MONEY).alias("revenue"),
        F.col("l_shipdate").alias("invoice_date"),
        *customer,
        is_return.alias("is_return"),
        (F.year("l_shipdate") - F.lit(BASE_YEAR)).cast("long").alias("upload_id"),
    )


def products(part: DataFrame) -> DataFrame:
    """Product dimension (schema ``schemas.PRODUCTS``) from part.

    Stock attributes are deterministic functions of the key so every run and
    the SQL oracle agree; abc_class is empty until ABC analysis writes it.
    """
    k = F.col("p_partkey").cast("long")
    return part.select(
        k.alias("product_id"),
        F.concat(F.lit("SKU"), k.cast("string")).alias("stock_code"),
        F.col("p_name").alias("description"),
        F.col("p_type").alias("category"),
        F.lit(None).cast("string").alias("abc_class"),
        ((k * 37) % 200).cast("int").alias("current_stock"),
        (F.lit(3) + k % 19).cast("int").alias("lead_time_days"),
        ((k * 13) % 40).cast("int").alias("safety_stock"),
        F.greatest(F.lit(0.1), F.lit(0.4) * F.col("p_retailprice")).alias("unit_cost"),
    )


def uploads_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Upload registry (schema ``schemas.UPLOADS``): one row per ship year.

    Built from the single ``l_shipdate`` column (a pruned scan, no join: the
    fact join is lossless, so the counts equal the fact rows per upload).
    The newest upload is the active one (REG-6 rule).
    """
    uid = (F.year("l_shipdate") - F.lit(BASE_YEAR)).cast("long")
    return uploads_registry(lineitem.groupBy(uid.alias("upload_id")).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.max("l_shipdate").cast("timestamp").alias("uploaded_at"),
    ))


def uploads_registry(reg: DataFrame) -> DataFrame:
    """The registry from each upload's ``row_count`` and ``uploaded_at``."""
    from tillcast.operators.registry import activate_latest

    reg = reg.select(
        "upload_id",
        F.concat(F.lit("sales_"), (F.col("upload_id") + BASE_YEAR).cast("string"), F.lit(".csv")).alias("filename"),
        F.lit(None).cast("long").alias("file_size"),
        "row_count",
        F.col("row_count").alias("valid_rows"),
        F.lit(0).cast("long").alias("invalid_rows"),
        F.lit("completed").alias("status"),
        F.lit(False).alias("is_active"),
        F.lit(None).cast("string").alias("error_message"),
        "uploaded_at",
        F.col("uploaded_at").alias("processed_at"),
    )
    return activate_latest(reg)


@dataclass
class RetailData:
    """Lazily built retail tables over one scale-factor directory."""

    spark: SparkSession
    sf_dir: str
    _cache: dict = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    def _memo(self, key, build):
        if key not in self._cache:
            self._cache[key] = build()
        return self._cache[key]

    @property
    def tx(self) -> DataFrame:
        return self._memo("tx", lambda: transactions(
            self.table("lineitem"), self.table("orders"), self.table("customer"), self.table("nation")))

    @property
    def stored_tx(self) -> DataFrame:
        """The facts, stored: for inputs that are built from several looks at them."""
        return self._memo("stored_tx", lambda: stored(self.tx, "tx"))

    @property
    def lines(self) -> DataFrame:
        """The facts for operators that need no customer and no country."""
        return self._memo("lines", lambda: sale_lines(self.table("lineitem")))

    @property
    def active_lines(self) -> DataFrame:
        from tillcast.operators.registry import active_scope
        return self._memo("active_lines", lambda: active_scope(self.lines, self.uploads))

    @property
    def products(self) -> DataFrame:
        return self._memo("products", lambda: products(self.table("part")))

    @property
    def uploads(self) -> DataFrame:
        return self._memo("uploads", lambda: uploads_from_lineitem(self.table("lineitem")))

    @property
    def daily(self) -> DataFrame:
        from tillcast.operators.daily import daily_sales
        return self._memo("daily", lambda: daily_sales(self.lines))

    @property
    def sums(self) -> DataFrame:
        """The lines of every (upload, product, kind of line), summed and stored: the facts
        are read once, and whatever needs only sums reads this.  Its rows look like
        fact lines (``quantity``, ``revenue``, ``is_return``), with ``lines`` of them in each."""
        return self._memo("sums", lambda: stored_sums(self.lines))

    @property
    def active_sums(self) -> DataFrame:
        from tillcast.operators.registry import active_scope
        return self._memo("active_sums", lambda: active_scope(self.sums, self.uploads_of_sums))

    @property
    def uploads_of_sums(self) -> DataFrame:
        return self._memo("uploads_of_sums", lambda: uploads_registry(self.sums.groupBy("upload_id").agg(
            F.sum("lines").alias("row_count"), F.max("last_at").cast("timestamp").alias("uploaded_at"))))

    @property
    def stored_daily(self) -> DataFrame:
        """DAILY-1, stored: alerts, movements and lists read it several times, the facts once."""
        return self._memo("stored_daily", lambda: stored(self.daily, "daily"))

    @property
    def active_tx(self) -> DataFrame:
        from tillcast.operators.registry import active_scope
        return self._memo("active_tx", lambda: active_scope(self.tx, self.uploads))


def stored_sums(lines: DataFrame) -> DataFrame:
    g = lines.groupBy("upload_id", "product_id", "is_return", (F.col("quantity") > 0).alias("positive")).agg(
        F.sum("quantity").cast("long").alias("quantity"), F.sum("revenue").cast(schemas.SUM_MONEY).alias("revenue"),
        F.count(F.lit(1)).alias("lines"), F.max("invoice_date").alias("last_at"))
    return stored(g.drop("positive"), "sums")


def raw_log_from_facts(tx: DataFrame, dealt: bool = True) -> DataFrame:
    """A dirty raw transaction log (all-string columns, as read from CSV)
    derived from the facts, for the cleaning operators.

    The damage is a function of the invoice number (l_orderkey % 50), so the
    SQL oracle derives the very same rows:
    0 → Price 'abc'; 1 → Price '-1'; 2 → Quantity '200000'; 3 → StockCode
    missing; 4 → StockCode '=' prefixed; 5 → Description '@cmd'; 6 → Country
    padded with spaces; 7 → InvoiceDate as d/M/yyyy; else ISO timestamps.
    Lineage columns: ``_file`` (landed file name) and ``_upload_id``.
    The given lines may lie in a single row group, which one task reads; a
    landing folder holds many files, so the rows are dealt to a fixed number of
    partitions (one that is not coalesced) by invoice; not ``dealt`` for a caller that deals them itself.
    """
    k = F.col("invoice_no").cast("long") % 50
    pid = F.col("product_id").cast("string")
    code = F.concat(F.lit("SKU"), pid)
    ts = F.col("invoice_date")
    raw = tx.select(
        F.concat(F.lit("sales_"), (F.col("upload_id") + BASE_YEAR).cast("string"), F.lit(".csv")).alias("_file"),
        F.col("upload_id").alias("_upload_id"),
        F.col("invoice_no").alias("InvoiceNo"),
        F.when(k == 3, F.lit(None).cast("string")).when(k == 4, F.concat(F.lit("="), code))
         .otherwise(code).alias("StockCode"),
        F.when(k == 5, F.lit("@cmd")).otherwise(F.concat(F.lit("part "), pid)).alias("Description"),
        F.when(k == 2, F.lit("200000")).otherwise(F.col("quantity").cast("string")).alias("Quantity"),
        F.when(k == 7, F.date_format(ts, "d/M/yyyy"))
         .otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).alias("InvoiceDate"),
        F.when(k == 0, F.lit("abc")).when(k == 1, F.lit("-1"))
         .otherwise(F.col("unit_price").cast("string")).alias("Price"),
        F.col("customer_id").alias("Customer ID"),
        F.when(k == 6, F.concat(F.lit("  "), F.col("country"), F.lit("  ")))
         .otherwise(F.col("country")).alias("Country"),
    )
    return raw.repartition(int(tx.sparkSession.conf.get("spark.sql.shuffle.partitions")), "InvoiceNo") if dealt else raw


def superstore_log_from_facts(tx: DataFrame) -> DataFrame:
    """The same sales as an alternate-schema export: Order ID, Product ID,
    Product Name, Order Date (MM/dd/yyyy), Sales, Customer ID, Country and no
    Quantity column (CLEAN-1/2 aliases and the Quantity = 1 default)."""
    pid = F.col("product_id").cast("string")
    return tx.select(
        F.col("invoice_no").alias("Order ID"),
        F.concat(F.lit("SKU"), pid).alias("Product ID"),
        F.concat(F.lit("part "), pid).alias("Product Name"),
        F.date_format("invoice_date", "MM/dd/yyyy").alias("Order Date"),
        F.col("revenue").cast("string").alias("Sales"),
        F.col("customer_id").alias("Customer ID"),
        F.col("country").alias("Country"),
    )


def erp_sheet_from_facts(tx: DataFrame) -> DataFrame:
    """The sales as ERP sheet rows ``(file, row_idx, c0..c6)`` — one sheet per
    upload year: a title row, a row of column names, the bills, then a
    subtotal row without bill number (the layout SRC-2 maps).  Row indexes
    only need to be increasing within a sheet: bills get 2 + a load-order id.
    """
    file = F.concat(F.lit("erp_"), (F.col("upload_id") + BASE_YEAR).cast("string"), F.lit(".xlsx"))
    names = ["Bill No", "Item", "Item Name", "Qty", "Bill Date", "Taxable Amt", "Customer Name"]
    files = tx.select(file.alias("file")).distinct()
    cells = [f"c{i}" for i in range(7)]
    title = files.select("file", F.lit(0).cast("long").alias("row_idx"), F.lit("Sales Register").alias("c0"),
                         *[F.lit(None).cast("string").alias(c) for c in cells[1:]])
    header = files.select("file", F.lit(1).cast("long").alias("row_idx"),
                          *[F.lit(n).alias(c) for n, c in zip(names, cells)])
    pid = F.col("product_id").cast("string")
    bills = tx.select(
        file.alias("file"), (F.lit(2) + F.monotonically_increasing_id()).alias("row_idx"),
        F.col("invoice_no").alias("c0"), F.concat(F.lit("SKU"), pid).alias("c1"),
        F.concat(F.lit("part "), pid).alias("c2"), F.col("quantity").cast("string").alias("c3"),
        F.date_format("invoice_date", "yyyy-MM-dd").alias("c4"), F.col("revenue").cast("string").alias("c5"),
        F.col("customer_id").alias("c6"))
    subtotal = tx.groupBy(file.alias("file")).agg(F.sum("revenue").cast("string").alias("c5")).select(
        "file", F.lit(1 << 62).cast("long").alias("row_idx"), F.lit(None).cast("string").alias("c0"),
        F.lit(None).cast("string").alias("c1"), F.lit("Total").alias("c2"), F.lit(None).cast("string").alias("c3"),
        F.lit(None).cast("string").alias("c4"), "c5", F.lit(None).cast("string").alias("c6"))
    return title.unionByName(header).unionByName(bills).unionByName(subtotal)
