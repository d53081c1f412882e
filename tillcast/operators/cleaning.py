"""CLEAN-1..13: validate and clean a raw transaction log.

Input: a DataFrame of string columns as read from CSV (``sources.raw_log``),
optionally with lineage columns (``_file``, ``_row``).  Output: a
``CleanResult`` with

* ``rows``     – every non-empty input row with a ``reject_reason`` column
                 (NULL = accepted) and the parsed/derived columns;
* ``accepted`` – rows without a reason, from files without a fatal error;
* ``report``   – one row per rule that fired (type, message, fatal, affected_rows);
* ``summary``  – row_count, valid_rows, invalid_rows, empty_rows.

Rules are evaluated in the reference's order, so one CASE column assigns each
row its first failing rule and a single ``groupBy(reject_reason)`` reproduces
the sequential counts — all in one scan, no per-rule passes.

``clean_staged`` is the form for whole loads: the parsed rows are written once,
the counts of every rule are observed by that same write, and report, summary
and the fatal check come from them without reading the stage again.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tillcast.functions.dates import parse_mixed_timestamp
from tillcast.functions.text import scrub_formula, strip_ws
from tillcast.session import CODEC, few, stored

# The required columns, in the reference's order.
REQUIRED_COLUMNS = ["InvoiceNo", "StockCode", "Description", "Quantity",
                    "InvoiceDate", "Price", "Customer ID", "Country"]

# Header aliases (source name → canonical name).
COLUMN_ALIASES = {
    "UnitPrice": "Price",
    "unit_price": "Price",
    "Sales": "Price",
    "CustomerID": "Customer ID",
    "customer_id": "Customer ID",
    "invoice_no": "InvoiceNo",
    "Order ID": "InvoiceNo",
    "stock_code": "StockCode",
    "Product ID": "StockCode",
    "description": "Description",
    "Product Name": "Description",
    "quantity": "Quantity",
    "invoice_date": "InvoiceDate",
    "Order Date": "InvoiceDate",
    "country": "Country",
}

# Validation limits.
MAX_ALLOWED_PRICE = 100_000
MAX_ALLOWED_QUANTITY = 100_000

# Text that a pandas CSV read treats as missing.
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
               "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

SCRUBBED_COLUMNS = ["StockCode", "Description", "Country"]


class CleaningError(ValueError):
    pass


@dataclass
class CleanResult:
    rows: DataFrame
    accepted: DataFrame
    report: DataFrame
    summary: DataFrame
    fatal: list
    counts: dict | None = None      # observed counts, if the rows were staged


def normalize_headers(df: DataFrame) -> tuple[DataFrame, list[dict]]:
    """CLEAN-1/2/3 (plan time, no job): trim header names, apply aliases,
    add Quantity = '1' when absent, report missing or ambiguous columns."""
    errors: list[dict] = []
    trimmed = {c: c.strip() for c in df.columns}
    renamed = {c: COLUMN_ALIASES.get(t, t) for c, t in trimmed.items()}
    targets = [t for c, t in renamed.items() if not c.startswith("_")]
    dupes = sorted({t for t in targets if targets.count(t) > 1})
    if dupes:
        errors.append({"type": "ambiguous_columns", "fatal": True,
                       "message": f"Several columns map to: {', '.join(dupes)}"})
        return df, errors
    out = df.withColumnsRenamed({c: t for c, t in renamed.items() if c != t})
    if "Quantity" not in out.columns:
        out = out.withColumn("Quantity", F.lit("1"))
    missing = sorted(set(REQUIRED_COLUMNS) - set(out.columns))
    if missing:
        errors.append({"type": "missing_columns", "fatal": True,
                       "message": f"Missing required columns: {', '.join(missing)}"})
    return out, errors


def _nullify(c: Column) -> Column:
    return F.when(c.isin(NULL_TOKENS), F.lit(None)).otherwise(c)


def _to_number(c: Column) -> Column:
    """CLEAN-6: numeric coercion, NULL when not a number (ANSI-safe)."""
    return strip_ws(c).try_cast("double")


def reject_reason(stock: Column, date: Column, qty: Column, price: Column) -> Column:
    """CLEAN-7/8/9 in order: null critical value, price outside [0, 100000],
    |quantity| > 100000 (negative quantities are returns and stay)."""
    return (F.when(stock.isNull() | date.isNull() | qty.isNull() | price.isNull(), "null_values")
            .when((price < 0) | (price > MAX_ALLOWED_PRICE), "invalid_price")
            .when(F.abs(qty) > MAX_ALLOWED_QUANTITY, "extreme_quantity"))


def _message(kind: Column, n: Column) -> Column:
    """CLEAN-13 report texts."""
    return (F.when(kind == "null_values", F.format_string("%d rows left out: stock code, date, quantity or price is missing", n))
            .when(kind == "invalid_price", F.format_string(f"%d rows left out: price below 0 or above {MAX_ALLOWED_PRICE}", n))
            .when(kind == "extreme_quantity", F.format_string(f"%d rows left out: more than {MAX_ALLOWED_QUANTITY} units", n))
            .when(kind == "fractional_quantity", F.format_string("%d rows have part units; whole units are stored", n))
            .when(kind == "date_parse_error", F.format_string("%d values of InvoiceDate are not dates", n)))


def report_counts(rows: DataFrame) -> DataFrame:
    """CLEAN-13 rows of a table with ``reject_reason``: one per rule that fired."""
    n = rows.filter(F.col("reject_reason").isNotNull()).groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.col("reject_reason").alias("type"), _message(F.col("reject_reason"), F.col("n")).alias("message"),
                    F.lit(False).alias("fatal"), F.col("n").alias("affected_rows"))


def clean_log(raw: DataFrame, strict_scrub: bool = False, file_col: str | None = None) -> CleanResult:
    """Validate and clean a raw log (see module doc)."""
    rows, errors = checked_rows(raw, strict_scrub)
    return clean_result(rows, raw, errors, file_col)


def clean_staged(raw: DataFrame, path: str, strict_scrub: bool = False, file_col: str | None = None) -> CleanResult:
    """``clean_log`` with its rows written to ``path`` once and read from there.

    The counts come with that write (``observe`` on its last stage, where a task
    counts once however often it is tried), so the raw log is scanned once, and
    report, summary and fatal check read nothing.  Only where some date is
    unparseable the stage is asked which files hold one.
    """
    rows, errors = checked_rows(raw, strict_scrub)
    if errors:
        return clean_result(rows, raw, errors, file_col)
    seen = Observation(f"clean-{uuid.uuid4().hex}")
    rows.observe(seen, *observed_counts()).write.mode("overwrite").parquet(path, compression=CODEC)
    return observed_result(raw.sparkSession.read.schema(rows.schema).parquet(path), seen.get, file_col)


#: Rules in report order.
RULES = ("null_values", "invalid_price", "extreme_quantity")


def _fractional() -> Column:
    return F.col("reject_reason").isNull() & (F.col("Quantity") != F.floor(F.col("Quantity")))


def observed_counts() -> list[Column]:
    """Aggregates of ``checked_rows`` from which ``observed_result`` makes report and summary."""
    reason = F.col("reject_reason")
    return [F.count(F.lit(1)).alias("row_count"), F.count_if(reason.isNull()).alias("valid_rows"),
            *[F.count_if(reason == r).alias(r) for r in (*RULES, "empty_row")],
            F.count_if(F.col("_bad_date")).alias("date_parse_error"), F.count_if(_fractional()).alias("fractional_quantity")]


def observed_result(rows: DataFrame, counts: dict, file_col: str | None = None) -> CleanResult:
    """The result over staged ``rows`` whose ``observed_counts`` are known."""
    spark = rows.sparkSession
    n = lambda k: int(counts.get(k) or 0)
    fired = [(k, k == "date_parse_error", n(k)) for k in (*RULES, "date_parse_error", "fractional_quantity") if n(k)]
    report = spark.createDataFrame(fired, "type string, fatal boolean, affected_rows long").select(
        "type", _message(F.col("type"), F.col("affected_rows")).alias("message"), "fatal", "affected_rows")
    summary = spark.createDataFrame([(n("row_count"), n("valid_rows"), sum(map(n, RULES)), n("empty_row"))],
                                    "row_count long, valid_rows long, invalid_rows long, empty_rows long")
    accepted = rows.filter(F.col("reject_reason").isNull())
    if n("date_parse_error"):
        accepted = (accepted.join(few(stored(rows.filter("_bad_date").select(file_col).distinct(), "bad-files")), file_col, "left_anti")
                    if file_col else accepted.limit(0))
    return CleanResult(rows.drop("_bad_date"), accepted.drop("reject_reason", "_bad_date"), report, summary, [], dict(counts))


def checked_rows(raw: DataFrame, strict_scrub: bool = False) -> tuple[DataFrame, list[dict]]:
    """Every row of a raw log with its parsed columns, ``reject_reason`` and
    ``_bad_date``; or, with plan-time errors, no rows.  Store this table to
    derive all of ``clean_result`` without parsing again."""
    df, errors = normalize_headers(raw)
    if errors:
        return df.limit(0), errors
    return _checked(df, strict_scrub), errors


def clean_result(rows: DataFrame, raw: DataFrame, errors: list[dict], file_col: str | None = None) -> CleanResult:
    """Accepted rows, report and summary of ``checked_rows``."""
    spark = raw.sparkSession
    report_schema = "type string, message string, fatal boolean, affected_rows long"
    if errors:
        report = spark.createDataFrame([(e["type"], e["message"], True, None) for e in errors], report_schema)
        empty = rows
        summary = raw.agg(F.count(F.lit(1)).alias("row_count")).select(
            "row_count", F.lit(0).cast("long").alias("valid_rows"),
            F.lit(0).cast("long").alias("invalid_rows"), F.lit(0).cast("long").alias("empty_rows"))
        return CleanResult(empty, empty, report, summary, errors)

    return _result(rows, file_col)


def _checked(df: DataFrame, strict_scrub: bool) -> DataFrame:
    lineage = [c for c in df.columns if c.startswith("_")]
    base = df.select(*lineage, *[_nullify(F.col(f"`{c}`")).alias(c) for c in REQUIRED_COLUMNS])
    all_null = F.lit(True)
    for c in REQUIRED_COLUMNS:
        all_null = all_null & F.col(f"`{c}`").isNull()
    base = base.withColumn("_empty", all_null)

    # The parsed values leave the projection as one generated row: filters on them
    # cannot be pushed below, so each is evaluated once per row and not written
    # out again in every predicate.
    parsed = F.struct(parse_mixed_timestamp(F.col("InvoiceDate")).alias("_date"),
                      _to_number(F.col("Quantity")).alias("_qty"), _to_number(F.col("Price")).alias("_price"))
    typed = base.select("*", F.inline(F.array(parsed)))
    bad_date = F.col("InvoiceDate").isNotNull() & F.col("_date").isNull()
    typed = typed.withColumn("_bad_date", bad_date & ~F.col("_empty"))
    reason = F.when(F.col("_empty"), "empty_row").otherwise(
        reject_reason(F.col("StockCode"), F.col("_date"), F.col("_qty"), F.col("_price")))
    scrub = (lambda c: scrub_formula(c, strict=strict_scrub))
    return typed.select(
        *lineage,
        F.col("InvoiceNo"),
        scrub(F.col("StockCode")).alias("StockCode"),
        scrub(F.col("Description")).alias("Description"),
        F.col("_qty").alias("Quantity"),
        F.col("_date").alias("InvoiceDate"),
        F.col("_price").alias("Price"),
        F.nullif(strip_ws(F.col("`Customer ID`")), F.lit("")).alias("Customer ID"),
        scrub(F.col("Country")).alias("Country"),
        (F.col("_qty") < 0).alias("is_return"),
        (F.col("_qty") * F.col("_price")).alias("revenue"),
        reason.alias("reject_reason"),
        F.col("_bad_date"),
        # Load order (first-row-wins lineage).
        F.monotonically_increasing_id().alias("_seq"),
    )


def _result(rows: DataFrame, file_col: str | None) -> CleanResult:
    # CLEAN-5: an unparseable date makes its whole file fatal.
    bad_rows = rows.filter(F.col("_bad_date"))
    if file_col:
        # One row per fatal file.  Their number grows with the landing folder,
        # so no broadcast is forced: the planner broadcasts what it measured
        # small, else the skew split applies to the hot file keys.
        fatal_files = bad_rows.select(file_col).distinct()
        accepted = rows.join(fatal_files, file_col, "left_anti")
    else:
        n_bad = bad_rows.agg(F.count("_seq")).scalar()
        accepted = rows.filter(n_bad == 0)
    accepted = accepted.filter(F.col("reject_reason").isNull()).drop("reject_reason", "_bad_date")

    # CLEAN-13 in one pass: counts per reason (≤ 5 groups) folded into one
    # row, then exploded into report rows.
    counts = rows.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"),
                                               F.count_if(F.col("_bad_date")).alias("bad"),
                                               F.count_if(_fractional()).alias("frac"))
    folded = counts.agg(
        F.collect_list(F.when(F.col("reject_reason").isin(*RULES),
                              F.struct(F.col("reject_reason").alias("type"), F.col("n").alias("affected_rows"))))
        .alias("_rules"),
        F.sum("bad").cast("long").alias("_bad"),
        F.sum("frac").cast("long").alias("_frac"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("row_count"),
        F.coalesce(F.sum(F.when(F.col("reject_reason").isNull(), F.col("n"))), F.lit(0)).cast("long")
        .alias("valid_rows"),
        F.coalesce(F.sum(F.when(F.col("reject_reason").isin(*RULES), F.col("n"))), F.lit(0)).cast("long")
        .alias("invalid_rows"),
        F.coalesce(F.sum(F.when(F.col("reject_reason") == "empty_row", F.col("n"))), F.lit(0)).cast("long")
        .alias("empty_rows"),
    )
    date_entry = F.when(F.col("_bad") > 0, F.array(F.struct(F.lit("date_parse_error").alias("type"),
                                                            F.col("_bad").alias("affected_rows"))))
    # D18: kept rows whose quantity is fractional are stored truncated while
    # revenue uses the raw value — reported as a non-fatal notice.
    frac_entry = F.when(F.col("_frac") > 0, F.array(F.struct(F.lit("fractional_quantity").alias("type"),
                                                              F.col("_frac").alias("affected_rows"))))
    none = F.array().cast("array<struct<type:string,affected_rows:bigint>>")
    entries = F.concat(F.col("_rules"), F.coalesce(date_entry, none), F.coalesce(frac_entry, none))
    report = folded.select(F.explode(entries).alias("e")).select(
        F.col("e.type").alias("type"), _message(F.col("e.type"), F.col("e.affected_rows")).alias("message"),
        (F.col("e.type") == "date_parse_error").alias("fatal"),
        F.col("e.affected_rows").cast("long").alias("affected_rows"))
    summary = folded.select("row_count", "valid_rows", "invalid_rows", "empty_rows")
    return CleanResult(rows.drop("_bad_date"), accepted, report, summary, [])
