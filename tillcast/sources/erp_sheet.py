"""SRC-2/3: ERP sales-sheet mapping.

Input: spreadsheet rows as text, ``(file, row_idx, c0 .. cN)`` — how a sheet
arrives once its container is decoded.  Per file the header row is the first
row whose lower-cased, space-joined cells contain both "bill no" and "item"
(row 0 when none does).  Columns are then named from that header row and the
ERP fields mapped onto the transaction-log layout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.functions.dates import parse_mixed_timestamp
from tillcast.functions.text import scrub_formula, strip_ws
from tillcast.session import few, stored
from tillcast.sources.landing import Mapped, map_rows

# ERP column names and the country of that export.
ERP_FIELDS = {
    "InvoiceNo": "Bill No",
    "StockCode": "Item",
    "Description": "Item Name",
    "Quantity": "Qty",
    "InvoiceDate": "Bill Date",
    "TaxableAmount": "Taxable Amt",
    "Customer ID": "Customer Name",
}
ERP_COUNTRY = "India"
HEADER_MARKERS = ("bill no", "item")


def _cells(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("file", "row_idx")]


def header_rows(sheet: DataFrame) -> DataFrame:
    """Per file: index of the header row and whether a marker row exists.
    A grouped ``min`` — one small row per file, stored."""
    cells = _cells(sheet)
    joined = F.concat_ws(" ", *[F.lower(F.trim(F.col(c))) for c in cells])
    hit = F.contains(joined, F.lit(HEADER_MARKERS[0])) & F.contains(joined, F.lit(HEADER_MARKERS[1]))
    return stored(sheet.groupBy("file").agg(
        F.coalesce(F.min(F.when(hit, F.col("row_idx"))), F.lit(0)).alias("header_idx"),
        F.max(hit.cast("int")).alias("_found")), "sheet-headers")


def map_erp_sheet(sheet: DataFrame, validate: bool = True) -> tuple[DataFrame, DataFrame]:
    """SRC-2: returns ``(mapped_rows, unmatched_files)``.

    mapped rows carry the log columns with Price = round(Taxable Amt / Qty,
    2) (Qty 0 counts as 1), Country 'India', rows without Bill No or Item
    dropped, is_return and revenue derived.  ``unmatched_files`` lists files
    without a marker row — SRC-3 sends those through the standard cleaning.

    The data rows look their fields up by the position of the name in the
    file's header row (one join with the per-file header table, no collect to
    the driver).  Stock code, description and country are scrubbed as in any
    log; rejected rows are counted by ``erp_report``.
    """
    rows, unmatched = erp_rows(sheet)
    if validate:
        rows = rows.filter(F.col("reject_reason").isNull())
    return rows.drop("reject_reason"), unmatched


def erp_report(rows: DataFrame) -> DataFrame:
    """CLEAN-13 counts of ``erp_rows``: one row per rule that fired."""
    from tillcast.operators.cleaning import report_counts
    return report_counts(rows)


def erp_rows(sheet: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All mapped rows with ``reject_reason`` (NULL = accepted), and the files without a marker row.

    A field's column is the first header cell of that name; blank and repeated
    header cells do no harm.
    """
    return _erp_rows(sheet)[:2]


def _erp_rows(sheet: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``erp_rows``, and the sheets' ``header_rows``."""
    from tillcast.operators.cleaning import reject_reason
    cells = _cells(sheet)
    # One row per sheet.  Their number grows with the files; while they are few they go to
    # every task, so that the sheets' rows are not dealt out by file.
    hdr = header_rows(sheet)
    names = sheet.join(few(hdr), "file").filter((F.col("row_idx") == F.col("header_idx")) & (F.col("_found") == 1)).select(
        "file", "header_idx", F.array(*[F.trim(F.col(c)) for c in cells]).alias("_names"))
    fields = list(ERP_FIELDS.values())
    names = stored(names.select("file", "header_idx", *[
        F.coalesce(F.array_position("_names", F.lit(n)), F.lit(0)).cast("int").alias(f"_at{i}") for i, n in enumerate(fields)]), "sheet-names")
    data = (sheet.select("file", "row_idx", F.array(*[F.col(c) for c in cells]).alias("_cells")).join(few(names), "file")
            .filter(F.col("row_idx") > F.col("header_idx")))

    def field(name: str):
        at = F.col(f"_at{fields.index(name)}")
        return F.when(at > 0, F.get("_cells", at - 1))

    qty = F.trim(field(ERP_FIELDS["Quantity"])).try_cast("double")
    amount = F.trim(field(ERP_FIELDS["TaxableAmount"])).try_cast("double")
    denom = F.when(qty == 0, F.lit(1.0)).otherwise(qty)
    text = lambda name: scrub_formula(field(ERP_FIELDS[name]))
    out = data.select(
        "file", "row_idx",
        field(ERP_FIELDS["InvoiceNo"]).alias("InvoiceNo"),
        text("StockCode").alias("StockCode"),
        text("Description").alias("Description"),
        qty.alias("Quantity"),
        parse_mixed_timestamp(field(ERP_FIELDS["InvoiceDate"])).alias("InvoiceDate"),
        F.round(F.try_divide(amount, denom), 2).alias("Price"),
        F.nullif(strip_ws(field(ERP_FIELDS["Customer ID"])), F.lit("")).alias("Customer ID"),
        F.lit(ERP_COUNTRY).alias("Country"),
    ).dropna(subset=["InvoiceNo", "StockCode"])
    # The reference skips the price, quantity and date checks for ERP rows;
    # here they pass the same rules as any log (CLEAN-7..9).
    out = out.withColumns({
        "is_return": F.col("Quantity") < 0,
        "revenue": F.col("Quantity") * F.col("Price"),
        "reject_reason": reject_reason(F.col("StockCode"), F.col("InvoiceDate"), F.col("Quantity"), F.col("Price"))})
    return out, hdr.filter(F.col("_found") == 0).select("file"), hdr


def sheet_fallback(sheet: DataFrame, unmatched: DataFrame | None = None) -> DataFrame:
    """SRC-3: the sheets without a marker row as raw log rows (``_file``, ``_row``, canonical columns): their
    row 0 names the columns; pass the result to ``cleaning.clean_log``."""
    return fallback_sheets(sheet, unmatched).rows


def fallback_sheets(sheet: DataFrame, unmatched: DataFrame | None = None) -> Mapped:
    """SRC-3 whole: the rows of ``sheet_fallback``, and in ``refused`` the sheets whose row 0
    does not name the required columns, with the reason."""
    if unmatched is None:
        unmatched = header_rows(sheet).filter(F.col("_found") == 0).select("file")
    cells = _cells(sheet)
    rows = sheet.join(few(unmatched), "file", "left_semi").select(
        F.col("file").alias("_file"), F.struct(F.lit(0).cast("long").alias("block"), F.col("row_idx").cast("long").alias("id")).alias("_row"),
        F.array(*[F.col(c) for c in cells]).alias("cells"))
    return map_rows(rows, width=None)


def sheet_outcomes(sheet: DataFrame) -> DataFrame:
    """One row per sheet: ``outcome`` mapped (ERP layout), fallback (standard cleaning) or
    refused with its ``reason``, and the ``data_rows`` that reach validation."""
    erp, unmatched, found = _erp_rows(sheet)
    other = fallback_sheets(sheet, unmatched)
    n = F.count(F.lit(1)).alias("data_rows")
    counts = erp.groupBy("file").agg(n).unionByName(other.rows.groupBy(F.col("_file").alias("file")).agg(n))
    found = found.select("file", (F.col("_found") == 1).alias("erp"))
    refused = other.refused.select(F.col("_file").alias("file"), "reason")
    j = found.join(refused, "file", "left").join(counts, "file", "left")
    outcome = F.when(F.col("erp"), "mapped").when(F.col("reason").isNotNull(), "refused").otherwise("fallback")
    return j.select("file", outcome.alias("outcome"), "reason", F.coalesce("data_rows", F.lit(0)).cast("long").alias("data_rows"))
