"""SRC-1 (raw log CSV scan), GATE-1/2 (landing-zone file gate), SRC-4
(table reads/writes)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.functions.text import file_extension, sanitize_filename
from tillcast.session import CODEC

# Upload limits and the xlsx (zip) signature.
ALLOWED_EXTENSIONS = (".csv", ".xlsx")
MAX_UPLOAD_MB = 100
XLSX_MAGIC = bytes([0x50, 0x4B, 0x03, 0x04])
MAGIC_PROBE_BYTES = 1024
HEADER_PROBE_BYTES = 1 << 16


BAD_CONTENT = "Content is not what the extension says"


def gate_reason(ext, length, allowed=ALLOWED_EXTENSIONS, max_mb: int | None = MAX_UPLOAD_MB):
    """GATE-1 by name and size: why a file is refused, NULL if it is not."""
    reason = F.when(~ext.isin(list(allowed)), F.lit("Extension is none of " + " ".join(allowed)))
    if max_mb is not None:
        reason = reason.when(length > max_mb * 1024 * 1024, F.lit(f"Larger than {max_mb} MB"))
    return reason


def file_gate(spark: SparkSession, path: str, allowed=ALLOWED_EXTENSIONS,
              max_mb: int | None = MAX_UPLOAD_MB) -> DataFrame:
    """GATE-1/2: one row per landed file with ``reason`` (NULL = accepted,
    first failing check wins: extension, size, content), the encoding to read
    it with (UTF-8, else ISO-8859-1) and the sanitised file name.

    Two passes over the listing: sizes and names come from file metadata
    without reading content; the size limit is a filter of the second pass, which the
    source applies before it reads bytes, so an oversized file is never loaded.  What is
    joined are a file's findings, not its bytes.  ``max_mb=None`` lifts the size limit.  ``columns``: those that the first line of a CSV file seems to have.
    """
    listing = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    ext = file_extension(F.col("path"))
    pre = gate_reason(ext, F.col("length"), allowed, max_mb)
    meta = listing.withColumn("ext", ext).withColumn("reason", pre)
    read = spark.read.format("binaryFile").load(path)
    if max_mb is not None:
        read = read.filter(F.col("length") <= max_mb * 1024 * 1024)
    content = (read.filter(file_extension(F.col("path")).isin(list(allowed)))
               .select("path",
                       F.substring("content", 1, 4).alias("_magic"),
                       _columns(F.substring("content", 1, HEADER_PROBE_BYTES)).alias("columns"),
                       F.is_valid_utf8(F.col("content").cast("string")).alias("_utf8")))
    j = meta.join(content, "path", "left")
    bad_content = (F.col("ext") == ".xlsx") & (F.col("_magic") != F.lit(XLSX_MAGIC))
    reason = F.coalesce(F.col("reason"),
                        F.when(bad_content, F.lit(BAD_CONTENT)))
    return j.select(
        "path", sanitize_filename(F.col("path")).alias("filename"), "length", "modificationTime",
        "ext", reason.alias("reason"),
        F.when(F.col("ext") == ".csv", F.when(F.col("_utf8"), "UTF-8").otherwise("ISO-8859-1")).alias("encoding"),
        F.when(F.col("ext") == ".csv", F.col("columns")).alias("columns"))


def _columns(head: Column) -> Column:
    """One more than the commas of the first line; a guess, as quoted names may hold commas or line ends."""
    line = F.substring_index(F.decode(head, "ISO-8859-1"), "\n", 1)
    return (F.length(line) - F.length(F.replace(line, F.lit(","))) + 1).cast("int")


def read_raw_log(spark: SparkSession, paths, encoding: str = "UTF-8") -> DataFrame:
    """SRC-1: CSV with a header row, every column as text (no inference pass,
    stock codes such as 71053 stay text), quoted multi-line fields allowed,
    lineage columns ``_file`` (source path) and ``_row`` (load order).

    Files read in one call must share a header layout: a header that differs
    fails the read.  ``sources.landing`` reads mixed folders."""
    df = (spark.read.option("header", True).option("inferSchema", False)
          .option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE")
          .option("encoding", encoding).option("enforceSchema", False).csv(paths))
    return df.select(F.col("_metadata.file_path").alias("_file"),
                     F.monotonically_increasing_id().alias("_row"), *[F.col(f"`{c}`") for c in df.columns])


def write_table(df: DataFrame, path: str, partition_by=None, dynamic: bool = True) -> None:
    """SRC-4: Parquet table write; with ``partition_by`` and ``dynamic`` only
    the partitions present in ``df`` are replaced (idempotent reloads)."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic" if dynamic else "static")
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.parquet(path, compression=CODEC)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
