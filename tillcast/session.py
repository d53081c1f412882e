"""Session helpers.

Library operators never build a session: they take DataFrames and return
DataFrames.  These helpers exist for tests, the bench and the driver entry
point, and for the few operators that need a durable checkpoint folder.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings every tillcast session wants, whatever the cluster size.
# AQE re-plans joins and coalesces partitions at runtime and splits skewed
# join partitions (a hot product can hold a third of all facts).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "tillcast", extra: dict | None = None) -> SparkSession:
    """A local session for tests and the bench (the cluster brings its own)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = "8g"
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, reading it from the session.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is.  Only when nothing is configured and the master is local (unit
    tests on a laptop) do we fall back to a fresh local scratch folder; on a
    cluster each machine would write to its own disk, so that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tillcast-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


#: Codec of tables that a job stores for itself: about half the bytes of the default (snappy) for text.
CODEC = "zstd"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared scratch area and read from there.  Readers
    share that one run, and the planner knows the size of what was written."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path, compression=CODEC)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def byte_count(text: str) -> int:
    """Bytes that a size setting such as ``64m``, ``64MB`` or ``67108864b`` means."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([kmgtp]?)i?b?\s*", text.lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


#: Rows up to which a table of a row per file goes to every task.
FEW_ROWS = 100_000


def few(df: DataFrame) -> DataFrame:
    """``df``, a stored table of a row per file, sent to every task while it holds at most
    ``FEW_ROWS`` rows, whatever broadcasts the session allows the planner.  Joined by shuffle, all rows
    of a file would be sorted by one task.  A longer table is left to the planner and its skew split."""
    return F.broadcast(df) if df.limit(FEW_ROWS + 1).count() <= FEW_ROWS else df


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "tillcast-tables", name)
