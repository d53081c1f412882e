"""Global order statistics without a single-partition window.

``Window.orderBy(...)`` with no ``partitionBy`` moves every row into one task.
These helpers compute global positions, running sums and exact quantiles in
two passes instead:

1. range-partition the rows on the (unique) sort key into ``buckets`` ranges,
   so bucket ``i`` holds keys strictly before bucket ``i+1``;
2. per bucket: local row numbers / running sums (a window partitioned by the
   bucket) and bucket totals (``buckets`` rows — the broadcast side, whose
   size is the bucket count we chose, not the data size);
3. global value = exclusive prefix of the bucket totals + local value.

The sort key must be total (add a unique tie-break column) so that results
do not depend on how ties fall across buckets.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _default_buckets(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def global_prefix(df: DataFrame, order: Sequence[Column], sum_cols: Sequence[str] = (),
                  pos_col: str = "_pos", total_col: str | None = None,
                  buckets: int | None = None) -> DataFrame:
    """Add a 1-based global position ``pos_col`` in ``order`` and, for each
    column ``c`` in ``sum_cols``, the inclusive running sum ``cum_<c>``.

    With ``total_col`` set, also add the row count of the whole input there
    and ``total_<c>`` for each summed column (free: they come from the same
    bucket totals).
    """
    n = buckets or _default_buckets(df)
    ranged = df.repartitionByRange(n, *order).withColumn("_bucket", F.spark_partition_id())
    # ``ranged`` feeds two branches (local windows, bucket totals).  Both must
    # see the same range bounds, and bounds are sampled anew whenever the
    # exchange is planned again (columns pruned differently, a retry), so the
    # ranged rows are written once by a reliable checkpoint and read twice.
    from tillcast.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    ranged = ranged.checkpoint(eager=True)

    in_bucket = Window.partitionBy("_bucket").orderBy(*order)
    running = in_bucket.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.withColumn("_lpos", F.row_number().over(in_bucket))
    for c in sum_cols:
        local = local.withColumn(f"_lcum_{c}", F.sum(c).over(running))

    totals = ranged.groupBy("_bucket").agg(
        F.count(F.lit(1)).alias("_bn"), *[F.sum(c).alias(f"_bs_{c}") for c in sum_cols])
    # ``totals`` has at most ``n`` rows: the ordered window over it is tiny.
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    offs = [F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_off_n")]
    for c in sum_cols:
        offs.append(F.coalesce(F.sum(f"_bs_{c}").over(before), F.lit(0)).alias(f"_off_{c}"))
    if total_col:
        offs.append(F.sum("_bn").over(everything).alias(total_col))
        for c in sum_cols:
            offs.append(F.sum(f"_bs_{c}").over(everything).alias(f"total_{c}"))
    offsets = totals.select("_bucket", *offs)

    out = local.join(F.broadcast(offsets), "_bucket")
    out = out.withColumn(pos_col, F.col("_off_n") + F.col("_lpos"))
    for c in sum_cols:
        out = out.withColumn(f"cum_{c}", F.col(f"_off_{c}") + F.col(f"_lcum_{c}"))
    drop = ["_bucket", "_lpos", "_off_n"] + [f"_lcum_{c}" for c in sum_cols] + [f"_off_{c}" for c in sum_cols]
    return out.drop(*drop)


def exact_quantiles(df: DataFrame, value_col: str, probs: Sequence[float],
                    tie_break: str | None = None, buckets: int | None = None) -> DataFrame:
    """One row with ``q_<i>`` = the exact linear-interpolated quantile of
    ``value_col`` for each probability (same rule as numpy's default and SQL
    ``quantile_cont``): position p·(n−1) between the two order statistics
    around it.  Distributed: only the (at most 2·len(probs)) order statistics
    needed are selected, never the whole column in one task.
    """
    order = [F.col(value_col).asc()]
    if tie_break:
        order.append(F.col(tie_break).asc())
    ranked = global_prefix(df.select(value_col, *([tie_break] if tie_break else [])),
                           order, total_col="_n", buckets=buckets)
    idx0 = F.col("_pos") - 1
    aggs = []
    wanted = F.lit(False)
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        ranked = ranked.withColumn(f"_lo{i}", lo).withColumn(f"_hi{i}", hi).withColumn(f"_fr{i}", pos - lo)
        wanted = wanted | (idx0 == F.col(f"_lo{i}")) | (idx0 == F.col(f"_hi{i}"))
    picked = ranked.filter(wanted)
    for i, _ in enumerate(probs):
        lo_v = F.max(F.when(idx0 == F.col(f"_lo{i}"), F.col(value_col).cast("double")))
        hi_v = F.max(F.when(idx0 == F.col(f"_hi{i}"), F.col(value_col).cast("double")))
        frac = F.max(F.col(f"_fr{i}"))
        aggs.append((lo_v + (hi_v - lo_v) * frac).alias(f"q_{i}"))
    return picked.agg(*aggs)
