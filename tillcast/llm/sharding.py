"""Operator 10, sharding: minimax contiguous partition of ordered groups.

Rows with equal texts form an atomic group.  Groups are ordered by a 64-bit
hash of their text and cut into ``n`` contiguous runs such that the largest
run is as small as possible: binary search over the capacity, each candidate
checked greedily (fill a shard until the next group would exceed it), and the
cuts of the smallest feasible capacity are used.

The group table stays in Spark.  The driver sees a prefix tree over the hash
order: sums of ``FIRST_BITS``-bit ranges first, then, level by level, sums of
``NEXT_BITS`` finer ranges inside only those ranges that may still hold a cut.
Its size depends on ``n`` and the tree's fan-out, not on the rows.

Groups larger than an even share (at most ``n`` exist) get a shard of their own
first, so that one giant group of copies does not spoil the other shards; the
remaining groups are cut by the same search into the remaining shards.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillcast.llm.common import documents, partitions, staged, text_or_empty

SHARDS = 40
ROW_BYTES = 16
FIRST_BITS = 12
NEXT_BITS = 6


@dataclass
class Node:
    """Range of hash order: all keys whose top ``bits`` bits equal ``prefix``."""

    prefix: int
    bits: int
    total: int
    groups: int

    @property
    def atomic(self) -> bool:
        return self.groups == 1 or self.bits == 64


def greedy(sizes: np.ndarray, capacity: int) -> list[int] | None:
    """Indexes after which to cut so that no run exceeds ``capacity``; None if
    one item alone does."""
    if len(sizes) and int(sizes.max()) > capacity:
        return None
    ends = np.cumsum(sizes)
    cuts, done, at = [], 0, 0
    while at < len(sizes):
        at = int(np.searchsorted(ends, done + capacity, side="right"))
        cuts.append(at)
        done = int(ends[at - 1])
    return cuts


def smallest_capacity(sizes: np.ndarray, n: int) -> int:
    """Least capacity for which at most ``n`` contiguous runs suffice."""
    if not len(sizes):
        return 0
    low = max(int(sizes.max()), -(-int(sizes.sum()) // n))
    high = int(sizes.sum())
    while low < high:
        mid = (low + high) // 2
        cuts = greedy(sizes, mid)
        if cuts is not None and len(cuts) <= n:
            high = mid
        else:
            low = mid + 1
    return low


def reach(ends: np.ndarray, starts: np.ndarray, atomic: np.ndarray, capacity: int, n: int, far: bool) -> list[int]:
    """Offsets of the first ``n`` cuts over unresolved ranges: as if a range
    could be cut anywhere (``far``) or nowhere."""
    out, done, total = [], 0, int(ends[-1])
    for _ in range(n):
        goal = done + capacity
        if goal >= total:
            done = total
        else:
            i = int(np.searchsorted(ends, goal, side="right"))  # the range that holds the goal
            done = goal if far and not atomic[i] else max(done, int(starts[i]))
        out.append(done)
    return out


def to_refine(nodes: list[Node], n: int) -> list[Node]:
    """Unresolved ranges in which a cut of the optimal partition may lie."""
    sizes = np.array([x.total for x in nodes], dtype=np.int64)
    atomic = np.array([x.atomic for x in nodes])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    # Whole ranges give a capacity that surely suffices; freely divisible
    # ranges one that no partition can go below.
    high = smallest_capacity(sizes, n)
    low = max(-(-int(ends[-1]) // n), int(sizes[atomic].max()) if atomic.any() else 0)
    near = reach(ends, starts, atomic, low, n, far=False)
    far = reach(ends, starts, atomic, high, n, far=True)
    marked = np.zeros(len(nodes), dtype=bool)
    for a, b in zip(near, far):
        i = int(np.searchsorted(ends, a, side="right"))
        j = int(np.searchsorted(ends, b, side="right"))
        marked[i:j + 1] = True
    return [x for x, m in zip(nodes, marked) if m and not x.atomic]


def _prefix(bits: int) -> Column:
    """Top ``bits`` bits of the hash in unsigned order."""
    return F.shiftrightunsigned(F.col("h"), 64 - bits) if bits < 64 else F.col("h")


def _unsigned(h: int) -> int:
    return h & 0xFFFFFFFFFFFFFFFF


def find_cuts(groups: DataFrame, n: int) -> list[int]:
    """First hash (unsigned) of each shard but the first, for ``groups(h, size)``."""
    def level(df: DataFrame, bits: int) -> list[Node]:
        rows = df.groupBy(_prefix(bits).alias("p")).agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("c")).collect()
        return sorted((Node(_unsigned(r["p"]), bits, int(r["s"]), int(r["c"])) for r in rows), key=lambda x: x.prefix)

    nodes = level(groups, FIRST_BITS)
    if not nodes:
        return []
    while todo := to_refine(nodes, n):
        bits = min(x.bits for x in todo)
        todo = [x for x in todo if x.bits == bits]
        spark = groups.sparkSession
        wanted = spark.createDataFrame([(x.prefix - (1 << 64) if x.prefix >= 1 << 63 else x.prefix,) for x in todo], "p long")
        finer = level(groups.withColumn("p", _prefix(bits)).join(F.broadcast(wanted), "p", "left_semi"), min(64, bits + NEXT_BITS))
        gone = {x.prefix for x in todo}
        nodes = sorted([x for x in nodes if not (x.bits == bits and x.prefix in gone)] + finer,
                       key=lambda x: x.prefix << (64 - x.bits))
    sizes = np.array([x.total for x in nodes], dtype=np.int64)
    cuts = greedy(sizes, smallest_capacity(sizes, n))
    return [nodes[c].prefix << (64 - nodes[c].bits) for c in cuts[:-1]]


def giants(groups: DataFrame, n: int) -> tuple[list[int], int]:
    """Hashes of groups that exceed an even share of what the larger ones
    leave, largest first, and the number of shards for the rest."""
    total = groups.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("s")).first()["s"]
    rows = groups.filter(F.col("size") * n > total).orderBy(F.desc("size"), "h").limit(n - 1).collect()
    out: list[int] = []
    # What a giant leaves may make a smaller group a giant: look again until none.
    while rows:
        for r in rows:
            out.append(r["h"])
            total -= r["size"]
        left = n - len(out)
        if left <= 1:
            break
        rows = (groups.filter((F.col("size") * left > total) & ~F.col("h").isin(out))
                .orderBy(F.desc("size"), "h").limit(left - 1).collect())
    return out, n - len(out)


def shard(docs: DataFrame, n: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, size, text_crc32, law, shard, slot and grown_shard of every row.

    ``size`` is the UTF-8 bytes of the text plus 16.  Rows with equal texts
    share a shard (a null text counts as an empty one, with crc 0).  ``slot`` numbers the
    rows of a shard from 0 in (text hash, id, size, crc) order; rows equal in
    all of these are numbered in any order.  Null ids come first.  An empty
    table gives an empty result, and with fewer groups than shards the last
    shards stay empty.  Other columns are not read.
    """
    t = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(t) + ROW_BYTES).cast("long").alias("size"),
                       F.crc32(t.cast("binary")).alias("crc"), F.xxhash64(t).alias("h"))
    parts = partitions(docs.sparkSession)
    # Range order by (hash, id) splits a hot group of copies; numbered once,
    # on stored rows, so that later readers see the same ranges.
    ordered = (rows.withColumn("u", F.col("h").bitwiseXOR(F.lit(-(1 << 63))))
               .repartitionByRange(parts, "u", "id", "size")
               .withColumn("part", F.spark_partition_id()))
    ordered = staged(ordered, "shard-rows")
    groups = staged(ordered.groupBy("h").agg(F.sum("size").alias("size")), "shard-groups")
    big, left = giants(groups, n)
    cuts = find_cuts(groups.filter(~F.col("h").isin(big)) if big else groups, left)
    signed = [c ^ (1 << 63) for c in cuts]  # position in the order of u
    bounds = [c - (1 << 64) if c >= 1 << 63 else c for c in signed]
    rest = F.lit(len(big))
    for b in bounds:
        rest = rest + (F.col("u") >= F.lit(b)).cast("int")
    where = rest
    for i, h in enumerate(big):
        where = F.when(F.col("h") == F.lit(h), F.lit(i)).otherwise(where)
    placed = ordered.withColumn("shard", where.cast("int"))
    # slot = rows of the shard in earlier ranges (at most ranges x shards
    # counts) + position among its own range's rows of the shard.
    counts = placed.groupBy("part", "shard").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "shard", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("off"))
    inside = Window.partitionBy("part", "shard").orderBy("u", "id", "size", "crc")
    out = placed.withColumn("pos", F.row_number().over(inside) - 1).join(offsets, ["part", "shard"])
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
                      "shard", (F.col("off") + F.col("pos")).cast("long").alias("slot"),
                      F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, n: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the rows below ``path``, one folder ``shard=<k>`` per shard.  Ids must be unique."""
    plan = shard(docs, n, id_col, text_col).select(F.col(id_col).alias("_sid"), "shard", "slot")
    cols = [c for c in docs.columns if c not in ("shard", "slot")]
    (docs.select(*cols).join(plan, docs[id_col].eqNullSafe(F.col("_sid"))).drop("_sid")
     .write.partitionBy("shard").parquet(path))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: shard and slot of every document."""
    return shard(documents(spark, sf_dir))
