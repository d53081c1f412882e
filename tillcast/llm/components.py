"""Connected components of an edge table by alternating star contraction.

Each round links every larger neighbour of a node to the node's least
neighbour, then every node and its lesser neighbours to the least of them.
The number of rounds grows with the logarithm of the longest chain; edges
never exceed their first count, and each round is stored durably.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.llm.common import staged


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """edges(u, v): one star per node over both directions (large) or over the
    lesser neighbours (small), linked to the least of its members."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    joined = both.join(least.withColumn("m", F.least("m", "u")), "u")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge in ``edges(u, v)`` (long);
    ``root`` is the least node of its component."""
    e = staged(edges.filter(F.col("u") != F.col("v")).distinct(), "edges")
    last = None
    while True:
        e = staged(_stars(_stars(e, True), False), "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if last is not None and tuple(now) == last:
            break
        last = tuple(now)
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(e.select("v", "v").distinct())
