"""Operator 7, SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is embedded as the vector of bit counts of its
``SEGMENTS`` segments.  The Manhattan distance of two vectors never exceeds
the Hamming distance of the fingerprints.  Two vectors at distance 2 or less
have a grid point within distance 1 of both, so a range join on the grid is
an equality join on the points around each vector: only fingerprints that
meet another one on a point go on.

Exact check, linear in the members of a point: fingerprints at Hamming
distance 2 or less share a value reached by flipping at most one bit in each,
and all that share such a value are linked.  A fingerprint flips only the
bits that lead to the point at hand, and grouping by (point, value) yields
star edges instead of pairs, so a group of thousands of near copies costs
thousands of rows, never their square.  Components are then contracted in
rounds.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from tillcast.llm.common import documents, staged, task, text_or_empty
from tillcast.llm.components import connected_components

SHINGLE = 3
MAX_BITS = 2
SEED = 42
SEGMENTS = 16
BITS = 64 // SEGMENTS
#: Shingles whose bits are counted at a time (memory bound only).
CHUNK = 1 << 14


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """SimHash of the ``size``-word shingles of a text, as unsigned 64 bits."""
    words = text.encode().lower().split()  # bytes: ASCII white space and A-Z only
    n = len(words)
    if not n:
        return 0
    flat = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    ends = np.cumsum(lengths + 1) - 1
    k = min(size, n)
    starts = (ends - lengths)[:n - k + 1].tolist()
    stops = ends[k - 1:].tolist()
    m, counts = len(starts), np.zeros(64, dtype=np.int64)
    for i in range(0, m, CHUNK):
        h = np.array([xxh64_intdigest(flat[a:b], SEED) for a, b in zip(starts[i:i + CHUNK], stops[i:i + CHUNK])],
                     dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > m, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text",
                 text_hash: bool = False) -> DataFrame:
    """``id_col`` and ``fp`` (the 64 bits as a signed long) of each whole text; with
    ``text_hash`` also ``h``, a 64-bit hash of the text.

    Null, empty and blank texts have fingerprint 0.  Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias(id_col), text_or_empty(text_col).alias("text"),
                       *[F.xxhash64(text_or_empty(text_col)).alias("h")] * text_hash)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, max(b.num_rows, 1), 512):
                part = b.slice(i, 512)
                fp = np.array([fingerprint(t, size) for t in part.column(1).to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64)), *part.columns[2:]],
                                                 [id_col, "fp", *part.schema.names[2:]])

    return rows.mapInArrow(task(run), T.StructType([rows.schema[id_col], T.StructField("fp", T.LongType()), *rows.schema.fields[2:]]))


def _count(segment: int) -> F.Column:
    return F.bit_count(F.shiftrightunsigned("fp", BITS * segment).bitwiseAND(F.lit((1 << BITS) - 1)))


def _key(delta_segment=None, delta: int = 0):
    """The vector as one long, 3 bits a segment."""
    key = F.lit(0).cast("long")
    for s in range(SEGMENTS):
        key = key + F.shiftleft(_count(s).cast("long"), 3 * s)
    return key


def grid_links(fps: DataFrame) -> DataFrame:
    """Star edges (u, v) over the distinct ``fps(fp)`` whose components are those
    of "Hamming distance 2 or less"."""
    unit = F.array(*[F.lit(1 << (3 * s)) for s in range(SEGMENTS)])
    counts = F.array(*[_count(s) for s in range(SEGMENTS)])
    v = fps.select("fp", _key().alias("key"), counts.alias("c"))
    # Grid points within distance 1: the vector itself and one step in each segment.
    up = F.filter(F.sequence(F.lit(1), F.lit(SEGMENTS)), lambda s: F.element_at("c", s) < BITS)
    down = F.filter(F.sequence(F.lit(1), F.lit(SEGMENTS)), lambda s: F.element_at("c", s) > 0)
    points = F.concat(F.array(F.lit(0)), up, F.transform(down, lambda s: -s))
    # Points and their members travel as (step, point); the point is 48 bits.
    at = v.select("fp", "key", F.explode(points).alias("step")).select(
        "fp", "step", (F.col("key") + F.when(F.col("step") == 0, F.lit(0))
                       .when(F.col("step") > 0, F.element_at(unit, F.greatest(F.abs("step"), F.lit(1))))
                       .otherwise(-F.element_at(unit, F.greatest(F.abs("step"), F.lit(1))))).cast("long").alias("point"))
    # A point with two different fingerprints is a candidate; one aggregate
    # with map-side partials, then a semi-join back.
    shared = (at.groupBy("point").agg(F.min("fp").alias("a"), F.max("fp").alias("b"))
              .filter(F.col("a") != F.col("b")).select("point"))
    near = at.join(shared, "point", "left_semi")
    # Values that lie on the point: the fingerprint itself, or one flipped bit
    # (0 to 1 in the raised segment, 1 to 0 in the lowered one).
    first = (F.abs("step") - 1) * BITS
    masks = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), (first + i).cast("int")))
    flips = F.filter(masks, lambda m: (F.col("fp").bitwiseAND(m) == 0) == (F.col("step") > 0))
    values = F.when(F.col("step") == 0, F.array("fp")).otherwise(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m)))
    met = near.select("fp", F.explode(values).alias("value"))
    least = met.groupBy("value").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).filter(F.col("a") != F.col("b"))
    return (met.join(least.select("value", "a"), "value").filter(F.col("fp") != F.col("a"))
            .select(F.col("fp").alias("u"), F.col("a").alias("v")))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, max_bits: int = MAX_BITS, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``id_col``, ``fp`` and ``component_id`` (least id reachable) of every row.

    Rows with equal fingerprints are linked, whatever their texts; repeated
    rows give repeated results.  A null id is never a component id unless
    every id of the component is null.  An empty table gives an empty result.
    """
    if max_bits != MAX_BITS:
        raise ValueError("the grid step and the exact check are built for a distance of 2 bits")
    fp = staged(fingerprints(docs, size, id_col, text_col), "fingerprints")
    return fp.join(_components(fp, id_col), "fp").select(id_col, "fp", "component_id")


def _components(fp: DataFrame, id_col: str) -> DataFrame:
    """``root`` and ``component_id`` of every distinct fingerprint of staged ``fp``."""
    classes = staged(fp.groupBy("fp").agg(F.min(id_col).alias("least")), "classes")
    roots = staged(connected_components(grid_links(classes.select("fp"))), "roots")
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    component = named.groupBy("root").agg(F.min("least").alias("component_id"))
    # A fingerprint may belong to a third of all rows; its side here is unique,
    # so the adaptive skew split of the rows' side applies.
    return named.select("fp", "root").join(component, "root").select("fp", "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every near-duplicate class of ``docs``: that of the least id, a
    null id only if no row of the class has an id.  Of several rows with that
    id the one with the least hash of the text stays, of rows equal in id and
    text any one."""
    fp = staged(fingerprints(docs, id_col=id_col, text_col=text_col, text_hash=True), "fingerprints")
    least = fp.join(_components(fp, id_col), "fp").filter(F.col(id_col).eqNullSafe(F.col("component_id")))
    per_text = least.groupBy("root", "component_id", "h").agg(F.count(F.lit(1)).alias("n"))
    kept = staged(per_text.groupBy("root", "component_id").agg(F.min(F.struct("h", "n")).alias("least"))
                  .select(F.col("component_id").alias("_keep_id"), F.col("least.h").alias("_keep_hash"), F.col("least.n").alias("n")), "kept")
    rows = docs.withColumn("_hash", F.xxhash64(text_or_empty(text_col)))

    def of(keys: DataFrame) -> DataFrame:
        return rows.join(keys, rows[id_col].eqNullSafe(F.col("_keep_id")) & (rows["_hash"] == F.col("_keep_hash")), "left_semi")

    repeated = kept.filter("n > 1")
    if repeated.isEmpty():
        return of(kept).drop("_hash")
    # Only rows that are repeated whole are compared once more.
    return of(kept.filter("n = 1")).unionByName(of(repeated).dropDuplicates([id_col, "_hash"])).drop("_hash")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: fingerprint and component of every document."""
    return near_duplicates(documents(spark, sf_dir)).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
