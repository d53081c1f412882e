"""Merkle manifest of a table: a tree of hashes per group, one root over all groups.

A row's leaf is the hash of its fields.  Within a group the leaves stand in
order of their id; every ``ARITY`` consecutive nodes of a level become the hash
of their digests, until one node is left, the group's subroot.  The subroots,
in order of the group's name, become the root in the same way.

Nodes of a group are cut into blocks of ``SPAN = ARITY ** LEVELS`` consecutive
ones, so that a window is never larger than a block however many rows a group
has.  In a block the node of level ``l`` stands on the first of its
``ARITY ** l`` rows, and lag and lead at the fixed offsets ``j * ARITY ** l``,
masked by the slot in the run, give a node's siblings (a lead beyond the run's
end is null); rows of first children hash their run.  The blocks' nodes are the
rows of the next tier, as many times smaller, until one block is left.

Results in odd cases: null fields hash as ``-``; null ids come first, null
groups first; rows that repeat an id stand in order of their leaf, equal rows
next to each other; a group of one row has its leaf as subroot, a single
group's subroot is the root; an empty table gives no rows.  Columns not named
in ``fields`` are not read.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillcast.llm.common import documents, staged
from tillcast.operators.ordered import global_prefix

ARITY = 2
LEVELS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows whose id's crc32 this divides are edited in the contract's check.
EDITED = 7


def field(value: Column) -> Column:
    """A field as it is hashed: ``-`` for null, else UTF-8 byte count, ``:`` and the value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_hash(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _tier(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """``nodes`` (g, pos, n, h, ...) with their ``block``, ``path`` (siblings
    before and after, level by level) and, on a block's first row, its node ``top``."""
    span = arity ** levels
    w = Window.partitionBy("g", "block").orderBy("pos")
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = nodes.withColumn("block", F.floor(F.col("pos") / F.lit(span)).cast("long")).withColumn("slot", F.col("pos") - F.col("block") * span)
    df = df.withColumn("h0", F.col("h"))
    for level in range(levels):
        step = arity ** level
        at = F.floor(F.col("slot") / step) % arity
        offsets = range(1, arity)
        df = df.withColumns({f"b{j}": F.lag(f"h{level}", j * step).over(w) for j in offsets}
                            | {f"a{j}": F.lead(f"h{level}", j * step).over(w) for j in offsets})
        before = F.concat(*[F.when(at >= j, F.col(f"b{j}")).otherwise("") for j in reversed(offsets)])
        after = F.concat(*[F.coalesce(F.when(at < arity - j, F.col(f"a{j}")), F.lit("")) for j in offsets])
        live = F.col("n") > step                      # more than one node is left on this level
        node, first = F.col("slot") % step == 0, F.col("slot") % (step * arity) == 0
        df = df.withColumns({
            f"s{level}": F.when(node & live, F.struct(before.alias("before"), after.alias("after"))),
            f"h{level + 1}": F.when(first & live, F.sha2(F.concat(F.col(f"h{level}"), after), 256)).when(first, F.col(f"h{level}")),
        }).drop(*[f"{x}{j}" for j in offsets for x in "ab"], *([f"h{level}"] if level else []))
    # A row's siblings on a level are those of the last node row up to it.
    filled = [F.last(f"s{i}", ignorenulls=True).over(running) for i in range(levels)]
    df = df.withColumns({f"s{i}": f for i, f in enumerate(filled)})
    path = F.filter(F.array(*[F.col(f"s{i}") for i in range(levels)]), lambda x: x.isNotNull())
    return df.withColumn("path", path).withColumn("top", F.col(f"h{levels}")).drop(
        "slot", "h0", f"h{levels}", *[f"s{i}" for i in range(levels)])


def _tops(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """The next tier's nodes: the block nodes of ``nodes``."""
    span = arity ** levels
    return (_tier(nodes, arity, levels).filter(F.col("pos") % span == 0)
            .select("g", F.col("block").alias("pos"), F.ceil(F.col("n") / F.lit(span)).cast("long").alias("n"), F.col("top").alias("h")))


def _tree(nodes: DataFrame, most: int, arity: int, levels: int) -> tuple[list[tuple[DataFrame, int]], DataFrame]:
    """Tiers (nodes, levels) above ``nodes`` whose groups have at most ``most`` rows,
    lowest first, all but the first staged; and the root (g, h) of every group."""
    tiers = []
    while True:
        own = 1
        while own < levels and arity ** own < most:
            own += 1
        tiers.append((nodes, own))
        nodes = staged(_tops(nodes, arity, own), "merkle-tier")
        most = -(-most // arity ** own)
        if most <= 1:
            return tiers, nodes.select("g", "h")


def _paths(tiers: list[tuple[DataFrame, int]], ends: DataFrame, arity: int) -> DataFrame:
    """Rows of the lowest tier, with the siblings up to the top in ``rest``; ``ends``
    (g, rest, ...) holds what follows a group's root.  Only the parents' side is
    shuffled: a tier's rows already lie by (g, block)."""
    up, key = ends, ["g"]
    for i, (nodes, levels) in reversed(list(enumerate(tiers))):
        joined = _tier(nodes, arity, levels).join(up, key).withColumn("rest", F.concat("path", "rest")).drop("path", "block", "top")
        up, key = (joined.drop("h", "n").withColumnRenamed("pos", "block") if i else joined), ["g", "block"]
    return up


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", group_col: str = "lang",
             edited: dict[str, Column] | None = None, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """``id_col``, ``group_col``, ``leaf``, ``subroot``, ``root`` and the proof ``path`` of every
    row: per level the sibling digests before and after its own, joined.  With
    ``edited`` (values that replace fields; a null column leaves the row's field alone) also ``edited_leaf``,
    null where nothing is replaced."""
    values = {c: F.col(f"`{c}`") for c in fields}
    swapped = {c: edited[c] for c in fields if edited and c in edited}
    bad = F.lit(None).cast("string")
    if swapped:
        hit = reduce(lambda a, b: a | b, [v.isNotNull() for v in swapped.values()])
        bad = F.when(hit, leaf_hash([F.coalesce(swapped[c].cast("string"), v.cast("string")) if c in swapped else v for c, v in values.items()]))
    leaves = staged(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{group_col}`").alias("grp"),
                                leaf_hash(list(values.values())).alias("h"), bad.alias("bad"),
                                F.monotonically_increasing_id().alias("tie")), "merkle-leaves")
    by_name = F.col("grp").asc_nulls_first()
    groups = staged(global_prefix(leaves.groupBy("grp").agg(F.count(F.lit(1)).alias("rows")), [by_name], ["rows"], pos_col="g"), "merkle-groups")
    size = groups.agg(F.max("rows").alias("most"), F.count(F.lit(1)).alias("k")).first()
    ranked = global_prefix(leaves, [by_name, F.col("id").asc_nulls_first(), F.col("h"), F.col("tie")], pos_col="p")
    named = groups.select(F.col("grp").alias("name"), "g", F.col("rows").alias("n"), (F.col("cum_rows") - F.col("rows")).alias("start"))
    nodes = staged(ranked.join(named, F.col("grp").eqNullSafe(F.col("name")))
                   .select("g", (F.col("p") - 1 - F.col("start")).alias("pos"), "n", "h", "id", "grp", "bad"), "merkle-nodes")

    tiers, subroots = _tree(nodes, size["most"] or 0, arity, levels)
    upper = staged(subroots.select(F.lit(0).cast("long").alias("g"), (F.col("g") - 1).alias("pos"), F.lit(size["k"]).cast("long").alias("n"), "h"), "merkle-subroots")
    top_tiers, root = _tree(upper, size["k"], arity, levels)
    none = F.array().cast("array<struct<before:string,after:string>>")
    above = _paths(top_tiers, root.select("g", F.col("h").alias("root"), none.alias("rest")), arity)
    ends = above.select((F.col("pos") + 1).alias("g"), F.col("h").alias("subroot"), "root", "rest")
    out = _paths(tiers, ends, arity)
    return out.select(F.col("id").alias(id_col), F.col("grp").alias(group_col), F.col("h").alias("leaf"), "subroot", "root",
                      F.col("rest").alias("path"), F.col("bad").alias("edited_leaf"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and the siblings of ``path`` give."""
    return F.aggregate(path, leaf, lambda acc, x: F.sha2(F.concat(x["before"], acc, x["after"]), 256))


def proof_digest(path: Column) -> Column:
    """Hash of the siblings of ``path``, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["before"], x["after"])), ""), 256)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: leaf, subroot, root, proof and the check of every document after tampering."""
    more = (F.col("n_chars").cast("decimal(38,0)") + 1).cast("string")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % EDITED == 0
    m = manifest(documents(spark, sf_dir), edited={"n_chars": F.when(hit, more)})
    again = folded(F.coalesce("edited_leaf", "leaf"), F.col("path"))
    return (m.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), again.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


def oracle_sql() -> str:
    """DuckDB SQL of the contract's rows (nodes level by level, then every leaf folded)."""
    part = lambda v: f"coalesce(octet_length(encode({v}))::VARCHAR || ':' || {v}, '-')"
    leaf = lambda n: "sha256(" + " || ".join(part(v) for v in ("doc_id::VARCHAR", "source", "lang", n, "text")) + ")"
    rounds = "c"
    for _ in range(8):
        rounds = f"list_transform([{rounds}], lambda x: xor(x >> 1, 3988292384 * (x & 1)))[1]"
    crc = ("xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), "
           f"lambda a, b: list_transform([xor(a, b)], lambda c: {rounds})[1]), 4294967295)")
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {leaf("n_chars::VARCHAR")} AS leaf,
         CASE WHEN n_chars IS NOT NULL AND {crc} % {EDITED} = 0 THEN {leaf("(n_chars + 1)::VARCHAR")} END AS bad,
         row_number() OVER () AS tie
  FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, tie) - 1 AS pos,
             dense_rank() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS g FROM d),
t(g, level, i, h) AS (
  SELECT g, 0, pos, leaf FROM r
  UNION ALL
  SELECT g, level + 1, i // {ARITY}, sha256(string_agg(h, '' ORDER BY i))
  FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM t) WHERE n > 1 GROUP BY g, level, i // {ARITY}),
top AS (SELECT g, max(level) AS last FROM t GROUP BY g),
u(level, i, h) AS (
  SELECT 0, t.g, h FROM t JOIN top ON t.g = top.g AND level = last
  UNION ALL
  SELECT level + 1, i // {ARITY}, sha256(string_agg(h, '' ORDER BY i))
  FROM (SELECT *, count(*) OVER () AS n FROM u) WHERE n > 1 GROUP BY level, i // {ARITY}),
whole AS (SELECT max(level) AS last FROM u),
steps AS (
  SELECT r.tie, lv.level AS k, r.pos // pow({ARITY}, lv.level)::BIGINT AS own, s.i, s.h
  FROM r JOIN top ON r.g = top.g JOIN (SELECT DISTINCT level FROM t) lv ON lv.level < top.last
  LEFT JOIN t s ON s.g = r.g AND s.level = lv.level AND s.i // {ARITY} = r.pos // pow({ARITY}, lv.level + 1)::BIGINT
                AND s.i <> r.pos // pow({ARITY}, lv.level)::BIGINT
  UNION ALL
  SELECT r.tie, 1000 + lv.level, r.g // pow({ARITY}, lv.level)::BIGINT, s.i, s.h
  FROM r CROSS JOIN whole JOIN (SELECT DISTINCT level FROM u) lv ON lv.level < whole.last
  LEFT JOIN u s ON s.level = lv.level AND s.i // {ARITY} = r.g // pow({ARITY}, lv.level + 1)::BIGINT
                AND s.i <> r.g // pow({ARITY}, lv.level)::BIGINT),
lv AS (SELECT tie, k, coalesce(string_agg(h, '' ORDER BY i) FILTER (i < own), '') AS b,
              coalesce(string_agg(h, '' ORDER BY i) FILTER (i > own), '') AS a FROM steps GROUP BY tie, k),
p AS (SELECT tie, string_agg(b || a, '' ORDER BY k) AS proof, list({{'b': b, 'a': a}} ORDER BY k) AS path FROM lv GROUP BY tie),
f(tie, h, path) AS (
  SELECT r.tie, coalesce(bad, leaf), coalesce(path, []) FROM r LEFT JOIN p ON r.tie = p.tie
  UNION ALL
  SELECT tie, sha256(path[1].b || h || path[1].a), path[2:] FROM f WHERE len(path) > 0)
SELECT r.doc_id, r.leaf, s.h AS subroot, (SELECT u.h FROM u, whole WHERE u.level = whole.last) AS root,
       sha256(coalesce(proof, '')) AS proof_sha256, f.h AS folded_root,
       f.h = (SELECT u.h FROM u, whole WHERE u.level = whole.last) AS verified
FROM r JOIN top ON r.g = top.g JOIN t s ON s.g = r.g AND s.level = top.last
JOIN f ON f.tie = r.tie AND len(f.path) = 0 LEFT JOIN p ON p.tie = r.tie"""
