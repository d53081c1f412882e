"""Operator 6, benchmark decontamination with an FM-index per training shard.

The benchmark's windows are the stated query set: they are searched backward
in an index of each shard (a few MB of training text held by one task).  A
shard is indexed as word numbers; words that no benchmark item has end a run,
and runs shorter than the shortest window cannot hold one, so only the rest is
sorted.  Occurrences are located by sampled suffix positions, compared with
the window's words, and merged to removal spans.

A benchmark larger than ``BLOCK_BYTES`` is dealt into blocks by a hash of its
rows and searched block by block; what a pass broadcasts never exceeds about
that size.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillcast.llm.common import documents, staged, task, text_or_empty
from tillcast.llm.fm_index import FMIndex

WINDOW = 13
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 4 << 20
HASHED = 1 << 20  # bytes hashed at a time (memory bound only)
#: Share of hit words from which a document counts as contaminated: 1 / 20.
SHARE = 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)

# Bytes of words: digits, a-z after lower-casing, and all of non-ASCII.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_WORD = np.zeros(256, dtype=bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


class _Powers:
    """Powers of the hash base and of its inverse, grown as needed."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
            cls.up, cls.down = (np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(size - 1, b)]), dtype=np.uint64)
                                for b in (BASE, inverse))
        return cls.up, cls.down


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and the starts and ends of their words."""
    low = _LOWER[data]
    edge = np.diff(np.concatenate([[False], _WORD[low], [False]]).view(np.int8))
    return low, np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of each word's bytes (equal words, equal hashes), about ``HASHED`` bytes at a time."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + HASHED, side="right")))
        part, s, e = low[base:int(ends[j - 1])], starts[i:j] - base, ends[i:j] - base
        up, down = _Powers.upto(len(part) + 1)
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(up[:len(part)] * part, dtype=np.uint64)])
        out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        i = j
    return out


class Windows:
    """Distinct windows of benchmark items, with the items that have each."""

    def __init__(self, items: list[tuple[object, str]], size: int = WINDOW):
        found: dict[tuple[bytes, ...], set] = {}
        for key, text in items:
            low, starts, ends = word_spans(np.frombuffer(text.encode(), dtype=np.uint8))
            raw = low.tobytes()
            words = [raw[a:b] for a, b in zip(starts, ends)]
            for i in range(max(1, len(words) - size + 1) if words else 0):
                found.setdefault(tuple(words[i:i + size]), set()).add(key)
        self.phrases = list(found)
        self.items = [sorted(str(k) for k in keys if k is not None) for keys in found.values()]
        vocabulary = sorted({w for p in self.phrases for w in p})
        raw = np.frombuffer(b" ".join(vocabulary) or b" ", dtype=np.uint8)
        sizes = np.array([len(w) for w in vocabulary], dtype=np.int64)
        ends = np.cumsum(sizes + 1) - 1
        hashes = word_hashes(raw, ends - sizes, ends)
        # Words with equal hashes share a number; found places are compared word by word.
        self.hashes = np.unique(hashes)
        number = dict(zip(vocabulary, (np.searchsorted(self.hashes, hashes) + 1).tolist()))
        self.lengths = np.array([len(p) for p in self.phrases], dtype=np.int64)
        self.symbols = np.zeros((len(self.phrases), size), dtype=np.int64)
        for i, p in enumerate(self.phrases):
            self.symbols[i, :len(p)] = [number[w] for w in p]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Word number from 1 of each hash, 0 for words of no window."""
        if not len(self.hashes):
            return np.zeros(len(hashes), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at + 1, 0)


def _runs(symbols: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Index text: runs of at least ``least`` non-zero symbols, a 0 before each
    and at the end; and the place in ``symbols`` of each of its symbols (-1 at a 0)."""
    edge = np.diff(np.concatenate([[False], symbols > 0, [False]]).view(np.int8))
    a, b = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    long = b - a >= least
    a, b = a[long], b[long]
    sizes = b - a + 1
    total = int(sizes.sum())
    begin = np.cumsum(sizes) - sizes
    place = np.arange(total) - np.repeat(begin, sizes) - 1 + np.repeat(a, sizes)
    place[begin] = -1
    place = np.append(place, -1)
    return np.where(place < 0, 0, symbols[place]), place


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals as maximal runs (touching ones join)."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    first = np.nonzero(new)[0]
    return starts[first], ends[np.append(first[1:], len(ends)) - 1]


def search_shard(texts: list[bytes], windows: Windows) -> list[tuple[int, list[int], list[int], list[int], list[int], list[str]]]:
    """Per text: number of words, hit word runs [from, to), the same in bytes, items."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    text_starts = text_ends - np.array([len(t) + 1 for t in texts])
    low, starts, ends = word_spans(data)
    # Words of each text; none crosses the separator.
    first = np.searchsorted(starts, text_starts)
    upto = np.searchsorted(starts, text_ends)
    out = [(int(b - a), [], [], [], [], []) for a, b in zip(first, upto)]
    if not len(windows.phrases) or not len(starts):
        return out
    symbols = windows.numbers(word_hashes(low, starts, ends))
    text_of = np.repeat(np.arange(len(texts)), upto - first)
    # A text's first word after another text's last must not continue its run:
    # a 0 goes between the texts.
    where = np.arange(len(symbols)) + text_of
    spread = np.zeros(len(symbols) + len(texts), dtype=np.int64)
    spread[where] = symbols
    back = np.full(len(spread), -1, dtype=np.int64)
    back[where] = np.arange(len(symbols))
    index_text, place = _runs(spread, int(windows.lengths.min()))
    if len(index_text) < 2:
        return out
    index = FMIndex(index_text, len(windows.hashes) + 1)
    lo, hi = index.search(windows.symbols, windows.lengths)
    count = np.maximum(0, hi - lo)
    phrase = np.repeat(np.arange(len(lo)), count)
    rows = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
    word = back[place[index.locate(rows)]]
    raw = low.tobytes()
    per_text: dict[int, tuple[list, list, set]] = {}
    for p, w in zip(phrase.tolist(), word.tolist()):
        words = windows.phrases[p]
        if all(raw[starts[w + k]:ends[w + k]] == x for k, x in enumerate(words)):
            t = int(text_of[w])
            a, b, items = per_text.setdefault(t, ([], [], set()))
            a.append(w - first[t])
            b.append(w - first[t] + len(words))
            items.update(windows.items[p])
    for t, (a, b, items) in per_text.items():
        a, b = merged(np.array(a), np.array(b))
        out[t] = (out[t][0], a.tolist(), b.tolist(), (starts[first[t] + a] - text_starts[t]).tolist(),
                  (ends[first[t] + b - 1] - text_starts[t]).tolist(), sorted(items))
    return out


_LONGS = T.ArrayType(T.LongType())
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("starts", _LONGS),
                      T.StructField("ends", _LONGS), T.StructField("byte_starts", _LONGS),
                      T.StructField("byte_ends", _LONGS), T.StructField("items", T.ArrayType(T.StringType()))])


def _search(shared, keep_all: bool, text_col: str | None):
    """mapInArrow function: search shard by shard.  The text is the field
    ``text_col`` of the carried struct ``row``, else the column ``text``."""
    def text_of(b: pa.RecordBatch) -> pa.Array:
        return pc.struct_field(b.column("row"), text_col) if text_col else b.column("text")

    def shard(tables: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(tables)
        texts = [(x or "").encode() for b in tables for x in text_of(b).to_pylist()]
        found = search_shard(texts, shared.value)
        at = list(range(len(found))) if keep_all else [i for i, x in enumerate(found) if x[1]]
        carried = t if text_col else t.drop_columns(["text"])
        if not keep_all:
            carried = carried.take(pa.array(at, pa.int64()))
        carried = carried.combine_chunks()
        kinds = [pa.int64(), *[pa.list_(pa.int64())] * 4, pa.list_(pa.string())]
        cols = [pa.array([found[i][k] for i in at], kind) for k, kind in enumerate(kinds)]
        arrays = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in carried.columns]
        arrays = [a.chunk(0) if isinstance(a, pa.ChunkedArray) else a for a in arrays]
        return pa.RecordBatch.from_arrays([*arrays, *cols], [*carried.column_names, *FOUND.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for i in range(0, b.num_rows, 128):
                part = b.slice(i, 128)
                held.append(part)
                size += part.nbytes
                if size >= SHARD_BYTES:
                    yield shard(held)
                    held, size = [], 0
        if held:
            yield shard(held)
    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the spans and items of several passes, row by row."""
    for b in batches:
        cols = {c: b.column(c).to_pylist() for c in b.schema.names if c != "row"}
        out = {c: [] for c in FOUND.names}
        for i in range(b.num_rows):
            out["n_words"].append(cols["n_words"][i])
            for x, y in (("starts", "ends"), ("byte_starts", "byte_ends")):
                s = [*cols[x][i], *[v for p in cols["more"][i] or () for v in p[x]]]
                e = [*cols[y][i], *[v for p in cols["more"][i] or () for v in p[y]]]
                a, z = merged(np.array(s), np.array(e)) if s else (np.zeros(0, int), np.zeros(0, int))
                out[x].append(a.tolist())
                out[y].append(z.tolist())
            out["items"].append(sorted({*cols["items"][i], *[v for p in cols["more"][i] or () for v in p["items"]]}))
        kinds = [pa.int64(), *[pa.list_(pa.int64())] * 4, pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([b.column("row"), *[pa.array(out[c], k) for c, k in zip(FOUND.names, kinds)]],
                                         ["row", *FOUND.names])


def find_benchmark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW,
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Struct ``row`` (the columns of ``docs``), ``n_words``, the hit word runs
    [starts, ends), the same runs in bytes, the ``items`` (ids as strings, sorted) that
    occur, ``n_hit`` and ``contaminated``.

    Null and empty texts have no words and are never hit; items without words
    have no windows; a null item id hits but is not listed.  Repeated rows are
    searched each on its own; repeated items count once.  Empty tables give no
    rows or no hits.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).alias("k"), text_or_empty(item_text_col).alias("t"))
    size_of = items.agg(F.coalesce(F.sum(F.octet_length("t") + 16), F.lit(0)).alias("b")).first()["b"]
    blocks = max(1, -(-size_of // block_bytes))
    row = F.struct(*[F.col(c).cast("string").alias(c) if c == text_col else F.col(c) for c in docs.columns])
    key = F.xxhash64(F.col(id_col), text_or_empty(text_col))
    base = docs.select(row.alias("row"))

    def passed(block: int, df: DataFrame, keep_all: bool):
        part = items.filter(F.pmod(F.xxhash64("k", "t"), F.lit(blocks)) == block)
        shared = spark.sparkContext.broadcast(Windows([(r["k"], r["t"]) for r in part.collect()], size))
        kept = [f for f in df.schema.fields if f.name != "text"]
        return shared, df.mapInArrow(task(_search(shared, keep_all, text_col if keep_all else None)), T.StructType([*kept, *FOUND.fields]))

    if blocks == 1:
        _, out = passed(0, base, True)
    else:
        # One pass a block: its hits are stored and its windows given back before
        # the next is read, so the driver holds one block at a time.
        keyed = docs.select(key.alias("rk"), text_or_empty(text_col).alias("text")).dropDuplicates(["rk"])
        rest = None
        for b in range(1, blocks):
            shared, df = passed(b, keyed, False)
            df = staged(df, "benchmark-hits")
            shared.destroy()
            rest = df if rest is None else rest.union(df)
        _, out = passed(0, base, True)
        more = rest.groupBy("rk").agg(F.collect_list(F.struct(*FOUND.names[1:])).alias("more"))
        out = (out.withColumn("rk", F.xxhash64(F.col(f"row.`{id_col}`"), text_or_empty(F.col(f"row.`{text_col}`"))))
               .join(more, "rk", "left").drop("rk").mapInArrow(task(_joined), T.StructType([out.schema["row"], *FOUND.fields])))
    hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    return out.withColumn("n_hit", hit).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, unchanged."""
    found = find_benchmark(docs, benchmark, **options).filter(~F.col("contaminated"))
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: hit words and occurring items of every document."""
    found = find_benchmark(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def oracle_sql() -> str:
    """DuckDB SQL of the contract's rows."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = rf"regexp_extract_all({low}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH i AS (SELECT item_id, {words} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[j:j + {WINDOW - 1}], ' ') AS s
        FROM (SELECT *, unnest(generate_series(1, greatest(1, len(w) - {WINDOW - 1}))) AS j FROM i WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents),
p AS (SELECT rid, n, j, array_to_string(w[j:j + n - 1], ' ') AS s
      FROM (SELECT rid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS j
            FROM d CROSS JOIN (SELECT DISTINCT n FROM win))),
m AS (SELECT p.rid, p.n, p.j, win.item_id FROM p JOIN win ON p.s = win.s AND p.n = win.n),
h AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT rid, j + unnest(range(n)) AS k FROM m) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items
      FROM (SELECT DISTINCT rid, item_id::VARCHAR AS x FROM m WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)"""
