"""Operator 5, exact substring deduplication over suffixes sorted by hash.

A byte goes if a ``LENGTH``-byte string over it also starts in a document with
a smaller id.  Sorting every suffix of the corpus would shuffle the corpus
``LENGTH`` times over; instead:

1. anchors: in every ``LENGTH``-byte window the ``GRAM``-byte string with the
   least hash is an anchor.  Equal windows have equal anchors at equal places,
   so windows can only match around anchors that two documents share.  Each
   task packs its anchors by hash into blobs; an anchor that two documents of
   a task share needs no reply, and only one of them is sent on, with the
   blocks of the others.
2. per hash bucket: anchors that meet another document are returned.
3. contexts: the bytes around each shared anchor.  Equal contexts of a task
   are reduced to the one with the least id, the others are decided at once.
   A passage or copy that a third of all documents hold thus sends one row a
   task.  Anchors with more than ``HOT`` contexts in the corpus (counted in
   step 2) do not meet by anchor: each of their windows goes to the bucket of
   its own hash, of equal windows of a task only those of the least id, so an
   anchor in many different surroundings makes no large group.  Only blocks
   that hold such an anchor hear of it.
4. per hash bucket: the suffixes to the right of the anchors and the reversed
   prefixes to their left are sorted (``suffix_sort``); cutting the sorted
   orders where the common extension falls short gives, for each place of the
   window over the anchor, the classes of equal windows and their least id.
   Windows of hot anchors are compared as they are.
5. the decided windows return to their documents, which are cut.

Documents are dealt by a hash of their id and text into blocks; work and
memory of a group are those of a block or a bucket, whose number follows the
input's partitions.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillcast.llm.common import documents, give_back, partitions, task, text_or_empty
from tillcast.llm.suffix_sort import segmented_sort

LENGTH = 50
GRAM = 16
REACH = LENGTH - GRAM  # bytes kept to the left of an anchor
CONTEXT = REACH + LENGTH
CONTEXTS = 1 << 14  # contexts gathered at a time (memory bound only)
HOT = 1 << 15  # contexts of an anchor above which its windows are dealt by their own hash
CHUNK = 4 << 20  # bytes hashed at a time (memory bound only)
GATHER = 1 << 20  # anchors packed at a time at most (memory bound only)
RECORDS = 1 << 12  # anchors that a blob is to hold, as far as that bound allows
MOST_TEXT = 16 << 20  # bytes of documents packed at a time at most (memory bound only)
BLOB_TEXT = 64 << 10  # bytes of documents that a blob is to hold, as far as that bound allows
LEVEL = 6  # of zstd; 1 for anchors, which are mostly hash bits
PAD = 0xFF  # never occurs in UTF-8
BLOB = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("data", T.BinaryType())])
ANCHOR = np.dtype([("rk", "<i8"), ("pos", "<u4")])
HIT = np.dtype([("rk", "<i8"), ("pos", "<u4"), ("mask", "<u8")])
SEEN = np.dtype([("id", "<i8"), ("rk", "<i8"), ("pos", "<u4"), ("ctx", "u1", CONTEXT)])
WINDOW = np.dtype([("id", "<i8"), ("rk", "<i8"), ("pos", "<u4"), ("o", "u1"), ("text", "u1", LENGTH)])
HOT_ANCHOR = 0xFFFFFFFF  # as ``pos`` of an ``ANCHOR``: ``rk`` is the name of a hot anchor
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` bytes at each place of ``data``."""
    n = len(data) - GRAM + 1
    words = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    h = words[:n] * _M1
    h ^= h >> np.uint64(29)
    h += words[8:8 + n] * _M2
    h ^= h >> np.uint64(32)
    h *= _M1
    h ^= h >> np.uint64(31)
    return h


def _windowed(x: np.ndarray, size: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each run of ``size`` values, by doubling."""
    span = 1
    while span * 2 <= size:
        x = pick(x[:-span], x[span:])
        span *= 2
    return pick(x[:len(x) - (size - span)], x[size - span:]) if span < size else x


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the least ``GRAM``-byte hash of every window (all, on ties)."""
    if len(data) < LENGTH:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    h = gram_hashes(data)
    key = (h >> np.uint64(32)).astype(np.uint32)
    size = REACH + 1
    least = _windowed(key, size, np.minimum)
    edge = np.zeros(size - 1, dtype=np.uint32)
    # A place is an anchor if it is the least of some window that holds it.
    most = _windowed(np.concatenate([edge, least, edge]), size, np.maximum)
    at = np.nonzero(key == most[:len(key)])[0]
    return at, h[at]


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte: all first bytes, all second ones, and so on.  The high bytes of keys, places
    and ranks are alike and compress to nothing, also in the small blobs that many buckets make."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T).tobytes()


def _from_planes(raw: bytes, kind: np.dtype, offset: int, count: int) -> np.ndarray:
    planes = np.frombuffer(raw, dtype=np.uint8, offset=offset, count=count * kind.itemsize)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, count).T).view(kind)[:, 0] if count else np.zeros(0, dtype=kind)


def _packed(bucket: np.ndarray, records: np.ndarray) -> pa.RecordBatch:
    """One row per bucket with its records, field by field, compressed."""
    order = np.argsort(bucket, kind="stable")
    bucket, records = bucket[order], records[order]
    first = _runs(bucket).tolist()
    pack = zstandard.ZstdCompressor(level=LEVEL).compress
    blobs = [pack(b"".join(records[f][x:y].tobytes() if records.dtype[f].shape else _planes(records[f][x:y]) for f in records.dtype.names))
             for x, y in zip(first, [*first[1:], len(bucket)])]
    return pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int32)), pa.array(blobs, pa.binary())],
                                      ["bucket", "data"])


def _unpacked(table: pa.Table, kind: np.dtype) -> np.ndarray:
    parts, unpack = [], zstandard.ZstdDecompressor().decompress
    for x in table.column("data"):
        raw = unpack(x.as_py())
        n = len(raw) // kind.itemsize
        part, at = np.empty(n, dtype=kind), 0
        for f in kind.names:
            size = n * kind[f].itemsize
            if kind[f].shape:
                part[f] = np.frombuffer(raw, dtype=kind[f].base, offset=at, count=size // kind[f].base.itemsize).reshape(n, *kind[f].shape)
            else:
                part[f] = _from_planes(raw, kind[f], at, n)
            at += size
        parts.append(part)
    return np.concatenate(parts) if parts else np.zeros(0, dtype=kind)


def _pack_documents(buckets: int):
    """Documents of a task as compressed Arrow tables, one per block.  The more blocks, the more text
    is gathered first: pieces of a document or two would compress badly."""
    most = max(CHUNK, min(MOST_TEXT, buckets * BLOB_TEXT))

    def chunk(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        block = np.mod(t.column("rk").to_numpy(), buckets)
        order = np.argsort(block, kind="stable")
        t, block = t.take(pa.array(order)).combine_chunks(), block[order]
        first, blobs, options = _runs(block).tolist(), [], pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", LEVEL))
        for x, y in zip(first, [*first[1:], len(block)]):
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, t.schema, options=options) as w:
                w.write_table(t.slice(x, y - x))
            blobs.append(out.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(block[first].astype(np.int32)), pa.array(blobs, pa.binary())],
                                          ["bucket", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for i in range(0, b.num_rows, 256):
                held.append(b.slice(i, 256))
                size += held[-1].column("text").nbytes
                if size >= most:
                    yield chunk(held)
                    held, size = [], 0
        if held:
            yield chunk(held)
    return run


def _documents(table: pa.Table) -> pa.Table | None:
    parts = [pa.ipc.open_stream(x.as_buffer()).read_all() for x in table.column("data")]
    return pa.concat_tables(parts).combine_chunks() if parts else None


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """First place of each run of equal values."""
    return np.concatenate([[0], np.nonzero(sorted_values[1:] != sorted_values[:-1])[0] + 1]) if len(sorted_values) else np.zeros(0, dtype=np.int64)


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.to_pylist()]


def _meets_another(h: np.ndarray, rk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For records sorted by ``h``: whether the run of each holds another ``rk``,
    and the first ``rk`` of its run."""
    first = _runs(h)
    sizes = np.diff(np.append(first, len(h)))
    head = np.repeat(rk[first], sizes)
    differs = np.add.reduceat((rk != head).astype(np.int64), first) > 0 if len(first) else np.zeros(0, dtype=bool)
    return np.repeat(differs, sizes), head


_NONE = np.zeros((2, 0), dtype="<u4")


# Blob of anchors: counts, then documents' keys with their number of anchors,
# 32 further hash bits, places and how many of the chunk's anchors each stands for; then the blocks,
# beside its own, of the anchors that a record stands for, with its hash bits.  (A filter only: bits lost to the bucket
# number and to truncation can add candidates, never lose one.)
def _anchor_blob(h32: np.ndarray, rk: np.ndarray, pos: np.ndarray, many: np.ndarray, also_h: np.ndarray, also: np.ndarray) -> bytes:
    first = _runs(rk)
    sizes = np.diff(np.append(first, len(rk))).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(b"".join([np.array([len(first), len(rk)], dtype="<u4").tobytes(), _planes(rk[first].astype("<i8")),
                     _planes(sizes), h32.astype("<u4").tobytes(), _planes(pos.astype("<u4")), _planes(many.astype("<u4")),
                     also_h.astype("<u4").tobytes(), also.astype("<u4").tobytes()]))


def _read_anchor_blob(blob: bytes) -> tuple[np.ndarray, ...]:
    blob = zstandard.ZstdDecompressor().decompress(blob)
    nd, n = np.frombuffer(blob, dtype="<u4", count=2)
    nd, n = int(nd), int(n)
    also_h, also = np.frombuffer(blob, dtype="<u4", offset=8 + 12 * (nd + n)).reshape(2, -1) if len(blob) > 8 + 12 * (nd + n) else _NONE
    u4 = np.dtype("<u4")
    rk = _from_planes(blob, np.dtype("<i8"), 8, nd)
    sizes = _from_planes(blob, u4, 8 + 8 * nd, nd)
    h = np.frombuffer(blob, dtype=u4, count=n, offset=8 + 12 * nd)
    pos = _from_planes(blob, u4, 8 + 12 * nd + 4 * n, n)
    many = _from_planes(blob, u4, 8 + 12 * nd + 8 * n, n)
    return h, np.repeat(rk, sizes), pos, many, also_h, also


def _text_anchors(texts: list[bytes], keys: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of some documents: their hashes, keys of their documents and places."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    at, h = anchors(data)
    doc = np.searchsorted(ends, at, side="right")
    inside = at + GRAM <= ends[doc]
    at, h, doc = at[inside], h[inside], doc[inside]
    return _mix(h), np.array(keys, dtype=np.int64)[doc], (at - np.concatenate([[0], ends])[doc]).astype(np.uint32)


def _chunk_anchors(texts: list[bytes], keys: list[int], buckets: int) -> pa.RecordBatch | None:
    """``_anchor_blobs`` of some documents."""
    return _anchor_blobs(*_text_anchors(texts, keys), buckets)


def _anchor_blobs(h: np.ndarray, rk: np.ndarray, pos: np.ndarray, buckets: int) -> pa.RecordBatch | None:
    """Blobs of anchors: hash buckets 0.., and ``buckets`` + block
    for anchors that are known to be shared already."""
    if not len(h):
        return None
    order = np.argsort(h, kind="stable")
    h, rk, pos = h[order], rk[order], pos[order]
    shared, head = _meets_another(h, rk)
    first = _runs(h)
    many = np.zeros(len(h), dtype=np.int64)
    many[first] = np.diff(np.append(first, len(h)))
    # Of shared anchors the first document's go on to meet other tasks.
    send = ~shared | (rk == head)
    # Blocks of the documents that a sent anchor stands for, each once.
    block = np.mod(rk, buckets)
    others = np.nonzero(shared & (block != np.mod(head, buckets)))[0]
    others = others[np.lexsort((block[others], h[others]))]
    fresh = (np.diff(h[others], prepend=h[others[:1]]) != 0) | (np.diff(block[others], prepend=-1) != 0)
    others = others[fresh]
    also_h, also, also_bucket = h[others], block[others], ((h[others] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(also_bucket, kind="stable")
    also_h, also, also_bucket = also_h[order] & np.uint64(0xFFFFFFFF), also[order], also_bucket[order]
    bucket = np.concatenate([(h[send] >> np.uint64(32)) % np.uint64(buckets),
                             (np.mod(rk[shared], buckets) + buckets).astype(np.uint64)]).astype(np.int64)
    h = np.concatenate([h[send], h[shared]])
    rk, pos, many = (np.concatenate([x[send], x[shared]]) for x in (rk, pos, many))
    many[int(send.sum()):] = 0
    order = np.lexsort((pos, rk, bucket))
    bucket, h32, rk, pos, many = bucket[order], (h[order] & np.uint64(0xFFFFFFFF)).astype("<u4"), rk[order], pos[order], many[order]
    first = _runs(bucket).tolist()
    low, high = (np.searchsorted(also_bucket, bucket[first], side=side).tolist() for side in ("left", "right"))
    blobs = [_anchor_blob(h32[a:b], rk[a:b], pos[a:b], many[a:b], also_h[x:y], also[x:y])
             for a, b, x, y in zip(first, [*first[1:], len(bucket)], low, high)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int32)), pa.array(blobs, pa.binary())],
                                      ["bucket", "data"])


def _emit_anchors(buckets: int):
    """The more buckets, the more anchors are gathered before they are packed: else a blob would hold
    a few, and more bytes of keys and headers than of anchors."""
    most = min(GATHER, buckets * RECORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, keys, size, held, n = [], [], 0, [], 0

        def blobs() -> pa.RecordBatch | None:
            return _anchor_blobs(*(np.concatenate([x[i] for x in held]) for i in range(3)), buckets)

        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                for key, text in zip(part.column(0).to_pylist(), _bytes(part.column(1))):
                    if len(text) >= LENGTH:
                        texts.append(text)
                        keys.append(key)
                        size += len(text)
                    if size >= CHUNK:
                        held.append(_text_anchors(texts, keys))
                        n += len(held[-1][0])
                        texts, keys, size = [], [], 0
                        if n >= most:
                            yield blobs()
                            held, n = [], 0
        if texts:
            held.append(_text_anchors(texts, keys))
        if held and (out := blobs()) is not None:
            yield out
    return run


def _find_shared(buckets: int, hot: int):
    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        parts = [_read_anchor_blob(x.as_py()) for x in table.column("data")]
        h, rk, pos, many, also_h, also = (np.concatenate([p[i] for p in parts]) for i in range(6))
        names = blocks = np.zeros(0, dtype=np.int64)
        if bucket < buckets:
            order = np.argsort(h, kind="stable")
            h, rk, pos = h[order], rk[order], pos[order]
            keep = _meets_another(h, rk)[0]
            if len(h):
                first = _runs(h)
                names = h[first[np.add.reduceat(many[order].astype(np.int64), first) > hot]]
                # Each block that holds such an anchor hears of it, once.
                mine, theirs = np.isin(h, names), np.isin(also_h, names)
                names, blocks = np.unique(np.stack([np.concatenate([h[mine], also_h[theirs]]).astype(np.int64) | bucket << 32,
                                                    np.concatenate([np.mod(rk[mine], buckets), also[theirs].astype(np.int64)])]), axis=1)
            rk, pos = rk[keep], pos[keep]
        like = np.lexsort((pos, rk))  # a document's anchors side by side compress well
        rk, pos = rk[like], pos[like]
        out = np.empty(len(rk), dtype=ANCHOR)
        out["rk"], out["pos"] = rk, pos
        told = np.empty(len(names), dtype=ANCHOR)
        told["rk"], told["pos"] = names, HOT_ANCHOR
        return pa.Table.from_batches([_packed(np.mod(rk, buckets), out), _packed(blocks, told)])
    return run


def _short(keys: np.ndarray, buckets: int) -> np.ndarray:
    """A short name for each key of a block, the same for whoever holds the block: its rank there, times
    ``buckets``, plus the block.  Contexts and hits bear it instead of the eight random bytes of the key."""
    return np.unique(keys, return_inverse=True)[1].astype(np.int64) * buckets + np.mod(keys, buckets)


def _names(gram: np.ndarray, buckets: int) -> np.ndarray:
    """What ``_find_shared`` calls the anchors with these ``GRAM`` bytes."""
    h = _mix(gram_hashes(gram.reshape(-1))[::GRAM])
    return ((h >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | h & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _valid(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Bit ``o``: the window starting ``o`` bytes before the anchor lies inside the text."""
    upper = (np.uint64(2) << left.astype(np.uint64)) - np.uint64(1)
    lower = (np.uint64(1) << np.maximum(0, LENGTH - right).astype(np.uint64)) - np.uint64(1)
    return upper & ~lower


def _sides(ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that each context really has to the left and to the right."""
    return (ctx[:, :REACH] != PAD).sum(axis=1), (ctx[:, REACH:] != PAD).sum(axis=1)


def _row_hashes(rows: np.ndarray) -> np.ndarray:
    words = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), dtype=np.uint8)
    words[:, :rows.shape[1]] = rows
    h = np.zeros(len(rows), dtype=np.uint64)
    for j, w in enumerate(words.view("<u8").T):
        h = _mix(h ^ (w * _M2 + np.uint64(j + 1)))
    return h


def _collapse(ids: np.ndarray, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that puts equal contexts together, least id first; and whether each
    record in that order has an equal one with a smaller id."""
    h = _row_hashes(ctx)
    order = np.lexsort((ids, h))
    first = _runs(h[order])
    head = np.repeat(order[first], np.diff(np.append(first, len(order))))
    same = (ctx[order] == ctx[head]).all(axis=1)  # an equal hash of other bytes decides nothing
    return order, same & (ids[order] > ids[head])


def repeated_windows(ids: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Whether each window has an equal one with a smaller id."""
    h = _row_hashes(text)
    order = np.lexsort((ids, h))
    first = _runs(h[order])
    head = np.repeat(order[first], np.diff(np.append(first, len(order))))
    if not np.array_equal(text[order], text[head]):  # an equal hash of other bytes: by the bytes themselves
        h = np.unique(np.ascontiguousarray(text).view(f"V{LENGTH}")[:, 0], return_inverse=True)[1]
        order = np.lexsort((ids, h))
        first = _runs(h[order])
        head = np.repeat(order[first], np.diff(np.append(first, len(order))))
    out = np.empty(len(ids), dtype=bool)
    out[order] = ids[order] > ids[head]
    return out


def _hot_windows(rec: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Of contexts of hot anchors, windows for the buckets of their own hash (from
    2 * ``buckets``) and hits decided here.  A window goes with its least
    anchors only: equal windows have those in common."""
    ctx, masks, valid = rec["ctx"], np.zeros(len(rec), dtype=np.uint64), _valid(*_sides(rec["ctx"]))
    own = np.empty((len(rec), REACH + 1), dtype=bool)
    for i in range(0, len(rec), CONTEXTS):
        part = np.ascontiguousarray(ctx[i:i + CONTEXTS])
        h = gram_hashes(np.append(part.reshape(-1), np.zeros(GRAM, dtype=np.uint8)))[:part.size]
        key = (h >> np.uint64(32)).astype(np.uint32).reshape(part.shape)
        left = np.minimum.accumulate(key[:, REACH::-1], axis=1)  # by the offset of the window
        right = np.minimum.accumulate(key[:, REACH:2 * REACH + 1], axis=1)[:, ::-1]
        own[i:i + CONTEXTS] = np.minimum(left, right) == key[:, REACH:REACH + 1]
    held, size = [], 0

    def windows() -> pa.RecordBatch:
        w = np.concatenate(held)
        w = w[np.argsort(np.ascontiguousarray(w["text"][:, -8:]).view(">u8")[:, 0], kind="stable")]
        return _packed((_row_hashes(w["text"]) % np.uint64(buckets)).astype(np.int64) + 2 * buckets, w)

    for o in range(REACH + 1):
        here = np.nonzero((valid >> np.uint64(o) & np.uint64(1)).astype(bool) & own[:, o])[0]
        text = np.ascontiguousarray(ctx[here, REACH - o:REACH - o + LENGTH])
        gone = repeated_windows(rec["id"][here], text)
        masks[here[gone]] |= np.uint64(1) << np.uint64(o)
        here, text = here[~gone], text[~gone]
        w = np.empty(len(here), dtype=WINDOW)
        w["id"], w["rk"], w["pos"], w["o"], w["text"] = rec["id"][here], rec["rk"][here], rec["pos"][here], o, text
        held.append(w)
        size += len(w)
        if size >= 8 * CONTEXTS:
            yield windows()
            held, size = [], 0
    if size:
        yield windows()
    some = masks != 0
    hits = np.empty(int(some.sum()), dtype=HIT)
    hits["rk"], hits["pos"], hits["mask"] = rec["rk"][some], rec["pos"][some], masks[some]
    yield _packed(np.mod(hits["rk"], buckets) + buckets, hits)


def _emit_contexts(buckets: int):
    def run(packed: pa.Table, found: pa.Table) -> pa.Table:
        docs = _documents(packed)
        want = np.unique(_unpacked(found, ANCHOR)) if docs is not None else np.zeros(0, dtype=ANCHOR)
        told = want["pos"] == HOT_ANCHOR
        hot, want = want["rk"][told], want[~told]
        out = [pa.RecordBatch.from_arrays([pa.array([], pa.int32()), pa.array([], pa.binary())], ["bucket", "data"])]
        if len(want):
            keys = docs.column("rk").to_numpy()
            names = _short(keys, buckets)
            wanted = np.unique(want["rk"])
            rows, seen = [], set()
            for i in np.nonzero(np.isin(keys, wanted))[0].tolist():  # of repeated rows, one
                if keys[i] not in seen:
                    seen.add(keys[i])
                    rows.append(i)
            rows.sort(key=lambda i: keys[i])
            part = docs.take(pa.array(rows))
            texts = _bytes(part.column("text"))
            ids, ends = part.column("ord").to_numpy(), np.cumsum([len(t) for t in texts])
            data = np.frombuffer(b"".join(texts), dtype=np.uint8)
            doc = np.searchsorted(keys[rows], want["rk"])
            begin = np.concatenate([[0], ends])[doc]
            rec = np.empty(len(want), dtype=SEEN)
            rec["id"], rec["rk"], rec["pos"] = ids[doc], names[rows][doc], want["pos"]
            for i in range(0, len(want), CONTEXTS):
                s = slice(i, i + CONTEXTS)
                places = (begin[s] + want["pos"][s])[:, None] + np.arange(-REACH, LENGTH)
                inside = (places >= begin[s][:, None]) & (places < ends[doc[s]][:, None])
                rec["ctx"][s] = np.where(inside, data[np.clip(places, 0, len(data) - 1)], PAD)
            order, hit = _collapse(rec["id"], rec["ctx"])
            done = rec[order[hit]]
            hits = np.empty(len(done), dtype=HIT)
            hits["rk"], hits["pos"], hits["mask"] = done["rk"], done["pos"], _valid(*_sides(done["ctx"]))
            out.append(_packed(np.mod(hits["rk"], buckets) + buckets, hits))
            rec = rec[order[~hit]]
            if len(hot):
                split = np.isin(_names(np.ascontiguousarray(rec["ctx"][:, REACH:REACH + GRAM]), buckets), hot)
                out.extend(_hot_windows(rec[split], buckets))
                rec = rec[~split]
            gram = np.ascontiguousarray(rec["ctx"][:, REACH:REACH + GRAM]).view("<u8")
            like = np.argsort(gram[:, 0], kind="stable")  # like contexts side by side compress well
            bucket = _mix(gram[:, 0] * _M1 ^ _mix(gram[:, 1])) % np.uint64(buckets)
            out.append(_packed(bucket[like].astype(np.int64), rec[like]))
        return pa.Table.from_batches(out)
    return run


def match(rec: np.ndarray) -> np.ndarray:
    """For contexts that share anchors: bit ``o`` set if the window starting ``o``
    bytes before the anchor also starts in a text of a smaller id."""
    order, hit = _collapse(rec["id"], rec["ctx"])
    masks = np.zeros(len(rec), dtype=np.uint64)
    valid = _valid(*_sides(rec["ctx"]))
    masks[order[hit]] = valid[order[hit]]
    rest = order[~hit]
    ctx = rec["ctx"][rest]
    gram = np.ascontiguousarray(ctx[:, REACH:REACH + GRAM]).view(f"V{GRAM}")[:, 0]
    gram = np.unique(gram, return_inverse=True)[1]
    by = np.lexsort((rec["id"][rest], gram))  # segments of one anchor, least id first
    rest, ctx, gram = rest[by], np.ascontiguousarray(ctx[by]), gram[by]
    n, ids, ok = len(rest), rec["id"][rest], valid[rest]
    if n < 2:
        return masks
    to_right, lcp_right = segmented_sort(np.ascontiguousarray(ctx[:, REACH:]), gram)
    to_left, lcp_left = segmented_sort(np.ascontiguousarray(ctx[:, :REACH][:, ::-1]), gram)
    found = np.zeros(n, dtype=np.uint64)
    right, left = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for o in range(REACH + 1):
        # Classes of rows whose common extension reaches far enough.
        right[to_right] = np.cumsum(lcp_right < LENGTH - o)
        left[to_left] = np.cumsum(lcp_left < o)
        here = np.nonzero(ok & (np.uint64(1) << np.uint64(o)))[0]
        if len(here) < 2:
            continue
        key = left[here] * (n + 1) + right[here]
        sort = np.argsort(key, kind="stable")
        first = _runs(key[sort])
        least = np.repeat(ids[here][sort][first], np.diff(np.append(first, len(sort))))
        later = here[sort[ids[here][sort] > least]]
        found[later] |= np.uint64(1) << np.uint64(o)
    masks[rest] |= found
    return masks


def _match_bucket(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        if bucket >= 2 * buckets:
            w = _unpacked(table, WINDOW)
            w = w[repeated_windows(w["id"], np.ascontiguousarray(w["text"]))]
            hits = np.empty(len(w), dtype=HIT)
            hits["rk"], hits["pos"], hits["mask"] = w["rk"], w["pos"], np.uint64(1) << w["o"].astype(np.uint64)
        elif bucket >= buckets:  # decided before
            hits = _unpacked(table, HIT)
        else:
            rec = _unpacked(table, SEEN)
            masks = match(rec)
            some = masks != 0
            hits = np.empty(int(some.sum()), dtype=HIT)
            hits["rk"], hits["pos"], hits["mask"] = rec["rk"][some], rec["pos"][some], masks[some]
        out = pa.Table.from_batches([_packed(np.mod(hits["rk"], buckets), hits)])
        give_back()
        return out
    return run


def removed_runs(sizes: np.ndarray, doc: np.ndarray, pos: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal removed runs of texts of ``sizes`` bytes: text, start and end of each."""
    begin = np.cumsum(sizes + 1) - (sizes + 1)  # a gap after each text keeps runs apart
    window = np.zeros(int((sizes + 1).sum()) + 1, dtype=bool)
    at = begin[doc] + pos
    for o in range(REACH + 1):
        window[at[(mask >> np.uint64(o)) & np.uint64(1) > 0] - o] = True
    # A byte goes if one of the last LENGTH places starts such a window.
    covered = np.cumsum(window, dtype=np.int32)
    covered[LENGTH:] -= covered[:-LENGTH].copy()
    gone = np.diff(np.concatenate([[False], covered > 0, [False]]).view(np.int8))
    a, b = np.nonzero(gone == 1)[0], np.nonzero(gone == -1)[0]
    owner = np.searchsorted(begin, a, side="right") - 1
    return owner, a - begin[owner], b - begin[owner]


def _cut_block(rest: list[str], characters: bool, buckets: int):
    """Cut the documents of a block. ``characters``: keep whole characters only."""
    def run(packed: pa.Table, found: pa.Table) -> pa.Table:
        docs, hits = _documents(packed), _unpacked(found, HIT)
        if docs is None:
            raise ValueError("hits for a block without documents")
        texts = docs.column("text").to_pylist()
        starts, ends, kept = [[] for _ in texts], [[] for _ in texts], list(texts)
        if len(hits):
            # Each row with hits, repeated rows included, takes those of its key.
            hits = hits[np.argsort(hits["rk"], kind="stable")]
            keys = _short(docs.column("rk").to_numpy(), buckets)
            low, high = np.searchsorted(hits["rk"], keys, side="left"), np.searchsorted(hits["rk"], keys, side="right")
            rows = np.nonzero(high > low)[0]
            count = (high - low)[rows]
            take = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low[rows], count)
            sizes = np.array([len(texts[i]) for i in rows.tolist()], dtype=np.int64)
            owner, a, b = removed_runs(sizes, np.repeat(np.arange(len(rows)), count),
                                       hits["pos"][take].astype(np.int64), hits["mask"][take])
            for k, x, y in zip(owner.tolist(), a.tolist(), b.tolist()):
                starts[rows[k]].append(x)
                ends[rows[k]].append(y)
            for i in rows.tolist():
                parts = [texts[i][x:y] for x, y in zip([0, *ends[i]], [*starts[i], len(texts[i])])]
                if characters:
                    parts = [p.decode(errors="ignore").encode() for p in parts]
                kept[i] = b"".join(parts)
        return pa.table([*[docs.column(c) for c in rest], docs.column("text"), pa.array(starts, pa.list_(pa.int64())),
                         pa.array(ends, pa.list_(pa.int64())), pa.array(kept, pa.binary())],
                        names=[*rest, "bytes", "starts", "ends", "kept"])
    return run


def _blocks(docs: DataFrame) -> int:
    """Blocks and buckets: as many as the input has partitions, or shuffles make."""
    return max(partitions(docs.sparkSession), docs.rdd.getNumPartitions())


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     characters: bool = False, hot: int = HOT) -> DataFrame:
    """All columns of ``docs`` but the text (as struct ``row``), ``bytes`` (the text in UTF-8), the removed
    runs [starts, ends) in bytes and ``kept`` (the remaining bytes; with ``characters`` those of whole characters).

    Ids are integers.  A null text counts as empty and stays null; texts under 50 bytes stay
    whole.  A null id sorts after every id, and texts without an id don't remove
    from each other.  Rows that repeat an id don't remove from each other;
    repeated rows each give the same result.  An empty table gives an empty result.
    ``hot``: contexts of an anchor above which its windows are dealt one by one;
    it never changes a result.
    """
    n = _blocks(docs)
    others = [F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text_col]
    key = F.xxhash64(F.col(id_col), text_or_empty(text_col))
    d = docs.select(key.alias("rk"), F.col(text_col).cast("string").cast("binary").alias("text"),
                    F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("ord"),
                    F.struct(*others).alias("row"))
    sent = d.select("rk", "text").mapInArrow(task(_emit_anchors(n)), BLOB)
    shared = sent.groupBy("bucket").applyInArrow(_find_shared(n, hot), BLOB)
    packed = d.mapInArrow(task(_pack_documents(n)), BLOB)
    seen = packed.groupBy("bucket").cogroup(shared.groupBy("bucket")).applyInArrow(_emit_contexts(n), BLOB)
    hits = seen.groupBy("bucket").applyInArrow(_match_bucket(n), BLOB)
    out = T.StructType([d.schema["row"], T.StructField("bytes", T.BinaryType()),
                        T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.LongType())),
                        T.StructField("kept", T.BinaryType())])
    cut = packed.groupBy("bucket").cogroup(hits.groupBy("bucket")).applyInArrow(_cut_block(["row"], characters, n), out)
    names = [c for c in docs.columns if c != text_col]
    return cut.select(F.struct(*[F.col(f"row.c{docs.columns.index(c)}").alias(c) for c in names]).alias("row"),
                      "bytes", "starts", "ends", "kept")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated bytes cut out of the text, cut characters whole; all rows and columns stay."""
    cut = dedup_substrings(docs, id_col, text_col, characters=True)
    return cut.select(*[F.col("kept").cast("string").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c)
                        for c in docs.columns])


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: bytes, removed bytes and runs, digest of what is kept, of every document."""
    d = dedup_substrings(documents(spark, sf_dir).select("doc_id", "text"))
    size = lambda c: F.coalesce(F.octet_length(c).cast("long"), F.lit(0).cast("long"))
    return d.select(F.col("row.doc_id").alias("doc_id"), size("bytes").alias("n_bytes"),
                    (size("bytes") - size("kept")).alias("n_removed"), F.size("starts").cast("long").alias("n_spans"),
                    F.sha2(F.coalesce("kept", F.lit(b"")), 256).alias("kept_sha256"))


def oracle_sql() -> str:
    """DuckDB SQL of the contract's rows: every 50-byte string against its least id."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, {(1 << 63) - 1}) AS ord,
                  hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT rid, ord, p, substr(x, 2 * p - 1, {2 * LENGTH}) AS s
      FROM (SELECT *, unnest(generate_series(1, (len(x) // 2)::INT - {LENGTH - 1})) AS p FROM d)),
f AS (SELECT s, min(ord) AS least FROM w GROUP BY s HAVING min(ord) < max(ord)),
h AS (SELECT rid, p, CASE WHEN p > lag(p) OVER (PARTITION BY rid ORDER BY p) + {LENGTH} THEN 1 ELSE 0 END AS new
      FROM w JOIN f USING (s) WHERE ord > least),
r AS (SELECT rid, min(p) AS a, max(p) + {LENGTH} AS b
      FROM (SELECT rid, p, sum(new) OVER (PARTITION BY rid ORDER BY p) AS run FROM h) GROUP BY rid, run),
k AS (SELECT rid, a, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 1) AS e, b FROM r),
c AS (SELECT rid, sum(k.b - k.a) AS n_removed, count(*) AS n_spans, max(k.b) AS last,
             string_agg(substr(x, 2 * e - 1, 2 * (a - e)), '' ORDER BY a) AS kept
      FROM k JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN n_spans IS NULL THEN x ELSE kept || substr(x, 2 * last - 1) END)) AS kept_sha256
FROM d LEFT JOIN c USING (rid)"""
