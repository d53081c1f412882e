"""Operator 8, token ids as binary files coded by a context-mixing range coder.

Documents are dealt into ranges of ascending id; each range is encoded to ids
(end id after every document) and written as segments.  A segment is one
binary record: header, keys and lengths of its documents, sizes and checksums
of its blocks, and the blocks' payloads (``range_coder``), every block
decodable by itself.  The records lie in a Parquet table together with their
range and sequence number, so that any store Spark writes to will do, failed
tasks leave nothing behind, and readers get segments in parallel.

Record (little-endian): magic ``TCT1``; u32 documents, u64 ids, u32 blocks,
u32 end id; per document i64 key, u8 whether it has one, u32 ids; per block
u32 bytes and u32 crc32 of its payload; the payloads; u32 crc32 of all before.
"""

from __future__ import annotations

import struct
import zlib
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillcast.llm.common import documents, partitions, staged, task, text_or_empty, tokenizer_path
from tillcast.llm.pretokens import piece_encoder
from tillcast.llm.range_coder import BLOCK, decode_blocks, encode_blocks

BYTE_BPE = tokenizer_path("byte_bpe_50k.json")
END_ID = 2
MAGIC = b"TCT1"
#: Ids coded in step (a segment ends with the document that reaches it; the last
#: one of a range may be half as long again, so that none is short beside another)
#: and text bytes encoded at a time (memory bounds only).
SEGMENT_IDS = 2 << 20
CHUNK_BYTES = 2 << 20

SEGMENT = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()),
                        T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType()),
                        T.StructField("data", T.BinaryType())])


def pack_segment(keys: np.ndarray, named: np.ndarray, sizes: np.ndarray, ids: np.ndarray, end_id: int = END_ID) -> bytes:
    """Record of documents with ``sizes`` ids each, one after another in ``ids``."""
    payloads = encode_blocks(ids)
    lengths = np.array([len(p) for p in payloads], dtype="<u4")
    sums = np.array([zlib.crc32(p) for p in payloads], dtype="<u4")
    body = b"".join([MAGIC, struct.pack("<IQII", len(keys), len(ids), len(payloads), end_id),
                     keys.astype("<i8").tobytes(), named.astype("u1").tobytes(), sizes.astype("<u4").tobytes(),
                     lengths.tobytes(), sums.tobytes(), *payloads])
    return body + struct.pack("<I", zlib.crc32(body))


def unpack_segment(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, whether they are set, sizes and ids; ValueError if a checksum fails."""
    if data[:4] != MAGIC or struct.unpack("<I", data[-4:])[0] != zlib.crc32(data[:-4]):
        raise ValueError("damaged token segment")
    n, total, blocks, _ = struct.unpack_from("<IQII", data, 4)
    at = 4 + struct.calcsize("<IQII")
    parts = []
    for kind, count in (("<i8", n), ("u1", n), ("<u4", n), ("<u4", blocks), ("<u4", blocks)):
        parts.append(np.frombuffer(data, dtype=kind, count=count, offset=at))
        at += count * np.dtype(kind).itemsize
    keys, named, sizes, lengths, sums = parts
    payloads = []
    for size, crc in zip(lengths.tolist(), sums.tolist()):
        payloads.append(data[at:at + size])
        at += size
        if zlib.crc32(payloads[-1]) != crc:
            raise ValueError("damaged block in a token segment")
    return keys, named.astype(bool), sizes.astype(np.int64), decode_blocks(payloads, total)


def read_block(data: bytes, number: int) -> np.ndarray:
    """Ids of one block of a record, decoded without the others."""
    n, total, blocks, _ = struct.unpack_from("<IQII", data, 4)
    at = 4 + struct.calcsize("<IQII") + 13 * n
    lengths = np.frombuffer(data, dtype="<u4", count=blocks, offset=at).astype(np.int64)
    crc = int(np.frombuffer(data, dtype="<u4", count=blocks, offset=at + 4 * blocks)[number])
    begin = at + 8 * blocks + int(lengths[:number].sum())
    payload = data[begin:begin + int(lengths[number])]
    if zlib.crc32(payload) != crc:
        raise ValueError("damaged block in a token segment")
    return decode_blocks([payload], min(BLOCK, total - number * BLOCK))


def _segments(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(path)
        keys, sizes, parts, held, seq, part = [], [], [], 0, 0, None

        def flush(upto):
            """Segment of the first documents held, up to the one that reaches so many ids."""
            nonlocal keys, sizes, parts, held, seq
            size, ids = np.concatenate(sizes), np.concatenate(parts)
            ends = np.cumsum(size)
            n = min(int(np.searchsorted(ends, upto)) + 1, len(keys))
            total = int(ends[n - 1])
            key = np.array([0 if k is None else k for k in keys[:n]], dtype=np.int64)
            data = pack_segment(key, np.array([k is not None for k in keys[:n]]), size[:n], ids[:total], end_id)
            row = [part], [seq], [n], [total], [data]
            keys, sizes, parts, held, seq = keys[n:], [size[n:]], [ids[total:]], held - total, seq + 1
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (
                pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], SEGMENT.names)

        def rest():
            """Segments of all documents held."""
            while keys:
                yield flush(held // 2 if 2 * held > 3 * SEGMENT_IDS else held)

        for b in batches:
            texts = b.column("text").to_pylist()
            ids_of, part_of = b.column("id").to_pylist(), b.column("part").to_pylist()
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (size < CHUNK_BYTES or j == i) and part_of[j] == part_of[i]:
                    size += len(texts[j])
                    j += 1
                if part_of[i] != part:
                    yield from rest()
                    part, seq = part_of[i], 0
                ids, n = encoder.encode(texts[i:j])
                # The end id after each document's ids.
                ends = np.cumsum(n + 1) - 1
                out = np.full(len(ids) + len(n), end_id, dtype=np.int32)
                keep = np.ones(len(out), dtype=bool)
                keep[ends] = False
                out[keep] = ids
                keys += ids_of[i:j]
                sizes.append(n + 1)
                parts.append(out)
                held += len(out)
                while held >= 2 * SEGMENT_IDS:
                    yield flush(SEGMENT_IDS)
                i = j
        yield from rest()
    return run


def write_tokens(docs: DataFrame, tokenizer: str = BYTE_BPE, end_id: int = END_ID, id_col: str = "doc_id",
                 text_col: str = "text", path: str | None = None) -> DataFrame:
    """Write the documents' ids in ascending id order; returns the segment table read back.

    ``path``: where to write; by default below the checkpoint folder.  Null
    and empty texts hold the end id alone; null ids come first; rows that
    repeat an id stand in order of a hash of their text.  Ids of documents are
    integers.  An empty table writes no segment.
    """
    n = max(partitions(docs.sparkSession), docs.rdd.getNumPartitions())
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    order = ["id", F.xxhash64("text")]
    ranged = rows.repartitionByRange(n, "id").withColumn("part", F.spark_partition_id()).sortWithinPartitions(*order)
    segments = ranged.mapInArrow(task(_segments(tokenizer, end_id)), SEGMENT)
    if path is None:
        return staged(segments, "tokens")
    segments.write.parquet(path)
    return docs.sparkSession.read.schema(SEGMENT).parquet(path)


def _documents_of(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                keys, named, sizes, ids = unpack_segment(b.column("data")[i].as_py())
                ends = np.cumsum(sizes)
                raw = ids.astype("<u4")
                crc = [zlib.crc32(raw[a:z]) for a, z in zip((ends - sizes).tolist(), ends.tolist())]
                n = len(keys)
                columns = {"part": pa.array(np.full(n, b.column("part")[i].as_py(), dtype=np.int32)),
                           "seq": pa.array(np.full(n, b.column("seq")[i].as_py(), dtype=np.int32)),
                           "doc_id": pa.array(keys, mask=~named), "inside": pa.array(ends - sizes), "n_tokens": pa.array(sizes),
                           "ids_crc32": pa.array(crc, pa.int64())}
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(np.append(ends - sizes, len(ids)).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_pydict(columns)
    return run


def read_tokens(segments: DataFrame, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 and, unless
    ``with_ids`` is False, ids of every document, all decoded from the segments.
    A damaged record fails the read."""
    out = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()),
                        *[T.StructField(c, T.LongType()) for c in ("doc_id", "inside", "n_tokens", "ids_crc32")],
                        *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])
    rows = segments.select("part", "seq", "data").mapInArrow(task(_documents_of(with_ids)), out)
    # Ids before a segment: those of earlier ranges (one row a range) and of
    # earlier segments of its own range.
    size = segments.select("part", "seq", "n_ids")
    ranges = size.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ranges_before"))
    own = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = (size.withColumn("own_before", F.coalesce(F.sum("n_ids").over(own), F.lit(0))).join(ranges, "part")
              .select("part", "seq", (F.col("ranges_before") + F.col("own_before")).alias("before")))
    return rows.join(before, ["part", "seq"]).select(
        "doc_id", (F.col("before") + F.col("inside")).cast("long").alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: place, number and checksum of every document's ids, read from the files."""
    return read_tokens(write_tokens(documents(spark, sf_dir)), with_ids=False)
