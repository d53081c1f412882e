"""Operator 4, byte-pair encoding and decoding with a given vocabulary file.

Encoding of one piece: its symbols form a doubly linked list; every adjacent
pair with a merge rule enters a priority queue ordered by (rank, position);
the lowest entry merges its pair, relinks the neighbours and queues the two
new pairs.  Entries whose symbols have changed meanwhile are stale and
skipped.  Decoding concatenates vocabulary strings.

The file is the JSON of a tokenizer of this kind: added tokens matched in the
raw text; NFC, white space to blank, lower case; pieces by a pattern; bytes
mapped to printable characters; an end-of-word suffix; no decoder (tokens are
joined by a blank).  Its path is a parameter; it is read once per worker.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import lru_cache
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillcast.llm.common import documents, task, text_or_empty, tokenizer_path

WORD_BPE = tokenizer_path("word_bpe_49k.json")
#: Distinct pieces whose ids a worker remembers (about 230 bytes each); cleared
#: when full (memory bound only, results do not depend on it).
CACHE_PIECES = 1_000_000
#: Longer pieces are encoded each time.
CACHED_CHARS = 64


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1
    bytes stand for themselves, the others follow from U+0100 on in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in set(own) else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Merge rules and strings of one tokenizer file, with encode and decode."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.strings = [""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for s, i in vocab.items():
            self.strings[i] = s
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for s, i in self.added.items():
            self.strings[i] = s
        self.arrow = pa.array(self.strings)
        suffix = model.get("end_of_word_suffix") or ""
        chars = byte_characters()
        self.inner = [vocab[c] for c in chars]
        self.final = [vocab[c + suffix] for c in chars]
        # Rank of each pair (left * shift + right), and by rank its symbols and their union.
        self.shift = len(self.strings)
        self.left = [vocab[a] for a, _ in model["merges"]]
        self.right = [vocab[b] for _, b in model["merges"]]
        self.union = [vocab[a + b] for a, b in model["merges"]]
        self.ranks = {a * self.shift + b: r for r, (a, b) in enumerate(zip(self.left, self.right))}
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(split).findall
        # The same pattern for texts of ASCII alone.
        self.split_ascii = re.compile(split.replace(r"[\p{L}]", "[A-Za-z]").replace(r"[\p{N}]", "[0-9]")
                                      .replace(r"\p{L}\p{N}", "A-Za-z0-9"), re.A).findall
        self.split_added = regex.compile(
            "(" + "|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")").split
        self.cache = _Pieces(self)

    def merge(self, ids: list[int]) -> list[int]:
        """Apply the merge rules to a list of symbol ids; queue entries are rank * length + position."""
        n, ranks, shift = len(ids), self.ranks.get, self.shift
        left, right, union = self.left, self.right, self.union
        queue = [r * n + i for i in range(n - 1) if (r := ranks(ids[i] * shift + ids[i + 1])) is not None]
        if not queue:
            return ids
        heapq.heapify(queue)
        ids = ids[:]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            rank, i = divmod(pop(queue), n)
            j = after[i]
            if j >= n or ids[i] != left[rank] or ids[j] != right[rank]:
                continue  # stale
            new = ids[i] = union[rank]
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = ranks(new * shift + ids[k])
                if r is not None:
                    push(queue, r * n + i)
            h = before[i]
            if h >= 0:
                r = ranks(ids[h] * shift + new)
                if r is not None:
                    push(queue, r * n + h)
        return [x for x in ids if x >= 0]

    def piece(self, s: str) -> list[int]:
        raw = s.encode()
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.final[raw[-1]]
        return self.merge(ids)

    def pieces(self, text: str) -> list[str]:
        """Pieces of a text without added tokens."""
        text = self.normal(text)
        return self.split_ascii(text) if text.isascii() else self.split(text)

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        # Lower case of each character by itself (no final-sigma rule).
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()

    def encode(self, text: str) -> list[int]:
        return self.encode_all(pa.array([text], pa.string()))[0].as_py()

    def encode_all(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text; each distinct piece is merged once and its ids are gathered."""
        cache = self.cache
        if len(cache) >= CACHE_PIECES:
            cache.clear()
        pieces, ends = [], [0]
        for text in texts.to_pylist():
            for part in self.split_added(text) if "<|" in text else (text,):
                if part in self.added:
                    pieces.append(part)
                else:
                    pieces += self.pieces(part)
            ends.append(len(pieces))
        row = np.fromiter(map(cache.__getitem__, pieces), np.int64, len(pieces))
        ids, upto = cache.gather(row)
        return pa.ListArray.from_arrays(pa.array(upto[np.array(ends)].astype(np.int32)), pa.array(ids))

    def decode(self, ids: list[int]) -> str:
        strings = self.strings
        return " ".join([strings[i] for i in ids])

    def decode_lists(self, ids: pa.ListArray) -> pa.Array:
        """``decode`` of a whole list<int> array; null lists give empty texts."""
        if not len(ids):
            return pa.array([], pa.string())
        # Of a slice only its own ids: ``values`` holds those of the whole array.
        first, last = ids.offsets[0].as_py(), ids.offsets[-1].as_py()
        strings = self.arrow.take(ids.values.slice(first, last - first))
        lists = pa.ListArray.from_arrays(pc.subtract(ids.offsets, first), strings)
        return pc.fill_null(pc.binary_join(pc.if_else(ids.is_valid(), lists, None) if ids.null_count else lists, " "), "")


class _Pieces(dict):
    """Row of each distinct piece in a growing table of ids."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        self._empty()

    def _empty(self) -> None:
        self.first, self.count = np.zeros(1 << 12, dtype=np.int64), np.zeros(1 << 12, dtype=np.int64)
        self.ids, self.rows, self.used = np.zeros(1 << 14, dtype=np.int32), 0, 0

    def clear(self) -> None:
        super().clear()
        self._empty()

    def __missing__(self, piece: str) -> int:
        added = self.vocabulary.added.get(piece)
        ids = self.vocabulary.piece(piece) if added is None else [added]
        if self.rows == len(self.first):
            self.first, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        row = self.rows
        self.first[row], self.count[row] = self.used, len(ids)
        self.ids[self.used:self.used + len(ids)] = ids
        self.used += len(ids)
        self.rows += 1
        if len(piece) <= CACHED_CHARS:
            self[piece] = row
        return row

    def gather(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces ``row`` one after another, and how many lie before each piece and after the last."""
        count = self.count[row]
        upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(count)])
        ids = self.ids[np.arange(int(upto[-1])) + np.repeat(self.first[row] - upto[:-1], count)]
        return ids, upto


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(docs: DataFrame, path: str = WORD_BPE, id_col: str = "doc_id", text_col: str = "text",
           ids_col: str = "ids") -> DataFrame:
    """``id_col`` and the token ids of each whole text as array<int>.

    Null and empty texts give an empty array.  Every input row gives one row,
    repeated rows included; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias(id_col), text_or_empty(text_col).alias("text"))
    kind = rows.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                ids = v.encode_all(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], [id_col, ids_col])

    return rows.mapInArrow(task(run), T.StructType([T.StructField(id_col, kind),
                                                    T.StructField(ids_col, T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, path: str = WORD_BPE, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add ``out_col``: the vocabulary strings of ``ids_col`` joined by a blank
    (the file names no decoder).  A null or empty array gives an empty text."""
    names = [c for c in encoded.columns if c != out_col]
    rows = encoded.select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        at = names.index(ids_col)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                text = v.decode_lists(part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, text], [*names, out_col])

    return rows.mapInArrow(task(run), T.StructType([*rows.schema.fields, T.StructField(out_col, T.StringType())]))


def encode_decode(docs: DataFrame, path: str = WORD_BPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode`` and ``decode`` of every row in one pass of one worker: ``id_col``, ``ids``, ``decoded``."""
    rows = docs.select(F.col(id_col).alias(id_col), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                ids = v.encode_all(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, v.decode_lists(ids)], [id_col, "ids", "decoded"])

    return rows.mapInArrow(task(run), T.StructType([rows.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType())),
                                                    T.StructField("decoded", T.StringType())]))


def digests(ids_col: str = "ids", decoded_col: str = "decoded") -> list[Column]:
    """SHA-256 of the decimal ids joined by a blank, and of the decoded text."""
    return [F.sha2(F.array_join(F.col(ids_col).cast("array<string>"), " "), 256).alias("ids_sha256"),
            F.sha2(F.col(decoded_col).cast("binary"), 256).alias("decoded_sha256")]


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: number of ids, digest of the ids and of the decoded text of every document."""
    return encode_decode(documents(spark, sf_dir)).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), *digests())
