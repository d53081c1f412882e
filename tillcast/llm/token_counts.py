"""Operator 2, token counts by a linear longest-match automaton.

The word pieces are the byte strings of a vocabulary file; a word, with one
blank before it, is cut greedily into the longest pieces from the left.  The
pieces form a trie.  Where the walk leaves it, a failure link leads to the
node of what remains after the pieces that are then certain have been cut
off, and only their number, known in advance, is added: each byte is read
once, no piece is built.
"""

from __future__ import annotations

import json
from collections import deque
from functools import lru_cache
from typing import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillcast.llm.bpe import byte_characters
from tillcast.llm.common import documents, task, text_or_empty, tokenizer_path

PIECES = tokenizer_path("byte_bpe_50k.json")
#: Distinct words whose counts a worker remembers (memory bound only).
CACHE_WORDS = 300_000


def read_pieces(path: str) -> list[bytes]:
    """The byte strings of a byte-level vocabulary file."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    byte = {c: b for b, c in enumerate(byte_characters())}
    return [bytes(byte[c] for c in s) for s in vocab if all(c in byte for c in s)]


class LongestMatch:
    """Trie of ``pieces`` with failure links. Every single byte must be a piece
    for the words to be coverable; a byte that is none counts as one piece."""

    def __init__(self, pieces: Iterable[bytes]):
        pieces = {*pieces, *(bytes([b]) for b in range(256))}
        self.child: dict[int, int] = {}  # node << 8 | byte
        whole, nodes = [False], 1
        edges: list[list[int]] = [[]]
        for p in sorted(pieces):
            at = 0
            for b in p:
                to = self.child.get(at << 8 | b)
                if to is None:
                    to = self.child[at << 8 | b] = nodes
                    nodes += 1
                    whole.append(False)
                    edges.append([])
                    edges[at].append(b)
                at = to
            whole[at] = True
        # For each node: where to go on, and how many pieces are cut off then.
        self.link, self.popped = [0] * nodes, [0] * nodes
        queue = deque([0])
        while queue:
            at = queue.popleft()
            for b in edges[at]:
                to = self.child[at << 8 | b]
                queue.append(to)
                if whole[to]:
                    self.link[to], self.popped[to] = 0, 1
                    continue
                count, back = self.popped[at], self.link[at]
                while back << 8 | b not in self.child:
                    count += self.popped[back]
                    back = self.link[back]
                self.link[to], self.popped[to] = self.child[back << 8 | b], count

    def count(self, word: bytes) -> int:
        """Number of pieces of ``word``."""
        child, link, popped = self.child, self.link, self.popped
        at = n = 0
        for b in word:
            to = child.get(at << 8 | b)
            while to is None:
                n += popped[at]
                at = link[at]
                to = child.get(at << 8 | b)
            at = to
        while at:
            n += popped[at]
            at = link[at]
        return n


class Counts(dict):
    """Pieces of each word, worked out when first asked for."""

    def __init__(self, match: LongestMatch):
        super().__init__()
        self.match = match

    def __missing__(self, word: bytes) -> int:
        n = self.match.count(b" " + word)
        if len(word) <= 64:
            self[word] = n
        return n

    def of(self, text: str) -> tuple[int, int]:
        """Words and pieces of a whole text."""
        if len(self) > CACHE_WORDS:
            self.clear()
        words = text.encode().split()
        return len(words), sum(map(self.__getitem__, words))


@lru_cache(maxsize=2)
def counts(path: str) -> Counts:
    return Counts(LongestMatch(read_pieces(path)))


def token_counts(docs: DataFrame, path: str = PIECES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_words`` and ``n_pieces`` of each whole text.

    Words are separated by ASCII white space.  Null and empty texts have none.
    Repeated rows are counted each; other columns are not read; an empty table
    gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias(id_col), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counts(path)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                found = [c.of(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())],
                    [id_col, "n_words", "n_pieces"])

    return rows.mapInArrow(task(run), T.StructType([rows.schema[id_col], T.StructField("n_words", T.LongType()),
                                              T.StructField("n_pieces", T.LongType())]))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and greedy word pieces of every document."""
    return token_counts(documents(spark, sf_dir))
