"""Byte-level BPE ids of many texts: distinct pieces go to the tokenizers library once.

The pieces of the byte-level pattern (contractions, an optional blank before a
run of letters, numbers or other characters, white space up to the last one
before a word) are found for a chunk of texts at once from the classes of
their characters, in UTF-8.  Each distinct piece is encoded by the library's
model and its ids are remembered; a text's ids are its pieces' ids in order.
Pieces of up to 15 bytes are their own key (two words, the number of bytes in
the last byte) and are looked up all at once in a table with open addresses.
"""

from __future__ import annotations

import codecs
import unicodedata
from functools import lru_cache

import numpy as np

from tillcast.llm.bpe import byte_characters

LETTER, NUMBER, OTHER, BLANK, SPACE, GAP = range(6)
#: Distinct pieces a worker remembers (memory bound only).
CACHE_PIECES = 2_000_000
#: Bytes of longer pieces a worker remembers (memory bound only).
CACHE_LONG_BYTES = 32 << 20
#: Bytes from which on a piece is no key of two words.
LONG = 16
_K1, _K2, _SIZE_AT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(56)
#: Bytes of a piece of each size in its key's two words.
_MASK1 = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(LONG)], dtype=np.uint64)
_MASK2 = np.array([(1 << 8 * max(n - 8, 0)) - 1 for n in range(LONG)], dtype=np.uint64)


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """Class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for plane in (0, 1, 2, 3, 14):  # the others hold nothing, or private characters
        at = plane << 16
        out[at:at + 0x10000] = [kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(at, at + 0x10000)]
    # White space by the Unicode property.
    out[[*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    out[0x20] = BLANK
    return out


@lru_cache(maxsize=1)
def _byte_classes() -> bytes:
    """Class of every byte below 128."""
    return character_classes()[:128].tobytes() + bytes(128)


def byte_kinds(raw: bytes) -> np.ndarray:
    """Class of the character each byte of a UTF-8 text belongs to."""
    kind = np.frombuffer(bytearray(raw.translate(_byte_classes())), dtype=np.uint8)
    byte = np.frombuffer(raw, dtype=np.uint8)
    classes = character_classes()
    first = np.flatnonzero(byte >= 0xC0)
    lead = byte[first]
    for n, low, high, bits in ((2, 0xC0, 0xE0, 0x1F), (3, 0xE0, 0xF0, 0x0F), (4, 0xF0, 0xF8, 0x07)):
        at = first[(lead >= low) & (lead < high)]
        if len(at):
            code = byte[at].astype(np.int64) & bits
            for i in range(1, n):
                code = code << 6 | (byte[at + i] & 0x3F)
            of = classes[code]
            for i in range(n):
                kind[at + i] = of
    return kind


def piece_starts(byte: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each byte of UTF-8. ``kind``: classes of their characters, GAP between texts."""
    white = (kind == BLANK) | (kind == SPACE)
    group = np.where(white, np.uint8(BLANK), kind)
    n = len(byte)
    start = np.ones(n, dtype=bool)
    start[1:] = group[1:] != group[:-1]
    solid = ~white & (kind != GAP)
    # The last white character before a run stands alone, or as a blank joins the run.
    run = np.flatnonzero(start[1:] & solid[1:] & white[:-1]) + 1
    blank = kind[run - 1] == BLANK
    start[run[blank] - 1] = True
    start[run[blank]] = False
    last = run[~blank] - 1
    for _ in range(3):
        last = last - ((byte[last] & 0xC0) == 0x80)  # back to its first byte
    start[last] = True
    # A lone apostrophe that starts a piece takes a contraction's letters.
    lone = np.flatnonzero((byte == 0x27) & start)
    lone = lone[lone + 1 < n]
    lone = lone[kind[lone + 1] == LETTER]
    a = byte[lone + 1]
    b = np.where(lone + 2 < n, byte[np.minimum(lone + 2, n - 1)], 0)
    one = np.isin(a, [ord(c) for c in "stmd"])
    two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
    for hit, size in ((one, 2), (two, 3)):
        at = lone[hit]
        start[at + 1] = False
        after = at + size
        start[after[after < n]] = True
    return start


class PieceEncoder:
    """Ids of texts by a tokenizers file with the byte-level pattern and no normalizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = "".join(byte_characters())
        self._clear()

    def _clear(self) -> None:
        self.n = self.used = self.long_bytes = 0
        self.long: dict[bytes, int] = {}
        self.first, self.count = np.zeros(1 << 12, dtype=np.int64), np.zeros(1 << 12, dtype=np.int64)
        self.ids = np.zeros(1 << 14, dtype=np.int32)
        # Keys of the pieces, and the piece at each address (-1: none).
        self.key1, self.key2 = np.zeros(1 << 12, dtype=np.uint64), np.zeros(1 << 12, dtype=np.uint64)
        self.bits = 14
        self.place = np.full(1 << self.bits, -1, dtype=np.int32)

    def _learn(self, pieces: list[bytes]) -> int:
        """Have the pieces encoded; the number of the first, the others follow."""
        tokenize, letters, decode = self.model.tokenize, self.letters, codecs.charmap_decode
        flat, sizes = [], []
        for p in pieces:
            found = tokenize(decode(p, "strict", letters)[0])
            sizes.append(len(found))
            flat += [t.id for t in found]
        n, k = self.n, len(pieces)
        while n + k > len(self.first):
            self.first, self.count, self.key1, self.key2 = (
                np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count, self.key1, self.key2))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.count[n:n + k] = sizes
        self.first[n:n + k] = self.used + np.cumsum(self.count[n:n + k]) - self.count[n:n + k]
        self.ids[self.used:self.used + len(flat)] = flat
        self.used += len(flat)
        self.n += k
        return n

    def _address(self, key1: np.ndarray, key2: np.ndarray) -> np.ndarray:
        h = key2 * _K2
        h ^= key1
        h ^= h >> np.uint64(32)
        h *= _K1
        h >>= np.uint64(64 - self.bits)
        return h.view(np.int64)

    def _look(self, key1: np.ndarray, key2: np.ndarray) -> np.ndarray:
        """Number of the piece of each key, -1 where it is not known."""
        at = self._address(key1, key2)
        row = self.place.take(at)
        todo = np.flatnonzero((self.key1.take(row, mode="clip") != key1) | (self.key2.take(row, mode="clip") != key2) | (row < 0))
        while len(todo):
            todo = todo[row[todo] >= 0]  # taken by another piece: the next address
            at[todo] = (at[todo] + 1) & (len(self.place) - 1)
            found = self.place[at[todo]]
            row[todo] = found
            todo = todo[(found < 0) | (self.key1.take(found, mode="clip") != key1[todo]) | (self.key2.take(found, mode="clip") != key2[todo])]
        return row

    def _enter(self, rows: np.ndarray) -> None:
        """Give the pieces of these numbers, none of which has one, an address."""
        if 2 * self.n > len(self.place):
            while 2 * self.n > 1 << self.bits:
                self.bits += 1
            self.place = np.full(1 << self.bits, -1, dtype=np.int32)
            rows = np.flatnonzero(self.key2[:self.n])  # longer pieces have no key
        at = self._address(self.key1[rows], self.key2[rows])
        while len(rows):
            free = self.place[at] < 0
            self.place[at[free]] = rows[free]
            left = self.place[at] != rows
            rows, at = rows[left], (at[left] + 1) & (len(self.place) - 1)

    def _numbers(self, raw: bytes, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Number of each piece."""
        is_long = size >= LONG
        n = np.where(is_long, 0, size)
        padded = np.frombuffer(raw + bytes(16), dtype=np.uint8)
        eight = np.ndarray(len(raw) + 9, dtype="<u8", buffer=padded, strides=(1,))
        key1 = eight[begin] & _MASK1.take(n)
        key2 = eight[begin + 8] & _MASK2.take(n)
        key2 |= n.astype(np.uint64) << _SIZE_AT
        row = self._look(key1, key2)
        long = np.flatnonzero(is_long)
        new = np.flatnonzero((row < 0) & ~is_long)
        if len(new):
            seen: dict[bytes, int] = {}
            kind = [seen.setdefault(raw[a:z], len(seen)) for a, z in zip(begin[new].tolist(), (begin + size)[new].tolist())]
            at = self._learn(list(seen))
            row[new] = np.array(kind) + at
            self.key1[row[new]], self.key2[row[new]] = key1[new], key2[new]
            self._enter(np.arange(at, at + len(seen)))
        if len(long):
            strings = [raw[a:z] for a, z in zip(begin[long].tolist(), (begin + size)[long].tolist())]
            fresh = [p for p in dict.fromkeys(strings) if p not in self.long]
            if fresh:
                at = self._learn(fresh)
                self.key2[at:at + len(fresh)] = 0
                self.long_bytes += sum(map(len, fresh))
                for i, p in enumerate(fresh):
                    self.long[p] = at + i
            row[long] = [self.long[p] for p in strings]
        return row

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of each text's."""
        if any(a in t for a in self.added for t in texts):
            # Added tokens are matched before the pattern: leave such texts to the library.
            special = [any(a in t for a in self.added) for t in texts]
            plain, sizes = self.encode(["" if s else t for s, t in zip(special, texts)])
            parts, at = [], 0
            for i, t in enumerate(texts):
                part = plain[at:at + sizes[i]]
                at += sizes[i]
                if special[i]:
                    part = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, dtype=np.int32)
                parts.append(part)
            return np.concatenate(parts), np.array([len(p) for p in parts], dtype=np.int64)
        encoded = [t.encode() for t in texts]
        raw = b"\0".join(encoded) + b"\0"
        gaps = np.cumsum([len(t) + 1 for t in encoded]) - 1
        kind = byte_kinds(raw)
        kind[gaps] = GAP
        begin = np.flatnonzero(piece_starts(np.frombuffer(raw, dtype=np.uint8), kind))
        size = np.diff(np.append(begin, len(raw)))
        real = kind[begin] != GAP
        begin, size = begin[real], size[real]
        if not len(begin):
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
        if self.n > CACHE_PIECES or self.long_bytes > CACHE_LONG_BYTES:
            self._clear()
        row = self._numbers(raw, begin, size)
        count = self.count.take(row)
        ends = np.cumsum(count)
        at = np.repeat(self.first.take(row) - ends + count, count)
        at += np.arange(len(at))
        ids = self.ids.take(at)
        upto = np.searchsorted(begin, gaps)  # pieces before each text's end
        total = np.concatenate([[0], ends])[upto]
        return ids, np.diff(np.concatenate([[0], total]))


@lru_cache(maxsize=1)
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)
