"""Adaptive context-mixing range coder for token ids.

Ids are coded in blocks of ``BLOCK``; every block starts with empty tables and
a fresh coder, so blocks are independent.  Per block three tables predict the
next id: order 2 (the id that last followed the two ids before), order 1 (the
id that last followed the id before) and order 0 (the id last seen with the
same low six bits, 64 of them).  One symbol says which prediction holds, or
that none does; then the id's upper byte follows by adaptive counts and its
lower byte evenly.

The symbol's probabilities mix two adaptive counts: those of the context (is
there an order-2 prediction, did the order-1 prediction hold last time) and
those of the whole block, by the context's experience.  They are renewed at
fixed steps.  The coder keeps a 64-bit low end and range and puts out 32 bits
at a time; where the range straddles a 32-bit boundary it is cut to it, so no
carry arises.

All blocks of a segment are coded in step with each other, a numpy lane each.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
SLOTS = 64
SYMBOLS = SLOTS + 3  # order 2, order 1, none, order-0 slots
NONE, FIRST_SLOT = 2, 3
CONTEXTS = 4
TABLE = 1024
TOTAL_BITS = 12
TOTAL = 1 << TOTAL_BITS
STEP = 24  # added to a count
GROUP = 64  # lanes whose shares are renewed together, so that they stay near the core
MAX_ID = (1 << 16) - 2
_MASK32 = np.uint64(0xFFFFFFFF)
_TOP = np.uint64(1 << 32)
_B12, _B8, _B32 = np.uint64(TOTAL_BITS), np.uint64(8), np.uint64(32)
_LAST, _BYTE = np.uint64(TOTAL - 1), np.uint64(255)
_FOUR, _TOPS = np.uint64(0x0001000100010001), np.uint64(0x8000800080008000)


def _renewals() -> set[int]:
    """Steps of a block before which probabilities are renewed."""
    return {16, 48, 128, *range(256, BLOCK, 192)}


def _shares(weights: np.ndarray, ends: np.ndarray) -> None:
    """Into ``ends``: where each entry's integer share of ``TOTAL``, at least one, ends (last axis)."""
    n = weights.shape[-1]
    sums = np.cumsum(weights, axis=-1, dtype=np.float32)
    sums *= np.float32(TOTAL - n) / sums[..., -1:]
    ends[...] = sums
    ends += np.arange(1, n + 1, dtype=np.uint16)
    ends[..., -1] = TOTAL


def _share(ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and width of the shares at these places."""
    # Before the first of a row stands the last of another, where TOTAL is as good as 0.
    a = ends.take(at - 1, mode="wrap")
    a &= TOTAL - 1
    return a, ends.take(at, mode="wrap") - a


def _words(ends: np.ndarray) -> np.ndarray:
    """Four ends in a word."""
    return np.ascontiguousarray(ends).reshape(-1).view(np.uint64)


def _counted(at: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    more = np.bincount(at.reshape(-1), minlength=int(np.prod(shape))).astype(np.float32)
    more *= np.float32(STEP)
    return more.reshape(shape)


class Lanes:
    """Model state of ``n`` blocks coded in step; ``search``: whether symbols will be looked for by their shares."""

    def __init__(self, n: int, search: bool = False):
        self.n = n
        lane = np.arange(n, dtype=np.int64)
        self.at_table, self.at_slot = lane * TABLE, lane * SLOTS
        self.at_context = lane * CONTEXTS
        # Id + 1, 0 where nothing is known; 16 bits keep the tables near the core.
        self.order2 = np.zeros(n * TABLE, dtype=np.uint16)
        # The same doubled, the lowest bit telling whether the prediction held.
        self.order1 = np.zeros(n * TABLE, dtype=np.uint32)
        self.order0 = np.zeros(n * SLOTS, dtype=np.uint16)
        self.counts = np.full((n, CONTEXTS, SYMBOLS), 1, dtype=np.float32)
        self.counts[..., NONE] = 16
        self.high_counts = np.full((n, 256), 1, dtype=np.float32)
        self.search = search
        self.ends = np.empty(self.counts.shape, dtype=np.uint16), np.empty(self.high_counts.shape, dtype=np.uint16)
        self.mixed, self.high = (x.reshape(-1) for x in self.ends)
        self.renew()

    def renew(self, seen: np.ndarray | None = None, seen_high: np.ndarray | None = None) -> None:
        """New shares; ``seen``, ``seen_high``: places of the counts of what was coded since, a row a step the former."""
        ends, high_ends = self.ends
        if seen_high is not None:
            self.high_counts += _counted(seen_high, self.high_counts.shape)
        for i in range(0, self.n, GROUP):
            part = slice(i, i + GROUP)
            counts = self.counts[part]
            if seen is not None:
                counts += _counted(seen[:, part] - i * CONTEXTS * SYMBOLS, counts.shape)
            block = counts.sum(axis=1, keepdims=True)
            block *= np.float32(64) / block.sum(axis=2, keepdims=True)
            _shares(counts + block, ends[part])
            _shares(self.high_counts[part], high_ends[part])
        if self.search:
            head = np.full((self.n, CONTEXTS, 4), TOTAL, dtype=np.uint16)
            head[..., :FIRST_SLOT] = ends[..., :FIRST_SLOT]
            self.head = [_words(head)]
            slots = ends[..., FIRST_SLOT:]
            self.slots = [_words(slots[..., 15::16]), _words(slots[..., 3::4]), _words(slots)]
            self.highs = [_words(high_ends[:, 63::64]), _words(high_ends[:, 15::16]), _words(high_ends[:, 3::4]), _words(high_ends)]

    def places(self, before1: np.ndarray, before2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the predictions of order 1 and 2 stand after the two ids before."""
        h2 = before2 * np.int64(60493)
        h2 += before1
        h2 *= 40503
        h2 >>= 5
        h2 &= TABLE - 1
        h2 += self.at_table
        h1 = before1 * np.int64(40503)
        h1 >>= 6
        h1 &= TABLE - 1
        h1 += self.at_table
        return h1, h2

    def follow(self, ids: np.ndarray, before1: np.ndarray, before2: np.ndarray) -> tuple[np.ndarray, ...]:
        """Take in several steps' ids: their predictions of order 1, whether it held, of order 2 and of order 0."""
        h1, h2 = self.places(before1, before2)
        h0 = (ids & np.uint16(SLOTS - 1)) + self.at_slot
        mark = ids + np.uint16(1)
        double = mark.astype(np.uint32)
        double += double
        p1, p2, p0 = np.empty(ids.shape, dtype=np.uint32), np.empty(ids.shape, dtype=np.uint16), np.empty(ids.shape, dtype=np.uint16)
        for t in range(len(ids)):
            at, m = h1[t], double[t]
            p = self.order1.take(at, out=p1[t], mode="wrap")
            self.order1[at] = m + ((p | 1) == m + 1)
            at, m = h2[t], mark[t]
            self.order2.take(at, out=p2[t], mode="wrap")
            self.order2[at] = m
            at = h0[t]
            self.order0.take(at, out=p0[t], mode="wrap")
            self.order0[at] = m
        return p1 >> 1, p1 & 1, p2, p0

    def learn(self, ids: np.ndarray, p1: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> None:
        """Take in the ids just decoded; ``p1``: their predictions of order 1."""
        mark = (ids + 1).astype(np.uint16)
        self.order2[h2] = mark
        self.order0[self.at_slot + (ids & (SLOTS - 1))] = mark
        double = mark.astype(np.uint32)
        held = p1 == double
        double += double
        double += held
        self.order1[h1] = double


def _spans() -> list[tuple[int, int]]:
    """Steps of a block between two renewals."""
    at = [0, *sorted(_renewals()), BLOCK]
    return list(zip(at, at[1:]))


class Writer:
    """Ends, ranges and words put out of ``n`` range coders in step."""

    def __init__(self, n: int):
        self.low, self.span = np.zeros(n, dtype=np.uint64), np.full(n, ~np.uint64(0), dtype=np.uint64)
        self.out = np.zeros((n, BLOCK + 2), dtype="<u4")
        self.flat, self.first = self.out.reshape(-1), np.arange(n, dtype=np.int64) * (BLOCK + 2)
        self.used = self.first.copy()

    def put(self, a: np.ndarray, width: np.ndarray, lane: np.ndarray, high: np.ndarray, high_width: np.ndarray,
            byte: np.ndarray) -> None:
        """Code a share of ``TOTAL`` from ``a`` on in every lane, then an id's two bytes in the lanes named."""
        low, span = self.low, self.span
        span >>= _B12
        low += span * a
        span *= width
        if len(lane):
            r = span.take(lane)
            r >>= _B12
            s = r * high_width
            s >>= _B8
            r *= high
            r += s * byte
            low[lane] = low.take(lane) + r
            span[lane] = s
        small = np.flatnonzero(span < _TOP)
        if len(small):
            l, s = low.take(small), span.take(small)
            s = _cut(l, s)
            at = self.used.take(small)
            self.flat[at] = l >> _B32
            self.used[small] = at + 1
            low[small], span[small] = l << _B32, s << _B32

    def payload(self, lane: int, words: int, end: int) -> bytes:
        return self.out[lane, :words].tobytes() + (end >> 32).to_bytes(4, "little") + (end & 0xFFFFFFFF).to_bytes(4, "little")


def _cut(low: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Ranges below 32 bits, cut where they straddle a 32-bit boundary."""
    over = np.flatnonzero((low ^ (low + span)) >= _TOP)
    if len(over):
        span[over] = (~low[over] + np.uint64(1)) & _MASK32
    return span


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """Payload of each block of ``ids`` (int, at most ``MAX_ID``).

    As all ids are known, only the tables of predictions and the coders go
    step by step; all else is worked out for the steps between two renewals
    at a time."""
    if len(ids) and (int(ids.max()) > MAX_ID or int(ids.min()) < 0):
        raise ValueError("ids must lie between 0 and 65534")
    blocks = -(-len(ids) // BLOCK)
    if not blocks:
        return []
    padded = np.zeros(blocks * BLOCK, dtype=np.uint16)
    padded[:len(ids)] = ids
    grid = np.zeros((BLOCK + 2, blocks), dtype=np.uint16)  # two zeros before each block
    grid[2:] = padded.reshape(blocks, BLOCK).T
    tail = len(ids) - (blocks - 1) * BLOCK  # ids of the last block
    model, coder, final = Lanes(blocks), Writer(blocks), None
    seen = seen_high = None
    for begin, end in _spans():
        if begin:
            model.renew(seen, seen_high)
        x = grid[begin + 2:end + 2]
        p1, held, p2, p0 = model.follow(x, grid[begin + 1:end + 1], grid[begin:end])
        mark = x + np.uint16(1)
        slot = (x & np.uint16(SLOTS - 1)).astype(np.uint8)
        # No prediction, else order 0, else order 1, else order 2.
        symbol = (p0 == mark) * (slot + np.uint8(FIRST_SLOT - NONE)) + np.uint8(NONE)
        hit = p1 == mark
        symbol *= ~hit
        symbol += hit
        symbol *= p2 != mark
        row = (p2 > 0).astype(np.int64)
        row += row
        row += held
        row += model.at_context
        seen = row * SYMBOLS
        seen += symbol
        a, width = _share(model.mixed, seen)
        step, lane = np.nonzero(symbol == NONE)
        y = x[step, lane]
        seen_high = lane * 256
        seen_high += y >> 8
        high, high_width = _share(model.high, seen_high)
        byte = y & np.uint16(255)
        upto = np.searchsorted(step, np.arange(end - begin + 1)).tolist()
        for t in range(end - begin):
            if begin + t == tail:
                # The last block ends early; what its lane codes from here on is dropped.
                final = int(coder.used[-1] - coder.first[-1]), int(coder.low[-1])
            i, j = upto[t], upto[t + 1]
            coder.put(a[t], width[t], lane[i:j], high[i:j], high_width[i:j], byte[i:j])
    ends = list(zip((coder.used - coder.first).tolist(), coder.low.tolist()))
    if final is not None:
        ends[-1] = final
    return [coder.payload(i, words, end) for i, (words, end) in enumerate(ends)]


def _search(levels: list[np.ndarray], at: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Place, counted on from four to the power of levels for each ``at``, of the share that holds ``value``.

    A word of a level holds the ends of four groups of shares; the ends at or
    below the value, counted in one go, tell which group to look into."""
    key = value * _FOUR
    key |= _TOPS
    for level in levels:
        below = key - level.take(at, mode="wrap")
        below &= _TOPS
        at = at << 2
        at += np.bitwise_count(below)
    return at


def decode_blocks(payloads: list[bytes], total: int) -> np.ndarray:
    """The ``total`` ids of the blocks, in order."""
    blocks = len(payloads)
    if not blocks:
        return np.zeros(0, dtype=np.int32)
    sizes = np.array([len(p) // 4 for p in payloads], dtype=np.int64)
    data = np.frombuffer(b"".join(payloads) + b"\0" * 8, dtype="<u4")
    at = np.cumsum(sizes) - sizes
    rest = (data[at].astype(np.uint64) << _B32) | data[at + 1]  # the code above the low end
    at += 2
    model = Lanes(blocks, search=True)
    low, span = np.zeros(blocks, dtype=np.uint64), np.full(blocks, ~np.uint64(0), dtype=np.uint64)
    grid = np.empty((BLOCK, blocks), dtype=np.uint16)
    before1 = before2 = np.zeros(blocks, dtype=np.int64)
    tail = total - (blocks - 1) * BLOCK
    seen, seen_high = None, []
    for begin, stop in _spans():
        if begin:
            model.renew(seen, np.concatenate(seen_high) if seen_high else None)
        seen, seen_high = np.empty((stop - begin, blocks), dtype=np.int64), []
        for t in range(begin, stop):
            h1, h2 = model.places(before1, before2)
            p1, p2 = model.order1.take(h1, mode="wrap"), model.order2.take(h2, mode="wrap")
            row = (p2 > 0).astype(np.int64)
            row += row
            row += p1 & 1
            row += model.at_context
            p1 >>= 1
            span >>= _B12
            value = rest // span
            np.minimum(value, _LAST, out=value)
            symbol = _search(model.head, row, value)
            symbol &= 3
            slotted = np.flatnonzero(symbol == FIRST_SLOT)
            slots = _search(model.slots, row.take(slotted), value.take(slotted))
            slots &= SLOTS - 1
            symbol[slotted] = slots + FIRST_SLOT
            row *= SYMBOLS
            row += symbol
            seen[t - begin] = row
            a, width = _share(model.mixed, row)
            a = span * a
            low += a
            rest -= a
            span *= width
            x = p2.astype(np.int64)
            hit = np.flatnonzero(symbol == 1)
            x[hit] = p1.take(hit)
            slots += model.at_slot.take(slotted)
            x[slotted] = model.order0.take(slots)
            x -= 1
            none = np.flatnonzero(symbol == NONE)
            if len(none):
                r, over = span.take(none), rest.take(none)
                r >>= _B12
                value = over // r
                np.minimum(value, _LAST, out=value)
                high = _search(model.highs, none, value)
                seen_high.append(high)
                a, width = _share(model.high, high)
                a = r * a
                r *= width
                r >>= _B8
                over -= a
                byte = over // r
                np.minimum(byte, _BYTE, out=byte)
                s = r * byte
                over -= s
                a += s
                low[none] = low.take(none) + a
                rest[none], span[none] = over, r
                high = high << 8 & 0xFF00
                high |= byte.view(np.int64)
                x[none] = high
            if t >= tail:
                x[-1] = 0  # beyond the last block's end
            small = np.flatnonzero(span < _TOP)
            if len(small):
                l = low.take(small)
                s = _cut(l, span.take(small))
                word = at.take(small)
                rest[small] = (rest.take(small) << _B32) | data.take(word, mode="clip")
                at[small] = word + 1
                low[small], span[small] = l << _B32, s << _B32
            grid[t] = x
            model.learn(x, p1, h1, h2)
            before2, before1 = before1, x
    return grid.T.reshape(-1)[:total].astype(np.int32)
