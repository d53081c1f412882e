"""Hash-compared merge sort of suffixes held as rows of bytes.

Prefix polynomial hashes (mod 2**64) of every row let a binary search find how
far two rows agree, so a comparison costs the logarithm of the row length.
The merge sort works bottom-up on all segments at once: at each level every
element finds its place in the partner run by binary search.  Hash collisions
cannot pass: the neighbours' extensions are checked against the bytes, and a
mismatch makes the segments sort by the bytes themselves.
"""

from __future__ import annotations

import numpy as np

#: Odd multiplier of the polynomial hash.
BASE = np.uint64(0x9E3779B97F4A7C15)


def prefix_hashes(rows: np.ndarray) -> np.ndarray:
    """hashes[j, i]: hash of the first ``j`` bytes of row ``i``."""
    n, width = rows.shape
    out = np.zeros((width + 1, n), dtype=np.uint64)
    for j in range(width):
        out[j + 1] = out[j] * BASE + rows[:, j] + np.uint64(1)
    return out


def extension(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows ``a`` and ``b``, pair by pair."""
    width = len(hashes) - 1
    low = np.zeros(len(a), dtype=np.int64)
    high = np.full(len(a), width, dtype=np.int64)
    same = hashes[width, a] == hashes[width, b]
    low[same] = width
    while True:
        open_ = np.nonzero(low < high)[0]
        if not len(open_):
            return low
        mid = (low[open_] + high[open_] + 1) >> 1
        equal = hashes[mid, a[open_]] == hashes[mid, b[open_]]
        low[open_] = np.where(equal, mid, low[open_])
        high[open_] = np.where(equal, high[open_], mid - 1)


def _before(rows, hashes, a, b, ties):
    """Whether row ``a`` sorts before row ``b``; equal rows: ``ties``."""
    at = extension(hashes, a, b)
    end = at == rows.shape[1]
    at[end] = 0
    return np.where(end, ties, rows[a, at] < rows[b, at])


def segmented_sort(rows: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort the rows of each segment.

    ``segment``: non-decreasing segment number of each row.  Returns ``order``
    (row at each place) and ``lcp`` (bytes shared with the row before it; -1
    at the first place of a segment).
    """
    n = len(rows)
    order = np.arange(n)
    lcp = np.full(n, -1, dtype=np.int64)
    if not n:
        return order, lcp
    hashes = prefix_hashes(rows)
    first = np.concatenate([[0], np.nonzero(np.diff(segment))[0] + 1, [n]])
    sizes = np.diff(first)
    start = np.repeat(first[:-1], sizes)
    size = np.repeat(sizes, sizes)
    width = 1
    while width < sizes.max():
        here = np.nonzero(size > width)[0]
        local = here - start[here]
        run = local // width
        partner = (run ^ 1) * width
        low = np.minimum(partner, size[here])
        count = np.minimum(partner + width, size[here]) - low
        me, right = order[here], (run & 1).astype(bool)
        lo, hi = np.zeros(len(here), dtype=np.int64), count.copy()
        while True:
            open_ = np.nonzero(lo < hi)[0]
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            other = order[start[here[open_]] + low[open_] + mid]
            ahead = _before(rows, hashes, other, me[open_], right[open_])
            lo[open_] = np.where(ahead, mid + 1, lo[open_])
            hi[open_] = np.where(ahead, hi[open_], mid)
        merged = order.copy()
        merged[start[here] + (run >> 1) * 2 * width + (local - run * width) + lo] = me
        order = merged
        width *= 2
    pairs = np.nonzero(np.diff(segment) == 0)[0]
    a, b = order[pairs], order[pairs + 1]
    lcp[pairs + 1] = extension(hashes, a, b)
    if not _verified(rows, a, b, lcp[pairs + 1]):
        order = np.array(sorted(range(n), key=lambda i: (int(segment[i]), rows[i].tobytes())))
        a, b = order[pairs], order[pairs + 1]
        differ = rows[a] != rows[b]
        lcp[pairs + 1] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return order, lcp


def _verified(rows: np.ndarray, a: np.ndarray, b: np.ndarray, lcp: np.ndarray) -> bool:
    """Whether the bytes confirm every extension and the order of neighbours."""
    for i in range(0, len(a), 1 << 16):
        x, y, k = rows[a[i:i + (1 << 16)]], rows[b[i:i + (1 << 16)]], lcp[i:i + (1 << 16)]
        differ = x != y
        found = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        if not np.array_equal(found, k):
            return False
        inner = np.nonzero(k < rows.shape[1])[0]
        if (x[inner, k[inner]] > y[inner, k[inner]]).any():
            return False
    return True
