"""FM-index of a shard of word numbers: suffix order, wavelet matrix ranks,
backward search and location by sampled suffix positions, in numpy arrays."""

from __future__ import annotations

import numpy as np

#: Every how many places a suffix position is kept.
SAMPLE = 8


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array; every 0 is a terminator of its own, ordered by place."""
    n = len(symbols)
    ends = symbols == 0
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64) + int(ends.sum())
    rank[ends] = np.arange(int(ends.sum()))
    order = np.argsort(rank, kind="stable")
    step = 1
    while True:
        sorted_rank = rank[order]
        if (sorted_rank[1:] != sorted_rank[:-1]).all():
            return order
        after = np.zeros(n, dtype=np.int64)
        after[:n - step] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        step *= 2


class WaveletMatrix:
    """Ranks of symbols below ``2**levels`` in a sequence."""

    def __init__(self, values: np.ndarray, levels: int):
        self.levels, self.ones, self.zeros = levels, [], []
        for level in range(levels - 1, -1, -1):
            bit = ((values >> level) & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(len(values) - int(self.ones[-1][-1]))
            values = np.concatenate([values[~bit], values[bit]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each ``symbol`` occurs before each ``place``."""
        begin, end = np.zeros(len(place), dtype=np.int64), place.astype(np.int64)
        for i in range(self.levels):
            ones, zeros = self.ones[i], self.zeros[i]
            bit = ((symbol >> (self.levels - 1 - i)) & 1).astype(bool)
            b, e = ones[begin], ones[end]
            begin, end = np.where(bit, zeros + b, begin - b), np.where(bit, zeros + e, end - e)
        return end - begin


class FMIndex:
    """Index of ``symbols`` (non-negative integers; 0 ends a run, first value is 0)."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        n = len(symbols)
        sa = suffix_order(symbols)
        self.last = symbols[sa - 1]  # place 0 wraps to the final symbol, which is 0 too
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=alphabet))])
        self.wavelet = WaveletMatrix(self.last, max(1, int(alphabet - 1).bit_length()))
        # Sampled: every SAMPLE-th place, and the places after a terminator,
        # so that no walk crosses one.
        self.sampled = (sa % SAMPLE == 0) | (self.last == 0)
        self.at = np.cumsum(self.sampled) - 1
        self.places = sa[self.sampled]
        self.size = n

    def _step(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        return self.first[symbol] + self.wavelet.rank(symbol, place)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of phrases given as rows padded at the end."""
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), self.size, dtype=np.int64)
        for back in range(int(lengths.max()) if len(lengths) else 0):
            here = np.nonzero((back < lengths) & (low < high))[0]
            if not len(here):
                break
            symbol = phrases[here, lengths[here] - 1 - back]
            low[here], high[here] = self._step(symbol, low[here]), self._step(symbol, high[here])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of the suffixes at ``rows`` of the suffix order."""
        rows, out = rows.copy(), np.zeros(len(rows), dtype=np.int64)
        walked = np.zeros(len(rows), dtype=np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            done = self.sampled[rows[open_]]
            hit = open_[done]
            out[hit] = self.places[self.at[rows[hit]]] + walked[hit]
            open_ = open_[~done]
            symbol = self.last[rows[open_]]
            rows[open_] = self._step(symbol, rows[open_])
            walked[open_] += 1
        return out
