"""FM-index over a sequence of small integers, searched in bulk with numpy.

Symbol 0 separates the sequences and matches nothing. Ranks come from a
wavelet matrix (one bit level per binary digit of the alphabet with cumulated
zero counts); positions from suffix-array samples at every ``SAMPLE``-th
position and at the start of every sequence, so walking back to a sample never
crosses a separator.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; every separator counts as different
    (earlier is smaller), so comparisons end at it."""
    n = len(symbols)
    gaps = symbols == 0
    rank = np.where(gaps, np.cumsum(gaps) - 1, symbols.astype(np.int64) + n)
    order = np.argsort(rank, kind="stable")
    step = 1
    while n:
        new = np.concatenate([[0], np.cumsum(np.diff(rank[order]) != 0)])
        if step > 1:
            new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1 or step > n:
            break
        after = np.full(n, -1, np.int64)
        after[:n - step] = rank[step:]
        after[gaps] = -1
        key = rank * (n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        step *= 2
    return order


class FMIndex:
    def __init__(self, symbols: np.ndarray):
        self.n = n = len(symbols)
        sa = suffix_array(symbols)
        last = symbols[sa - 1] if n else symbols
        self.sigma = int(symbols.max(initial=0)) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=self.sigma))])
        self.levels = max(1, (self.sigma - 1).bit_length())
        self.zeros, self.split = [], []  # wavelet matrix: zeros before i, number of zeros
        row = last
        for level in range(self.levels - 1, -1, -1):
            ones = (row >> level) & 1
            self.zeros.append(np.concatenate([[0], np.cumsum(1 - ones)]).astype(np.int32))
            self.split.append(int(self.zeros[-1][-1]))
            row = np.concatenate([row[ones == 0], row[ones == 1]])
        self.base = self._descend(np.arange(self.sigma), np.zeros(self.sigma, np.int64))
        starts = np.zeros(n, bool)
        starts[1:] = symbols[:-1] == 0
        kept = (sa % SAMPLE == 0) | starts[sa]
        self.sampled = kept
        self.sample_rank = np.cumsum(kept) - 1
        self.samples = sa[kept]

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, (zeros, split) in enumerate(zip(self.zeros, self.split)):
            z = zeros[i]
            i = np.where((symbol >> (self.levels - 1 - k)) & 1, split + i - z, z)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the first i rows of the transform."""
        return self._descend(symbol, i) - self.base[symbol]

    def _back(self, i: np.ndarray) -> np.ndarray:
        """Row of the suffix one position earlier (access and rank in one descent)."""
        symbol, at = np.zeros(len(i), np.int64), i
        for zeros, split in zip(self.zeros, self.split):
            z = zeros[at]
            one = zeros[at + 1] == z
            symbol = symbol * 2 + one
            at = np.where(one, split + at - z, z)
        return self.first[symbol] + at - self.base[symbol]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of all patterns (right-aligned rows); returns the
        numbers of those that occur and their row intervals."""
        who = np.arange(len(patterns))
        low, high = np.zeros(len(who), np.int64), np.full(len(who), self.n, np.int64)
        for back in range(1, patterns.shape[1] + 1):
            active = lengths[who] >= back
            symbol = patterns[who, -back]
            fits = symbol < self.sigma
            c = np.where(active & fits, symbol, 0)
            new_low, new_high = self.first[c] + self.rank(c, low), self.first[c] + self.rank(c, high)
            low, high = np.where(active, new_low, low), np.where(active, new_high, high)
            alive = (low < high) & (fits | ~active)
            who, low, high = who[alive], low[alive], high[alive]
            if not len(who):
                break
        return who, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of rows: walk back to a sampled one and count the steps."""
        out, at, left, steps = np.empty(len(rows), np.int64), rows, np.arange(len(rows)), 0
        while len(left):
            hit = self.sampled[at]
            out[left[hit]] = self.samples[self.sample_rank[at[hit]]] + steps
            at, left = self._back(at[~hit]), left[~hit]
            steps += 1
        return out
