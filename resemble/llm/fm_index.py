"""FM-index over a sequence of symbols: suffix order, wavelet-matrix ranks, backward search, sampled positions.

The sequence is a list of runs.  Each run ends with a separator of its own, so
no suffix comparison passes the end of a run and the longest run bounds the
rounds of the suffix sort.
"""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; ``symbols`` > 0 in runs, 0 after each run (every 0 counts as distinct)."""
    n = len(symbols)
    zeros = symbols == 0
    n_zero = int(zeros.sum())
    rank = symbols.astype(np.int64) + n_zero
    rank[zeros] = np.arange(n_zero)
    width = 1
    while True:
        after = np.zeros(n, np.int64)
        after[:n - width] = rank[width:] + 1
        order = np.lexsort((after, rank))
        r, a = rank[order], after[order]
        new = np.ones(n, np.int64)
        new[1:] = (r[1:] != r[:-1]) | (a[1:] != a[:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        if rank[order[-1]] == n - 1:
            return order
        width *= 2


class WaveletMatrix:
    """Ranks of symbols by one bit vector per level, most significant bit first."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.levels = []
        cur = seq
        for level in range(bits - 1, -1, -1):
            bit = ((cur >> level) & 1).astype(bool)
            ones = np.concatenate([[0], np.cumsum(bit)])
            n_zero = len(cur) - int(ones[-1])
            self.levels.append((level, ones, n_zero))
            cur = np.concatenate([cur[~bit], cur[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol[i]`` in the first ``at[i]`` places."""
        lo, hi = np.zeros_like(at), at
        for level, ones, n_zero in self.levels:
            bit = ((symbol >> level) & 1).astype(bool)
            lo = np.where(bit, n_zero + ones[lo], lo - ones[lo])
            hi = np.where(bit, n_zero + ones[hi], hi - ones[hi])
        return hi - lo


class FmIndex:
    """Backward search for many patterns at once over one shard's runs."""

    def __init__(self, symbols: np.ndarray, sample: int = 8):
        self.n = len(symbols)
        order = suffix_order(symbols)
        before = symbols[order - 1]  # the separator that ends the sequence wraps to the front
        self.bits = max(int(symbols.max()).bit_length(), 1)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=1 << self.bits))])
        self.before = before
        self.ranks = WaveletMatrix(before, self.bits)
        # sampled: every ``sample``-th position, and those a separator precedes, where no step leads further
        self.sampled = (order % sample == 0) | (before == 0)
        self.position = np.where(self.sampled, order, -1)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(pattern, low, high)`` of the patterns that occur; row i of ``patterns`` is right-aligned, 0 is a gap.

        A pattern with a symbol that the sequence lacks must carry a symbol above the largest one.
        """
        which = np.arange(len(patterns))
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for step in range(1, patterns.shape[1] + 1):
            sym = patterns[which, -step]
            go = step <= lengths[which]
            known = go & (sym < (1 << self.bits))
            c = np.where(known, sym, 0)
            new_low = self.first[c] + self.ranks.rank(c, low)
            new_high = self.first[c] + self.ranks.rank(c, high)
            low, high = np.where(go, new_low, low), np.where(go, new_high, high)
            alive = (high > low) & (known | ~go)
            which, low, high = which[alive], low[alive], high[alive]
            if not len(which):
                break
        return which, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffix rows: walk back to a sampled row, counting the steps."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        open_ = np.flatnonzero(~self.sampled[at])
        while len(open_):
            c = self.before[at[open_]]
            at[open_] = self.first[c] + self.ranks.rank(c, at[open_])
            steps[open_] += 1
            open_ = open_[~self.sampled[at[open_]]]
        return self.position[at] + steps
