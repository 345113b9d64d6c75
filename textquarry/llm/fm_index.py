"""FM-index over the words of one shard: backward search through wavelet-matrix ranks, occurrences by sampled suffix positions.

The indexed sequence holds word ids of 1 and up, and 0 between segments. No phrase holds a 0, so no match crosses segments. Zeros
count as different from each other while suffixes are sorted (in the order of their positions), so that all suffixes differ and
sorting ends at the longest repeat inside a segment.
"""

from __future__ import annotations

import numpy as np


def suffix_order(tokens: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in sorted order, by prefix doubling. Only suffixes that still tie are sorted again."""
    n = len(tokens)
    zeros = tokens == 0
    rank = np.where(zeros, np.cumsum(zeros), tokens.astype(np.int64) + int(zeros.sum()))
    order = np.argsort(rank, kind="stable")
    rank = _ranks(rank[order], order)
    step = 1
    while True:
        ordered = rank[order]
        tied = np.zeros(n, bool)
        same = ordered[1:] == ordered[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        if not len(at):
            return order
        # A tie's members hold the places from their rank on; sort them there by what follows after `step` words.
        who = order[at]
        follow = np.where(who + step < n, rank[np.minimum(who + step, n - 1)] + 1, 0)
        inner = np.argsort(rank[who] * np.int64(n + 2) + follow, kind="stable")
        who, follow = who[inner], follow[inner]
        order[at] = who
        head = rank[who]
        fresh = np.ones(len(who), bool)
        fresh[1:] = (head[1:] != head[:-1]) | (follow[1:] != follow[:-1])
        first = np.flatnonzero(fresh)
        new = at[first][np.cumsum(fresh) - 1]
        rank = rank.copy()
        rank[who] = new
        step *= 2


def _ranks(ordered: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each position the first place in the order among equals."""
    fresh = np.ones(len(ordered), bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(len(ordered), np.int64)
    rank[order] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1] if len(ordered) else 0
    return rank


class WaveletMatrix:
    """Ranks of a symbol in any prefix, a bit level at a time; every level keeps running counts of its ones."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits = bits
        self.ones = []
        self.zeros = []
        level = symbols
        for b in range(bits - 1, -1, -1):
            bit = (level >> b) & 1
            count = np.zeros(len(level) + 1, np.int32)
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
            self.zeros.append(len(level) - int(count[-1]))
            level = np.concatenate((level[bit == 0], level[bit == 1]))

    def rank(self, symbol: np.ndarray, upto: np.ndarray, start: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place. ``start``: ``first_place(symbol)``."""
        at = upto
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            ones = self.ones[level][at]
            at = np.where((symbol >> b) & 1, self.zeros[level] + ones, at - ones)
        return at - start

    def first_place(self, symbol: np.ndarray) -> np.ndarray:
        at = np.zeros(len(symbol), np.int64)
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            ones = self.ones[level][at]
            at = np.where((symbol >> b) & 1, self.zeros[level] + ones, at - ones)
        return at


class FMIndex:
    def __init__(self, tokens: np.ndarray, n_symbols: int, sample: int = 8):
        """``tokens``: ids below ``n_symbols``, 0 between segments and at the end. Every ``sample``-th position, and each that
        follows a 0, keeps its suffix position, so a walk back ends within a segment after fewer than ``sample`` steps."""
        n = len(tokens)
        self.order = suffix_order(tokens)
        before = np.where(self.order > 0, tokens[self.order - 1], 0)
        self.last = before
        self.matrix = WaveletMatrix(before, max(1, int(n_symbols).bit_length()))
        self.smaller = np.zeros(n_symbols + 1, np.int64)
        np.cumsum(np.bincount(tokens, minlength=n_symbols), out=self.smaller[1:])
        start = np.arange(n) % sample == 0
        start[0:1] = True
        start[1:] |= tokens[:-1] == 0
        self.sampled = start[self.order]
        self.position = np.where(self.sampled, self.order, -1)
        del self.order  # from here on positions come from the samples alone
        self.places = self.matrix.first_place(np.arange(n_symbols, dtype=np.int64))

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows ``[low, high)`` of the suffixes that begin with each phrase. ``phrases``: ids, right-aligned in their rows."""
        width = phrases.shape[1] if len(phrases) else 0
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), len(self.last), np.int64)
        for back in range(width):
            live = np.flatnonzero((lengths > back) & (low < high))
            if not len(live):
                break
            symbol = phrases[live, width - 1 - back]
            start = self.places[symbol]
            low[live] = self.smaller[symbol] + self.matrix.rank(symbol, low[live], start)
            high[live] = self.smaller[symbol] + self.matrix.rank(symbol, high[live], start)
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back through the text until a sampled one."""
        at, steps, found = rows.copy(), np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            here = at[open_]
            done = self.sampled[here]
            found[open_[done]] = self.position[here[done]] + steps[open_[done]]
            open_ = open_[~done]
            here = at[open_]
            symbol = self.last[here]
            at[open_] = self.smaller[symbol] + self.matrix.rank(symbol, here, self.places[symbol])
            steps[open_] += 1
        return found
