"""FM-index over integer symbols, with a wavelet matrix for ranks and sampled suffix positions.

Symbol ``SEPARATOR`` ends a stretch: it is in no pattern, and equal separators are ordered by
position, so that suffixes never need comparing beyond their first separator.
"""

from __future__ import annotations

import numpy as np

SEPARATOR = 1  # symbols of patterns start at 2


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of ``s`` (its last symbol is a separator) by prefix doubling of open groups."""
    n = len(s)
    bits = max(1, int(s.max()).bit_length())
    key, closed, h = s.astype(np.int64), s == SEPARATOR, 1
    while bits * 2 * h <= 62:
        later = np.zeros(n, np.int64)
        later[:-h] = key[h:]
        later[closed] = 0
        ends = np.ones(n, bool)
        ends[:-h] = closed[h:]
        key, closed, h = (key << (bits * h)) | later, closed | ends, 2 * h
    sa = np.argsort(key, kind="stable")
    head = np.ones(n, bool)
    head[1:] = (key[sa][1:] != key[sa][:-1]) | closed[sa][1:]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    while True:
        single = head.copy()
        single[:-1] &= head[1:]
        at = np.flatnonzero(~single)
        if not len(at):
            return sa
        some = sa[at]
        key = rank[some] * (n + 1) + rank[some + h]
        order = np.argsort(key, kind="stable")
        sa[at], key = some[order], key[order]
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        head[at] = new
        rank[sa[at]] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        h *= 2


class WaveletMatrix:
    """Access and rank on a sequence of integers, one bit vector a level, packed with block counts."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.zeros, self.words, self.counts = bits, [], [], []
        for level in range(bits - 1, -1, -1):
            bit = ((values >> level) & 1).astype(bool)
            padded = np.zeros((len(bit) // 64 + 1) * 64, bool)
            padded[: len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            counts = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=counts[1:])
            self.words.append(words)
            self.counts.append(counts)
            self.zeros.append(len(bit) - int(counts[-1]))
            values = np.concatenate([values[~bit], values[bit]])

    def _ones(self, k: int, i: np.ndarray) -> np.ndarray:
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[k][i >> 6] + np.bitwise_count(self.words[k][i >> 6] & low)

    def rank(self, symbol: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """Occurrences of ``symbol`` before each place."""
        at = [np.zeros_like(symbol), *places]
        for k in range(self.bits):
            one = (symbol >> (self.bits - 1 - k)) & 1 == 1
            for j, i in enumerate(at):
                ones = self._ones(k, i)
                at[j] = np.where(one, self.zeros[k] + ones, i - ones)
        return [i - at[0] for i in at[1:]]

    def access(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for k in range(self.bits):
            bit = (self.words[k][i >> 6] >> (i & 63).astype(np.uint64)).astype(np.int64) & 1
            ones = self._ones(k, i)
            out = out * 2 + bit
            i = np.where(bit == 1, self.zeros[k] + ones, i - ones)
        return out


class FMIndex:
    def __init__(self, s: np.ndarray, sigma: int, sample: int = 8):
        """Index of ``s`` (symbols 1 .. sigma - 1, ending in a separator)."""
        sa = suffix_array(s)
        before = s[sa - 1]
        self.n = len(s)
        self.first = np.zeros(sigma + 1, np.int64)
        np.cumsum(np.bincount(s, minlength=sigma), out=self.first[1:])
        self.bwt = WaveletMatrix(before.astype(np.int64), max(1, (sigma - 1).bit_length()))
        # sampled: every so many places, and wherever the walk to the left would cross a separator
        marked = (sa % sample == 0) | (before == SEPARATOR)
        self.sampled = np.flatnonzero(marked)
        self.at = sa[self.sampled]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of patterns (rows, left-aligned symbols) by backward search."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        open_ = np.arange(len(patterns))
        for step in range(int(lengths.max(initial=0))):
            open_ = open_[(lengths[open_] > step) & (low[open_] < high[open_])]
            if not len(open_):
                break
            c = patterns[open_, lengths[open_] - 1 - step]
            a, b = self.bwt.rank(c, low[open_], high[open_])
            low[open_], high[open_] = self.first[c] + a, self.first[c] + b
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by walking left to a sampled one."""
        out, steps = np.empty(len(rows), np.int64), 0
        todo, rows = np.arange(len(rows)), rows.copy()
        while len(todo):
            k = np.searchsorted(self.sampled, rows)
            done = (k < len(self.sampled)) & (self.sampled[np.minimum(k, len(self.sampled) - 1)] == rows)
            out[todo[done]] = self.at[k[done]] + steps
            todo, rows = todo[~done], rows[~done]
            if len(todo):
                c = self.bwt.access(rows)
                rows = self.first[c] + self.bwt.rank(c, rows)[0]
            steps += 1
        return out
