"""An FM-index over the words of a shard of documents, in numpy: suffix order, wavelet ranks, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_order(words: np.ndarray, boundary: int = 0) -> np.ndarray:
    """Starts of the suffixes in order, by prefix doubling; each boundary differs from all others and ends a suffix."""
    n = len(words)
    at_end = words == boundary
    rank = words.astype(np.int64) + n
    rank[at_end] = np.arange(at_end.sum())  # boundaries in the order of the text, below all words
    order = np.argsort(rank, kind="stable")
    step = 1
    while True:
        sorted_rank = rank[order]
        new = np.empty(n, dtype=np.int64)
        if step == 1:
            diff = np.concatenate([[0], np.diff(sorted_rank) != 0])
        else:
            follow = tail[order]
            diff = np.concatenate([[0], (np.diff(sorted_rank) != 0) | (np.diff(follow) != 0)])
        new[order] = np.cumsum(diff)
        rank = new
        if rank[order[-1]] == n - 1:
            return order
        tail = np.concatenate([rank[step:], np.full(step, -1)])[:n] + 1
        order = np.argsort(rank * (n + 1) + tail, kind="stable")
        step *= 2


class FMIndex:
    """Counts and places of word patterns. `words` are ids from 1, with 0 as a boundary that no pattern holds."""

    def __init__(self, words: np.ndarray, sample: int = 8) -> None:
        words = np.concatenate([words, [0]]).astype(np.int64)
        self.n, self.sigma = len(words), int(words.max()) + 1
        order = suffix_order(words)
        last = words[order - 1]
        counts = np.bincount(words, minlength=self.sigma)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.levels = max(1, int(self.sigma - 1).bit_length())
        self.ones, self.zeros, self.bits = [], [], []
        seq = last
        for level in range(self.levels - 1, -1, -1):
            bit = ((seq >> level) & 1).astype(np.int8)
            self.bits.append(bit)
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(int(len(seq) - bit.sum()))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        starts = np.concatenate([[True], words[:-1] == 0])
        kept = (np.arange(self.n) % sample == 0) | starts  # the first word of a document is always sampled
        self.sampled = kept[order]
        self.before = np.concatenate([[0], np.cumsum(self.sampled)])
        self.places = order[self.sampled]

    def rank(self, word: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Occurrences of each word among the last letters of the rows before each row."""
        start, row = np.zeros_like(row), row.copy()
        for level, ones, zeros in zip(range(self.levels - 1, -1, -1), self.ones, self.zeros):
            bit = (word >> level) & 1
            a, b = ones[start], ones[row]
            start = np.where(bit == 1, zeros + a, start - a)
            row = np.where(bit == 1, zeros + b, row - b)
        return row - start

    def _last(self, row: np.ndarray) -> np.ndarray:
        word, row = np.zeros_like(row), row.copy()
        for ones, zeros, bits in zip(self.ones, self.zeros, self.bits):
            bit = bits[row]
            word = word * 2 + bit
            row = np.where(bit == 1, zeros + ones[row], row - ones[row])
        return word

    def ranges(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all patterns (rows of equal length) at once: the first row and the row after the last."""
        lo, hi = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.n, dtype=np.int64)
        for k in range(patterns.shape[1] - 1, -1, -1):
            alive = np.nonzero((lo < hi) & (patterns[:, k] < self.sigma))[0]
            gone = (lo < hi) & (patterns[:, k] >= self.sigma)
            lo[gone] = hi[gone] = 0
            if not len(alive):
                break
            w = patterns[alive, k]
            lo[alive], hi[alive] = self.first[w] + self.rank(w, lo[alive]), self.first[w] + self.rank(w, hi[alive])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row, walked back to the nearest sampled one."""
        out, row, steps = np.full(len(rows), -1, dtype=np.int64), rows.copy(), np.zeros(len(rows), dtype=np.int64)
        left = np.arange(len(rows))
        while len(left):
            at = self.sampled[row[left]]
            hit = left[at]
            out[hit] = self.places[self.before[row[hit]]] + steps[hit]
            left = left[~at]
            if len(left):
                w = self._last(row[left])
                row[left] = self.first[w] + self.rank(w, row[left])
                steps[left] += 1
        return out
