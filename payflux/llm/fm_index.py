"""A compressed FM-index over sequences of whole numbers: Burrows-Wheeler transform in a wavelet matrix, searched backwards.

Bits of each level lie in 64-bit words with a count before each word, so the matrix takes about
1.5 bits a symbol and level. All operations work on arrays of queries at once. Suffixes are
sorted by their first DEPTH symbols only, which is exact for patterns that long: how many rows
lie below a pattern doesn't depend on the order of suffixes that begin alike.
"""

from __future__ import annotations

import numpy as np

DEPTH = 32


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions in the order of the DEPTH symbols that follow; sorted by 1, 2, 4, ... symbols in turn."""
    n = len(text)
    rank = text.astype(np.uint64)
    h, order = 1, None
    while h < DEPTH:
        follows = np.zeros(n, np.uint64)
        follows[: max(n - h, 0)] = rank[h:] + np.uint64(1)
        key = (rank << np.uint64(32)) | follows
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.empty(n, np.uint64)
        new[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]).astype(np.uint64)
        rank, h = new, 2 * h
    return order


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        x = symbols.astype(np.uint32)
        n = len(x)
        for level in reversed(range(self.levels)):
            bit = (x >> np.uint32(level)) & np.uint32(1)
            padded = np.zeros((n // 64 + 1) * 64, np.uint8)
            padded[:n] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            counts = np.cumsum(np.bitwise_count(words), dtype=np.int32)
            self.words.append(words)
            self.before.append(np.concatenate([[0], counts[:-1]]).astype(np.int32))
            ones = bit == 1
            self.zeros.append(n - int(counts[-1]))
            x = np.concatenate([x[~ones], x[ones]])
        self.start = self._follow(np.arange(sigma), np.zeros(sigma, np.int64))

    def _follow(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, level in enumerate(reversed(range(self.levels))):
            word, inside = at >> 6, (at & 63).astype(np.uint64)
            ones = self.before[k][word] + np.bitwise_count(self.words[k][word] & ((np.uint64(1) << inside) - np.uint64(1)))
            at = np.where((symbol >> level) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often the symbol stands before `at`."""
        return self._follow(symbol, at) - self.start[symbol]


def _highest(x: np.ndarray) -> np.ndarray:
    """Place of the highest bit of each non-zero number; in halves, which doubles hold exactly."""
    top = x >> np.uint64(32)
    big = top > 0
    return np.frexp(np.where(big, top, x).astype(np.float64))[1] - 1 + np.where(big, 32, 0)


class Boundaries:
    """Marks in a row of bits, and for each the next one on either side."""

    def __init__(self, marks: np.ndarray):
        self.n = len(marks)
        padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
        padded[: self.n] = marks
        padded[self.n] = 1  # the end
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        at = np.arange(len(self.words), dtype=np.int32)
        some = self.words != 0
        self.earlier = np.maximum.accumulate(np.where(some, at, 0)).astype(np.int32)
        self.later = np.minimum.accumulate(np.where(some, at, len(at) - 1)[::-1])[::-1].astype(np.int32)

    def up_to(self, at: np.ndarray) -> np.ndarray:
        """The last mark at or before `at`; there is one at 0."""
        word = at >> 6
        bits = self.words[word] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (63 - (at & 63)).astype(np.uint64))
        empty = bits == 0
        word = np.where(empty, self.earlier[np.maximum(word - 1, 0)], word)
        return word * 64 + _highest(np.where(empty, self.words[word], bits))

    def from_(self, at: np.ndarray) -> np.ndarray:
        """The first mark at or after `at`, or the end."""
        word = at >> 6
        bits = self.words[word] & (np.uint64(0xFFFFFFFFFFFFFFFF) << (at & 63).astype(np.uint64))
        empty = bits == 0
        word = np.where(empty, self.later[np.minimum(word + 1, len(self.words) - 1)], word)
        bits = np.where(empty, self.words[word], bits)
        return word * 64 + _highest(bits & (~bits + np.uint64(1)))


class FMIndex:
    """Beside the wavelet matrix it keeps a byte for each suffix (symbols in common with the one before), marks for
    each such depth that searches come back to, and the least owner of what occurs twice; no suffix order."""

    def __init__(self, text: np.ndarray, sigma: int, owner: np.ndarray, length: int):
        """text: symbols from 0 to sigma - 1. owner: of each position. length: of the patterns whose least owner is asked for."""
        if length >= DEPTH:
            raise ValueError(f"patterns of {length} symbols; suffixes are sorted by {DEPTH}")
        n = len(text)
        order = suffix_order(text)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.matrix = WaveletMatrix(text[order - 1], sigma)
        self.common = np.zeros(n + 1, np.uint8)
        same, padded = np.arange(1, n), np.concatenate([text, np.full(DEPTH, -1)])
        for k in range(DEPTH - 1):
            same = same[padded[order[same] + k] == padded[order[same - 1] + k]]
            if not len(same):
                break
            self.common[same] = k + 1
        self.marks: dict[int, Boundaries] = {}
        starts = np.flatnonzero(self.common[:n] < length)
        several = np.diff(np.append(starts, n)) > 1
        self.groups = starts[several].astype(np.int32)
        self.least = np.minimum.reduceat(owner[order], starts)[several] if n else owner[:0]

    def widen(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of patterns with one more symbol in front."""
        n = len(low)
        both = self.matrix.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return self.first[symbol] + both[:n], self.first[symbol] + both[n:]

    def at_depth(self, depth: int) -> Boundaries:
        if depth not in self.marks:
            self.marks[depth] = Boundaries(self.common[:-1] < depth)
        return self.marks[depth]

    def shortened(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the longest beginning of each pattern that more rows have, and its length."""
        depth = np.maximum(self.common[low], self.common[high]).astype(np.int64)
        low, high = low.copy(), high.copy()
        for d in np.unique(depth):
            at = np.flatnonzero(depth == d)
            if d:
                marks = self.at_depth(int(d))
                low[at], high[at] = marks.up_to(low[at]), marks.from_(high[at])
            else:
                low[at], high[at] = 0, len(self.common) - 1
        return low, high, depth

    def matching(self, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of the sequences of text: at each position how many symbols from there on occur in the
        index at least twice (a sequence of the index itself once), and a row of what is matched.

        One pass backwards over all sequences at once: the match is one symbol longer, or is cut at its end until it can be.
        Sequences must be shorter than DEPTH, to which suffixes are sorted.
        """
        if len(lengths) and lengths.max() >= DEPTH:
            raise ValueError(f"a sequence of {lengths.max()} symbols; suffixes are sorted by {DEPTH}")
        out, row = np.zeros(len(text), np.int32), np.zeros(len(text), np.int64)
        low, high, size = np.zeros(len(starts), np.int64), np.full(len(starts), len(self.common) - 1), np.zeros(len(starts), np.int64)
        for t in range(int(lengths.max()) if len(lengths) else 0):
            lane = np.flatnonzero(lengths > t)
            at = starts[lane] + lengths[lane] - 1 - t
            active, symbol = lane, text[at]
            while len(active):
                new_low, new_high = self.widen(low[active], high[active], symbol)
                fits = new_high - new_low > 1
                done = active[fits]
                low[done], high[done] = new_low[fits], new_high[fits]
                size[done] += 1
                more = ~fits & (size[active] > 0)
                active, symbol = active[more], symbol[more]
                low[active], high[active], size[active] = self.shortened(low[active], high[active])
            out[at], row[at] = size[lane], low[lane]
        return out, row

    def least_owner(self, row: np.ndarray, length: int) -> np.ndarray:
        """The least owner of what rows have in their first `length` symbols, where it occurs twice."""
        return self.least[np.searchsorted(self.groups, self.at_depth(length).up_to(row))]
