"""A compressed FM-index over integer sequences, searched for many patterns at once."""

from __future__ import annotations

import numpy as np

WORD = np.uint64(63)


class BitVector:
    """Packed bits with a count per 64-bit word: 1.5 bits for each bit."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)].astype(np.int32)
        self.ones = int(self.before[-1])

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        word = i >> 6
        mask = (np.uint64(1) << (i.astype(np.uint64) & WORD)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask).astype(np.int64)


class WaveletTree:
    """Rank of any symbol in a sequence: one bit vector for each bit of a symbol."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.levels, self.zeros, self.bits = [], [], bits
        for k in range(bits - 1, -1, -1):
            bit = (sequence >> k) & 1 == 1
            self.levels.append(BitVector(bit))
            self.zeros.append(len(sequence) - self.levels[-1].ones)
            sequence = np.r_[sequence[~bit], sequence[bit]]

        # where each symbol's places begin after the last level
        self.begin = self._down(np.arange(1 << bits), np.zeros(1 << bits, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros)):
            ones = level.rank1(at)
            at = np.where((symbol >> (self.bits - 1 - k)) & 1 == 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``symbol`` before lo and before hi."""
        both = self._down(np.r_[symbol, symbol], np.r_[lo, hi]) - np.r_[self.begin[symbol], self.begin[symbol]]
        return both[: len(lo)], both[len(lo) :]


def suffix_array(sequence: np.ndarray) -> np.ndarray:
    """Suffixes of a sequence in order, by doubling; a shorter one comes first."""
    n = len(sequence)
    rank = sequence.astype(np.int64)
    step = 1
    order = np.argsort(rank, kind="stable")
    while True:
        ordered = rank[order]
        new = np.r_[0, np.cumsum(ordered[1:] != ordered[:-1])] if n else np.empty(0, np.int64)
        rank = np.empty(n, np.int64)
        rank[order] = new
        if not n or new[-1] == n - 1:
            return order
        later = np.zeros(n, np.int64)
        later[: max(0, n - step)] = rank[step:] + 1
        rank = rank * (n + 1) + later
        order = np.argsort(rank, kind="stable")
        step *= 2


class FMIndex:
    """Backward search over the runs of a shard. Runs end in a symbol 0, so no
    match crosses them; symbols are 1 .. sigma. The suffix order is needed to build
    the index only: what stays is the wavelet tree and a count for each symbol."""

    def __init__(self, sequence: np.ndarray):
        last = sequence[suffix_array(sequence) - 1]  # the first suffix is preceded by the last symbol
        self.size = len(sequence)
        self.sigma = int(sequence.max(initial=0)) + 1
        self.tree = WaveletTree(last.astype(np.int64), max(1, (self.sigma - 1).bit_length()))
        self.smaller = np.r_[0, np.cumsum(np.bincount(sequence, minlength=self.sigma))]

    def matches(self, text: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """For each place in ``text`` the matching statistic: how many symbols before
        it, up to ``most``, stand elsewhere too; and the first place of the suffix
        interval of the longest such match, which equal matches share. A search goes
        on for as long as its interval holds a second occurrence."""
        length, begin = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
        on = np.arange(len(ends))
        lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), self.size, np.int64)
        for k in range(1, most + 1):
            symbol = text[ends[on] - k]
            a, b = self.tree.rank(symbol, lo, hi)
            lo, hi = self.smaller[symbol] + a, self.smaller[symbol] + b
            several = np.flatnonzero(hi - lo > 1)
            on, lo, hi = on[several], lo[several], hi[several]
            if not len(on):
                break
            length[on], begin[on] = k, lo
        return length, begin
