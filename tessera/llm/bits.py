"""Succinct sequences on numpy: bit vectors with rank, wavelet trees, Elias-Fano sequences. All queries take arrays."""

from __future__ import annotations

import numpy as np

_ONE, _63 = np.uint64(1), np.uint64(63)


class BitVector:
    """Packed bits with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        packed = np.packbits(np.asarray(bits, dtype=bool), bitorder="little")
        raw = np.zeros((self.n // 64 + 1) * 8, np.uint8)
        raw[:len(packed)] = packed
        self.words = raw.view(np.uint64)
        self._directory()

    def _directory(self):
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]])
        self.ones = int(self.before[-1] + np.bitwise_count(self.words[-1]))

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        i = np.asarray(i, np.int64)
        w = i >> 6
        below = (_ONE << (i.astype(np.uint64) & _63)) - _ONE
        return self.before[w] + np.bitwise_count(self.words[w] & below)

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        return ((self.words[i >> 6] >> (i.astype(np.uint64) & _63)) & _ONE).astype(bool)


class WaveletTree:
    """Rank and access over a sequence of symbols in [0, 2 ** levels), stored level by level.

    At each level the zeros of the whole sequence come first, so a node is an interval and needs no
    pointer.
    """

    def __init__(self, symbols: np.ndarray, levels: int):
        self.n, self.levels, self.bits, self.zeros = len(symbols), levels, [], []
        s = np.asarray(symbols)
        for lev in range(levels - 1, -1, -1):
            b = ((s >> lev) & 1).astype(bool)
            self.bits.append(BitVector(b))
            self.zeros.append(int(len(b) - np.count_nonzero(b)))
            s = np.concatenate([s[~b], s[b]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol ``c`` stands before position ``i`` (element by element)."""
        lo, hi = np.zeros(len(c), np.int64), np.asarray(i, np.int64)
        for k, (bv, z) in enumerate(zip(self.bits, self.zeros)):
            one = ((c >> (self.levels - 1 - k)) & 1).astype(bool)
            rl, rh = bv.rank1(lo), bv.rank1(hi)
            lo, hi = np.where(one, z + rl, lo - rl), np.where(one, z + rh, hi - rh)
        return hi - lo

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol at each position and how often it stands before it."""
        lo, at = np.zeros(len(i), np.int64), np.asarray(i, np.int64)
        sym = np.zeros(len(i), np.int64)
        for bv, z in zip(self.bits, self.zeros):
            one = bv.get(at)
            sym = sym * 2 + one
            rl, ra = bv.rank1(lo), bv.rank1(at)
            lo, at = np.where(one, z + rl, lo - rl), np.where(one, z + ra, at - ra)
        return sym, at - lo


class EliasFano:
    """A non-decreasing sequence: low bits packed, high parts as unary gaps, with a bucket directory for searches."""

    def __init__(self, values: np.ndarray):
        v = np.asarray(values, np.int64)
        self.n = len(v)
        self.low = max(0, (int(v[-1]) // self.n).bit_length() - 1) if self.n else 0
        high = v >> self.low
        self.buckets = int(high[-1]) + 1 if self.n else 0
        unary = np.zeros(self.buckets + self.n, bool)
        unary[high + np.arange(self.n)] = True
        self.unary = BitVector(unary)
        self.lows = self._packed((v & ((1 << self.low) - 1)).astype(np.uint64))
        self._starts = None

    def _packed(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n * self.low // 64 + 2, np.uint64)
        if self.low and self.n:
            at = np.arange(self.n, dtype=np.int64) * self.low
            w, s = at >> 6, (at & 63).astype(np.uint64)
            for word, part in ((w, x << s), (w + 1, (x >> (_63 - s)) >> _ONE)):     # bits do not overlap, so sums are unions
                first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
                out[word[first]] += np.add.reduceat(part, first)
        return out

    @property
    def nbytes(self) -> int:
        """Bytes of the sequence itself (without the search directory)."""
        return self.lows.nbytes + self.unary.words.nbytes

    def _low(self, i: np.ndarray) -> np.ndarray:
        at = i * self.low
        w, s = at >> 6, (at & 63).astype(np.uint64)
        # a value may run over into the next word; shifting by 64 is undefined, so shift twice
        v = (self.lows[w] >> s) | ((self.lows[w + 1] << (_63 - s)) << _ONE)
        return (v & np.uint64((1 << self.low) - 1)).astype(np.int64)

    @property
    def starts(self) -> np.ndarray:
        """Directory: index of the first value of each high part (read off the zeros of the unary part)."""
        if self._starts is None:
            bits = np.unpackbits(self.unary.words.view(np.uint8), bitorder="little", count=self.unary.n)
            zeros = np.flatnonzero(bits == 0)
            self._starts = np.concatenate([[0], zeros - np.arange(len(zeros))]).astype(np.int32 if self.n < 1 << 31 else np.int64)
        return self._starts

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        if not len(i):
            return i
        if len(i) > self.n // 8:                      # for many places the high parts are read off in one go
            high = np.repeat(np.arange(self.buckets), np.diff(self.starts))[i]
        else:
            high = np.searchsorted(self.starts, i, side="right") - 1
        return (high << self.low) | self._low(i)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first value >= x (n where there is none), and whether it equals x."""
        x = np.asarray(x, np.int64)
        if not self.n or not len(x):
            return np.full(len(x), self.n, np.int64), np.zeros(len(x), bool)
        h = x >> self.low
        inside = h < self.buckets
        h = np.minimum(h, self.buckets - 1)
        lo = np.where(inside, self.starts[h], self.n).astype(np.int64)
        hi = np.where(inside, self.starts[h + 1], self.n).astype(np.int64)
        end, low = hi.copy(), x & ((1 << self.low) - 1)
        todo = np.flatnonzero(lo < hi)
        while len(todo):                              # binary search within the bucket
            mid = (lo[todo] + hi[todo]) >> 1
            less = self._low(mid) < low[todo]
            lo[todo] = np.where(less, mid + 1, lo[todo])
            hi[todo] = np.where(less, hi[todo], mid)
            todo = todo[lo[todo] < hi[todo]]
        equal = lo < end
        equal[equal] = self._low(lo[equal]) == low[equal]
        return lo, equal
