"""Elias-Fano coding of monotone sequences, read in place from a memory-mapped buffer.

A value is cut at ``l`` low bits. Low parts are packed; high parts are a bit vector
with a one per value after as many zeros as the high part. Counts of ones and
zeros before each 64-bit word make select a binary search and a step in one word.
All operations take and give whole arrays.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64


def _ored(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Words of ``size`` with values or-ed into ascending places."""
    out = np.zeros(size, dtype=_U)
    if len(at):
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        out[at[first]] = np.bitwise_or.reduceat(values, first)
    return out


def encode(values: np.ndarray, universe: int) -> bytes:
    """Bytes of a sorted uint64 sequence with values up to ``universe``."""
    values = values.astype(_U, copy=False)
    n = len(values)
    low = max(0, (int(universe) // max(1, n)).bit_length() - 1)
    low = min(low, 57)
    k = np.arange(n, dtype=np.int64)
    high = (values >> _U(low)).astype(np.int64) + k
    size = (n + (int(universe) >> low) + 1) // 64 + 1
    ones = _ored(high >> 6, _U(1) << (high & 63).astype(_U), size)
    del high
    packed = np.zeros(1, dtype=_U)
    if low and n:
        part = values & _U((1 << low) - 1)
        at, off = k * low >> 6, (k * low & 63).astype(_U)
        packed = _ored(at, part << off, (n * low >> 6) + 2)
        spill = np.flatnonzero(off + _U(low) > _U(64))
        packed[at[spill] + 1] |= part[spill] >> (_U(64) - off[spill])
    before = np.concatenate([[0], np.cumsum(np.bitwise_count(ones).astype(np.int64))])[:-1]
    zeros = np.arange(size, dtype=np.int64) * 64 - before
    head = np.array([n, low, len(packed), size, int(universe) >> low], dtype=np.int64)
    return b"".join(x.tobytes() for x in (head, packed, ones, before, zeros))


_BYTES, _TOPS = _U(0x0101010101010101), _U(0x8080808080808080)
#: Place of one number r in byte b, at 8 b + r.
_IN_BYTE = np.array(
    [([i for i in range(8) if b >> i & 1] + [0] * 8)[r] for b in range(256) for r in range(8)], dtype=_U
)


class EliasFano:
    """A view on encoded bytes at ``offset`` of a buffer; ``end`` is where they stop."""

    def __init__(self, buffer, offset: int = 0):
        head = np.frombuffer(buffer, np.int64, 5, offset)
        self.n, self.low, words, size, self.top = (int(x) for x in head)
        offset += 40
        views = []
        for count, kind in ((words, _U), (size, _U), (size, np.int64), (size, np.int64)):
            views.append(np.frombuffer(buffer, kind, count, offset))
            offset += 8 * count
        self.packed, self.ones, self.before, self.zeros = views
        self.end = offset

    @staticmethod
    def _in_word(word: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Place of one number r (from 0) in each word: the byte by prefix counts, the bit by table."""
        r = r.astype(_U)
        counts = np.bitwise_count(word.view(np.uint8)).view(_U) * _BYTES
        byte = np.bitwise_count((r * _BYTES | _TOPS) - counts & _TOPS).astype(_U)
        shift = byte << _U(3)
        before = counts << _U(8) >> shift & _U(0xFF)
        inside = (word >> shift & _U(0xFF)) << _U(3) | (r - before) & _U(7)
        return (shift + _IN_BYTE[inside]).astype(np.int64)

    def _select(self, directory: np.ndarray, words: np.ndarray, k: np.ndarray, flip: bool) -> np.ndarray:
        at = np.searchsorted(directory, k, side="right") - 1
        word = ~words[at] if flip else words[at]
        return at * 64 + self._in_word(word, k - directory[at])

    def _next_zero(self, at: np.ndarray) -> np.ndarray:
        """Place of the first zero from each place on; almost always in the same word."""
        rest = ~self.ones[at >> 6] >> (at & 63).astype(_U)
        found = at + np.bitwise_count((rest & -rest) - _U(1)).astype(np.int64)
        far = np.flatnonzero(rest == 0)
        if len(far):
            word = (at[far] >> 6) + 1
            zeros = self.zeros[word]  # zeros before the next word, so the next zero is that number
            found[far] = self._select(self.zeros, self.ones, zeros, True)
        return found

    def low_part(self, k: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(k), dtype=_U)
        at, off = k * self.low >> 6, (k * self.low & 63).astype(_U)
        word = self.packed[at] >> off | self.packed[at + 1] << _U(1) << (_U(63) - off)
        return word & _U((1 << self.low) - 1)

    def access(self, k: np.ndarray) -> np.ndarray:
        """Values at positions k."""
        high = self._select(self.before, self.ones, k, False) - k
        return high.astype(_U) << _U(self.low) | self.low_part(k)

    def find(self, x: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """Position of each value x, searched by successor within positions [first, last); -1 where absent."""
        out = np.full(len(x), -1, dtype=np.int64)
        high = (x >> _U(self.low)).astype(np.int64)
        ok = np.flatnonzero((high <= self.top) if self.n else np.zeros(len(x), dtype=bool))
        if not len(ok):
            return out
        high, want = high[ok], x[ok] & _U((1 << self.low) - 1)
        before = np.where(high > 0, self._select(self.zeros, self.ones, np.maximum(high - 1, 0), True), -1)
        lo, hi = before - high + 1, self._next_zero(before + 1) - high
        if first is not None:
            lo, hi = np.maximum(lo, first[ok]), np.minimum(hi, last[ok])
        stop = hi.copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = lo[live] + hi[live] >> 1
            less = self.low_part(mid) < want[live]
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
            live = live[lo[live] < hi[live]]
        there = np.flatnonzero(lo < stop)
        hit = there[self.low_part(lo[there]) == want[there]]
        out[ok[hit]] = lo[hit]
        return out
