"""Elias-Fano sequences in one flat buffer of 64-bit words, read in place from a memory map; all queries take arrays."""

from __future__ import annotations

import numpy as np

_SELECT = np.zeros((256, 8), np.uint8)
for _b in range(256):
    _at = [i for i in range(8) if _b >> i & 1]
    _SELECT[_b, : len(_at)] = _at
_SELECT = _SELECT.ravel()


def packed(values: np.ndarray) -> np.ndarray:
    """Words of a non-decreasing sequence of unsigned integers below 2**63, held as distances from the first."""
    values = values.astype(np.uint64)
    n = len(values)
    base = values[0] if n else np.uint64(0)
    values = values - base
    top = int(values[-1]) if n else 0
    low_bits = max(0, (top // n).bit_length() - 1) if n else 0
    high = (values >> np.uint64(low_bits)).astype(np.int64)
    size = (int(high[-1]) + n + 2 if n else 1) // 64 + 1
    bits = np.zeros(size, np.uint64)
    where = high + np.arange(n)
    np.bitwise_or.at(bits, where >> 6, np.uint64(1) << (where & 63).astype(np.uint64))
    ones = np.zeros(size + 1, np.int64)
    np.cumsum(np.bitwise_count(bits), out=ones[1:])
    zeros = np.arange(size + 1) * 64 - ones
    low = np.zeros(n * low_bits // 64 + 2, np.uint64)
    if low_bits:
        part = values & np.uint64((1 << low_bits) - 1)
        at = np.arange(n) * low_bits
        shift = (at & 63).astype(np.uint64)
        np.bitwise_or.at(low, at >> 6, part << shift)
        over = (at & 63) + low_bits > 64
        np.bitwise_or.at(low, (at[over] >> 6) + 1, part[over] >> (np.uint64(64) - shift[over]))
    head = np.array([n, low_bits, size, len(low), base], np.uint64)
    return np.concatenate([head, bits, ones.view(np.uint64), zeros.view(np.uint64), low])


#: Buckets of at most so many elements are read through, longer ones are halved first.
NEAR = 4
_U1, _U2, _U3, _U4, _U8, _TOP, _BYTE = (np.uint64(i) for i in (1, 2, 3, 4, 8, 63, 255))
_M1, _M2, _M4, _EACH, _TOPS = (np.uint64(int(b * 8, 16)) for b in ("55", "33", "0f", "01", "80"))


class Sequence:
    """A packed sequence at the start of `words`; `end` is the first word after it."""

    def __init__(self, words: np.ndarray):
        self.n, self.low_bits, size, low, _ = (int(x) for x in words[:5])
        self.base, at = words[4], 5
        self.bits = words[at : at + size]
        self.ones = words[at + size : at + 2 * size + 1].view(np.int64)
        self.zeros = words[at + 2 * size + 1 : at + 3 * size + 2].view(np.int64)
        self.low = words[at + 3 * size + 2 : at + 3 * size + 2 + low]
        self.end = at + 3 * size + 2 + low
        held = int(np.searchsorted(self.ones, self.n)) - 1 if self.n else 0
        #: The high bits of the last element.
        self.most = held * 64 + int(self.bits[held]).bit_length() - self.n

    def _select(self, k: np.ndarray, counts: np.ndarray, flip: bool) -> np.ndarray:
        """Places of the k-th ones, or zeros: byte sums of a word are found side by side within the word."""
        word = np.searchsorted(counts, k, side="right") - 1
        rest = (k - counts.take(word)).astype(np.uint64)
        x = self.bits.take(word)
        if flip:
            x = ~x
        with np.errstate(over="ignore"):
            s = x - ((x >> _U1) & _M1)
            s = (s & _M2) + ((s >> _U2) & _M2)
            sums = ((s + (s >> _U4)) & _M4) * _EACH  # byte i: ones in bytes 0 to i
            octet = np.bitwise_count(((rest * _EACH | _TOPS) - sums) & _TOPS).astype(np.uint64)
            before = ((sums << _U8) >> (octet << _U3)) & _BYTE
            found = (x >> (octet << _U3)) & _BYTE
        return word * 64 + (octet << _U3).astype(np.int64) + _SELECT.take(((found << _U3) + rest - before).astype(np.intp))

    def _run(self, at: np.ndarray, flip: bool) -> np.ndarray:
        """Bits from each place up to the next one, or zero; 64 where it stands in a later word."""
        x = self.bits.take(at >> 6)
        if flip:
            x = ~x
        x = x >> (at & 63).astype(np.uint64)
        with np.errstate(over="ignore"):
            return np.bitwise_count((x & (~x + _U1)) - _U1).astype(np.int64)

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.low_bits
        shift = (at & 63).astype(np.uint64)
        at >>= 6
        first = self.low.take(at) >> shift
        second = (self.low.take(at + 1) << _U1) << (_TOP - shift)  # nothing of it where the shift is 0
        return (first | second) & np.uint64((1 << self.low_bits) - 1)

    def _joined(self, high: np.ndarray, i: np.ndarray) -> np.ndarray:
        return ((high.astype(np.uint64) << np.uint64(self.low_bits)) | self._lows(i)) + self.base

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return self._joined(self._select(i, self.ones, False) - i, i)

    def pairs(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The elements at i and those after them, which are there."""
        at = self._select(i, self.ones, False)
        run = self._run(at + 1, False)
        after = at + 1 + run
        far = np.flatnonzero(run == 64)
        after[far] = self._select(i[far] + 1, self.ones, False)
        return self._joined(at - i, i), self._joined(after - i - 1, i + 1)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of the first element that equals each x, or -1: a successor search inside x's bucket of high bits."""
        out = np.full(len(x), -1, np.int64)
        if not self.n:
            return out
        with np.errstate(over="ignore"):
            far = x - self.base
        ask = np.flatnonzero((x >= self.base) & (far >> np.uint64(self.low_bits) <= np.uint64(self.most)))
        high = (far[ask] >> np.uint64(self.low_bits)).astype(np.int64)
        place = self._select(np.maximum(high - 1, 0), self.zeros, True) + 1
        place[high == 0] = 0
        lo = place - high
        run = self._run(place, True)
        stop = lo + run
        long = np.flatnonzero(run == 64)
        stop[long] = self._select(high[long], self.zeros, True) - high[long]
        open_ = np.flatnonzero(lo < stop)
        ask, lo, stop = ask[open_], lo[open_], stop[open_]
        if not self.low_bits:
            out[ask] = lo
            return out
        want = far[ask] & np.uint64((1 << self.low_bits) - 1)
        hi = stop.copy()
        while len(wide := np.flatnonzero(hi - lo > NEAR)):
            middle = (lo[wide] + hi[wide]) >> 1
            less = self._lows(middle) < want[wide]
            lo[wide[less]] = middle[less] + 1
            hi[wide[~less]] = middle[~less]
        stop = np.minimum(hi + 1, stop)  # the one that was looked at last may be it
        while len(ask):
            low = self._lows(lo)
            there = low == want
            out[ask[there]] = lo[there]
            lo += 1
            go = np.flatnonzero((low < want) & (lo < stop))
            ask, lo, stop, want = ask[go], lo[go], stop[go], want[go]
        return out
