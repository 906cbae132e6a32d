"""Elias-Fano sequences over memory-mapped words, read many places at a time."""

from __future__ import annotations

import numpy as np

U = np.uint64
_ONE, _SIX, _LOW6 = U(1), U(6), U(63)


_BYTES, _TOPS = U(0x0101010101010101), U(0x8080808080808080)
#: Place of the k-th set bit of a byte, by byte and k.
_IN_BYTE = np.array([([p for p in range(8) if b >> p & 1] + [0] * 8)[:8] for b in range(256)], np.int64).ravel()


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th set bit (from 0) of each word."""
    k = k.astype(U)
    x = word - (word >> U(1) & U(0x5555555555555555))
    x = (x & U(0x3333333333333333)) + (x >> U(2) & U(0x3333333333333333))
    x += x >> U(4)
    x &= U(0x0F0F0F0F0F0F0F0F)
    x *= _BYTES  # set bits up to and with each byte
    byte = np.bitwise_count((k * _BYTES | _TOPS) - x & _TOPS).astype(U) << U(3)
    k -= (x << U(8) >> byte) & U(255)
    return byte.astype(np.int64) + _IN_BYTE[((word >> byte & U(255)) << U(3) | k).astype(np.int64)]


class Monotone:
    """A non-decreasing sequence: low bits packed, high parts in unary with directories of ones and zeros."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray):
        self.n, self.bits, self.low, self.high, self.ones, self.zeros = n, bits, low, high, ones, zeros

    @classmethod
    def of(cls, values: np.ndarray) -> Monotone:
        v = np.asarray(values).astype(U)
        n = len(v)
        top = int(v[-1]) if n else 0
        bits = max(0, (top // max(1, n)).bit_length() - 1)
        low = np.zeros(n * bits // 64 + 2, U)
        if bits:
            at = np.arange(n, dtype=np.int64) * bits
            word, shift = at >> 6, (at & 63).astype(U)
            part = v & U((1 << bits) - 1)
            np.bitwise_or.at(low, word, part << shift)
            over = (shift.astype(np.int64) + bits) > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (U(64) - shift[over]))
        place = (v >> U(bits)).astype(np.int64) + np.arange(n)
        length = (top >> bits) + n + 1
        high = np.zeros(length // 64 + 1, U)
        np.bitwise_or.at(high, place >> 6, _ONE << (place & 63).astype(U))
        count = np.bitwise_count(high).astype(np.int64)
        ones = np.concatenate([[0], np.cumsum(count)])
        return cls(n, bits, low, high, ones, np.arange(len(ones)) * 64 - ones)

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.bits], np.int64), self.low, self.high, self.ones, self.zeros]

    @classmethod
    def from_parts(cls, parts: list[np.ndarray]) -> Monotone:
        head, *rest = parts
        return cls(int(head[0]), int(head[1]), *rest)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), U)
        at = i * self.bits
        word, shift = at >> 6, (at & 63).astype(U)
        value = self.low[word] >> shift
        over = shift.astype(np.int64) + self.bits > 64
        if over.any():
            value[over] |= self.low[word[over] + 1] << (U(64) - shift[over])
        return value & U((1 << self.bits) - 1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i, "right") - 1
        place = (word << 6) + _select_in_word(self.high[word], i - self.ones[word])
        return (place - i) << self.bits | self._low(i).astype(np.int64)

    def _before(self, part: np.ndarray) -> np.ndarray:
        """How many elements have a lesser high part."""
        k = np.clip(part - 1, 0, self.zeros[-1] - 1)
        word = np.searchsorted(self.zeros, k, "right") - 1
        zero = (word << 6) + _select_in_word(~self.high[word], k - self.zeros[word])
        return np.minimum(np.where(part > 0, zero - k, 0), self.n)

    def successor(self, x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The first place in [begin, end) whose value is at least x, or end."""
        part = x >> self.bits
        place = np.clip(self._before(part), begin, end)
        last = np.clip(self._before(part + 1), begin, end)  # of those with x's high part
        want = (x & ((1 << self.bits) - 1)).astype(U)
        todo = np.flatnonzero(place < last)
        while len(todo):
            todo = todo[self._low(place[todo]) < want[todo]]
            place[todo] += 1
            todo = todo[place[todo] < last[todo]]
        return place

    def find(self, x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Where in [begin, end) the value x stands, or -1. No element before ``begin`` is above x.

        The successor search for values that may be absent: elements with x's
        high part stand in a row after one zero of the upper bits.
        """
        part = x >> self.bits
        place = np.maximum(self._before(part), begin)
        want = (x & ((1 << self.bits) - 1)).astype(U)
        out = np.full(len(x), -1, np.int64)
        todo = np.flatnonzero(place < end)
        at = place[todo]
        for _ in range(4):  # most rows are short
            if not len(todo):
                return out
            bit = at + part[todo]
            word = np.minimum(bit >> 6, len(self.high) - 1)
            inside = (bit & 63).astype(U)
            here = self.high[word] >> inside & _ONE == 1
            low = self._low(at)
            hit = np.flatnonzero(here & (low == want[todo]))
            if len(hit):
                # it is the element's own bit if as many stand before it
                w = word[hit]
                before = self.ones[w] + np.bitwise_count(self.high[w] & ((_ONE << inside[hit]) - _ONE))
                own = hit[before == at[hit]]
                out[todo[own]] = at[own]
            on = here & (low < want[todo])
            todo, at = todo[on], at[on] + 1
            more = at < end[todo]
            todo, at = todo[more], at[more]
        last = np.minimum(self._before(part[todo] + 1), end[todo])
        below, above = at.copy(), last.copy()
        while (open_ := np.flatnonzero(below < above)).size:
            middle = (below[open_] + above[open_]) >> 1
            less = self._low(middle) < want[todo[open_]]
            below[open_[less]] = middle[less] + 1
            above[open_[~less]] = middle[~less]
        some = np.flatnonzero(below < last)
        hit = some[self._low(below[some]) == want[todo[some]]]
        out[todo[hit]] = below[hit]
        return out
