"""Elias-Fano coding of monotone sequences in numpy: plain arrays (so they can be memory-mapped), with access and successor search for many arguments at once."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)
#: Each byte of a word: ones, low bits of pairs, of nibbles, top bits.
_ONES, _PAIRS, _QUADS, _NIBBLES, _TOPS = (np.uint64(x * 0x0101010101010101) for x in (0x01, 0x55, 0x33, 0x0F, 0x80))
#: Place of the r-th set bit of each byte, at 8 * byte + r.
_IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], np.int64).ravel()


def select_in_words(words: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of the r-th (from 0) set bit of each 64-bit word: the byte from running sums of the bytes' set bits, then a table."""
    with np.errstate(over="ignore"):
        sums = words - ((words >> _ONE) & _PAIRS)
        sums = (sums & _QUADS) + ((sums >> np.uint64(2)) & _QUADS)
        sums = ((sums + (sums >> np.uint64(4))) & _NIBBLES) * _ONES
        r = r.astype(np.uint64)
        shift = np.bitwise_count(((r * _ONES | _TOPS) - sums) & _TOPS).astype(np.uint64) << np.uint64(3)
        before = ((sums << np.uint64(8)) >> shift) & np.uint64(255)
        byte = (words >> shift) & np.uint64(255)
    return shift.astype(np.int64) + _IN_BYTE[((byte << np.uint64(3)) + r - before).astype(np.int64)]


class EliasFano:
    """Fields: n, low_bits, low (packed low bits), high (unary high parts), ones (set bits before each word of high); low and high are 64-bit words."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ones = n, low_bits, low, high, ones
        self.mask = np.uint64((1 << low_bits) - 1)

    @classmethod
    def build(cls, values: np.ndarray) -> "EliasFano":
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, ((top + 1) // max(n, 1)).bit_length() - 1)
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits and n:
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            part = values & np.uint64((1 << bits) - 1)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(bits) > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        size = n + (top >> bits) + 2
        unary = np.zeros(-(-size // 64) * 64, np.uint8)
        if n:
            unary[(values >> np.uint64(bits)).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(unary, bitorder="little").view(np.uint64)
        return cls(n, bits, low, high, np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)]))

    def _nth(self, k: np.ndarray, zeros: bool) -> np.ndarray:
        """Places in the unary part of the k-th set (or clear) bits."""
        if zeros:
            if not hasattr(self, "_clear"):
                self._clear = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
            before = self._clear
        else:
            before = self.ones
        word = np.searchsorted(before, k, side="right") - 1
        bits = self.high[word]
        return word * 64 + select_in_words(~bits if zeros else bits, k - before[word])

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        out = self.low[word] >> shift
        over = shift + np.uint64(self.low_bits) > 64
        out[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return out & self.mask

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at places i."""
        if not len(i):
            return np.zeros(0, np.int64)
        return ((self._nth(i, False) - i) << self.low_bits) | self._low(i).astype(np.int64)

    def _bucket(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places [lo, hi) of the values with these high parts (all within the unary part)."""
        at = np.where(part > 0, self._nth(np.maximum(part - 1, 0), True) + 1, 0)
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        # Set bits from `at` on, in the rest of its word: up to the first clear one.
        rest = ~(self.high[np.minimum(word, len(self.high) - 1)] >> bit)
        run = np.bitwise_count((rest & (~rest + _ONE)) - _ONE).astype(np.int64)
        lo = at - part
        hi = lo + run
        over = np.flatnonzero(run + bit.astype(np.int64) >= 64)
        if len(over):
            hi[over] = self._nth(part[over], True) - part[over]
        return lo, hi

    def _search(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Successor's place, and whether it equals the target."""
        part = target >> self.low_bits
        beyond = part >= len(self.high) * 64 - self.n - 1
        part = np.where(beyond, 0, part)
        lo, hi = self._bucket(part)
        end = hi.copy()
        want = target.astype(np.uint64) & self.mask
        open_ = np.flatnonzero(lo < hi)
        while len(open_):  # binary search among the values with the same high part
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < want[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        same = ~beyond & (lo < end)
        at = np.flatnonzero(same)
        same[at] = self._low(lo[at]) == want[at]
        return np.where(beyond, self.n, lo), same

    def successor(self, target: np.ndarray) -> np.ndarray:
        """For each target, the place of the first value that is not less (n if there is none)."""
        return self._search(target)[0] if len(target) else np.zeros(0, np.int64)

    def find(self, target: np.ndarray) -> np.ndarray:
        """For each target, the place of its successor if that equals it, else -1."""
        if not len(target) or not self.n:
            return np.full(len(target), -1, np.int64)
        place, same = self._search(target)
        return np.where(same, place, -1)

    def all(self) -> np.ndarray:
        return self.access(np.arange(self.n, dtype=np.int64))

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.low": self.low, f"{name}.high": self.high, f"{name}.ones": self.ones, f"{name}.n": np.array([self.n, self.low_bits])}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray], name: str) -> "EliasFano":
        n, bits = (int(x) for x in arrays[f"{name}.n"])
        return cls(n, bits, arrays[f"{name}.low"], arrays[f"{name}.high"], arrays[f"{name}.ones"])
