"""Elias-Fano sequences and an n-gram trie on them, queried in numpy batches.

A monotone sequence is kept as packed low bits and a unary bit vector of the high parts. Levels are
written to a file and read back through memory maps.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Sequence

import numpy as np

U = np.uint64
READ, READ_UP_TO = 1 << 17, 8  # values read at once; so many for each that is looked for, at most
#: Place of the r-th set bit of each byte.
_BYTE_SELECT = np.array([[([i for i in range(8) if b >> i & 1] + [0] * 8)[r] for r in range(8)] for b in range(256)], np.int64)


_ONES, _TOPS = U(0x0101010101010101), U(0x8080808080808080)


def _octet(bits: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word, where the byte with the set bit of that rank begins, and the set bits before it: sums of all
    eight bytes at once, in the bytes of one word."""
    sums = bits - (bits >> U(1) & U(0x5555555555555555))
    sums = (sums & U(0x3333333333333333)) + (sums >> U(2) & U(0x3333333333333333))
    sums = (sums + (sums >> U(4)) & U(0x0F0F0F0F0F0F0F0F)) * _ONES
    octet = np.bitwise_count((rank * _ONES | _TOPS) - sums & _TOPS).astype(np.int64) * 8
    return octet, (sums << U(8) >> octet.astype(U) & U(255)).astype(np.int64)


class EliasFano:
    """A monotone sequence of unsigned integers below ``universe``."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ranks: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.ranks = n, low_bits, low, high, ranks

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        low_bits = min(low_bits, 56)
        words = np.zeros(n * low_bits // 64 + 2, U)
        if low_bits:
            part = values & U((1 << low_bits) - 1)
            at = np.arange(n, dtype=U) * U(low_bits)
            word, shift = (at >> U(6)).astype(np.int64), at & U(63)
            np.bitwise_or.at(words, word, part << shift)
            over = shift + U(low_bits) > U(64)
            np.bitwise_or.at(words, word[over] + 1, part[over] >> (U(64) - shift[over]))
        places = (values >> U(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(places[-1]) // 64 + 1) * 64 if n else 64, np.uint8)
        bits[places] = 1
        high = np.packbits(bits, bitorder="little").view(U)
        ranks = np.append(0, np.cumsum(np.bitwise_count(high), dtype=np.int64)).astype(np.uint32)
        return cls(n, low_bits, words, high, ranks)

    def parts(self) -> list[np.ndarray]:
        return [self.low, self.high, self.ranks]

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ranks, i, "right") - 1
        rest = i - self.ranks[word].astype(np.int64)
        bits = self.high[word]
        octet, below = _octet(bits, rest.astype(U))
        place = word * 64 + octet + _BYTE_SELECT[(bits >> octet.astype(U) & U(255)).astype(np.int64), rest - below]
        return self._with_low(place - i, i)

    def between(self, start: int, end: int) -> np.ndarray:
        """The values at places start to end - 1, read one after another."""
        if start >= end:
            return np.zeros(0, U)
        first, last = (int(np.searchsorted(self.ranks, i, "right")) - 1 for i in (start, end - 1))
        bits = np.unpackbits(self.high[first : last + 1].view(np.uint8), bitorder="little")
        skip = start - int(self.ranks[first])
        places = np.flatnonzero(bits)[skip : skip + end - start]
        places += first * 64
        i = np.arange(start, end)
        return self._with_low(places - i, i)

    def _with_low(self, high: np.ndarray, i: np.ndarray) -> np.ndarray:
        value = high.astype(U) << U(self.low_bits)
        if self.low_bits:
            at = i.astype(U) * U(self.low_bits)
            w, shift = (at >> U(6)).astype(np.int64), at & U(63)
            part = self.low[w] >> shift
            carry = shift > 0
            part = np.where(carry, part | (self.low[w + 1] << ((U(64) - shift) & U(63))), part)
            value |= part & U((1 << self.low_bits) - 1)
        return value

    def successor(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The first place in [lo, hi) whose value is at least x (hi if there is none)."""
        lo, hi = lo.copy(), hi.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self[mid] < x[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        return lo


    def located(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of a sequence without repeats the first place in [lo, hi) whose value is at least x (hi if there is none), and
        whether it is x. Many values in order are met with the sequence as it is read; others are searched for one by one."""
        if len(x) * READ_UP_TO >= self.n and (x[1:] >= x[:-1]).all():
            place, same, done = hi.copy(), np.zeros(len(x), bool), 0
            start, end = (int(lo.min()), int(hi.max())) if len(x) else (0, 0)
            for a in range(start, end, READ):
                values = self.between(a, min(a + READ, end))
                until = int(np.searchsorted(x, values[-1], "right"))
                at = np.searchsorted(values, x[done:until])
                place[done:until] = a + at
                same[done:until] = values[at] == x[done:until]
                done = until
            same &= (place >= lo) & (place < hi)
            return np.clip(place, lo, hi), same
        place = self.successor(x, lo, hi)
        same = place < hi
        same[same] = self[place[same]] == x[same]
        return place, same


SUCCESSOR_BITS = 40  # of a successor inside its context
_SCALE, _FLOOR = 1024, 40


def quantise(p: np.ndarray) -> np.ndarray:
    """16-bit codes of probabilities, even in the logarithm (about 0.07 % apart); 0 stands for 0."""
    out = np.zeros(len(p), np.uint16)
    some = p > 0
    out[some] = np.clip(np.rint((np.log2(p[some]) + _FLOOR) * _SCALE), 0, _FLOOR * _SCALE) + 1
    return out


def restored(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, np.exp2((codes.astype(float) - 1) / _SCALE - _FLOOR), 0.0)


class Trie:
    """Contexts, monotone pointers to their successors, the successors relative to their context, and
    the quantised probability of each; and so on for each deeper level, whose contexts are the successors above."""

    def __init__(self, contexts: np.ndarray, successors: np.ndarray, codes: np.ndarray, deeper: Sequence[tuple] = ()) -> None:
        """Sorted by context, then successor (below 2**SUCCESSOR_BITS), without repeats. deeper: for each further
        level the places of its contexts in the level above, successors and codes, in the same order."""
        own, nth = np.unique(contexts, return_inverse=True)
        self._file = tempfile.NamedTemporaryFile(prefix="trie-")
        self._size = 0
        self.contexts = self._mapped(EliasFano.of(own, 1 << 64))
        self.levels = []
        above = len(own)
        for parents, last, code in ((nth, successors, codes), *deeper):
            pointers = np.append(0, np.cumsum(np.bincount(parents, minlength=above)))
            self.levels.append(
                (
                    self._mapped(EliasFano.of(pointers.astype(U), len(last) + 1)),
                    self._mapped(
                        EliasFano.of(parents.astype(U) << U(SUCCESSOR_BITS) | last, max(1, above) << SUCCESSOR_BITS)
                    ),
                    self._written(code),
                )
            )
            above = len(last)

    def _written(self, part: np.ndarray) -> np.ndarray:
        """``part`` as a memory map of the trie's file."""
        if not part.size:
            return part
        at = self._size
        self._file.write(part.tobytes() + bytes(-part.nbytes % 8))
        self._file.flush()
        self._size += part.nbytes + -part.nbytes % 8
        os.posix_fadvise(self._file.fileno(), 0, 0, os.POSIX_FADV_RANDOM)
        return np.asarray(np.memmap(self._file.name, part.dtype, "r", at, part.shape))

    def _mapped(self, level: EliasFano) -> EliasFano:
        return EliasFano(level.n, level.low_bits, *map(self._written, level.parts()))

    def first(self, contexts: np.ndarray) -> np.ndarray:
        """The place of each context; -1 where it is not in the trie."""
        n = self.contexts.n
        if not n or not len(contexts):
            return np.full(len(contexts), -1, np.int64)
        at, same = self.contexts.located(contexts, np.zeros(len(contexts), np.int64), np.full(len(contexts), n, np.int64))
        return np.where(same, at, -1)

    def after(self, level: int, rows: np.ndarray, successors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place in its level (from 0, -1 if missing) and the code (0 if missing) of each successor of the
        entry at ``rows`` (-1: missing) in the level above."""
        pointers, inside, codes = self.levels[level]
        out, code = np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.uint16)
        at = np.flatnonzero(rows >= 0)
        if not len(at) or not inside.n:
            return out, code
        row = rows[at]
        if len(row) * READ_UP_TO >= pointers.n:
            ends = pointers.between(0, pointers.n).view(np.int64)
            lo, hi = ends[row], ends[row + 1]
        else:
            lo, hi = pointers[row].astype(np.int64), pointers[row + 1].astype(np.int64)
        x = row.astype(U) << U(SUCCESSOR_BITS) | successors[at]
        place, hit = inside.located(x, lo, hi)
        out[at[hit]] = place[hit]
        code[at[hit]] = codes[place[hit]]
        return out, code

    def find(self, contexts: np.ndarray, successors: np.ndarray) -> np.ndarray:
        """The code of each pair; 0 where it is not in the trie."""
        asked, which = np.unique(contexts, return_inverse=True)
        return self.after(0, self.first(asked)[which], successors)[1]

    def close(self) -> None:
        self._file.close()
