"""Numpy helpers over the UTF-8 bytes of an Arrow string column. No Spark here; each function
works on one slice of one record batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_BASE_INVERSE = pow(_BASE, -1, 2**64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all values together, offsets); a null counts as an empty string."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``size`` bytes each (one row at least), so that work arrays
    stay small however large the batch is."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


#: A 64-bit symbol for each byte.
BYTE_SYMBOL = mix(np.arange(1, 257, dtype=U) * U(_BASE))

_powers = [np.ones(1, U), np.ones(1, U)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(n, base, U)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


class Spans:
    """Hashes of any spans of a symbol sequence in constant time each (prefix sums of a
    polynomial modulo 2**64, finalised with the length)."""

    def __init__(self, symbols: np.ndarray) -> None:
        n = len(symbols)
        power, self._inverse = _power_tables(n + 1)
        self._sums = np.zeros(n + 1, U)
        np.cumsum(symbols * power[:n], out=self._sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        body = (self._sums[end] - self._sums[start]) * self._inverse[start]
        return mix(body + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def words_at(data: np.ndarray) -> np.ndarray:
    """At each byte the little-endian 64-bit word that begins there (zeros past the end)."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    return np.ndarray((len(data) + 8,), "<u8", padded.data, strides=(1,)).copy()


def multikey_sort(keys: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Multikey quicksort, one key at a time: only rows still tied on all former keys are sorted
    by the next one. Returns the order and, for each key, whether a row equals the row before it
    on this and all former keys."""
    n = len(keys[0])
    order = np.argsort(keys[0], kind="quicksort")
    first = keys[0][order]
    same = np.zeros(n, bool)
    same[1:] = first[1:] == first[:-1]
    ties = [same]
    for key in keys[1:]:
        tied = same.copy()
        tied[:-1] |= same[1:]
        at = np.flatnonzero(tied)
        if len(at):
            run = np.cumsum(~same[at])
            order[at] = order[at][np.lexsort((key[order[at]], run))]
        same = same.copy()
        now = key[order]
        same[1:] &= now[1:] == now[:-1]
        ties.append(same)
    return order, ties


def place(keys: list[np.ndarray], cuts: list[np.ndarray]) -> np.ndarray:
    """The number of cuts (sorted tuples, one array for each key) below each row. Later keys are
    looked at only for rows that tie with a cut on the former ones."""
    low = np.searchsorted(cuts[0], keys[0], "left")
    high = np.searchsorted(cuts[0], keys[0], "right")
    if len(keys) > 1:
        tie = np.flatnonzero(low < high)
        first = low[tie]  # a copy: low changes below
        for v in np.unique(first):
            at = tie[first == v]
            part = slice(v, high[at[0]])
            low[at] = v + place([k[at] for k in keys[1:]], [c[part] for c in cuts[1:]])
    return low


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased, white space 0x20 and 0x09-0x0D), one text after another,
    and the number of words of each text."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, U), np.zeros(n, np.int64)
    data = _LOWER[data]
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.append(False, inside[:-1])
    after = np.append(inside[1:], False)
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    owner = np.searchsorted(offsets, start, "right") - 1
    return Spans(BYTE_SYMBOL[data])(start, end), np.bincount(owner, minlength=n)


def distinct(values: np.ndarray, kind: str = "stable") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values in order, the place among them of each value, how often each occurs). ``kind`` of sort:
    the result does not depend on it."""
    order = np.argsort(values, kind=kind)
    ordered = values[order]
    del values  # which its caller may hold no longer
    new = np.append(True, ordered[1:] != ordered[:-1]) if len(ordered) else np.zeros(0, bool)
    ordered = ordered[new]
    number = np.cumsum(new, dtype=np.int32)
    number -= 1
    which = np.empty(len(order), np.int32)
    which[order] = number
    del order, number
    first = np.flatnonzero(new)
    return ordered, which, np.diff(np.append(first, len(which)))


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the runs that begin at ``start`` and have ``size`` places, one after another."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)
