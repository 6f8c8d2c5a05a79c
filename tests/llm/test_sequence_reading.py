"""Monotone sequences read one after another, and values met in order, against plain numpy."""

import numpy as np
import pytest

from trailmark.llm import elias_fano
from trailmark.llm.elias_fano import EliasFano, Trie, U


@pytest.mark.parametrize("universe", [40, 5000, 1 << 40, (1 << 64) - 1])
@pytest.mark.parametrize("read", [7, 1 << 17])
def test_reading_and_locating(monkeypatch, universe, read):
    monkeypatch.setattr(elias_fano, "READ", read)
    rng = np.random.default_rng(6)
    for n in (0, 1, 2, 65, 700):
        values = np.unique(rng.integers(0, universe, n, dtype=U))
        n = len(values)
        own = EliasFano.of(values, universe)
        for a, b in ((0, n), (0, 0), (n // 3, n // 2), (n - n // 4, n)):
            assert np.array_equal(own.between(a, b), values[a:b])
        x = np.sort(np.concatenate([values[::2], rng.integers(0, universe, 90, dtype=U)]))
        lo = np.sort(rng.integers(0, n + 1, len(x)))
        hi = np.minimum(lo + rng.integers(0, 60, len(x)), n)
        for order in (np.arange(len(x)), rng.permutation(len(x))):
            place, same = own.located(x[order], lo[order], hi[order])
            expected = np.clip(np.searchsorted(values, x), lo, hi)
            found = (expected < hi) & (np.append(values, [0])[expected] == x)
            assert np.array_equal(place, expected[order]) and np.array_equal(same, found[order])


def test_many_asked_grams_read_each_level_once(monkeypatch):
    """Before, each was searched for by itself: some twenty steps over all."""
    contexts = np.repeat(np.arange(0, 4000, 2, dtype=U), 10)
    successors = np.tile(np.arange(10, dtype=U) * U(3), 2000)
    trie = Trie(contexts, successors, np.arange(1, 20_001, dtype=np.uint16))
    looked = []
    one_by_one = EliasFano.__getitem__
    monkeypatch.setattr(EliasFano, "__getitem__", lambda self, i: looked.append(len(i)) or one_by_one(self, i))
    asked = np.arange(4000, dtype=U)
    row = trie.first(asked)
    assert np.array_equal(row, np.where(asked % 2 == 0, asked // 2, -1).astype(np.int64))
    place, code = trie.after(0, np.repeat(row, 30), np.tile(np.arange(30, dtype=U), 4000))
    hit = (np.repeat(row, 30) >= 0) & (np.tile(np.arange(30), 4000) % 3 == 0)
    assert np.array_equal(place[hit], np.arange(20_000)) and (place[~hit] == -1).all()
    assert np.array_equal(code[hit], np.arange(1, 20_001)) and not code[~hit].any()
    assert not looked
    trie.close()
