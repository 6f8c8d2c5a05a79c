"""Words longer than a lattice's usual block, against brute force in exact arithmetic."""

from __future__ import annotations

import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest

from trailmark.llm import langid, lattice
from trailmark.llm.queries import remainder

TEXTS = ["a", "b", "ab", "ba", "aba", "c", "cc", "ccc"]


def _sums(word, vocabulary, p):
    """(probability, expected uses of each piece) over all segmentations, as fractions."""
    n = len(word)
    edges = []
    for i in range(n):
        found = [(i + len(t), k) for k, t in enumerate(vocabulary.texts) if word.startswith(t, i)]
        if not any(e == i + 1 for e, _ in found):
            found.append((i + 1, None))
        edges.append([(e, k, Fraction(langid.UNKNOWN) if k is None else Fraction(float(p[k]))) for e, k in found])
    alpha = [Fraction(1)] + [Fraction(0)] * n
    for i in range(n):
        for e, _, q in edges[i]:
            alpha[e] += alpha[i] * q
    beta = [Fraction(0)] * n + [Fraction(1)]
    uses = Counter()
    for i in reversed(range(n)):
        for e, k, q in edges[i]:
            beta[i] += q * beta[e]
            if k is not None:
                uses[k] += alpha[i] * q * beta[e]
    return alpha[n], {k: float(u / alpha[n]) for k, u in uses.items()}


def _log(fraction):
    return math.log(fraction.numerator) - math.log(fraction.denominator)  # of integers of any size


def _long_words():
    rng = random.Random(3)
    words = ["x" * 64, "c" * 64, "x" * 63 + "a", "a" + "x" * 70 + "b", "abxcc" * 20, "c" * 120, "x" * 150]
    return words + ["".join(rng.choice("abcx") for _ in range(rng.randint(1, 130))) for _ in range(8)]


@pytest.mark.parametrize("rare", [1.0, 1e-7, 1e-12])
def test_sums_of_long_runs_do_not_underflow(rare):
    vocabulary = lattice.Pieces(TEXTS)
    p = np.array([0.3, 0.2, 0.1, 0.25, 0.1, 0.02, 0.02, 0.01]) * rare
    words = _long_words()
    want = [_sums(w, vocabulary, p) for w in words]
    uses, weight = Counter(), np.arange(1.0, len(words) + 1)
    for c, (_, own) in zip(weight, want):
        for k, u in own.items():
            uses[k] += c * u
    counts = np.zeros(len(p))
    for at, matrix, lengths in lattice.matrices(words):
        got = langid.log_probability(vocabulary, matrix, lengths, p[:, None])[:, 0]
        assert np.allclose(got, [_log(want[i][0]) for i in at], rtol=1e-10)
        counts += langid.expected_counts(vocabulary, matrix, weight[at], p, lengths)
    assert np.allclose(counts, [uses[k] for k in range(len(p))], rtol=1e-9)


def test_split_words_have_the_same_sums():
    vocabulary = lattice.Pieces(TEXTS)
    p = np.array([0.3, 0.2, 0.1, 0.25, 0.1, 0.02, 0.02, 0.01])
    words = _long_words()
    split = vocabulary.split(words)
    assert ["".join(s) for s in split] == words and max(map(len, split)) > 1
    for w, parts in zip(words, split):
        whole = _log(_sums(w, vocabulary, p)[0])
        assert np.isclose(sum(_log(_sums(x, vocabulary, p)[0]) for x in parts), whole, rtol=1e-9)
    assert vocabulary.short([words[:1], words[4:5]]) == [words[:1], split[4]]


def test_scores_of_unseen_and_unknown_letters(spark):
    """Runs of 64 letters that training has not met, and of letters in no piece, in both."""
    pieces = langid.letter_pieces(public_tokenizers.path(langid.VOCABULARY))
    single = [t for t in pieces.texts if len(t) == 1]
    unknown = "".join(chr(c) for c in range(0x1200, 0x1240) if chr(c).isalpha() and chr(c) not in single)[:40]
    unseen = "".join([t for t in single if t >= "一"][:64])
    assert len(unknown) >= 36 and len(unseen) == 64
    rng = random.Random(2)
    stock = {"xx": ["the", "and", "over", "house", "water"], "yy": ["der", "und", "über", "haus", "wasser"]}
    rows = [(i, " ".join(rng.choices(stock[g], k=12)), g) for i in range(120) for g in [("xx", "yy")[i % 2]]]
    odd = [unseen, unknown, unknown + "the", (unknown * 2)[:64], "the " + unseen, unseen * 40, "haus" * 40 + unknown]
    rows += [(1000 + i, t, "yy") for i, t in enumerate(odd * 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for trained_on in (remainder(4) != 2, remainder(4).isNotNull() & (df.doc_id < 1000)):
        got = {r.doc_id: r for r in langid.identify(df, trained_on).collect()}
        assert all(0.5 - 1e-9 <= r.score <= 1 for r in got.values()), sorted(got.items())
        assert all(got[i].lang_pred == ("xx", "yy")[i % 2] and got[i].score > 0.9 for i in range(120))
        assert got[1006].lang_pred == "yy"
