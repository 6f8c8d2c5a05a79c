"""N-gram scores of higher order against a brute-force model, and ids that are null, shared or repeated."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.llm import elias_fano, lm_scoring

SCHEMA = "doc_id long, text string, train boolean, block string, shard int"
MU = (20.0, 3.0, 2.0)


def _rows():
    words = ["the", "cat", "sat", "On", "a", "mat", "été", "and", "ran"]
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(words, rng.integers(1, 30))), bool(i % 4), "x", 1) for i in range(60)]
    rows += [(None, "the cat sat on a mat", True, "x", 1)] * 3 + [(None, "the cat sat", False, "x", 1)]
    rows += [(7, "a mat and a cat", True, None, None), (7, "a mat", None, None, None)]
    return rows + [(90, None, True, "x", 1), (91, "", False, "x", 1), (92, "the cat " * 3000, True, "x", 1)] + [rows[1]] * 40


def _tokens(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*lowered.encode().split(), b"</s>"]


def _brute(rows, order, mu):
    counts = Counter()
    for _, text, train, *_ in rows:
        if train:
            t = [b"<s>", *_tokens(text)]
            counts.update(tuple(t[i : i + k]) for k in range(1, order + 1) for i in range(len(t) - k + 1))
    total = sum(n for g, n in counts.items() if len(g) == 1 and g != (b"<s>",))
    vocabulary = sum(len(g) == 1 and g != (b"<s>",) for g in counts)
    out = []
    for doc, text, *_ in rows:
        t = [b"<s>", *_tokens(text)]
        score = base = 0.0
        for i in range(1, len(t)):
            p = (counts[t[i],] + 0.5) / (total + 0.5 * (vocabulary + 1))
            base += math.log10(p)
            for k in range(2, min(order, i + 1) + 1):
                h = tuple(t[i - k + 1 : i])
                p = (counts[(*h, t[i])] + mu[k - 2] * p) / (counts[h] + mu[k - 2])
            score += math.log10(p)
        out.append((doc is None, doc or 0, len(t) - 1, sum(counts[w,] > 0 for w in t[1:]), total, base, score))
    return sorted(out)


def _got(spark, rows, order):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = lm_scoring.score(docs, F.col("train"), mu=MU[: order - 1], order=order).collect()
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)


@pytest.mark.parametrize("order", [2, 3, 4])
@pytest.mark.parametrize("block", [lm_scoring.BLOCK, 700])
def test_scores_equal_brute_force(spark, monkeypatch, order, block):
    monkeypatch.setattr(lm_scoring, "BLOCK", block)
    rows = _rows()
    got, want = _got(spark, rows, order), _brute(rows, order, MU)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], abs=3e-4 * g[2])


def test_without_training_rows(spark):
    rows = [(1, "a b", False, "", 0), (None, "a", None, "", 0)]
    for r in _got(spark, rows, 3):
        assert r[3:5] == (0, 0) and r[5] == pytest.approx(r[6]) == 0.0


def test_blocks_are_even_whatever_the_ids(spark):
    docs = spark.range(1).selectExpr("explode(sequence(1, 900)) AS n").selectExpr(
        "CASE WHEN n % 3 > 0 THEN n END AS doc_id", "CASE WHEN n % 3 = 0 THEN repeat('same ', 10) ELSE repeat('other ', 9) END AS text",
        "true AS train", "cast(n AS bigint) AS row",
    )
    sizes = [r.n_bytes for r in docs.coalesce(1).mapInArrow(lm_scoring._packed(2000), lm_scoring._BLOCK_ROW).collect()]
    assert sum(sizes) == 300 * 50 + 600 * 54 and max(sizes) <= 2000


def test_third_level_of_the_trie():
    trie = elias_fano.Trie(
        np.array([5, 5, 9], np.uint64),
        np.array([1, 7, 2], np.uint64),
        np.array([11, 12, 13], np.uint16),
        [(np.array([0, 0, 2]), np.array([3, 4, 3], np.uint64), np.array([21, 22, 23], np.uint16))],
    )
    rows, codes = trie.after(0, trie.first(np.array([5, 5, 9, 8], np.uint64)), np.array([1, 7, 2, 2], np.uint64))
    assert rows.tolist() == [0, 1, 2, -1] and codes.tolist() == [11, 12, 13, 0]
    rows, codes = trie.after(1, np.array([0, 0, 1, 2, -1]), np.array([3, 4, 3, 3, 3], np.uint64))
    assert rows.tolist() == [0, 1, -1, 2, -1] and codes.tolist() == [21, 22, 0, 23, 0]
    trie.close()


@pytest.mark.parametrize("order, mu", [(1, 3.0), (3, (3.0,))])
def test_wrong_orders_are_refused(spark, order, mu):
    with pytest.raises(ValueError):
        lm_scoring.score(spark.createDataFrame([], SCHEMA), F.col("train"), mu=mu, order=order)
