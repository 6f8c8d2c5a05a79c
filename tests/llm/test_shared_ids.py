"""Rows that share a doc_id, or have none, and differ in text."""

from __future__ import annotations

import random
import zlib

import corpus_pipeline
import numpy as np

from test_operators import _fingerprint
from trailmark.llm import simhash, suffix_dedup


def _text(rng, n=130):
    return "".join(rng.choice("abcdefghij ") for _ in range(n))


def _colliding(rng):
    """Two texts without a common window whose CRC32 agrees in 12 bits."""
    seen = {}
    while True:
        text = _text(rng)
        other = seen.setdefault(zlib.crc32(text.encode()) & 0xFFF, text)
        if other != text:
            return other, text


def test_suffix_dedup_tells_texts_without_ids_apart(spark):
    """Marks of one text are never applied to another; repeats among texts of one id go."""
    rng = random.Random(1)
    passage = _text(rng, 200)
    rows = []
    for _ in range(4):
        a, b = _colliding(rng)
        rows += [(None, a), (7, a), (7, b)]  # what goes from the one is new in the other
    rows += [(None, passage + _text(rng, 40)) for _ in range(60)] + [(9, passage + _text(rng, 40)) for _ in range(30)] + [(3, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    hashes = {r.text: r.h for r in df.selectExpr("text", "xxhash64(text) AS h").collect()}
    order = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], hashes[r[1]]))
    seen, want = set(), []
    for doc, text in order:
        raw, gone = text.encode(), np.zeros(len(text), bool)
        for i in range(len(raw) - 99):
            gone[i : i + 100] |= raw[i : i + 100] in seen
            seen.add(raw[i : i + 100])
        want.append((doc or -1, len(raw), bytes(b for b, g in zip(raw, gone) if not g)))
    got = [(r.doc_id or -1, r.n_bytes, bytes(r.kept)) for r in suffix_dedup.remove_repeats(df, 100).collect()]
    assert sorted(got) == sorted(want)


def _groups(prints):
    """Sets of fingerprints connected by links of two bits or fewer."""
    left, out = set(prints), []
    while left:
        group, new = set(), {left.pop()}
        while new:
            group |= new
            new = {f for f in left if any((f ^ g).bit_count() <= 2 for g in new)}
            left -= new
        out.append(group)
    return out


def _prose(rng):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(60))


def _near_rows():
    rng = random.Random(4)
    a, b, c, d, e = (_prose(rng) for _ in range(5))
    rows = [(None, a), (None, a), (None, b), (None, c), (1, b), (2, c), (2, d), (3, d), (3, e), (3, e), (4, d)]
    return rows + [(None, None), (None, ""), (8, " ")] + [(None, _prose(rng)) for _ in range(20)]


def test_simhash_links_rows_without_ids_by_their_texts_alone(spark):
    rows = _near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    least = {}
    for group in _groups({_fingerprint(t) for _, t in rows}):
        ids = [i for i, t in rows if _fingerprint(t) in group]
        least |= dict.fromkeys(group, None if None in ids else min(ids))
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    want = sorted(((i, _fingerprint(t), least[_fingerprint(t)]) for i, t in rows), key=key)
    got = [(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(df).collect()]
    assert sorted(got, key=key) == want
    assert any(i == 4 and c == 2 for i, _, c in want)  # linked to the text d of document 2, not to its c


def test_one_row_of_each_near_duplicate_group_stays(spark):
    rows = _near_rows()
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", 1) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.simhash_near_dedup(spark, docs.repartition(5), "")
    assert kept.columns == list(corpus_pipeline.COLUMNS)
    left = kept.collect()
    groups = _groups({_fingerprint(t) for _, t in rows})
    assert len(left) == len(groups)
    for group in groups:
        ids = [-1 if i is None else i for i, t in rows if _fingerprint(t) in group]
        (row,) = [r for r in left if _fingerprint(r.text) in group]
        assert (-1 if row.doc_id is None else row.doc_id) == min(ids)
        assert (row.doc_id, row.text) == rows[int(row.source[1:])]
