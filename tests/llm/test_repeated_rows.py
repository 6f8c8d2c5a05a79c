"""Rows without ids, shared ids and one row many times: the same results, and no task that takes them all."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from trailmark.llm import chunk_fingerprints, line_dedup, lm_scoring, packing, pieces, search, suffix_dedup

WORDS = ["tree", "house", "river", "stone", "light", "cloud", "grass", "road"]


def _table(spark, copies=1000):
    """1200 rows of their own, a third of them without id, and one row ``copies`` times."""
    rng = random.Random(5)
    rows = [(None if i % 3 == 0 else i // 2, " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(40))) for i in range(1200)]
    hot = (7, " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(60)))
    rows += [hot] * copies
    rng.shuffle(rows)
    return rows, hot, spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, hash string, row int").repartition(8)


@pytest.fixture(scope="module")
def table(spark):
    return _table(spark)


def test_suffix_dedup_records_of_a_repeated_row_are_made_once(spark, table):
    rows, hot, docs = table
    once = suffix_dedup._once(suffix_dedup._hashed(suffix_dedup.documents(docs)))
    assert once.count() == len({(i, t) for i, t in rows}) and once.columns == ["doc_id", "text", "hash"]
    got = Counter(tuple(r) for r in suffix_dedup.remove_repeats(docs, 100).select("doc_id", "n_removed", "kept").collect())
    few = suffix_dedup.remove_repeats(docs.dropDuplicates(["doc_id", "text"]), 100).select("doc_id", "n_removed", "kept").collect()
    assert sum(got.values()) == len(rows) and set(got) == {tuple(r) for r in few}


def test_suffix_dedup_without_repeated_rows_reads_its_input(spark):
    docs = spark.createDataFrame([(1, "a" * 120), (1, "b"), (None, "b")], "doc_id long, text string")
    own = suffix_dedup._hashed(suffix_dedup.documents(docs))
    assert suffix_dedup._once(own) is own


def test_packing_spreads_rows_that_are_alike(spark, table):
    rows, hot, docs = table
    packed = packing.pack(docs, capacity=1024, keep_ids=True).collect()
    assert len(packed) == len(rows)  # no row is longer than a sequence here
    by_sequence = defaultdict(list)
    for r in packed:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    want = Counter(i for i, _ in rows)
    assert Counter(r.doc_id for r in packed) == want


def test_packing_ranks_no_hot_row_in_one_group(spark, table):
    rows, hot, docs = table
    numbered = docs.drop("row").where(F.col("doc_id") == hot[0]).withColumn("row", F.monotonically_increasing_id())
    sizes = [r["count"] for r in numbered.groupBy(packing._part(8)).count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 2 * sum(sizes) / 8


def test_language_model_scores_alike_rows_alike(spark, table):
    rows, hot, docs = table
    got = lm_scoring.score(docs, trained_on=F.pmod(F.xxhash64("text"), F.lit(5)) != 1, order=3, mu=(300.0, 5.0)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    assert len({(r.n_tokens, round(r.score, 9)) for r in got if r.doc_id == hot[0] and r.n_tokens == 61}) == 1
    for learned in (F.lit(False), F.lit(None).cast("boolean")):  # nothing to learn from; a null flag is no
        none = lm_scoring.score(docs.limit(20), trained_on=learned, order=3, mu=(300.0, 5.0)).collect()
        assert len(none) == 20 and all(r.train_tokens == 0 and r.n_known == 0 for r in none)


def test_line_dedup_with_null_and_shared_ids(spark):
    lines = ["one line of text", "two lines of text", "three lines of text", "four"]
    text = "\n".join(lines)
    rows = [(None, text), (4, text), (4, text), (4, "other\n" + text), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.remove_repeated_lines(df, lines=3).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    assert sum(r.n_lines - r.n_removed for r in got if r.n_lines) == 5  # each line once: four, and "other"


def test_pieces_and_fingerprints_keep_every_row(spark, table):
    rows, hot, docs = table
    decoded = pieces.decode(pieces.encode(docs.select("doc_id", "text"))).select("doc_id", "text").collect()
    assert Counter(map(tuple, decoded)) == Counter(rows)
    edited = chunk_fingerprints.compare_edited(docs).collect()
    assert Counter(r.doc_id for r in edited) == Counter(i for i, _ in rows)
    # all copies but the last stand before a copy of their own, so only two edited texts arise
    shas = {r.edited_sha256 for r in edited if r.doc_id == hot[0] and r.n_chars == len(hot[1])}
    same = hot[1][: len(hot[1]) - len(hot[1]) // 2] + hot[1][: len(hot[1]) // 2]
    assert hashlib.sha256(same.encode()).hexdigest() in shas and len(shas) <= 2


def test_search_finds_every_copy(spark):
    rows, hot, docs = _table(spark, copies=30)
    found = search.search(docs, F.col("text") == hot[1], k=40).where(F.col("rank") <= 30).collect()
    assert len(found) == 30 * 30 and {r.doc_id for r in found} == {hot[0]}
    assert len({round(r.score, 6) for r in found}) == 1
