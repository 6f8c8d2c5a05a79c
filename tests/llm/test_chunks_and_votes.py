"""Fingerprints and quality votes against plain brute-force versions; null, shared and repeated ids."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.llm import chunk_fingerprints as cf
from trailmark.llm import quality
from trailmark.llm.common import NULL_ID
from trailmark.llm.queries import remainder


def _plain_chunks(text: bytes) -> list[bytes]:
    """Byte by byte: the gear hash of the 16 bytes up to each place (fewer at the beginning)."""
    gear = [int(g) for g in cf._GEAR]
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + cf.LARGEST)
        for e in range(at + cf.SMALLEST, end):
            h = sum(gear[text[e - 1 - i]] << i for i in range(min(16, e))) & 0xFFFFFFFF
            if h >> (32 - (cf._STRICT if e - at < cf.NORMAL else cf._LOOSE)) == 0:
                end = e
                break
        out.append(text[at:end])
        at = end
    return out


def _likeness(a: list[bytes], b: list[bytes]) -> float:
    own, other = set(a), set(b)
    return float(own == other) if not own or not other else sum(map(len, own & other)) / sum(map(len, own))


@pytest.mark.parametrize("seed", [1, 2])
def test_chunk_ends_digests_and_likeness(seed):
    rng = random.Random(seed)
    texts = [bytes(rng.randrange(97, 101 if k % 2 else 123) for _ in range(rng.choice([0, 1, 15, 16, 17, 64, 900, 5000]))) for k in range(12)]
    texts += [texts[6][:400] + b"inserted" + texts[6][400:], b"a" * 3000]
    for text in texts:
        want = _plain_chunks(text)
        ends, counts = cf.chunk_ends(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert ends.tolist() == np.cumsum([len(c) for c in want]).astype(int).tolist() and counts.tolist() == [len(want)]
    prints = cf.fingerprints(texts)
    chunks = [_plain_chunks(t) for t in texts]
    for a, p in zip(chunks, prints):
        assert len(p[0]) == len(set(a)) and int(p[1].sum()) == sum(map(len, set(a)))
        for b, q in zip(chunks, prints):
            assert cf.likeness(p, q) == pytest.approx(_likeness(a, b))


def _neighbours(rows):
    """(id, text, edited text) with rows in order of descending id (null last), then of the text's hash."""
    ordered = sorted(rows, key=lambda r: (-(2**63 - 1) if r[0] is not None else 1, -(r[0] or 0), r[2]))
    out = []
    for k, (i, text, _) in enumerate(ordered):
        text, after = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        out.append((i is None, i or 0, text, text[: len(text) - half] + after[:half]))
    return sorted(out)


@pytest.mark.parametrize("bucket", [300, 12 << 20])
def test_null_shared_and_repeated_ids(spark, monkeypatch, bucket):
    monkeypatch.setattr(cf, "BUCKET_BYTES", bucket)
    rng = random.Random(4)
    text = lambda: "".join(rng.choice("abé ") for _ in range(rng.randrange(200)))
    rows = [(None, text()) for _ in range(40)] + [(5, text()) for _ in range(10)] + [(9, "same text")] * 60
    rows += [(k, text()) for k in range(-3, 30, 4)] + [(9, None), (None, None), (12, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"place": F.lit(1), "nth": F.lit("x")}).repartition(3)
    hashed = [tuple(r) for r in docs.select("doc_id", "text", F.xxhash64("text")).collect()]
    want = _neighbours(hashed)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_chars, r.edited_sha256) for r in cf.compare_edited(docs).collect())
    assert got == sorted((n, i, len(t), hashlib.sha256(e.encode()).hexdigest()) for n, i, t, e in want)


def test_buckets_do_not_follow_the_ids(spark):
    """A third of the rows without id, and one row 1,000 times: no bucket above twice its share."""
    rows = [(None, f"text {k:04d}") for k in range(700)] + [(3, "text same")] * 1000 + [(k, f"text {k:04d}") for k in range(10, 400)]
    own = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).select(
        F.bitwise_not(F.coalesce("doc_id", F.lit(NULL_ID))).alias("place"),
        F.xxhash64("text").alias("hash"),
        F.monotonically_increasing_id().alias("nth"),
        F.lit(10).alias("size"),
    ).cache()
    cuts = cf._cuts(own.toArrow(), 20)
    sizes = own.mapInArrow(cf._numbered(cuts), "bucket int, place long, hash long, nth long").groupBy("bucket").count().collect()
    assert len(sizes) == 20 and max(r["count"] for r in sizes) <= 2 * len(rows) / 20


def _votes(texts, sample, labels, seen, n, k, sharpness, dimensions):
    def vector(text):
        code = text.encode()
        out = np.zeros(quality.FEATURES)
        for i in range(len(code) - 2):
            word = int.from_bytes(code[i : i + 3], "little") * 2654435761 & 0xFFFFFFFF
            out[word >> 21] += 1
        return out

    unit = lambda v: v / np.linalg.norm(v) if np.linalg.norm(v) > 0 else v
    weight = np.log((n + 1) / (seen(vector) + 1)) + 0.1
    x = np.array([unit(np.log1p(vector(t)) * weight) for t in sample])
    axes = np.linalg.svd(x)[2][:dimensions].T
    points = [unit(row @ axes) for row in x]
    out = []
    for text in texts:
        z = unit(unit(np.log1p(vector(text)) * weight) @ axes)
        cosines = [round(float(z @ p), 9) for p in points]
        near = sorted(range(len(points)), key=lambda i: (-cosines[i], i))[:k]
        weights = [max(cosines[i], 0) ** sharpness for i in near]
        out.append(sum(w * labels[i] for w, i in zip(weights, near)) / sum(weights) if sum(weights) else 0.0)
    return out


def test_votes_equal_brute_force_with_ties_and_repeated_ids(spark):
    rng = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "on", "the", "Été", "zero", "north"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(3, 12)))
    rows = [(k, text()) for k in range(60)]
    rows += [(60 + k, "the same text here") for k in range(12)] + [(7, rows[7][1] + " zz")] * 5 + [(None, "no id"), (90, None), (91, "")]
    label = {k: k % 2 for k in range(72)}
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit("clash")).repartition(3)
    labels = spark.createDataFrame([*label.items(), (3, None), (None, 1)], "doc_id long, label int")
    got = quality.score(docs, labels, trained_on=F.lit(True), dimensions=6, neighbours=5)
    by_id: dict = {}
    for i, t in rows:
        if i in label and t is not None:
            by_id[i] = min(by_id.get(i, t), t, key=str.encode)
    ids = sorted(by_id)

    def seen(vector):
        return sum((vector(t or "") > 0).astype(float) for _, t in rows)

    want = _votes([t or "" for _, t in rows], [by_id[i] for i in ids], [label[i] for i in ids], seen, len(rows), 5, 4.0, 6)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for g, w in zip(sorted(map(tuple, got.select("doc_id", "score").collect()), key=key), sorted(((i, s) for (i, _), s in zip(rows, want)), key=key)):
        assert g[0] == w[0] and g[1] == pytest.approx(w[1], abs=2e-3)


def test_the_sample_is_bounded_by_ids(spark):
    docs = spark.range(400).selectExpr("id % 100 AS doc_id", "concat('text ', id) AS text")
    labels = spark.range(100).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS label")
    assert quality.score(docs, labels, trained_on=remainder(4) != 2, sample=10, dimensions=4).count() == 400
