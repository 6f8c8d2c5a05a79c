"""Document fingerprints by content-defined chunking.

A gear hash over the last 16 bytes decides on chunk ends: before the normal size a stricter mask must
match, after it a looser one, and a chunk has at least ``SMALLEST`` and at most ``LARGEST`` bytes
(normalised chunking). An insertion moves the ends near it only. A fingerprint is the set of a
text's chunk digests with their lengths; the likeness of one fingerprint to another is the
share of its length whose chunks the other has too (containment).

Edited texts: documents are in order of descending doc_id, those that share one in order of a hash of
their text, equal ones as they come. Splitters over these three keys, from a sample that grows with
the number of buckets, cut the order into buckets of about ``BUCKET_BYTES`` of text, whatever the ids; the
first document of each bucket is also sent to the bucket before it, so every document meets its next one without
a global sort in one task. The driver holds the sample (four rows a bucket, or 20,000) and one row a bucket, some
40 bytes each. The table is read several times and must give the same rows in the same order each time.

Nulls and edge cases: a null text is empty; an empty text has the empty fingerprint, which is fully
like an empty one and not at all like others; texts of less than SMALLEST bytes are one chunk; a null
doc_id sorts below all others; rows that share a doc_id are in order of their texts' hashes; a single
document is its own next; an empty table gives an empty table. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import BYTE_SYMBOL, U, Spans, place
from .common import documents, public_id, shuffle_partitions

SMALLEST, NORMAL, LARGEST = 16, 64, 256
_STRICT, _LOOSE = 8, 4  # bits that must be zero before and after the normal size
_GEAR = (BYTE_SYMBOL >> U(32)).astype(np.uint32)
_SLICE = 1 << 20
BUCKET_BYTES = 12 << 20
SAMPLE_ROWS, PER_BUCKET = 20_000, 4
_KEYS = ("place", "hash", "nth")  # the complement of doc_id, a hash of the text, the number of the row


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunk ends of each text (one after another) and the number of chunks of each."""
    h = _GEAR[data]
    for k in range(4):  # sums over 2, 4, 8, 16 bytes, older bytes shifted further
        step = 1 << k
        older = np.zeros_like(h)
        older[step:] = h[:-step] << np.uint32(step) if len(h) > step else h[:0]
        h = h + older
    strict = (np.flatnonzero(h >> np.uint32(32 - _STRICT) == 0) + 1).tolist()
    loose = (np.flatnonzero(h >> np.uint32(32 - _LOOSE) == 0) + 1).tolist()
    strict.append(len(h) + LARGEST + 1)
    loose.append(len(h) + LARGEST + 1)
    ends: list[int] = []
    counts = np.zeros(len(offsets) - 1, np.int64)
    s = n = 0
    for i, (at, last) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        before = len(ends)
        while at < last:
            s = bisect_left(strict, at + SMALLEST, s)
            end = strict[s]
            if end >= at + NORMAL:
                n = bisect_left(loose, at + NORMAL, n)
                end = min(loose[n], at + LARGEST)
            at = min(end, last)
            ends.append(at)
        counts[i] = len(ends) - before
    return np.array(ends, np.int64), counts


Fingerprint = tuple[np.ndarray, np.ndarray]  # distinct digests in order, and their chunks' lengths


def fingerprints(texts: list[bytes]) -> list[Fingerprint]:
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.append(0, np.cumsum([len(t) for t in texts], dtype=np.int64))
    ends, counts = chunk_ends(data, offsets)
    starts = np.append(0, ends[:-1]) if len(ends) else ends
    digest = Spans(BYTE_SYMBOL[data])(starts, ends)
    size = ends - starts
    out, at = [], 0
    for c in counts.tolist():
        own, first = np.unique(digest[at : at + c], return_index=True)
        out.append((own, size[at : at + c][first]))
        at += c
    return out


def as_text(f: Fingerprint) -> str:
    """16 hex digits of digest and 4 of length for each chunk, in order of digest."""
    both = np.zeros(len(f[0]), np.dtype([("digest", ">u8"), ("size", ">u2")]))
    both["digest"], both["size"] = f
    return both.tobytes().hex()


def from_text(text: str) -> Fingerprint:
    both = np.frombuffer(bytes.fromhex(text), np.dtype([("digest", ">u8"), ("size", ">u2")]))
    return both["digest"].astype(U), both["size"].astype(np.int64)


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """Share of a's length whose chunks b has."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    return float(a[1][b[0][at] == a[0]].sum() / a[1].sum())


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    i, total = 0, 0
    for j, size in enumerate(sizes):
        total += size
        if total >= _SLICE:
            yield i, j + 1
            i, total = j + 1, 0
    if i < len(sizes):
        yield i, len(sizes)


def _all_fingerprints(texts: list[bytes]) -> list[Fingerprint]:
    return [f for i, j in _groups([len(t) for t in texts]) for f in fingerprints(texts[i:j])]


def _keys(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(k).to_numpy() for k in _KEYS]


def _numbered(cuts: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = pa.array(place(_keys(batch), cuts).astype(np.int32))
            yield pa.RecordBatch.from_arrays([bucket, *map(batch.column, _KEYS)], ["bucket", *_KEYS])

    return run


def _cuts(sample: pa.Table, buckets: int) -> list[np.ndarray]:
    """Splitters, after even shares of the sample's bytes."""
    sample = sample.sort_by([(k, "ascending") for k in _KEYS])
    upto = np.cumsum(sample.column("size").to_numpy())
    at = np.searchsorted(upto, np.arange(1, buckets) * (upto[-1] / buckets)) if len(upto) else np.zeros(0, int)
    return [np.ascontiguousarray(k[at]) for k in _keys(sample)]


def _dealt(cuts: list[np.ndarray], heads: list[np.ndarray], before: np.ndarray):
    """Each document to its bucket, and the first of a bucket also to the one before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _keys(batch)
            bucket = place(keys, cuts)
            at = np.minimum(place(keys, heads), len(before) - 1)
            extra = np.flatnonzero(np.logical_and.reduce([h[at] == k for h, k in zip(heads, keys)]))
            take = pa.array(np.concatenate([np.arange(len(bucket)), extra]))
            guest = np.arange(len(take)) >= len(bucket)
            buckets = np.concatenate([bucket, before[at[extra]]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(buckets), pa.array(guest), *(batch.column(k).take(take) for k in (*_KEYS, "doc_id", "text"))],
                ["bucket", "guest", *_KEYS, "doc_id", "text"],
            )

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    batches = list(batches)
    if not batches:
        return
    rows = pa.Table.from_batches(batches)
    del batches
    for bucket in sorted(set(rows.column("bucket").to_pylist())):
        own = rows.filter(pc.equal(rows.column("bucket"), bucket))
        own = own.sort_by([(k, "ascending") for k in ("guest", *_KEYS)])
        n = own.num_rows - sum(own.column("guest").to_pylist())
        texts = own.column("text").to_pylist()[: n + 1]
        texts = [t or "" for t in texts]  # the guest is what comes after the last document
        raw = [t.encode() for t in texts]
        prints = _all_fingerprints(raw)
        sizes = [len(r) for r in raw]
        ids = own.column("doc_id").to_numpy()
        for i, j in _groups(sizes[:n]):
            half = [len(t) // 2 for t in texts[i:j]]
            edited = [(t[: len(t) - h] + nxt[:h]).encode() for t, nxt, h in zip(texts[i:j], texts[i + 1 : j + 1], half)]
            changed = fingerprints(edited)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": ids[i:j],
                    "n_chars": pa.array([len(t) for t in texts[i:j]], pa.int64()),
                    "edited_sha256": [hashlib.sha256(e).hexdigest() for e in edited],
                    "fingerprint": [as_text(f) for f in prints[i:j]],
                    "edited_fingerprint": [as_text(f) for f in changed],
                    "near_edited": [likeness(f, e) for f, e in zip(prints[i:j], changed)],
                    "near_next": [likeness(f, g) for f, g in zip(prints[i:j], prints[i + 1 : j + 1])],
                }
            )


def _fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = _all_fingerprints([(t or "").encode() for t in batch.column("text").to_pylist()])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([as_text(f) for f in prints], pa.string())], ["doc_id", "fingerprint"]
        )


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (see ``from_text`` and ``likeness``) for each row."""
    return documents(docs).mapInArrow(_fingerprint_rows, "doc_id long, fingerprint string").withColumn("doc_id", public_id())


def compare_edited(docs: DataFrame) -> DataFrame:
    """Each document against an edited text (its last half replaced by as much of the beginning of
    the next document in descending doc_id) and against that next document."""
    own = documents(docs).select(
        "*",
        F.bitwise_not("doc_id").alias("place"),
        F.xxhash64("text").alias("hash"),
        F.monotonically_increasing_id().alias("nth"),
    )
    spark = own.sparkSession
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    size = own.agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("n_bytes")).first()
    if not size.rows:
        return spark.createDataFrame([], schema)
    buckets = max(shuffle_partitions(spark), (size.n_bytes or 0) // BUCKET_BYTES + 1)
    share = min(1.0, max(SAMPLE_ROWS, PER_BUCKET * buckets) / size.rows)
    weighed = own.select(*_KEYS, (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("size"))
    cuts = _cuts(weighed.sample(share, seed=7).toArrow(), buckets)
    # the first row of each bucket
    heads = (
        own.select(*_KEYS).mapInArrow(_numbered(cuts), "bucket int, place long, hash long, nth long")
        .groupBy("bucket").agg(F.min(F.struct(*_KEYS)).alias("head")).select("bucket", "head.*").toArrow().sort_by("bucket")
    )
    before = np.roll(heads.column("bucket").to_numpy(), 1)
    dealt = own.mapInArrow(
        _dealt(cuts, _keys(heads), before),
        "bucket int, guest boolean, place long, hash long, nth long, doc_id long, text string",
    )
    return dealt.repartitionById(buckets, F.col("bucket")).mapInArrow(_compare, schema).withColumn("doc_id", public_id())
