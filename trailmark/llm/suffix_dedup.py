"""Exact removal of long repeated byte strings, by a sparse distributed suffix array.

A suffix is kept for each *anchor*: in every window of ``length`` bytes the position whose 16-byte
hash is least (the leftmost of equals). Equal windows have the same anchor, so every repeated
window is seen, at about 1/42 of the suffixes for 100 bytes. A suffix record is (its leading
tokens: 4 bytes and a 32-bit fingerprint of the first 16; a 64-bit fingerprint of the whole
stretch its windows cover; document: doc_id and a 64-bit hash of the text; place).

1. Splitters from a sample of documents range-partition the records by leading tokens, then by
   the other keys, so a passage that fills a third of the table is split over many buckets. The
   sample grows with the number of buckets, so buckets do not grow with the table.
2. Each bucket sorts its records by multikey quicksort. A record equal to the one before it has
   an earlier copy: all its windows go. The first and last record of each bucket are compared
   across the boundaries on the driver (two rows a bucket).
3. Suffixes that share their leading tokens but not the whole stretch (the edges of passages, near
   copies) are opened: their window starts, in groups of ``STEP`` at fixed distances from the anchor,
   become suffix records of their own. Leading tokens are now the bytes that all windows of such a
   group have in common, so groups without a shared window part at once. Steps 1 and 2 run again,
   and once more with single windows for the groups that still differ in part.
4. Each document gets its removed windows, merged into spans.

Nulls and edge cases: a null text is empty; texts shorter than ``length`` lose nothing; a null
doc_id sorts before all others; a row that repeats a (doc_id, text) is the same document, makes its
records once and gets the same result; rows that share a doc_id (or have none) but differ in text are documents of their
own, ordered by the hash of the text; an empty table gives an empty table. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import BYTE_SYMBOL, U, Spans, mix, multikey_sort, place, ranges, slices, utf8, words_at
from .common import documents, public_id, shuffle_partitions, stored

GRAM = 16  # bytes whose hash decides on anchors
SAMPLE_DOCS = 4000  # documents sampled for splitters at first
SAMPLE_ROWS = 20_000  # records sampled for splitters, on the driver: so many, or
PER_BUCKET = 4  # so many for each bucket (160 bytes), if that is more
THIN = 3  # the sample keeps one record in 2**THIN
BUCKET_ROWS = 1_000_000  # records a bucket should hold
STEP = 8  # window starts that are compared together when a suffix is first opened

_RECORD = "lead long, rest long, doc long, hash long, pos long"
_KEYS = ("lead", "rest", "doc", "hash", "pos")
_MARK = ("doc", "hash", "pos")
_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_COPY, _OPEN, _FIRST, _LAST = 0, 1, 2, 3


def _pos(start: np.ndarray, anchor: np.ndarray, more: np.ndarray) -> np.ndarray:
    """First window start (31 bits), distance from it to the anchor (10), number of further window
    starts (10)."""
    return (start << 20) | (anchor << 10) | more


def _parts(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return pos >> 20, (pos >> 10) & 0x3FF, pos & 0x3FF


def _hashed(docs: DataFrame) -> DataFrame:
    """With the hash that tells apart the texts of one doc_id."""
    return docs.withColumn("hash", F.xxhash64("text"))


def _gram_hash(data: np.ndarray) -> np.ndarray:
    word = words_at(data)
    n = len(data) - GRAM + 1
    x = word[:n] * U(0x9FB21C651E98DF25)
    x ^= x >> U(29)
    x += word[8 : 8 + n] * U(0xA0761D6478BD642F)
    x ^= x >> U(32)
    x *= U(0xE7037ED1A0B428DB)
    x ^= x >> U(29)
    return x


def anchors(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, hashes: np.ndarray, length: int) -> list[np.ndarray]:
    """Suffix records of one slice of documents, as the columns of _RECORD."""
    n, wide = len(data), length - GRAM + 1
    if n < length:
        return [np.zeros(0, np.int64)] * len(_KEYS)
    gram = _gram_hash(data)
    bits = U(max(1, (wide - 1).bit_length()))
    low = (U(1) << bits) - U(1)
    # least value of each window by doubling; the low bits carry its distance, so the leftmost wins
    least, span = gram & ~low, 1
    while span * 2 <= wide:
        least = np.minimum(least[:-span], least[span:] + U(span))
        span *= 2
    if rest := wide - span:
        least = np.minimum(least[:-rest], least[rest:] + U(rest))
    # windows that lie in one document
    starts, ends = offsets[:-1], offsets[1:]
    has = ends - starts >= length
    step = np.zeros(n + 2, np.int8)
    step[starts[has]] = 1
    step[ends[has] - length + 1] -= 1
    at = np.flatnonzero(np.cumsum(step[: len(least)], dtype=np.int8))
    if not len(at):
        return [np.zeros(0, np.int64)] * len(_KEYS)
    anchor = at + (least[at] & low).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    lo, hi, anchor = at[first], at[last], anchor[first]
    doc = np.searchsorted(offsets, lo, "right") - 1
    whole = Spans(gram)(lo, hi + wide)
    lead = _lead(data, anchor, mix(gram[anchor]))
    return [lead, whole.view(np.int64), ids[doc], hashes[doc], _pos(lo - offsets[doc], anchor - lo, hi - lo)]


def _lead(data: np.ndarray, at: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Four bytes and half a fingerprint."""
    four = np.ndarray((len(data) - 3,), ">u4", np.ascontiguousarray(data).data, strides=(1,))[at].astype(U)
    return ((four << U(32)) | (tokens >> U(32))).view(np.int64)


def opened(data: np.ndarray, offsets: np.ndarray, doc: np.ndarray, pos: np.ndarray, length: int, step: int) -> list[np.ndarray]:
    """Records of ``step`` window starts each (in distance from the anchor) for those at pos; doc: their
    place in the slice. Returns the keys but doc and hash, and doc's places."""
    lo, anchor, more = _parts(pos)
    lo = lo + offsets[doc]
    if not len(doc):
        return [np.zeros(0, np.int64)] * 4
    anchor += lo
    least = (anchor - lo - more) // step
    count = (anchor - lo) // step - least + 1
    group = ranges(least, count)
    doc, lo, anchor, more = (np.repeat(x, count) for x in (doc, lo, anchor, more))
    shared = anchor - step * group  # where the bytes common to the group's windows begin
    first, last = np.maximum(lo, shared - step + 1), np.minimum(lo + more, shared)
    tokens = Spans(_gram_hash(data))(shared, shared - step + 1 + length - GRAM + 1)
    whole = Spans(BYTE_SYMBOL[data])(first, last + length)
    return [
        _lead(data, shared, tokens),
        whole.view(np.int64),
        _pos(first - offsets[doc], np.minimum(anchor - first, 0x3FF), last - first),
        doc,
    ]


def _bucketed(columns: list[np.ndarray], cuts: list[np.ndarray] | None) -> pa.RecordBatch:
    arrays, names = [pa.array(c) for c in columns], list(_KEYS)
    if cuts is not None:
        arrays.append(pa.array(place(columns, cuts).astype(np.int32)))
        names.append("bucket")
    return pa.RecordBatch.from_arrays(arrays, names)


def _anchor_rows(length: int, cuts: list[np.ndarray] | None, thin: int = 0):
    """thin: keep the records of one in 2**thin (for splitters)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            ids, hashes = (batch.column(k).to_numpy() for k in ("doc_id", "hash"))
            for i, j in slices(offsets):
                part = anchors(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ids[i:j], hashes[i:j], length)
                if thin:
                    keep = (mix(part[4].view(U) ^ part[3].view(U) ^ part[2].view(U)) & U((1 << thin) - 1)) == 0
                    part = [c[keep] for c in part]
                yield _bucketed(part, cuts)

    return run


def _opened_rows(length: int, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            ids, hashes = (batch.column(k).to_numpy() for k in ("doc_id", "hash"))
            marks = batch.column("marks")
            mark_at = marks.offsets.to_numpy().astype(np.int64)
            mark = marks.flatten().to_numpy()
            mark_at = mark_at - mark_at[0]
            for i, j in slices(offsets):
                pos = mark[mark_at[i] : mark_at[j]]
                doc = np.repeat(np.arange(j - i), np.diff(mark_at[i : j + 1]))
                part = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                lead, rest, at, doc = opened(*part, doc, pos, length, step)
                yield _bucketed([lead, rest, ids[i:j][doc], hashes[i:j][doc], at], None)

    return run


def _assign(cuts: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _bucketed([batch.column(k).to_numpy() for k in _KEYS], cuts)

    return run


def _sorted_bucket(open_edges: bool):
    """Sorts one bucket and tells the records with an earlier copy, those to open, and its ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), None) if (batches := list(batches)) else None
        if table is None or table.num_rows == 0:
            return
        bucket = int(np.min(table.column("bucket").to_numpy()))
        keys = [table.column(k).to_numpy() for k in _KEYS]
        del table
        order, (lead_tie, rest_tie, _, _, all_tie) = multikey_sort(keys)
        keys = [k[order] for k in keys]
        kind = np.full(len(order), -1, np.int32)
        kind[rest_tie] = _COPY
        if open_edges:
            # runs of equal leading tokens that hold several stretches, or that reach a boundary
            run = np.cumsum(~lead_tie) - 1
            mixed = np.zeros(run[-1] + 1, bool)
            mixed[run[lead_tie & ~rest_tie]] = True
            mixed[[0, -1]] = True
            kind[mixed[run] & ~rest_tie] = _OPEN
        kind[all_tie] = -1  # the same document again
        kind[0] = -1
        out = np.flatnonzero(kind >= 0)
        rows = np.concatenate([out, [0, len(order) - 1]])
        kinds = np.concatenate([kind[out], [_FIRST, _LAST]]).astype(np.int32)
        ends = kinds >= _FIRST
        names = ["kind", "bucket", *_KEYS]
        columns = [pa.array(kinds), pa.array(np.full(len(rows), bucket, np.int32))]
        columns += [pa.array(k[rows], mask=None if name in _MARK else ~ends) for name, k in zip(_KEYS, keys)]
        yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _cuts(sample: np.ndarray, buckets: int) -> list[np.ndarray]:
    """buckets - 1 splitters: even steps through the sorted sample."""
    order = np.lexsort(sample.T[::-1])
    at = order[np.linspace(0, len(order) - 1, buckets + 1).astype(int)[1:-1]] if len(order) else order
    return [np.ascontiguousarray(sample[at, k]) for k in range(len(_KEYS))]


def _splitters(records: DataFrame, n: int, buckets: int) -> np.ndarray:
    """Of n records, drawn evenly, about as many as make buckets of like size."""
    rows = records.sample(min(1.0, max(SAMPLE_ROWS, PER_BUCKET * buckets) / max(n, 1)), seed=7).toArrow()
    return np.stack([rows.column(k).to_numpy() for k in _KEYS], axis=1) if rows.num_rows else np.zeros((0, len(_KEYS)), np.int64)


def _copies(bucketed: DataFrame, buckets: int, open_edges: bool) -> tuple[DataFrame, DataFrame | None]:
    """(records with an earlier copy, records to open), each as doc, hash, pos."""
    spark = bucketed.sparkSession
    told = stored(
        bucketed.repartitionById(buckets, F.col("bucket")).mapInArrow(
            _sorted_bucket(open_edges), f"kind int, bucket int, {_RECORD}"
        ),
        "suffix-runs",
    )
    # two rows for each bucket, its first and last record: does its first run begin in a bucket before?
    ends = told.filter(f"kind >= {_FIRST}").toArrow().sort_by([("bucket", "ascending"), ("kind", "ascending")])
    lead, rest = (ends.column(k).to_numpy() for k in ("lead", "rest"))
    goes_on = np.zeros(ends.num_rows // 2, bool)
    goes_on[1:] = (lead[2::2] == lead[1:-1:2]) & (rest[2::2] == rest[1:-1:2])
    firsts = ends.select(list(_MARK)).take(np.arange(0, ends.num_rows, 2))
    rows = lambda kind, more: told.filter(F.col("kind") == kind).select(*_MARK).unionByName(
        spark.createDataFrame(firsts.filter(pa.array(more)), "doc long, hash long, pos long")
    )
    return rows(_COPY, goes_on), rows(_OPEN, ~goes_on) if open_edges else None


def _once(docs: DataFrame) -> DataFrame:
    """Each (doc_id, hash) once: equal rows would make equal records, which no splitter can part. Where
    no row repeats, only ids and hashes are shuffled; else each task sends each of its texts once."""
    rows = docs.groupBy("doc_id", "hash")
    if rows.count().where("count > 1").isEmpty():
        return docs
    return stored(rows.agg(F.min("text").alias("text")).select(*docs.columns), "rows-once")


def _marked(docs: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    """Documents with their records; a document has fewer of them than bytes."""
    lists = marks.groupBy(F.col("doc").alias("doc_id"), "hash").agg(F.collect_list("pos").alias("marks"))
    return docs.join(lists, ["doc_id", "hash"], how)


def _remove(length: int, as_text: bool, carry: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            marks = batch.column("marks")
            removed, spans, kept = [], [], []
            for i in range(len(batch)):
                own = data[offsets[i] : offsets[i + 1]]
                lo = hi = np.zeros(0, np.int64)
                if marks[i].is_valid:
                    pos = marks[i].values.to_numpy()
                    lo, _, more = _parts(np.sort(pos))
                    reach = np.maximum.accumulate(lo + more + length)
                    new = np.flatnonzero(np.append(True, lo[1:] > reach[:-1]))
                    lo, hi = lo[new], reach[np.append(new[1:], len(lo)) - 1]
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(lo, hi)])
                removed.append(int((hi - lo).sum()))
                if len(lo):
                    step = np.zeros(len(own) + 1, np.int8)
                    step[lo] = 1
                    step[hi] -= 1
                    own = own[np.cumsum(step[:-1], dtype=np.int8) == 0]
                kept.append(own.tobytes().decode("utf-8", "ignore") if as_text else own.tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(offsets)),
                    pa.array(removed, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array(kept, pa.string() if as_text else pa.binary()),
                    *([batch.column("carry")] if carry else []),
                ],
                ["doc_id", "n_bytes", "n_removed", "spans", "kept", *(["carry"] if carry else [])],
            )

    return run


def remove_repeats(docs: DataFrame, length: int = 100, as_text: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """Remove each byte covered by a ``length``-byte string that also starts earlier (in a document
    with a smaller doc_id, or in the same one). Returns a row for each input row: doc_id, n_bytes,
    n_removed, spans (array of start, end in bytes), kept (the remaining bytes; with ``as_text`` as a
    string, without characters of which a part went) and the columns named in ``carry``."""
    if not GRAM + STEP <= length <= 1024:
        raise ValueError(f"length must be from {GRAM + STEP} to 1024")
    own = _once(_hashed(documents(docs)))
    spark = own.sparkSession

    share = min(1.0, SAMPLE_DOCS / max(own.count(), 1))
    while True:
        sample = stored(own.sample(share, seed=7).mapInArrow(_anchor_rows(length, None, THIN), _RECORD), "sample")
        n = sample.count()
        buckets = max(shuffle_partitions(spark), int(n * 2**THIN / share / BUCKET_ROWS) + 1)
        if share == 1 or n >= PER_BUCKET * buckets:
            break
        share = min(1.0, 2 * share * PER_BUCKET * buckets / max(n, 1))
    cuts = _cuts(_splitters(sample, n, buckets), buckets)
    copies, open_ = _copies(
        own.mapInArrow(_anchor_rows(length, cuts), f"{_RECORD}, bucket int"), buckets, open_edges=True
    )

    for step in (STEP, 1):
        records = stored(_marked(own, open_, "inner").mapInArrow(_opened_rows(length, step), _RECORD), f"opened-{step}")
        n = records.count()
        buckets = max(shuffle_partitions(spark), n // BUCKET_ROWS + 1)
        cuts = _cuts(_splitters(records, n, buckets), buckets)
        more, open_ = _copies(records.mapInArrow(_assign(cuts), f"{_RECORD}, bucket int"), buckets, open_edges=step > 1)
        copies = copies.unionByName(more)

    last = _hashed(documents(docs, carry))
    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("spans", T.ArrayType(_SPAN)),
            T.StructField("kept", T.StringType() if as_text else T.BinaryType()),
            *([last.schema["carry"]] if carry else []),
        ]
    )
    found = _marked(last, copies, "left").mapInArrow(_remove(length, as_text, bool(carry)), schema)
    return found.select(
        public_id().alias("doc_id"), "n_bytes", "n_removed", "spans", "kept", *(["carry.*"] if carry else [])
    )
