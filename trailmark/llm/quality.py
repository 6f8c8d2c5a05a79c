"""Quality scores by nearest-neighbour voting in a latent semantic space.

Texts become counts of hashed byte trigrams, damped, weighted by inverse document frequency and
projected onto the leading singular vectors of a labelled sample. The sample's vectors are
broadcast (``sample`` rows of ``dimensions`` numbers: a bound that does not grow with the data), every
document's cosine with all of them is computed exactly, block by block, and the ``neighbours``
nearest vote for their labels with their similarity (to the power ``sharpness``) as weight.

Only the sample is bounded (documented parameter ``sample``: so many labelled ids, the least by a 64-bit hash);
every row is scored, on its whole text.

Nulls and edge cases: a null or empty text, and any of less than three bytes, has no trigram and
scores 0; a document with several labels counts once with the greatest; null labels are not learned
from; of rows that share a labelled id only the one with the least text is learned from; without any label all score 0; ties among neighbours go to the earlier sample row; repeated rows
get equal scores; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import slices, utf8
from .common import documents, public_id

FEATURES = 2048
_BLOCK = 256  # documents a block


def _counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hashed trigram counts, texts by features."""
    n = len(offsets) - 1
    if len(data) < 3:
        return np.zeros((n, FEATURES), np.float32)
    wide = data.astype(np.uint32)
    code = (wide[:-2] | wide[1:-1] << np.uint32(8) | wide[2:] << np.uint32(16)) * np.uint32(2654435761)
    code = (code >> np.uint32(32 - FEATURES.bit_length() + 1)).astype(np.int64)
    owner = np.repeat(np.arange(n), np.diff(offsets))[:-2]
    inside = np.arange(len(code)) + 3 <= offsets[1:][owner]
    return np.bincount(owner[inside] * FEATURES + code[inside], minlength=n * FEATURES).reshape(n, FEATURES).astype(np.float32)


def _blocks(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    data, offsets = utf8(batch.column("text"))
    for i, j in slices(offsets):
        for a in range(i, j, _BLOCK):
            b = min(a + _BLOCK, j)
            yield _counts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [row.astype(np.float32).tobytes() for block in _blocks(batch) for row in block]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("label"), pa.array(counts, pa.binary())], ["doc_id", "label", "counts"]
        )


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one task: in how many documents each feature occurs, and last the number of documents."""
    seen = np.zeros(FEATURES + 1, np.int64)
    for batch in batches:
        for block in _blocks(batch):
            seen[:-1] += (block > 0).sum(axis=0)
        seen[-1] += len(batch)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1, dtype=np.int32)), pa.array(seen)], ["feature", "n"])


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Over all documents: in how many each feature occurs, and their number."""
    sums = docs.mapInArrow(_seen, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow().sort_by("feature")
    n = sums.column("n").to_numpy() if sums.num_rows else np.zeros(FEATURES + 1, np.int64)
    return n[:-1], int(n[-1])


class Space:
    """The latent space and the labelled vectors in it. ``seen``: documents of all ``n`` with each feature."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, dimensions: int, seen: np.ndarray, n: int) -> None:
        self.weight = np.log((n + 1) / (seen + 1)).astype(np.float32) + np.float32(0.1)
        x = self._weighted(counts)
        _, vectors = np.linalg.eigh(x.T @ x)
        self.axes = np.ascontiguousarray(vectors[:, ::-1][:, :dimensions])
        # equal rows are one point, so that they tie in every cosine
        nth: dict[bytes, int] = {}
        self.point = np.array([nth.setdefault(row.tobytes(), len(nth)) for row in counts], np.int64)
        _, first = np.unique(self.point, return_index=True)
        self.points = _unit(x[first] @ self.axes)
        self.labels = labels.astype(np.float32)

    def _weighted(self, counts: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(counts) * self.weight)

    def scores(self, counts: np.ndarray, neighbours: int, sharpness: float) -> np.ndarray:
        cosine = (_unit(self._weighted(counts) @ self.axes) @ self.points.T)[:, self.point]
        k = min(neighbours, len(self.point))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        least = np.take_along_axis(cosine, near, axis=1).min(axis=1, keepdims=True)
        for row in np.flatnonzero((cosine >= least).sum(axis=1) > k):  # more than k are as near as the k-th
            near[row] = np.argsort(-cosine[row], kind="stable")[:k]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** sharpness
        total = weight.sum(axis=1)
        return np.divide((weight * self.labels[near]).sum(axis=1), total, out=np.zeros(len(total)), where=total > 0)


def _score(space: Space, neighbours: int, sharpness: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [space.scores(block, neighbours, sharpness) for block in _blocks(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.concatenate(scores) if scores else [], pa.float64())], ["doc_id", "score"]
            )

    return run


def score(
    docs: DataFrame,
    labels: DataFrame,
    trained_on: Column,
    sample: int = 6000,
    dimensions: int = 64,
    neighbours: int = 31,
    sharpness: float = 4.0,
) -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 likelier) for each row. labels: doc_id, label.
    ``trained_on``: condition on doc_id of the labels that may be learned from."""
    own = documents(docs)
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"))
        .where("doc_id IS NOT NULL AND label IS NOT NULL")
        .where(trained_on)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    # at most ``sample`` rows: small enough to send to every executor
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = (
        own.join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "label")
        .agg(F.min("text").alias("text"))
        .mapInArrow(_sample_rows, "doc_id long, label int, counts binary")
        .toArrow()
        .sort_by("doc_id")
    )
    if not rows.num_rows:
        return own.select(public_id().alias("doc_id"), F.lit(0.0).alias("score"))
    counts = np.frombuffer(b"".join(rows.column("counts").to_pylist()), np.float32).reshape(rows.num_rows, FEATURES)
    space = Space(counts, rows.column("label").to_numpy(), dimensions, *document_frequencies(own))
    held = own.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _score(held.value, neighbours, sharpness)(batches)

    return own.mapInArrow(run, "doc_id long, score double").withColumn("doc_id", public_id())
