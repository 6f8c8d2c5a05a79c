"""Encoding to and decoding from the pieces of a SentencePiece vocabulary, by batched Viterbi.

A text is cut before each space; a space becomes the word mark, which also goes before the text. The
segmentation of each such word, however long, is the one with the greatest sum of piece scores (of
equals, the one with the longer pieces first). Words of equal length advance together: substring hashes probe the
sorted piece keys, and vectorised maxima store backpointers. A code point without a piece becomes
its UTF-8 byte pieces, so decoding gives back every text exactly. No normalisation is applied.

Nulls and edge cases: a null text has null ids and decodes to null; an empty one has no ids; repeated
rows give equal rows; an empty table gives an empty table. Other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import slices, utf8
from .common import documents, public_id
from .lattice import Pieces, matrices, vocabulary

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
SLICE = 4 << 20
_RAW = 1 << 24  # added to a code point that is spelt in bytes
_LITERAL = "\udc00"  # a mark in the text itself, which stands for no space; no valid text holds this one


@lru_cache(maxsize=2)
def _model(path: str) -> tuple[Pieces, np.ndarray, np.ndarray, np.ndarray]:
    texts, ids, scores, byte_ids = vocabulary(path)
    return Pieces(texts), ids, scores, byte_ids


def words_of(text: str) -> list[str]:
    """The text's words, each with its mark."""
    return [MARK + w for w in text.replace(MARK, _LITERAL).split(" ")]


def best_paths(pieces: Pieces, scores: np.ndarray, words: np.ndarray, lengths: np.ndarray | None = None) -> np.ndarray:
    """The best segmentation of each row (of its first ``lengths`` code points), right to left, filled
    with -1. A value from _RAW on is a code point to spell in bytes."""
    n, length = words.shape
    unknown = scores.min() - 10
    best = np.full((length + 1, n), -np.inf)
    best[0] = 0
    back = np.zeros((length + 1, n), np.int16 if length < 1 << 15 else np.int32)
    used = np.full((length + 1, n), -1, np.int32)
    for i in range(length):
        known = np.zeros(n, bool)
        for end, rows, piece in pieces.matches(words, i):
            score = best[i, rows] + scores[piece]
            better = score > best[end, rows]
            rows, piece = rows[better], piece[better]
            best[end, rows], back[end, rows], used[end, rows] = score[better], i, piece
            if end == i + 1:
                known[rows] = True
        score = best[i] + unknown
        spelt = score > best[i + 1]
        best[i + 1, spelt], back[i + 1, spelt] = score[spelt], i
        used[i + 1, spelt] = _RAW + words[spelt, i].astype(np.int32)
    path = np.full((n, length), -1, np.int32)
    at = np.full(n, length) if lengths is None else lengths.copy()
    rows = np.arange(n)
    for step in range(length):
        path[rows, step] = used[at[rows], rows]
        at[rows] = back[at[rows], rows]
        rows = rows[at[rows] > 0]
        if not len(rows):
            break
    return path


def _gather(values: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The value runs of ``which``, one after another, and their lengths."""
    size = np.diff(offsets)[which]
    total = int(size.sum())
    at = np.arange(total) + np.repeat(offsets[which] - (np.cumsum(size) - size), size)
    return values[at], size


def _spell(tokens: np.ndarray, counts: np.ndarray, ids: np.ndarray, byte_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece places to ids, code points from _RAW on to byte ids; counts: tokens of each word."""
    raw = np.flatnonzero(tokens >= _RAW)
    out = ids[np.where(tokens >= _RAW, 0, tokens)]
    if not len(raw):
        return out, counts
    spelt = [byte_ids[list((MARK if chr(c) == _LITERAL else chr(c)).encode())] for c in (tokens[raw] - _RAW).tolist()]
    width = np.ones(len(tokens), np.int64)
    width[raw] = [len(s) for s in spelt]
    wide = np.repeat(out, width)
    first = np.cumsum(width) - width
    for r, s in zip(raw, spelt):
        wide[first[r] : first[r] + len(s)] = s
    word = np.repeat(np.arange(len(counts)), counts)
    return wide, np.bincount(word, width, len(counts)).astype(np.int64)


def encode_texts(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids and the number of ids of each text."""
    pieces, ids, scores, byte_ids = _model(path)
    listed = pieces.short([words_of(t) if t else [] for t in texts])
    n_words = np.fromiter(map(len, listed), np.int64, len(listed))
    flat = np.empty(int(n_words.sum()), object)
    flat[:] = [w for words in listed for w in words]
    if any(MARK in t for t in texts if t):  # pandas can't tell words with a lone surrogate apart
        seen: dict[str, int] = {}
        which = np.array([seen.setdefault(w, len(seen)) for w in flat], np.int64)
        distinct = list(seen)
    else:
        which, distinct = pd.factorize(flat)
    order, tokens, counts = [], [], []
    for at, matrix, lengths in matrices(list(distinct)):
        path_ = best_paths(pieces, scores, matrix, lengths)[:, ::-1]
        kept = path_ >= 0
        order.append(at)
        tokens.append(path_[kept])
        counts.append(kept.sum(axis=1))
    if not order:
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    spelt, counts = _spell(np.concatenate(tokens), np.concatenate(counts), ids, byte_ids)
    place = np.empty(len(distinct), np.int64)
    place[np.concatenate(order)] = np.arange(len(distinct))
    out, size = _gather(spelt, np.append(0, np.cumsum(counts)), place[which])
    return out, np.bincount(np.repeat(np.arange(len(texts)), n_words), size, len(texts)).astype(np.int64)


@lru_cache(maxsize=2)
def _spellings(path: str) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of each id, one after another, and their offsets."""
    texts, ids, _, byte_ids = vocabulary(path)
    spelt = {int(i): t.replace(MARK, " ").encode() for i, t in zip(ids, texts)}
    spelt |= {int(i): bytes([b]) for b, i in enumerate(byte_ids)}
    parts = [spelt.get(i, b"") for i in range(max(spelt) + 1)]
    return np.frombuffer(b"".join(parts), np.uint8), np.append(0, np.cumsum([len(p) for p in parts]))


def decode_ids(ids: np.ndarray, counts: np.ndarray, path: str) -> list[str]:
    data, size = _gather(*_spellings(path), ids)
    ends = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(counts))]
    raw = data.tobytes()
    return [raw[a + 1 : b].decode("utf-8") for a, b in zip(ends[:-1], ends[1:])]  # without the first mark


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            _, offsets = utf8(text)
            for i, j in slices(offsets, SLICE):
                texts = text.slice(i, j - i)
                ids, counts = encode_texts(texts.to_pylist(), path)
                ends = np.append(0, np.cumsum(counts)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends, mask=np.append(texts.is_null().to_numpy(False), False)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), lists], ["doc_id", "ids"])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            sizes = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
            step = max(1, int(len(batch) * (1 << 20) / max(1, sizes.sum())))
            texts: list[str] = []
            for i in range(0, len(batch), step):
                texts += decode_ids(lists.slice(i, step).flatten().to_numpy(), sizes[i : i + step], path)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), lists, pa.array(texts, pa.string(), mask=lists.is_null().to_numpy(False))], ["doc_id", "ids", "text"]
            )

    return run


def encode(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) for each row."""
    path = vocabulary_path or public_tokenizers.path(VOCABULARY)
    return documents(docs).mapInArrow(_encode(path), "doc_id long, ids array<int>").withColumn("doc_id", public_id())


def decode(encoded: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """encoded: doc_id, ids. Adds the text that the ids spell."""
    path = vocabulary_path or public_tokenizers.path(VOCABULARY)
    return encoded.select("doc_id", "ids").mapInArrow(_decode(path), "doc_id long, ids array<int>, text string")
