"""Word lattices over a fixed piece vocabulary, batched in numpy.

Words of equal length form a matrix of code points and advance together. At each start the
substring hashes of all rows grow by one code point a step and probe the sorted keys of the pieces'
prefixes; rows whose substring begins no piece drop out.

A word of more than ``WORD_LIMIT`` code points is split where no piece reaches across, so every
segmentation of it breaks there and its parts are solved each by itself without loss. Parts that are
still long share a matrix, filled up with ``PAD``, which no piece holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import sentencepiece

U = np.uint64
_STEP = U(0x9E3779B97F4A7C15)
WORD_LIMIT = 64  # code points; a longer word is split where no piece reaches across
PAD = 0x110000  # no code point
CELLS = 1 << 20  # of a matrix of long words


def grow(h: np.ndarray, code_points: np.ndarray) -> np.ndarray:
    return (h ^ (code_points.astype(U) + U(1))) * _STEP ^ ((h + code_points.astype(U)) >> U(31))


class Pieces:
    """texts: the pieces, distinct; a piece is known by its place."""

    def __init__(self, texts: list[str]) -> None:
        self.texts = texts
        value: dict[int, int] = {}
        for i, text in enumerate(texts):
            h = np.zeros(1, U)
            codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            for k in range(len(codes)):
                h = grow(h, codes[k : k + 1])
                value.setdefault(int(h[0]), -1)
            value[int(h[0])] = i
        self.longest = max(map(len, texts), default=1)
        self.keys = np.array(sorted(value), U)
        self.piece = np.array([value[int(k)] for k in self.keys], np.int32)

    def probe(self, h: np.ndarray) -> np.ndarray:
        """Piece for each hash; -1: only the beginning of one, -2: nothing."""
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.piece[at], -2)

    def matches(self, words: np.ndarray, start: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """words: rows by code points. (end, rows, their pieces) of all pieces that begin at start."""
        rows = np.arange(len(words))
        h = np.zeros(len(words), U)
        for end in range(start + 1, min(words.shape[1], start + self.longest) + 1):
            h = grow(h, words[rows, end - 1])
            piece = self.probe(h)
            alive = piece >= -1
            rows, h, piece = rows[alive], h[alive], piece[alive]
            if not len(rows):
                return
            whole = piece >= 0
            if whole.any():
                yield end, rows[whole], piece[whole]

    def split(self, words: list[str]) -> list[list[str]]:
        """The parts of each word between the places that no piece reaches across."""
        joined = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(w) for w in words])
        codes = np.insert(joined, ends, PAD) if len(words) else joined
        reach = np.arange(1, len(codes) + 1)
        rows = np.arange(len(codes))
        h = np.zeros(len(codes), U)
        for k in range(self.longest):
            inside = rows + k < len(codes)
            rows, h = rows[inside], h[inside]
            h = grow(h, codes[rows + k])
            piece = self.probe(h)
            alive = piece >= -1
            rows, h, piece = rows[alive], h[alive], piece[alive]
            whole = rows[piece >= 0]
            reach[whole] = whole + k + 1
        far = np.maximum.accumulate(reach)
        cuts = np.flatnonzero(far <= np.arange(1, len(codes) + 1)) + 1
        out = []
        for i, word in enumerate(words):
            first = int(ends[i]) - len(word) + i  # one PAD after each word before
            a, b = np.searchsorted(cuts, [first, first + len(word)], "right")
            at = [0, *(cuts[a:b] - first).tolist()]
            if at[-1] < len(word):
                at.append(len(word))
            out.append([word[x:y] for x, y in zip(at[:-1], at[1:])])
        return out

    def short(self, listed: list[list[str]]) -> list[list[str]]:
        """Lists of words with the long ones split."""
        long = list({w for words in listed if max(map(len, words), default=0) > WORD_LIMIT for w in words if len(w) > WORD_LIMIT})
        if not long:
            return listed
        parts = dict(zip(long, self.split(long)))
        return [[p for w in words for p in (parts[w] if len(w) > WORD_LIMIT else (w,))] for words in listed]


def matrices(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, matrix of code points, lengths): words up to WORD_LIMIT by length, longer ones with
    others of up to twice their length, filled up with PAD."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    usual = np.flatnonzero(lengths <= WORD_LIMIT)
    for at, matrix in by_length([words[i] for i in usual]):
        yield usual[at], matrix, np.full(len(at), matrix.shape[1])
    long = np.flatnonzero(lengths > WORD_LIMIT)
    long = long[np.argsort(lengths[long], kind="stable")]
    while len(long):
        fits = (lengths[long] <= 2 * lengths[long[0]]) & (lengths[long] * np.arange(1, len(long) + 1) <= CELLS)
        at, long = np.split(long, [max(1, int(np.argmin(fits)) if not fits.all() else len(long))])
        matrix = np.full((len(at), int(lengths[at].max())), PAD, np.uint32)
        for row, i in zip(matrix, at):
            row[: lengths[i]] = np.frombuffer(words[i].encode("utf-32-le", "surrogatepass"), np.uint32)
        yield at, matrix, lengths[at]


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix of code points) of the words of each length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    cut = np.flatnonzero(np.diff(lengths[order])) + 1
    for at in np.split(order, cut) if len(order) else ():
        n = int(lengths[at[0]])
        codes = "".join([words[i] for i in at]).encode("utf-32-le", "surrogatepass")
        yield at, np.frombuffer(codes, np.uint32).reshape(len(at), n)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Of a SentencePiece model file: the texts, ids and scores of the ordinary pieces, and the ids of
    the 256 byte pieces."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    ids = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
    return [model.id_to_piece(i) for i in ids], np.array(ids, np.int32), np.array([model.get_score(i) for i in ids]), byte_ids
