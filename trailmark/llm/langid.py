"""Language identification by segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary get a probability for each language. A word's probability
is the sum over all its segmentations into pieces of the product of their probabilities, by the
forward algorithm; a text's is the product over its words (runs of letters, lower case). Piece
probabilities are learned by expectation maximisation (forward and backward) on word counts.

Training uses a bounded sample: at most ``per_language`` documents of each language, those with the least
64-bit hashes of doc_id and text; equal rows count once there. Everything else covers all rows and whole texts.

Nulls and edge cases: a null text and one without a letter are ``und`` with score 0; rows with a null
lang are not learned from; ties go to the language first in order; without any training row all are
``und``; words of any length are solved whole (the sums are rescaled, so long ones do not underflow);
repeated rows get equal answers, as do rows that share a doc_id or have none, each by its own text; other columns are
dropped unless carried; an empty table gives an empty table. Only text and (for training rows) doc_id and lang are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .arrays import slices, utf8
from .common import documents, public_id, shuffle_partitions, stored
from .lattice import Pieces, matrices, vocabulary

VOCABULARY = "piece_bpe_32k.model"
UNKNOWN = 1e-9  # probability of a letter that is no piece
SLICE = 4 << 20  # bytes of text whose distinct words are scored together
SCALE = 200  # sums below 2**-SCALE are multiplied by 2**SCALE

_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(texts: list[str], pieces: Pieces) -> list[list[str]]:
    """The words of each text; long ones in the parts that lattice.py splits them into, whose
    probabilities multiply to the word's."""
    return pieces.short([_LETTERS.findall(t.lower()) for t in texts])


@lru_cache(maxsize=2)
def letter_pieces(path: str) -> Pieces:
    """The vocabulary's pieces that are runs of letters, without the word mark."""
    texts = {t.lstrip("▁").lower() for t in vocabulary(path)[0]}
    return Pieces(sorted(t for t in texts if t and _LETTERS.fullmatch(t)))


def _lift(ahead: np.ndarray, lifts: np.ndarray) -> None:
    """Multiplies by 2**SCALE the columns of ``ahead`` that have become too small, and counts that."""
    if ahead[0].min(initial=1.0) >= 2.0**-SCALE:
        return
    top = ahead.max(axis=0)
    low = (top > 0) & (top < 2.0**-SCALE)
    ahead[:, low] *= 2.0**SCALE
    lifts[low] += 1


def scaled_forward(pieces: Pieces, words: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """alpha and lifts: the first k letters of each word have probability alpha[k] * 2**(-SCALE * lifts[k])
    under each column of p (piece by language)."""
    n, length = words.shape
    alpha = np.zeros((length + 1, n, p.shape[1]))
    lifts = np.zeros(alpha.shape, np.int32)
    now = np.zeros(alpha.shape[1:], np.int32)
    alpha[0] = 1
    for i in range(length):
        # all sums that hold something already and are not done with are lifted together
        _lift(alpha[i : i + pieces.longest], now)
        if now.any():
            lifts[i] = now
        known = np.zeros(n, bool)
        for end, rows, piece in pieces.matches(words, i):
            alpha[end, rows] += alpha[i, rows] * p[piece]
            if end == i + 1:
                known[rows] = True
        alpha[i + 1, ~known] += alpha[i, ~known] * UNKNOWN
    lifts[length] = now
    return alpha, lifts


def forward(pieces: Pieces, words: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Probability of the first k letters of each word under each column of p; of a long word it may
    be below the least float."""
    alpha, lifts = scaled_forward(pieces, words, p)
    return np.ldexp(alpha, -SCALE * lifts)


def log_probability(pieces: Pieces, words: np.ndarray, lengths: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Log probability of each word under each column of p."""
    alpha, lifts = scaled_forward(pieces, words, p)
    rows = np.arange(len(words))
    return np.log(alpha[lengths, rows]) - SCALE * math.log(2) * lifts[lengths, rows]


def expected_counts(
    pieces: Pieces, words: np.ndarray, weight: np.ndarray, p: np.ndarray, lengths: np.ndarray | None = None
) -> np.ndarray:
    """Expected uses of each piece in all segmentations. p: a probability for each piece."""
    n, length = words.shape
    alpha, lifts = (x[:, :, 0] for x in scaled_forward(pieces, words, p[:, None]))
    last = np.full(n, length) if lengths is None else lengths
    own = np.arange(n)
    beta = np.zeros((length + 1, n))
    beta[last, own] = 1
    counts = np.zeros(len(p))
    total, total_lifts = alpha[last, own], lifts[last, own]
    beta_lifts = np.zeros(n, np.int32)
    for i in range(length - 1, -1, -1):
        _lift(beta[i + 1 : i + 1 + pieces.longest], beta_lifts)
        shift = SCALE * (total_lifts - lifts[i] - beta_lifts)
        known = np.zeros(n, bool)
        for end, rows, piece in pieces.matches(words, i):
            onward = p[piece] * beta[end, rows]
            beta[i, rows] += onward
            share = alpha[i, rows] * onward / total[rows]
            if shift.any():
                share = np.ldexp(share, shift[rows])
            counts += np.bincount(piece, share * weight[rows], len(p))
            if end == i + 1:
                known[rows] = True
        beta[i, ~known] += UNKNOWN * beta[i + 1, ~known]
    return counts


def _texts(batch: pa.RecordBatch, size: int = SLICE) -> Iterator[tuple[int, int, list[str]]]:
    _, offsets = utf8(batch.column("text"))
    for i, j in slices(offsets, size):
        yield i, j, [t or "" for t in batch.column("text").slice(i, j - i).to_pylist()]


def _word_counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = letter_pieces(path)
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            counts: Counter[tuple[str, str]] = Counter()
            for i, _, texts in _texts(batch):
                for k, words in enumerate(words_of(texts, pieces)):
                    counts.update((langs[i + k], w) for w in words)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())],
                ["lang", "word", "n"],
            )

    return run


def _expectation(path: str, langs: list[str], p: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = letter_pieces(path)
        counts = np.zeros_like(p)
        for batch in batches:
            lang = batch.column("lang").to_pylist()
            words = batch.column("word").to_pylist()
            n = batch.column("n").to_numpy()
            which = np.array([langs.index(x) for x in lang])
            for g in np.unique(which):
                own = np.flatnonzero(which == g)
                for at, matrix, lengths in matrices([words[k] for k in own]):
                    counts[:, g] += expected_counts(pieces, matrix, n[own[at]].astype(float), p[:, g], lengths)
        piece, g = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(g.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(counts[piece, g])], ["g", "piece", "c"]
        )

    return run


def learn(training: DataFrame, path: str, per_language: int = 3000, rounds: int = 3) -> tuple[list[str], np.ndarray]:
    """training: doc_id, text, lang. The languages in order and the probabilities (piece by language;
    bounded by vocabulary and languages)."""
    known = training.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    langs, n_pieces = sorted(sizes), len(letter_pieces(path).texts)
    p = np.full((n_pieces, len(langs)), 1 / n_pieces)
    if not langs:
        return langs, p
    # a little more than wanted by a threshold on the hash, then the least of them
    share = {g: min(1.0, 1.2 * per_language / n + 1e-6) for g, n in sizes.items()}
    ends = {g: (1 << 63) - 1 if x == 1 else int(x * 2**64) - (1 << 63) for g, x in share.items()}
    end = F.create_map(*[x for g, e in ends.items() for x in (F.lit(g), F.lit(e).cast("long"))])
    hashed = known.withColumn("hash", F.xxhash64("doc_id", "text")).where(F.col("hash") <= end[F.col("lang")])
    once = hashed.groupBy("lang", "hash").agg(F.max("text").alias("text"))
    least = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))
    chosen = once.withColumn("nth", least).where(F.col("nth") <= per_language)
    words = stored(
        chosen.mapInArrow(_word_counts(path), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")),
        "language-words",
    )
    # few rows, but much work on each: one part for each core at least
    words = words.repartition(max(shuffle_partitions(training.sparkSession), training.sparkSession.sparkContext.defaultParallelism), "word")
    for _ in range(rounds):
        counts = (
            words.mapInArrow(_expectation(path, langs, p), "g int, piece int, c double")
            .groupBy("g", "piece")
            .agg(F.sum("c").alias("c"))
            .toArrow()
        )
        p = np.full_like(p, 0.01)
        p[counts.column("piece").to_numpy(), counts.column("g").to_numpy()] += counts.column("c").to_numpy()
        p /= p.sum(axis=0)
    return langs, p


def text_scores(texts: list[str], pieces: Pieces, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of each text under each language, and its number of letters."""
    listed = words_of(texts, pieces)
    count = np.fromiter(map(len, listed), np.int64, len(listed))
    flat = np.empty(int(count.sum()), object)
    flat[:] = [w for words in listed for w in words]
    which, distinct = pd.factorize(flat)
    word = np.zeros((len(distinct) + 1, p.shape[1]))
    for at, matrix, lengths in matrices(list(distinct)):
        word[at] = log_probability(pieces, matrix, lengths, p)
    letters = np.array([sum(map(str.isalpha, w)) for w in distinct], np.int64)
    word[:-1][letters == 0] = 0
    owner = np.repeat(np.arange(len(texts)), count)
    totals = np.stack([np.bincount(owner, word[which, g], len(texts)) for g in range(p.shape[1])], axis=1)
    return totals, np.bincount(owner, letters[which], len(texts)).astype(np.int64)


def _predict(path: str, langs: list[str], p: np.ndarray, carried: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = letter_pieces(path)
        for batch in batches:
            names, scores, each, letters = [], [np.zeros(0)], [np.zeros(0)], [np.zeros(0, np.int64)]
            for _, _, texts in _texts(batch):
                totals, n = text_scores(texts, pieces, p)
                best = totals.argmax(axis=1)
                top = totals[np.arange(len(texts)), best]
                shares = 1 / np.exp(totals - top[:, None]).sum(axis=1)
                names += [langs[b] if k else "und" for b, k in zip(best, n)]
                scores.append(np.where(n > 0, shares, 0.0))
                each.append(top / math.log(10))
                letters.append(n)
            kept = [c for c in ("doc_id", *carried) if c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, kept), pa.array(names, pa.string()), *(pa.array(np.concatenate(x)) for x in (scores, each, letters))],
                [*kept, "lang_pred", "score", "log10_p", "letters"],
            )

    return run


def in_language(
    wanted: Sequence[str] | None = None, least_share: float = 0.5, least_letter: float = -2.5, margin: float = 6.0
) -> Column:
    """Of rows of ``identify``: whether the text is in one of the wanted languages (default: any learned one), with
    at least that share of the likelihood, and not letters of another kind: a model that gives every letter
    10**least_letter must not be 10**margin times likelier than the language."""
    own = F.col("lang_pred") != "und" if wanted is None else F.col("lang_pred").isin(list(wanted))
    return own & (F.col("score") >= least_share) & (F.col("log10_p") >= least_letter * F.col("letters") - margin)


def identify(
    docs: DataFrame,
    trained_on: Column,
    vocabulary_path: str | None = None,
    per_language: int = 3000,
    carry: Sequence[str] = (),
    with_text: bool = False,
) -> DataFrame:
    """doc_id, lang_pred, score (the language's share of the likelihood, 0 to 1), log10_p (the language's log10
    probability of the text) and letters for each row, with its text and columns to carry if asked for.
    ``trained_on``: condition of the rows whose lang may be learned from."""
    path = vocabulary_path or public_tokenizers.path(VOCABULARY)
    own = documents(docs, carry)
    labelled = docs.where(trained_on).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    langs, p = learn(labelled, path, per_language)
    kept = [*(["text"] if with_text else []), *(["carry"] if carry else [])]
    answers = "lang_pred string, score double, log10_p double, letters long"
    if langs:
        kinds = {f.name: f.dataType.simpleString() for f in own.schema.fields}
        own = own.mapInArrow(_predict(path, langs, p, kept), ", ".join(["doc_id long", *(f"{c} {kinds[c]}" for c in kept), answers]))
    else:
        own = own.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "log10_p": F.lit(0.0), "letters": F.lit(0).cast("long")})
    columns = [*(["text"] if with_text else []), *(["carry.*"] if carry else []), "lang_pred", "score", "log10_p", "letters"]
    return own.select(public_id().alias("doc_id"), *columns)
