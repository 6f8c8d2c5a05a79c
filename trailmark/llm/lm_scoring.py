"""N-gram language-model scores of whole documents, from sharded Elias-Fano tries.

Model of order n: p(w | h) = (c(h w) + mu p(w | h')) / (c(h) + mu), h' being h without its first token, down to
p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)); all counts are over the whole training text. A text begins with a
start mark (a context only) and ends with an end token; h is the last n - 1 tokens, or all that there are.

Documents are packed where they are read into blocks of about ``BLOCK`` bytes of text, a compressed row
each, in a table: blocks are even whatever the ids or copies. A block asks for each of its distinct words
and n-grams once, with its own training counts of them, so a frequent word is one request a block however
often it occurs. Requests are dealt to shards by the hash of the word, or of an n-gram's first token (if
that holds more than a quarter of a shard's share of all tokens: by its first two). A shard adds up
the counts of all blocks, builds its trie and answers every request. A trie's levels are the first tokens, their
successors, and so on; each level has monotone pointers into the next, successors within their context
and quantised probabilities. Blocks score their documents from the answers; the count of a context of
several tokens is told from its own probability. Words have 64-bit hashes; those of one shard are told apart by 48 bits,
as first tokens by 40, successors of one context by 32 (a shard holds about a million).

The driver holds the tokens whose requests are split: fewer than four for each shard.

Nulls and edge cases: a null text is empty, and an empty text is one end token; repeated rows count and
are scored each; ids are only passed through, so null and shared ones change nothing; without training rows
all counts are 0; a row whose training flag is null is not trained on; a very long text is a block of its own;
an empty table gives an empty table. Only doc_id, text and the flag are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import U, distinct, mix, slices, utf8, word_hashes
from .common import shuffle_partitions, stored, workers_import
from .elias_fano import SUCCESSOR_BITS, Trie, quantise, restored

BLOCK = 12 << 20
SHARD_BYTES = 8_000_000  # of text a shard: about a million n-grams of an order that it is asked for
MU = 300.0
START, END = U(0x5354415254), U(0x454E44)  # no hash is this small but by chance of 2**-24

# low bits of a hash that requests leave out: of words, first tokens and successors
_WORD, _FIRST, _NEXT = U(16), U(24), U(32)


class Block:
    """Tokens and distinct grams of one block of documents."""

    def __init__(self, texts: pa.Array, train: np.ndarray) -> None:
        # arrays of a row a token are 32 bits wide and kept no longer than needed: two workers share an executor
        self.words, which, _ = distinct(self._hashes(texts), "quicksort")
        self.trained = np.repeat(train, self.n_tokens)
        self.token = which[:-1]
        start = which[-1]
        self.context = np.empty_like(self.token)
        self.context[1:] = self.token[:-1]
        self.context[self.last - self.n_tokens + 1] = start
        self.word_counts = np.bincount(self.token[self.trained], minlength=len(self.words)).astype(np.int64)

    def _hashes(self, texts: pa.Array) -> np.ndarray:
        """Of all tokens, and of the start mark."""
        data, offsets = utf8(texts)
        parts = [word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in slices(offsets)]
        self.n_tokens = np.concatenate([p[1] for p in parts]) + 1 if parts else np.zeros(0, np.int64)
        self.last = np.cumsum(self.n_tokens) - 1
        tokens = np.full(int(self.n_tokens.sum()) + 1, START, U)
        tokens[self.last] = END
        is_word = np.ones(len(tokens), bool)
        is_word[self.last] = is_word[-1] = False
        tokens[is_word] = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, U)
        return tokens

    def count_grams(self, order: int) -> None:
        """``grams``: a Level for each order from 2. Within a level, grams are in order of their parents."""
        first = self.last - self.n_tokens + 1
        at = np.arange(len(self.token), dtype=np.int32)  # ends of grams: tokens of texts that have begun long enough ago
        before = self.context
        self.grams: list[Level] = []
        for _ in range(2, order + 1):
            keys, which, _ = distinct(_pairs(before, self.token[at]), "quicksort")
            counts = np.bincount(which[self.trained[at]], minlength=len(keys)).astype(np.uint32)
            successors = (self.words >> _NEXT).astype(np.uint32)[keys & 0xFFFFFFFF]
            keys >>= 32
            self.grams.append(Level(at, which, keys.astype(np.int32), successors, counts))
            if len(self.grams) == order - 1:
                break
            del keys
            # the grams that end at the next token of the same text
            own = np.full(len(self.token), -1, np.int32)
            own[at] = which
            inside = np.append(False, own[:-1] >= 0)
            inside[first] = False
            at = np.flatnonzero(inside).astype(np.int32)
            before = own[at - 1]


def _pairs(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    out = high.astype(np.int64)
    out <<= 32
    out |= low
    return out


class Level:
    """The grams of one order in a block: ``at`` the tokens that end one, ``which`` each of them ends,
    ``parents`` (words, or grams of the order below), ``successors`` and training ``counts`` of each gram."""

    def __init__(self, at: np.ndarray, which: np.ndarray, parents: np.ndarray, successors: np.ndarray, counts: np.ndarray) -> None:
        self.at, self.which, self.parents, self.successors, self.counts = at, which, parents, successors, counts


def word_shard(words_: np.ndarray, shards: int) -> np.ndarray:
    return (mix(words_ ^ U(0x51ED270B)) % U(shards)).astype(np.int32)


def bigram_shard(contexts: np.ndarray, successors: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    split = np.isin(contexts >> _WORD, hot)
    dealt = contexts.copy()
    dealt[split] ^= mix(successors[split] + U(1))
    return word_shard(dealt, shards)


_ZSTD = pa.Codec("zstd", compression_level=1)


def _small(numbers: np.ndarray) -> bytes:
    """Mostly small numbers: their bytes by significance, compressed, after their count."""
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T)
    return len(numbers).to_bytes(8, "little") + _ZSTD.compress(planes, asbytes=True)


def _full(raw: bytes, kind: type) -> np.ndarray:
    n, width = int.from_bytes(raw[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(_ZSTD.decompress(raw[8:], n * width, asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


_BLOCK_ROW = "block long, n_bytes long, n_docs long, docs binary"


def _packed(size: int):
    """The documents of one task as blocks of about ``size`` bytes, each named by the number of its first row."""

    def row(parts: list[pa.RecordBatch], n_bytes: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        docs = table.drop_columns("row").combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5))) as out:
            out.write_table(docs)
        return pa.RecordBatch.from_arrays(
            [
                table.column("row").chunk(0)[:1],
                pa.array([n_bytes], pa.int64()),
                pa.array([table.num_rows], pa.int64()),
                pa.array([sink.getvalue().to_pybytes()], pa.binary()),
            ],
            ["block", "n_bytes", "n_docs", "docs"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n_bytes = [], 0
        for batch in batches:
            _, offsets = utf8(batch.column("text"))
            for i, j in slices(offsets, size):
                more = int(offsets[j] - offsets[i])
                if parts and n_bytes + more > size:
                    yield row(parts, n_bytes)
                    parts, n_bytes = [], 0
                parts.append(batch.slice(i, j - i))
                n_bytes += more
        if parts:
            yield row(parts, n_bytes)

    return run


def _docs(packed: pa.Scalar) -> tuple[pa.Table, Block]:
    docs = pa.ipc.open_stream(packed.as_buffer()).read_all()
    return docs, Block(docs.column("text").combine_chunks(), docs.column("train").to_numpy().astype(bool))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Block]]:
    for batch in batches:
        for number, packed in zip(batch.column("block").to_pylist(), batch.column("docs")):
            yield number, _docs(packed)[1]


def _by_number(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard that occurs, in order, with its places in order."""
    order = np.argsort(shard, kind="stable").astype(np.int32)
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    for at in np.split(order, cuts) if len(order) else []:
        yield int(shard[at[0]]), at


def _ask_words(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in _blocks(batches):
            rows = list(_by_number(word_shard(block.words, shards)))
            yield pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array([s for s, _ in rows], pa.int32()),
                    "block": pa.array([number] * len(rows), pa.int64()),
                    "words": pa.array([_small(block.words[at] >> _WORD) for _, at in rows], pa.binary()),
                    "counts": pa.array([_small(block.word_counts[at]) for _, at in rows], pa.binary()),
                }
            )
            del block, rows  # before the next one is read

    return run


_ANSWER = "block long, shard int, kind int, answer binary"
_WORDS = 1  # the kind of answers to words; that of answers to n-grams is their order
_FACT = f"{_ANSWER}, word long, n long, vocabulary long"
_TOTAL, _TOP = -1, -2  # kinds of rows without a block: a shard's sums, one of its most frequent words
_TOPS = 64


def _asked(batches: Iterator[pa.RecordBatch]) -> tuple[int, list[dict]]:
    """The one shard of a task and its requests."""
    rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["block"])
    return (rows[0]["shard"] if rows else 0), rows


def _answers(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    block, shard, kind, answer = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(block, pa.int64()), pa.array(shard, pa.int32()), pa.array(kind, pa.int32()), pa.array(answer, pa.binary())],
        ["block", "shard", "kind", "answer"],
    )


def _answer_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard, rows = _asked(batches)
    if not rows:
        return
    asked = [_full(r["words"], U) for r in rows]
    ends = np.cumsum([len(a) for a in asked])
    asked = np.concatenate(asked)
    counts = np.concatenate([_full(r["counts"], np.int64) for r in rows])
    own, which = np.unique(asked, return_inverse=True)
    total = np.bincount(which, counts, len(own)).astype(np.int64)
    none = pa.array([None], pa.int64())
    for r, part in zip(rows, np.split(total[which], ends[:-1])):
        answer = _answers([(r["block"], shard, _WORDS, _small(part))])
        yield pa.RecordBatch.from_arrays([*answer.columns, none, none, none], [*answer.schema.names, "word", "n", "vocabulary"])
    top = np.argsort(-total, kind="stable")[:_TOPS]
    n = len(top) + 1
    yield pa.RecordBatch.from_arrays(
        [
            pa.nulls(n, pa.int64()),
            pa.array(np.full(n, shard, np.int32)),
            pa.array([_TOTAL] + [_TOP] * len(top), pa.int32()),
            pa.nulls(n, pa.binary()),
            pa.array([None, *own[top].view(np.int64).tolist()], pa.int64()),
            pa.array([int(total.sum()), *total[top].tolist()], pa.int64()),
            pa.array([int((total > 0).sum())] + [None] * len(top), pa.int64()),
        ],
        ["block", "shard", "kind", "answer", "word", "n", "vocabulary"],
    )


_ASK = "shard int, block long, contexts binary, fans array<binary>, successors array<binary>, counts array<binary>"


def _gram_shards(block: Block, hot: np.ndarray, shards: int) -> list[np.ndarray]:
    """For each order the shard of each gram: that of its first two tokens."""
    first = block.grams[0]
    out = [bigram_shard(block.words[first.parents], first.successors, hot, shards)]
    for level in block.grams[1:]:
        out.append(out[-1][level.parents])
    return out


def _ask_grams(order: int, shards: int, hot: np.ndarray):
    """For each shard its first tokens and, order by order, how many grams go on from each gram of the order below
    (in order), their last tokens and counts."""

    def rows(number: int, block: Block) -> Iterator[pa.RecordBatch]:
        block.count_grams(order)
        dealt = [dict(_by_number(s)) for s in _gram_shards(block, hot, shards)]
        for s, at in dealt[0].items():
            own, first = np.unique(block.grams[0].parents[at], return_index=True)
            fans = [np.diff(np.append(first, len(at)))]
            successors, counts = [], []
            for k, level in enumerate(block.grams):
                at = dealt[k].get(s, np.zeros(0, np.int32))
                if k:  # parents that no gram goes on from have none
                    fans.append(np.bincount(np.searchsorted(above, level.parents[at]), minlength=len(above)))
                successors.append(level.successors[at].tobytes())
                counts.append(_small(level.counts[at]))
                above = at
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([s], pa.int32()),
                    pa.array([number], pa.int64()),
                    pa.array([_small(block.words[own] >> _FIRST)], pa.binary()),
                    pa.array([[_small(f.astype(np.uint32)) for f in fans]], pa.list_(pa.binary())),
                    pa.array([successors], pa.list_(pa.binary())),
                    pa.array([counts], pa.list_(pa.binary())),
                ],
                ["shard", "block", "contexts", "fans", "successors", "counts"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in _blocks(batches):
            yield from rows(number, block)
            del block  # before the next one is read

    return run


def _answer_grams(order: int, hot: np.ndarray, hot_counts: np.ndarray, mu: Sequence[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows = _asked(batches)
        if not rows:
            return
        numbers = [r["block"] for r in rows]
        contexts, above = np.unique(np.concatenate([_full(r["contexts"], U) for r in rows]), return_inverse=True)
        size = None  # of the contexts; first tokens have the sum of their successors
        levels, places = [], []
        for k in range(order - 1):
            fan = np.concatenate([_full(r["fans"][k], np.uint32) for r in rows])
            last = np.concatenate([np.frombuffer(r["successors"][k], np.uint32) for r in rows]).astype(U)
            counts = [_full(r["counts"][k], np.uint32) for r in rows]
            ends = np.cumsum([len(c) for c in counts])
            counts = np.concatenate(counts)
            for r in rows:
                r["fans"][k] = r["successors"][k] = r["counts"][k] = None
            # the distinct grams asked for: each is counted and looked up once
            grams, which, _ = distinct(np.repeat(above, fan).astype(U) << U(SUCCESSOR_BITS) | last, "quicksort")
            total = np.bincount(which, counts, len(grams))
            parent, last = (grams >> U(SUCCESSOR_BITS)).astype(np.int64), grams & U((1 << SUCCESSOR_BITS) - 1)
            if size is None:
                size = np.bincount(parent, total, len(contexts))
                _, here, there = np.intersect1d(contexts, hot >> (_FIRST - _WORD), return_indices=True)
                size[here] = hot_counts[there]
            levels.append((parent, last, total > 0, quantise(total / (size[parent] + mu[k]))))
            places.append((which, ends))
            above, size = which, total
        trie = _trie(contexts, levels)
        row = trie.first(contexts)
        for k, ((parent, last, _, _), (which, ends)) in enumerate(zip(levels, places)):
            row, code = trie.after(k, row[parent], last)
            for number, part in zip(numbers, np.split(which, ends[:-1])):
                yield _answers([(number, shard, k + 2, _small(code[part]))])
        trie.close()

    return run


def _trie(contexts: np.ndarray, levels: list[tuple]) -> Trie:
    """Of the grams that occur in training."""
    parent, _, seen, _ = levels[0]
    used = np.zeros(len(contexts), bool)
    used[parent[seen]] = True
    contexts = contexts[used]
    kept = []
    for parent, last, seen, codes in levels:
        number = np.cumsum(used) - 1  # of each gram of the order below among those that occur
        kept.append((number[parent[seen]], last[seen], codes[seen]))
        used = seen
    (first, last, codes), *deeper = kept
    return Trie(contexts[first], last, codes, deeper)


def _score(order: int, shards: int, hot: np.ndarray, total: int, vocabulary: int, mu: Sequence[float]):
    def run(key: tuple, blocks: pa.Table, answers: pa.Table) -> pa.Table:
        docs, block = _docs(blocks.column("docs")[0])
        block.count_grams(order)
        counts = np.zeros(len(block.words), np.int64)
        codes = [np.zeros(len(level.counts), np.uint16) for level in block.grams]
        dealt = [dict(_by_number(s)) for s in (word_shard(block.words, shards), *_gram_shards(block, hot, shards))]
        for s, kind, answer in zip(answers.column("shard").to_pylist(), answers.column("kind").to_pylist(), answers.column("answer")):
            if kind == _WORDS:
                counts[dealt[0][s]] = _full(answer.as_py(), np.int64)
            elif s in dealt[kind - 1]:
                codes[kind - 2][dealt[kind - 1][s]] = _full(answer.as_py(), np.uint16)
        del dealt
        size = counts.astype(float)
        size[np.searchsorted(block.words, START)] = counts[np.searchsorted(block.words, END)]
        share = (counts + 0.5) / (total + 0.5 * (vocabulary + 1))
        p = share[block.token]
        for level, code, m in zip(block.grams, codes, mu):
            own = restored(code)
            size = size[level.parents] + m
            now = p[level.at]
            now *= (m / size)[level.which]
            now += own[level.which]
            p[level.at] = now
            size = np.rint(own * size)  # how often each gram occurs
        first = block.last - block.n_tokens + 1
        sums = lambda x: np.add.reduceat(x, first)
        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "n_tokens": pa.array(block.n_tokens, pa.int64()),
                "n_known": pa.array(sums((counts > 0)[block.token].astype(np.int64)), pa.int64()),
                "train_tokens": pa.array(np.full(len(first), total), pa.int64()),
                "base_score": sums(np.log10(share)[block.token]),
                "score": sums(np.log10(p)),
            }
        )

    return run


def score(docs: DataFrame, trained_on: Column, mu: float | Sequence[float] = MU, order: int = 2) -> DataFrame:
    """doc_id, n_tokens, n_known (tokens met in training), train_tokens, base_score (unigrams only) and
    score (log10 probability of the text) for each row. ``trained_on``: condition on docs' columns of the
    rows that are learned from; ``order``: longest n-grams (2 or more); ``mu``: of bigrams, trigrams and so on."""
    if order < 2:
        raise ValueError("order must be 2 or more")
    mu = [float(mu)] * (order - 1) if isinstance(mu, (int, float)) else [float(m) for m in mu]
    if len(mu) != order - 1:
        raise ValueError("mu must have a value for each order from 2")
    spark = docs.sparkSession
    workers_import(spark)
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(trained_on, F.lit(False)).alias("train"),
        F.monotonically_increasing_id().alias("row"),
    )
    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    packed = stored(own.mapInArrow(_packed(BLOCK), _BLOCK_ROW), "blocks")
    size = packed.agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("blocks")).first()
    if not size.blocks:
        return spark.createDataFrame([], schema)
    shards = max(shuffle_partitions(spark), size.n_bytes // SHARD_BYTES + 1)
    blocks = packed.select("block", "docs")

    words_ = stored(
        blocks.mapInArrow(_ask_words(shards), "shard int, block long, words binary, counts binary")
        .repartitionById(shards, F.col("shard"))
        .mapInArrow(_answer_words, _FACT),
        "word-counts",
    )
    sums = words_.where(F.col("kind") == _TOTAL).agg(F.sum("n").alias("n"), F.sum("vocabulary").alias("vocabulary")).first()
    total, vocabulary = sums.n, sums.vocabulary
    often = words_.where((F.col("kind") == _TOP) & (F.col("n") > total / (4 * shards))).select("word", "n").toArrow()
    hot, hot_counts = often.column("word").to_numpy().view(U), often.column("n").to_numpy()
    if END >> _WORD in hot:  # as many texts begin as end
        hot, hot_counts = np.append(hot, START >> _WORD), np.append(hot_counts, hot_counts[hot == END >> _WORD])

    answers = (
        blocks.mapInArrow(_ask_grams(order, shards, hot), _ASK)
        .repartitionById(shards, F.col("shard"))
        .mapInArrow(_answer_grams(order, hot, hot_counts, mu), _ANSWER)
        .unionByName(words_.where(F.col("kind") == _WORDS).select("block", "shard", "kind", "answer"))
    )
    tasks = max(size.blocks, shuffle_partitions(spark))  # a block each, however many there are
    return (
        blocks.repartition(tasks, "block").groupBy("block")
        .cogroup(answers.repartition(tasks, "block").groupBy("block"))
        .applyInArrow(_score(order, shards, hot, total, vocabulary, mu), schema)
    )
