"""Best-fit packing of token sequences, by large-item matching.

Texts are tokenized whole, get one end id, and are cut into pieces only where they exceed a sequence
(the first piece is the shorter one). How pieces are packed depends on their lengths alone, so the
plan is made from the number of pieces of each length: at most ``capacity`` rows, whatever the
table's size. Pieces above a third of the capacity pair at most twice per sequence: the longest
left is matched with the longest that fits beside it. Smaller ones, longest first, go to the
fullest sequences that still take them. The plan says, for ranges of ranks among the pieces of one
length, which sequences and places they get; Spark ranks the pieces (in groups by length and a hash,
with offsets from the counts, so that one frequent length is many groups) and joins the plan.

Nulls and edge cases: a null text is empty and still has the end id; ``<|endoftext|>`` in a text is
one token, as the vocabulary's own tokenizer has it; rows that share a doc_id are
packed each; pieces of one length are interchangeable and ranked in groups by a hash of their row's number
in the written table of pieces, so rows without ids and repeated rows are spread as all others, then by doc_id, piece
and checksum; an empty table gives an empty table. Only doc_id and text are read.
"""

from __future__ import annotations

import base64
import heapq
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, public_id, shuffle_partitions, stored

VOCABULARY = "byte_bpe_50k.tiktoken"  # byte_bpe_50k.json as ranks: the same ids, several times faster
ADDED, ADDED_ID = "<|endoftext|>", 50256  # the added token of byte_bpe_50k.json: found before all else
END = 2
_CACHE = 400_000  # words whose ids a worker remembers


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Words(dict):
    """Ids (little-endian 32-bit) of words met before."""

    def __init__(self, encode, before: str) -> None:
        self._encode, self._before = encode, before

    def __missing__(self, word: str) -> bytes:
        if len(self) >= _CACHE:
            self.clear()
        ids = pack_ids(self._encode(self._before + word))
        self[word] = ids
        return ids


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """A function from text to its ids as little-endian 32-bit bytes."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    first, spaced = _Words(encode, ""), _Words(encode, " ")

    added = ADDED_ID.to_bytes(4, "little")

    def ids(text: str) -> bytes:
        return added.join(map(plain, text.split(ADDED))) if ADDED in text else plain(text)

    def plain(text: str) -> bytes:
        # a token never reaches over the beginning of a run of white space, so single spaces are safe cuts
        if "  " in text:
            return pack_ids(encode(text))
        head, *rest = text.split(" ")
        return first[head] + b"".join(map(spaced.__getitem__, rest))

    return ids


def _pieces(path: str, capacity: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path)
        end = END.to_bytes(4, "little")
        for batch in batches:
            docs, nth, starts, lengths, sums, kept = [], [], [], [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = encode(text.as_py() or "") + end
                n, at, k = len(ids) // 4, 0, 0
                while at < n:
                    size = (n - at) % capacity or capacity
                    part = ids[4 * at : 4 * (at + size)]
                    docs.append(doc), nth.append(k), starts.append(at), lengths.append(size), sums.append(zlib.crc32(part))
                    kept.append(part if keep_ids else None)
                    at, k = at + size, k + 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(docs, pa.int64()),
                    pa.array(nth, pa.int32()),
                    pa.array(starts, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array(sums, pa.int64()),
                    pa.array(kept, pa.binary()),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32", "ids"],
            )

    return run


Run = tuple[int, int, int, int, int, int]  # length, first rank, end rank, first sequence, pieces in each, first place


def plan(counts: dict[int, int], capacity: int) -> list[Run]:
    """Where the pieces of each length go, from the number of pieces of each length."""
    left = {n: c for n, c in counts.items() if c > 0}
    rank = dict.fromkeys(left, 0)
    runs: list[Run] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: (first sequence, number of sequences)
    sequences = 0

    def put(length: int, pieces: int, sequence: int, each: int, place: int) -> None:
        runs.append((length, rank[length], rank[length] + pieces, sequence, each, place))
        rank[length] += pieces
        left[length] -= pieces

    def leave(gap: int, sequence: int, n: int) -> None:
        if n and gap:
            gaps.setdefault(gap, []).append((sequence, n))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        beside = [b for b in large if b <= capacity - a and left[b] > (b == a)]
        if not left[a]:
            large.pop()
        elif beside:
            b = beside[-1]
            n = left[a] // 2 if a == b else min(left[a], left[b])
            put(a, n, sequences, 1, 0)
            put(b, n, sequences, 1, a)
            leave(capacity - a - b, sequences, n)
            sequences += n
        else:
            n = left[a]
            put(a, n, sequences, 1, 0)
            leave(capacity - a, sequences, n)
            sequences += n

    heap = sorted(gaps)
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        passed = []
        while left[length]:
            while heap and (heap[0] < length or not gaps.get(heap[0])):
                gap = heapq.heappop(heap)
                if gaps.get(gap):
                    passed.append(gap)
            if heap:
                gap = heap[0]
                sequence, n = gaps[gap].pop()
            else:
                gap, sequence = capacity, sequences
                n = -(-left[length] // (capacity // length))
                sequences += n
            each = gap // length
            full = min(n, left[length] // each)
            if full:
                put(length, full * each, sequence, each, capacity - gap)
            rest = left[length] if full < n else 0
            if rest:
                put(length, rest, sequence + full, each, capacity - gap)
            for g, at, m in (
                (gap - each * length, sequence, full),
                (gap - rest * length, sequence + full, 1 if rest else 0),
                (gap, sequence + full + (1 if rest else 0), n - full - (1 if rest else 0)),
            ):
                if m and g:
                    if not gaps.get(g):
                        heapq.heappush(heap, g)
                    leave(g, at, m)
        for gap in passed:
            heapq.heappush(heap, gap)
    return runs


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64("row"), F.lit(parts))


def pack(docs: DataFrame, capacity: int = 1024, vocabulary_path: str | None = None, keep_ids: bool = True) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, with
    ``keep_ids``, its ids (binary, little-endian unsigned 32-bit)."""
    path = vocabulary_path or public_tokenizers.path(VOCABULARY)
    own = documents(docs)
    spark = own.sparkSession
    cut = own.mapInArrow(
        _pieces(path, capacity, keep_ids), "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
    )
    # the number is written with its row, so it stays the same whatever is read or computed again
    numbered = (cut if keep_ids else cut.drop("ids")).withColumn("row", F.monotonically_increasing_id())
    pieces = stored(numbered, "pieces")

    part = _part(shuffle_partitions(spark)).alias("part")
    sizes = pieces.groupBy("length", part).count()  # capacity times parts rows at most
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs = spark.createDataFrame(
        plan(counts, capacity), "length long, first long, past long, sequence long, each long, place long"
    )
    own_rank = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = (
        pieces.select("*", part)
        .withColumn("nth", own_rank)
        .join(sizes, ["length", "part"])
        .withColumn("rank", F.col("nth") + F.col("before"))
    )
    placed = ranked.join(F.broadcast(runs.withColumnRenamed("length", "of")), F.expr("length = of AND rank >= first AND rank < past"))
    columns = ["piece", "start", "length", "ids_crc32"]
    return placed.select(
        public_id().alias("doc_id"),
        *columns,
        F.expr("sequence + (rank - first) div each").alias("sequence_id"),
        F.expr("place + (rank - first) % each * length").alias("offset"),
        *(["ids"] if keep_ids else []),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from ``pack`` with ids: sequence_id, length and ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("length"), F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids")
    )
