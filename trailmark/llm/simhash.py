"""SimHash near-duplicates by deletion variants.

A fingerprint is cut into two segments of 32 bits. Of two fingerprints that differ in at most two
bits, one segment differs in at most one, so both agree on a variant of it: the segment with one bit
left out. Each distinct fingerprint is indexed under its 64 variants, groups of equal variants
come together by an equality join, and their pairs are verified on all 64 bits.

A variant shared by more than ``GROUP`` fingerprints (near copies of one text) is not expanded into
pairs. Its members are indexed once more by whole fingerprint: under themselves and their 64
one-bit neighbours. Two fingerprints within two bits share such a key, any two that share one are
within two bits, and a key has 65 members at most; each is linked to the least of them. No group
grows with the table, and no link is lost.

Nulls and edge cases: a null text, an empty one and one without words have fingerprint zero and link
like any other; equal fingerprints always link; rows that share a doc_id, or have none, link by their
fingerprints alone and keep a row each; a null doc_id sorts first; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, public_id, stored
from .components import components

SEED = 42
GROUP = 16  # fingerprints of a variant that are compared pair by pair


def fingerprint(text: bytes, words: int) -> int:
    """Majority bits of the XXH64 of all word shingles."""
    tokens = text.lower().split()  # of bytes: A-Z, and runs of 0x20 and 0x09-0x0D
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    width = np.fromiter(map(len, tokens), np.int64, len(tokens))
    end = np.cumsum(width + 1) - 1
    start = end - width
    n = max(1, len(tokens) - words + 1)
    last = end[words - 1 :] if len(tokens) >= words else end[-1:]
    hashed = xxhash.xxh64_intdigest
    h = np.array([hashed(joined[a:b], SEED) for a, b in zip(start[:n].tolist(), last.tolist())], "<u8")
    bits = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        block = np.unpackbits(h[i : i + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64)
        bits += block.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * bits > n, bitorder="little").view("<u8")[0])


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", words) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("hash"), pa.array(np.array(prints, np.uint64).view(np.int64))],
                ["doc_id", "hash", "fp"],
            )

    return run


def _variants(prints: DataFrame) -> DataFrame:
    """(rep, fp, variant): a long of segment and bit (6 bits) and the 31 bits that are left."""
    part = "CASE WHEN i < 32 THEN fp & 4294967295L ELSE shiftrightunsigned(fp, 32) END"
    return prints.select("rep", "fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")).selectExpr(
        "rep",
        "fp",
        f"""shiftleft(cast(i AS bigint), 31)
            | (({part}) & (shiftleft(1L, i % 32) - 1))
            | shiftleft(shiftrightunsigned({part}, i % 32 + 1), i % 32) AS variant""",
    )


def links(prints: DataFrame, max_bits: int) -> DataFrame:
    """prints: rep, fp, distinct by fp. Links u, v between reps within ``max_bits`` bits, enough to
    connect all that are."""
    variants = _variants(prints)
    # counted before the shuffle and joined as a table, so a frequent variant is split, too; the counts
    # grow with the documents, so they are never broadcast
    sizes = stored(variants.groupBy("variant").agg(F.count("*").alias("n")).where("n > 1"), "variant-sizes")
    shared = stored(variants.join(sizes.hint("merge"), "variant"), "variants")
    pairs = (
        shared.where(F.col("n") <= GROUP)
        .groupBy("variant")
        .agg(F.collect_list(F.struct("rep", "fp")).alias("g"))
        .select("g", F.explode("g").alias("a"))
        .select("a", F.explode("g").alias("b"))
        .where(f"a.rep < b.rep AND bit_count(a.fp ^ b.fp) <= {max_bits}")
        .selectExpr("a.rep AS u", "b.rep AS v")
    )
    near = "array(fp)" if max_bits < 2 else "concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))"
    if max_bits == 1:  # one bit left out of the whole fingerprint
        near = "transform(sequence(0, 63), i -> struct(i, fp & ~shiftleft(1L, i)))"
    stars = (
        shared.where(F.col("n") > GROUP)
        .select("rep", "fp")
        .distinct()
        .selectExpr("rep", f"explode({near}) AS near")
        .groupBy("near")
        .agg(F.collect_set("rep").alias("g"))
        .where("size(g) > 1")
        .selectExpr("explode(g) AS u", "array_min(g) AS v")
        .where("u <> v")
    )
    return pairs.unionByName(stars)


def _labelled(docs: DataFrame, words: int, max_bits: int) -> DataFrame:
    """doc_id, hash of the text, fp and component (its least fingerprint) for each row, and component_id."""
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits must be 0, 1 or 2: two segments with one bit left out find no more")
    own = documents(docs).withColumn("hash", F.xxhash64("text"))
    prints = stored(own.mapInArrow(_fingerprints(words), "doc_id long, hash long, fp long"), "fingerprints")
    # tables on both sides of the joins by fingerprint: a frequent one can then be split
    reps = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "representatives")
    # one node a fingerprint, known by itself: a doc_id may have several
    found = components(links(reps.select(F.col("fp").alias("rep"), "fp"), max_bits))
    parts = stored(
        reps.join(found, reps.fp == found.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("component")),
        "parts",
    )
    least = parts.groupBy("component").agg(F.min("rep").alias("component_id"))
    labelled = stored(parts.join(least, "component").select("fp", "component", "component_id"), "labels")
    return prints.join(labelled, "fp")


def near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 2) -> DataFrame:
    """doc_id, fp (long) and component_id (smallest doc_id reachable over links of at most
    ``max_bits`` bits, itself included) for each row."""
    return _labelled(docs, words, max_bits).select(
        public_id().alias("doc_id"), "fp", public_id("component_id").alias("component_id")
    )


def least_rows(docs: DataFrame, words: int = 3, max_bits: int = 2) -> DataFrame:
    """doc_id and hash (XXH64 of the text) of one document of each component: the least by doc_id (null
    first), then by hash. Equal rows of it are not told apart."""
    least = _labelled(docs, words, max_bits).groupBy("component").agg(F.min(F.struct("doc_id", "hash")).alias("least"))
    return least.select(public_id("least.doc_id").alias("doc_id"), F.col("least.hash").alias("hash"))
