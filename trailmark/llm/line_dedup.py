"""Removal of repeated runs of lines, in DataFrame functions only.

Every three consecutive lines are hashed (two 64-bit hashes with different beginnings). A window that
also occurs earlier, in a document with a smaller doc_id or further up in the same one, is a
repeat; all its lines are covered, and overlapping windows merge. Covered lines go.

Hot windows: first occurrences of repeated windows come from an aggregate (partial before the shuffle)
and are written as a table. The join that finds the others is an ordinary equality join of that table:
adaptive execution splits a skewed partition, which it could not do beside an aggregate in the same
stage, and a small table spares the windows their shuffle.
Positions are gathered for one document at a time.

Nulls and edge cases: a null text has no lines and keeps an empty text; an empty text is one empty
line; documents of fewer than three lines keep all; blank lines count; a row that repeats a
(doc_id, text) is the same document and gets the same result; rows that share a doc_id but differ
in text are in order of a hash of the text; a null doc_id sorts first; an empty table gives an empty
table. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, public_id, stored

LINES = 3


def _windows(own: DataFrame, lines: int) -> DataFrame:
    """h1, h2, doc_id, t, pos for each window."""
    parts = ", ".join(f"element_at(l, i + {k + 1})" for k in range(lines))
    return (
        own.withColumn("l", F.split("text", "\n", -1))
        .where(F.size("l") >= lines)
        .selectExpr(
            "doc_id",
            "t",
            f"""posexplode(transform(sequence(0, size(l) - {lines}),
                i -> struct(xxhash64({parts}) AS h1, xxhash64('second', {parts}) AS h2))) AS (pos, h)""",
        )
        .select("h.h1", "h.h2", "doc_id", "t", "pos")
    )


def remove_repeated_lines(docs: DataFrame, lines: int = LINES, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_lines, n_removed, kept (the lines that stay, joined by a line feed) and the columns
    named in ``carry`` for each row."""
    own = documents(docs).withColumn("t", F.xxhash64("text"))
    windows = _windows(own, lines)
    firsts = stored(
        windows.groupBy("h1", "h2")
        .agg(F.min(F.struct("doc_id", "t", "pos")).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n"),
        "first-windows",
    )
    repeats = windows.join(firsts, ["h1", "h2"]).where("struct(doc_id, t, pos) <> first")
    covered = (
        repeats.groupBy("doc_id", "t")
        .agg(F.collect_set("pos").alias("at"))
        .selectExpr("doc_id", "t", f"array_distinct(flatten(transform(at, p -> sequence(p, p + {lines - 1})))) AS covered")
    )
    return (
        documents(docs, carry)
        .withColumn("t", F.xxhash64("text"))
        .join(covered, ["doc_id", "t"], "left")
        .withColumn("l", F.split("text", "\n", -1))
        .withColumn("stay", F.expr("CASE WHEN covered IS NOT NULL THEN array_except(sequence(0, size(l) - 1), covered) END"))
        .select(
            public_id().alias("doc_id"),
            F.expr("CASE WHEN text IS NULL THEN 0 ELSE size(l) END").cast("long").alias("n_lines"),
            F.expr("CASE WHEN covered IS NULL THEN 0 ELSE size(covered) END").cast("long").alias("n_removed"),
            F.expr("CASE WHEN covered IS NULL THEN coalesce(text, '') ELSE array_join(transform(stay, i -> element_at(l, i + 1)), '\n') END").alias("kept"),
            *(["carry.*"] if carry else []),
        )
    )


ORACLE = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents
), windows AS (
  SELECT doc_id, pos, line AS a, lead(line, 1) OVER d AS b, lead(line, 2) OVER d AS c
  FROM lines WINDOW d AS (PARTITION BY doc_id ORDER BY pos)
), repeats AS (
  SELECT doc_id, pos FROM (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS nth FROM windows WHERE c IS NOT NULL
  ) WHERE nth > 1
), covered AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM repeats, (VALUES (0), (1), (2)) AS steps(k)
)
SELECT l.doc_id, count(*) AS n_lines, count(c.pos) AS n_removed,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE c.pos IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN covered c ON c.doc_id = l.doc_id AND c.pos = l.pos
GROUP BY l.doc_id
"""
