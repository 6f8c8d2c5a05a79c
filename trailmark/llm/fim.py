"""Fill-in-middle transformation with a sparse exception index.

Tokens (``[A-Za-z]+|[^A-Za-z]`` over code points) are found in the UTF-8 bytes of a whole slice of texts
at once. Code points and bytes differ only after a multibyte character, so the index of a slice holds those
characters alone: their positions and the bytes that they have beyond one, summed. A cut is converted from
bytes to code points, or back, by one ``searchsorted`` among them; in ASCII spans that is plain arithmetic,
and a slice without multibyte characters has an empty index.

Cuts and form are drawn from ``sha256("<seed>:<doc_id>")``, so a task that is repeated draws the same. A text
is cut into prefix, middle and suffix at two token boundaries and put together as
``<P>prefix<S>suffix<M>middle`` (psm) or ``<S>suffix<P>prefix<M>middle`` (spm), or left as it is (plain).
``restored`` gives the text back from output and form; ``recut`` gives the output back from the text and
the two lengths, so that a corpus may keep the lengths only. No row meets another: no shuffle.

Nulls and edge cases: a null text counts as empty; empty texts and texts that hold a sentinel are plain,
with null lengths; a null doc_id is drawn as the empty string; repeated rows give a row each; rows that share
a doc_id draw the same numbers, each for its own text; other columns are dropped unless carried; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import slices, utf8
from .common import workers_import

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = True
_LETTER[97:123] = True


class Exceptions:
    """The multibyte characters of UTF-8 text: where they begin, in bytes and in code points, and how many
    bytes beyond one a character all before the k-th have together."""

    def __init__(self, data: np.ndarray) -> None:
        self.bytes_at = np.flatnonzero(data >= 0xC0)
        lead = data[self.bytes_at]
        excess = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.total = np.concatenate([[0], np.cumsum(excess)])
        self.points_at = self.bytes_at - self.total[:-1]

    def points(self, at: np.ndarray) -> np.ndarray:
        """Code points before byte positions (that begin a character)."""
        return at - self.total[np.searchsorted(self.bytes_at, at)]

    def bytes(self, at: np.ndarray) -> np.ndarray:
        """Byte positions of code points."""
        return at + self.total[np.searchsorted(self.points_at, at)]


def token_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where tokens begin, and how many begin before each offset."""
    letter = _LETTER[data]
    begins = (data & 0xC0) != 0x80
    begins[1:] &= ~(letter[1:] & letter[:-1])
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] = True  # of texts: a run of letters ends with its text
    starts = np.flatnonzero(begins)
    return starts, np.searchsorted(starts, offsets)


def _assemble(text: bytes, a: int, b: int, form: str) -> bytes:
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if form == "psm":
        return b"".join((p, text[:a], s, text[b:], m, text[a:b]))
    return b"".join((s, text[b:], p, text[:a], m, text[a:b]))


def _text_column(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary()).cast(pa.string())


def _transform(plain_from: int, spm_below: int):
    sentinels = [x.encode() for x in (PREFIX, SUFFIX, MIDDLE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_data, all_offsets = utf8(batch.column("text"))
            for i, j in slices(all_offsets):
                data = all_data[all_offsets[i] : all_offsets[j]]
                offsets = all_offsets[i : j + 1] - all_offsets[i]
                part = batch.slice(i, j - i)
                h1, h2, h3, h4 = (part.column(f"h{k}").to_numpy() for k in (1, 2, 3, 4))
                raw = data.tobytes()
                texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]

                starts, before = token_starts(data, offsets)
                n = np.diff(before)
                low, high = h1 % (n + 1), h2 % (n + 1)
                cuts = before[:-1] + np.array([np.minimum(low, high), np.maximum(low, high)])
                ends = np.append(starts, len(data))
                at = np.where(cuts < before[1:], ends[np.minimum(cuts, len(starts))], offsets[1:])  # in bytes
                index = Exceptions(data)
                at_points = index.points(at) - index.points(offsets[:-1])

                held = np.array([any(x in t for x in sentinels) for t in texts], bool)
                plain = (n == 0) | held | (h3 % 100 >= plain_from)
                spm = ~plain & (h4 % 100 < spm_below)
                form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
                own = (at - offsets[:-1]).tolist()
                output = [t if f == "plain" else _assemble(t, a, b, f) for t, a, b, f in zip(texts, *own, form.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row"),
                        pa.array(n, pa.int64()),
                        pa.array(form.tolist(), pa.string()),
                        pa.array(at_points[0], pa.int64(), mask=plain),
                        pa.array(at_points[1] - at_points[0], pa.int64(), mask=plain),
                        _text_column(output),
                    ],
                    ["row", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return run


def _drawn(seed: int, k: int) -> Column:
    """The k-th 8-digit group of the hex sha256 of the seed and the id, as an unsigned integer."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(key, 256), 8 * k - 7, 8), 16, 10).cast("long").alias(f"h{k}")


def transform(
    docs: DataFrame, seed: int = 1, plain_from: int = 90, spm_below: int = 20, carry: Sequence[str] = ()
) -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars (code points, null if plain), output, and the
    columns to carry. A text is plain if a draw modulo 100 is ``plain_from`` or more, spm if another is
    below ``spm_below``."""
    spark = docs.sparkSession
    workers_import(spark)
    row = F.struct(F.col("doc_id").cast("long").alias("doc_id"), *([F.struct(*carry).alias("carry")] if carry else []))
    drawn = docs.select(row.alias("row"), F.col("text").cast("string").alias("text"), *[_drawn(seed, k) for k in (1, 2, 3, 4)])
    kind = drawn.schema["row"].dataType.simpleString()
    made = drawn.mapInArrow(
        _transform(plain_from, spm_below),
        f"row {kind}, n long, form string, prefix_chars long, middle_chars long, output string",
    )
    columns = ["n", "form", "prefix_chars", "middle_chars", "output"]
    return made.select("row.doc_id", *columns, *(["row.carry.*"] if carry else []))


def restored() -> Column:
    """The text, from the columns output and form alone. An output that is not plain holds each sentinel once."""
    after = "split_part(output, '{}', 2)"
    middle = after.format(MIDDLE)
    inner = "split_part({}, '{}', 1)"
    psm = f"concat({inner.format(after.format(PREFIX), SUFFIX)}, {middle}, {inner.format(after.format(SUFFIX), MIDDLE)})"
    spm = f"concat({inner.format(after.format(PREFIX), MIDDLE)}, {middle}, {inner.format(after.format(SUFFIX), PREFIX)})"
    return F.expr(f"CASE form WHEN 'psm' THEN {psm} WHEN 'spm' THEN {spm} ELSE output END")


def _recut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        all_data, all_offsets = utf8(batch.column("text"))
        for i, j in slices(all_offsets):
            data = all_data[all_offsets[i] : all_offsets[j]]
            offsets = all_offsets[i : j + 1] - all_offsets[i]
            part = batch.slice(i, j - i)
            form = part.column("form").to_pylist()
            a = part.column("prefix_chars").fill_null(0).to_numpy()
            b = a + part.column("middle_chars").fill_null(0).to_numpy()
            index = Exceptions(data)
            cuts = index.bytes(index.points(offsets[:-1]) + np.array([a, b])).tolist()
            raw = data.tobytes()
            output = [
                raw[s:e] if f == "plain" else _assemble(raw[s:e], x - s, y - s, f)
                for s, e, x, y, f in zip(offsets[:-1].tolist(), offsets[1:].tolist(), *cuts, form)
            ]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), _text_column(output)], ["doc_id", "output"])


def recut(cut: DataFrame) -> DataFrame:
    """doc_id and output, from doc_id, text, form, prefix_chars and middle_chars as ``transform`` gave them."""
    workers_import(cut.sparkSession)
    needed = cut.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "form", "prefix_chars", "middle_chars"
    )
    return needed.mapInArrow(_recut, "doc_id long, output string")


#: The registered query's digests, from the tokens as a list.
ORACLE = """
WITH drawn AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS hex,
        regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens
    FROM documents
),
cut AS (
    SELECT doc_id, text, tokens, len(tokens) AS n,
        ('0x' || hex[1:8])::BIGINT % (len(tokens) + 1) AS u, ('0x' || hex[9:16])::BIGINT % (len(tokens) + 1) AS v,
        CASE
            WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
            WHEN ('0x' || hex[17:24])::BIGINT % 100 >= 90 THEN 'plain'
            WHEN ('0x' || hex[25:32])::BIGINT % 100 < 20 THEN 'spm'
            ELSE 'psm'
        END AS form
    FROM drawn
),
parts AS (
    SELECT doc_id, text, n, form,
        array_to_string(tokens[1:least(u, v)], '') AS prefix,
        array_to_string(tokens[least(u, v) + 1:greatest(u, v)], '') AS middle,
        array_to_string(tokens[greatest(u, v) + 1:], '') AS suffix
    FROM cut
)
SELECT doc_id, n, form,
    CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form
        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
        ELSE text END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM parts
"""
