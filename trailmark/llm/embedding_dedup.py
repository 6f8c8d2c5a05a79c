"""Near-duplicate embeddings by collision counting in sorted projections.

Vectors are scaled to length one and projected on ``PROJECTIONS`` random directions. In each projection the
vectors of a block are sorted, and the window around a query, found in that order by two searches, holds the
vectors that collide with it. A pair whose collisions reach a count is verified by its cosine in double
precision. For a pair whose cosine is exactly the threshold, the difference in one projection is normal with
deviation d = sqrt(2 - 2 threshold); the half width of the windows is the one that nine of ten such pairs
stay within, so its collisions are binomial, and the count is the greatest that still finds the wanted share
of such pairs (``calibrated``). Nearer pairs are found more surely; no pair below the threshold is linked.

Only vectors of one label meet. One further projection cuts a label into strips ``STRIP`` deviations wide;
vectors meet those of their own strip and the next ones (beyond them a pair at the threshold lies with
probability 0.000001, which the recall allows for). A strip with more than ``BLOCK`` vectors is dealt into
blocks by a hash, and each pair of blocks is one group of at most about two blocks, so no label, strip or
cluster is ever whole in one task. Groups return, for each linked vector, the number of its links and the
least vector connected with it there: pairs are counted, never listed. Equal vectors of a label are one
class with a weight. What is shuffled is (blocks of a strip) x (its vectors); the work is the square of a
strip, which the count of links of dense clusters needs anyway.

Nulls and edge cases: a vector that is null, zero, empty or holds a null or non-finite component, and one
with a null label, links with nothing: no links, and its own id as component; a null vec_id sorts first, so
the component of a linked one is null; repeated rows link with each other; rows that share a vec_id are rows
of their own; the shorter of two vectors counts as filled up with zeros; components beyond the range of
doubles when squared are scaled first; other columns are dropped; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, public_id, shuffle_partitions, stored, workers_import
from .components import components
from .hard_negatives import matrix

PROJECTIONS = 24
COLLIDES = 0.9  # of pairs at the threshold, in one projection
STRIP = 5  # deviations of such pairs
BLOCK = 4096  # vectors
TILE = 256
SEED = 20
TASK_BYTES = 64 << 20


def calibrated(threshold: float, projections: int, recall: float) -> tuple[float, int]:
    """(half width of the windows, collisions asked for), so that of the pairs with this cosine the share
    ``recall`` is found, strips included."""
    half = NormalDist().inv_cdf((1 + COLLIDES) / 2) * math.sqrt(2 - 2 * threshold)
    wanted = recall / (1 - 2 * NormalDist().cdf(-STRIP))
    found, asked = 0.0, projections + 1
    while asked and found < wanted:
        asked -= 1
        found += math.comb(projections, asked) * COLLIDES**asked * (1 - COLLIDES) ** (projections - asked)
    if not asked:
        raise ValueError(f"{projections} projections cannot find the share {recall}")
    return half, asked


def directions(dim: int, n: int) -> np.ndarray:
    """dim x n standard normal numbers; a smaller dim gives the first rows of a larger one."""
    return np.random.default_rng(SEED).standard_normal((dim, n + 1))


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _valid(kind: str):
    """Vectors as bytes; null where they link with nothing."""

    def run(batches):
        for batch in batches:
            column = batch.column("vector")
            packed: list[bytes | None] = []
            for v in column:
                x = v.values.to_numpy(zero_copy_only=False) if v.is_valid else np.zeros(0)
                x = x.astype(kind)
                packed.append(x.tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(packed, pa.binary())], ["id", "label", "v"]
            )

    return run


def _strips(kind: str, width: float):
    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = unit(matrix(batch.column("v").to_pylist(), kind))
            strip = np.floor(x @ directions(x.shape[1], PROJECTIONS)[:, 0] / width)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(strip.astype(np.int32))], [*batch.schema.names, "strip"])

    return run


class Windows:
    """The sorted projections of some vectors, and for queries the window in each that is centred on them."""

    def __init__(self, vectors: np.ndarray, queries: np.ndarray, half: float) -> None:
        to = directions(vectors.shape[1], PROJECTIONS)[:, 1:]
        at, centre = (vectors @ to).T, (queries @ to).T
        order = np.argsort(at, axis=1)
        kind = np.uint16 if at.shape[1] < 1 << 16 else np.uint32
        self.rank = np.empty(at.shape, kind)
        np.put_along_axis(self.rank, order, np.arange(at.shape[1], dtype=kind)[None], axis=1)
        ordered = np.take_along_axis(at, order, axis=1)
        ends = [[np.searchsorted(o, c + s * half, side) for o, c in zip(ordered, centre)] for s, side in ((-1, "left"), (1, "right"))]
        self.low = np.array(ends[0]).astype(kind)
        self.width = (np.array(ends[1]) - np.array(ends[0])).astype(kind)

    def collisions(self, queries: slice) -> np.ndarray:
        """How many windows of each query each vector is in."""
        count = np.zeros((len(self.low[0][queries]), self.rank.shape[1]), np.uint8)
        for rank, low, width in zip(self.rank, self.low[:, queries], self.width[:, queries]):
            count += (rank[None] - low[:, None]) < width[:, None]  # unsigned: below the window wraps around
        return count


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the components of a[i] and b[i] for all i; each keeps its least label."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return label
        to = np.arange(len(label))
        np.minimum.at(to, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while (to[to] != to).any():
            to = to[to]
        label = to[label]


def links_of(
    x: np.ndarray, y: np.ndarray | None, weight: np.ndarray, threshold: float, half: float, asked: int
) -> tuple[np.ndarray, np.ndarray]:
    """(weighted number of links, least connected row) of the rows of x and then of y, or of x within
    itself where y is None. weight: of the rows of both."""
    nx = len(x)
    other, first = (x, 0) if y is None else (y, nx)
    windows = Windows(other, x, half)
    links = np.zeros(len(weight), np.int64)
    label = np.arange(len(weight))
    for i in range(0, nx, TILE):
        tile = slice(i, min(i + TILE, nx))
        near = windows.collisions(tile) >= asked
        if y is None:
            near[np.arange(len(near)), np.arange(i, tile.stop)] = False
        rows = np.flatnonzero(near.any(axis=1))
        if not len(rows):
            continue
        linked = near[rows] & (x[i + rows] @ other.T >= threshold)
        links[i + rows] += linked @ weight[first : first + len(other)]
        if y is not None:
            links[first:] += weight[i + rows] @ linked
        # stars first; what they leave apart is joined link by link
        from_row, from_col = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
        label = merge(
            label,
            np.concatenate([i + rows[from_row], i + rows[linked.argmax(axis=0)[from_col]]]),
            first + np.concatenate([linked.argmax(axis=1)[from_row], from_col]),
        )
        r, c = np.nonzero(linked)
        label = merge(label, i + rows[r], first + c)
    return links, label


def _compare(kind: str, threshold: float, half: float, asked: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("least", "ascending"), ("key", "ascending")])
        place = {s: np.flatnonzero(table["side"].to_numpy() == s) for s in (0, 1)}
        x = unit(matrix(table["v"].to_pylist(), kind))
        copies = table["copies"].to_numpy()
        within = not table["step"][0].as_py() and table["a"][0].as_py() == table["b"][0].as_py()
        order = np.concatenate([place[0], place[1]])
        if len(place[0]) and (within or len(place[1])):
            links, label = links_of(x[place[0]], None if within else x[place[1]], copies[order], threshold, half, asked)
        else:
            links, label = np.zeros(len(order), np.int64), np.arange(len(order))
        # the least node of a component: the table is sorted by node
        least = np.full(len(order), len(order))
        np.minimum.at(least, label, order)
        root = least[label]
        at = np.flatnonzero(links)
        node, to = table.take(pa.array(order[at])), table.take(pa.array(root[at]))
        return pa.table(
            {"least": node["least"], "key": node["key"], "links": links[at], "to_least": to["least"], "to_key": to["key"]}
        )

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, recall: float = 0.999) -> DataFrame:
    """vectors: vec_id, embedding (array of numbers), label. Pairs of one label with a cosine of at least
    ``threshold`` link; ``recall`` of those at the threshold, and more of the nearer ones, are found. For each
    row: vec_id, n_links (rows linked directly) and component_id (least vec_id reachable, itself included)."""
    if not 0 < threshold < 1:
        raise ValueError("threshold must lie between 0 and 1")
    half, asked = calibrated(threshold, PROJECTIONS, recall)
    spark = vectors.sparkSession
    workers_import(spark)
    kind, element = ("<f4", "float") if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else ("<f8", "double")
    own = vectors.select(
        F.coalesce(F.col("vec_id").cast("long"), F.lit(NULL_ID)).alias("id"),
        F.col("label").cast("string").alias("label"),
        F.col("embedding").cast(f"array<{element}>").alias("vector"),
    )
    rows = own.mapInArrow(_valid(kind), "id long, label string, v binary").withColumn(
        "key", F.unhex(F.md5(F.concat(F.col("label").cast("binary"), F.lit(b"\0"), "v")))  # null if either is
    )
    rows = stored(rows, "vectors")
    classes = rows.where("key IS NOT NULL").groupBy("key").agg(
        F.min("id").alias("least"), F.count("*").alias("copies"), F.max("label").alias("label"), F.max("v").alias("v")
    )
    width = STRIP * math.sqrt(2 - 2 * threshold)
    classes = classes.mapInArrow(_strips(kind, width), "key binary, least long, copies long, label string, v binary, strip int")
    classes = stored(classes, "classes")

    of = classes.groupBy("label", "strip").agg(F.count("*").alias("n"), F.sum(F.octet_length("v") + 64).alias("bytes"))
    of = stored(of.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")), "strips")

    def beside(by: int, name: str) -> DataFrame:
        return of.select("label", (F.col("strip") + by).alias("strip"), F.col("blocks").alias(name))

    sizes = of.join(beside(1, "before"), ["label", "strip"], "left").join(beside(-1, "after"), ["label", "strip"], "left")
    sizes = stored(sizes.na.fill(0, ["before", "after"]), "sizes")
    n_bytes = sizes.agg(F.coalesce(F.sum(F.expr("bytes * (blocks + before + after)")), F.lit(0))).first()[0]
    parts = max(shuffle_partitions(spark), int(n_bytes // TASK_BYTES))

    block = "cast(pmod(xxhash64(key), blocks) AS int)"
    cells = f"""concat(
        transform(sequence(0, blocks - 1), o -> struct(
            strip AS cell, 0 AS step, least(o, {block}) AS a, greatest(o, {block}) AS b, int(o < {block}) AS side)),
        if(after > 0, transform(sequence(0, after - 1), o -> struct(strip AS cell, 1 AS step, {block} AS a, o AS b, 0 AS side)), array()),
        if(before > 0, transform(sequence(0, before - 1), o -> struct(strip - 1 AS cell, 1 AS step, o AS a, {block} AS b, 1 AS side)), array()))"""
    group = ["label", "cell", "step", "a", "b"]
    dealt = (
        classes.join(sizes.select("label", "strip", "blocks", "before", "after"), ["label", "strip"])
        .select("label", "key", "least", "copies", "v", F.expr(f"inline({cells})"))
        .repartition(parts, *group)
    )
    found = dealt.groupBy(*group).applyInArrow(
        _compare(kind, threshold, half, asked), "least long, key binary, links long, to_least long, to_key binary"
    )
    found = stored(found, "links")

    # a node is (least id, key): the least node of a component has its least id
    node, to = F.struct("least", "key"), F.struct(F.col("to_least").alias("least"), F.col("to_key").alias("key"))
    parents = components(found.select(node.alias("u"), to.alias("v")))
    n_links = found.groupBy("least", "key").agg(F.sum("links").alias("links"))
    labelled = (
        classes.select("key", "least", "copies")
        .join(n_links.select("key", "links"), "key", "left")
        .join(parents.select(F.col("node.key").alias("key"), F.col("component.least").alias("to")), "key", "left")
        .selectExpr("key", "coalesce(links, 0L) + copies - 1 AS links", "coalesce(to, least) AS component")
    )
    # tables on both sides of the join: a vector with many copies can then be split
    joined = rows.select("id", "key").join(stored(labelled, "labelled"), "key", "left")
    joined = joined.selectExpr("id", "coalesce(links, 0L) AS n_links", "coalesce(component, id) AS component")
    return joined.select(public_id("id").alias("vec_id"), "n_links", public_id("component").alias("component_id"))


#: The same from all pairs of a label, for small tables.
ORACLE = """
WITH RECURSIVE rows AS (
    SELECT row_number() OVER () AS nr, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v,
        label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS valid
    FROM embeddings
),
links AS (
    SELECT a.nr, b.nr AS other
    FROM rows a JOIN rows b ON a.label = b.label AND a.nr <> b.nr AND a.valid AND b.valid
    WHERE list_cosine_similarity(a.v, b.v) >= 0.98
),
reach(nr, other) AS (
    SELECT nr, nr FROM rows
    UNION
    SELECT r.nr, l.other FROM reach r JOIN links l ON l.nr = r.other
)
SELECT r.vec_id, (SELECT count(*) FROM links l WHERE l.nr = r.nr) AS n_links, c.component_id, r.vec_id = c.component_id AS kept
FROM rows r JOIN (
    SELECT reach.nr, min(o.vec_id) AS component_id FROM reach JOIN rows o ON o.nr = reach.other GROUP BY reach.nr
) c ON c.nr = r.nr
"""
