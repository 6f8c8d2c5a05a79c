"""Hard-negative mining with anchor spanning-tree bounds.

Vectors become integers, floor(256 x), and a score is the integer inner product with an anchor. The anchors
are dealt into blocks, and each block gets a minimum spanning tree over the distances between its anchors.
The root's scores are computed; those of a child c of a parent p are bounded before they are computed:

    score(p, v) - |c - p| |v|  <=  score(c, v)  <=  score(p, v) + |c - p| |v|

(where the parent itself is known by bounds only, they are widened further). Positives need the vectors whose
upper bound reaches the k-th best so far, negatives those whose bounds overlap the windows below the positives;
only these are scored. The tree is walked with the largest subtree last, so the bounds of about log2(block)
anchors are held at a time. Bounds carry a margin for rounding, scores are exact, so the result is exact.

All vectors are dealt into lanes, and each pair of a lane and a block is one group, of at most about ``LANE``
vectors and ``BLOCK`` anchors. It returns the k best of each anchor only; a window merges the groups. Hot
labels and copies do not matter to the dealing, which is by a hash of the row. Work is (anchors) x (vectors)
where the bounds do not prune, as no exact method escapes; what is shuffled is that over ``BLOCK`` and ``LANE``.

Nulls and edge cases: a row with a null label, a null vector, or a null or non-finite component takes no
part, nor does one with a component of 2**19 or more (its products could pass 64 bits); a null vec_id is no
anchor unless the caller says so, and sorts first; rows equal in vec_id, label and vector count once; other
rows that share a vec_id are rows of their own; the shorter of two vectors counts as filled up with zeros; an
anchor without other rows of its label, or without rows in a window, gives no rows; other columns are dropped;
an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, public_id, shuffle_partitions, stored, workers_import

BLOCK = 4096  # anchors with a tree
LANE = 16384  # vectors of a group
LEAST_LANE = 2048  # smaller lanes only spread few vectors over the cores
TILE = 4096  # vectors bounded at a time
LARGEST = 1 << 27  # of an integer component
TASK_BYTES = 64 << 20
Best = tuple[np.ndarray, np.ndarray]  # scores and ids, the best first


def _integers(scale: float):
    def run(batches):
        for batch in batches:
            column = batch.column("vector")
            at = np.asarray(column.offsets)
            values = column.values.cast(pa.float64())
            x = values.to_numpy(zero_copy_only=False)  # a null is NaN here
            with np.errstate(invalid="ignore", over="ignore"):
                q = np.floor(x * scale)
                bad = ~(np.abs(q) < LARGEST)
            fails = np.concatenate([[0], np.cumsum(bad)])
            good = fails[at[1:]] == fails[at[:-1]]
            whole = np.where(bad, 0, q).astype("<i4")
            packed = [whole[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            out = [batch.column(c) for c in ("id", "label", "anchor")] + [pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(out, ["id", "label", "anchor", "q"]).filter(pa.array(good))

    return run


def matrix(packed: list[bytes], kind: str = "<i4") -> np.ndarray:
    """Vectors as rows, shorter ones filled up with zeros."""
    width = np.dtype(kind).itemsize
    most = max(map(len, packed), default=0)
    raw = b"".join(p.ljust(most, b"\0") for p in packed)
    return np.frombuffer(raw, kind).reshape(len(packed), most // width)


def _fit(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both with the same number of columns, as doubles where those hold all products exactly."""
    dim = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, dim - x.shape[1]))).astype(np.int64) for x in (a, b))
    most = [int(np.abs(x).max()) if x.size else 0 for x in (a, b)]
    return (a.astype(float), b.astype(float)) if most[0] * most[1] * dim < 2**53 else (a, b)


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows' Euclidean distances, by Prim's method from row 0: (rows in walking order, the parent of
    each row, -1 for the root, and its distance to it). The largest subtree of a row is walked last."""
    x = vectors.astype(float)
    n = len(x)
    square = np.einsum("ij,ij->i", x, x)
    parent, edge = np.full(n, -1), np.zeros(n)
    near, by, out = np.full(n, np.inf), np.full(n, -1), np.ones(n, bool)
    grown, now = [0], 0
    for _ in range(n - 1):
        out[now] = False
        distance = np.maximum(square + square[now] - 2 * (x @ x[now]), 0)
        closer = out & (distance < near)
        near[closer], by[closer] = distance[closer], now
        now = int(np.argmin(np.where(out, near, np.inf)))
        parent[now], edge[now] = by[now], np.linalg.norm(x[now] - x[by[now]])
        grown.append(now)
    size = np.ones(n, int)
    children: list[list[int]] = [[] for _ in range(n)]
    for k in reversed(grown[1:]):
        size[parent[k]] += size[k]
        children[parent[k]].append(k)
    order, stack = [], [0] if n else []
    while stack:
        k = stack.pop()
        order.append(k)
        stack += sorted(children[k], key=lambda c: -size[c])  # the smallest is popped first
    return np.array(order, int), parent, edge


def _tree(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    order, parent, edge = spanning_tree(matrix(table["q"].to_pylist()))
    place = np.empty(len(order), int)
    place[order] = np.arange(len(order))
    above = np.append(place, -1)[parent]  # as places in walking order; -1 stays -1
    walked = pa.array(order)
    return pa.table(
        {
            **{c: table[c].take(walked) for c in ("block", "id", "key", "label", "q")},
            "place": np.arange(len(order), dtype=np.int64),
            "parent": above[order],
            "edge": edge[order],
        }
    )


def _best(now: Best, scores: np.ndarray, ids: np.ndarray, k: int) -> Best:
    scores, ids = np.append(now[0], scores), np.append(now[1], ids)
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


NONE: Best = (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Block:
    """Anchors in walking order, and the vectors of a lane, a tile at a time."""

    def __init__(self, anchors: pa.Table, vectors: pa.Table) -> None:
        anchors = anchors.sort_by("place")
        self.ids, self.keys, self.labels, self.parent, self.edge = (
            anchors[c].to_numpy() for c in ("id", "key", "label", "parent", "edge")
        )
        self.windows = anchors["scores"].to_pylist()
        self.a, self.v = _fit(matrix(anchors["q"].to_pylist()), matrix(vectors["q"].to_pylist()))
        self.v_ids, self.v_keys, self.v_labels = (vectors[c].to_numpy() for c in ("id", "key", "label"))
        self.a_norm, self.v_norm = (np.linalg.norm(x.astype(float), axis=1) for x in (self.a, self.v))
        self.last = np.full(len(self.ids), -1)  # child of each anchor
        for k, p in enumerate(self.parent.tolist()):
            if p >= 0:
                self.last[p] = k
        self.scored = 0

    def scores(self, tile: slice, wanted):
        """(anchor, places in the tile, their scores) for each anchor; ``wanted(anchor, low, high)`` gives the
        places whose bounds do not settle them."""
        v, norm = self.v[tile], self.v_norm[tile]
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in range(len(self.ids)):
            p = int(self.parent[k])
            if p < 0:
                every = v @ self.a[k]
                self.scored += len(every)
                margin = 1 + 1e-9 * np.abs(every)
                low, high = every - margin, every + margin
                at = wanted(k, low, high)
                found = every[at]
            else:
                reach = (self.edge[k] * (1 + 1e-9) + 1e-9 * self.a_norm[k]) * norm + 1
                low, high = held[p][0] - reach, held[p][1] + reach
                if k == self.last[p]:
                    del held[p]
                at = wanted(k, low, high)
                found = v[at] @ self.a[k]
                self.scored += len(at)
                low[at] = high[at] = found
            if self.last[k] >= 0:
                held[k] = (low, high)
            yield k, at, found

    def tiles(self):
        return [slice(i, min(i + TILE, len(self.v))) for i in range(0, len(self.v), TILE)]

    def _itself(self, k: int, tile: slice) -> np.ndarray:
        return (self.v_ids[tile] == self.ids[k]) & (self.v_keys[tile] == self.keys[k])

    def positives(self, n: int) -> list[Best]:
        best = [NONE] * len(self.ids)
        for tile in self.tiles():
            labels, ids = self.v_labels[tile], self.v_ids[tile]
            of_label = {x: np.flatnonzero(labels == x) for x in np.unique(self.labels)}

            def wanted(k, low, high):
                at = of_label[self.labels[k]]
                least = best[k][0][-1] if len(best[k][0]) == n else -np.inf
                if len(at) > n:
                    least = max(least, np.partition(low[at], -n - 1)[-n - 1])  # one of them may be the anchor
                at = at[high[at] >= least]
                return at[~self._itself(k, tile)[at]]

            for k, at, found in self.scores(tile, wanted):
                if len(at):
                    best[k] = _best(best[k], found, ids[at], n)
        return best

    def negatives(self, n: int, low_share: int, high_share: int) -> list[list[Best]]:
        """The n best of each anchor's windows; the window below a positive's score s holds the scores x with
        low_share s <= 100 x <= high_share s."""
        best = [[NONE] * len(w) for w in self.windows]
        # windows in whole scores
        ends = [[(-(-low_share * s // 100), high_share * s // 100) for s in w] for w in self.windows]
        for tile in self.tiles():
            labels, ids = self.v_labels[tile], self.v_ids[tile]

            def wanted(k, low, high):
                if not ends[k]:
                    return np.zeros(0, int)
                overlaps = (high >= min(a for a, _ in ends[k])) & (low <= max(b for _, b in ends[k]))
                return np.flatnonzero(overlaps & (labels != self.labels[k]))

            for k, at, found in self.scores(tile, wanted):
                if len(at):
                    for j, (a, b) in enumerate(ends[k]):
                        inside = (found >= a) & (found <= b)
                        if inside.any():
                            best[k][j] = _best(best[k][j], found[inside], ids[at][inside], n)
        return best


FOUND = "anchor long, anchor_key long, nth int, id long, score long"


def _rows(block: Block, best: list[list[Best]]) -> pa.Table:
    flat = [(k, j, *b) for k, bs in enumerate(best) for j, b in enumerate(bs) if len(b[0])]
    size = [len(s) for *_, s, _ in flat]
    k = np.repeat(np.array([x[0] for x in flat], int), size)
    none = np.zeros(0, np.int64)
    return pa.table(
        {
            "anchor": block.ids[k],
            "anchor_key": block.keys[k],
            "nth": np.repeat(np.array([x[1] for x in flat], np.int32), size),
            "id": np.concatenate([none, *[x[3] for x in flat]]),
            "score": np.concatenate([none, *[x[2].astype(np.int64) for x in flat]]),
        }
    )


def _search(find):
    def run(key: tuple[pa.Scalar, ...], vectors: pa.Table, anchors: pa.Table) -> pa.Table:
        if not (len(vectors) and len(anchors)):
            return _rows(Block(anchors.slice(0, 0), vectors.slice(0, 0)), [])
        block = Block(anchors, vectors)
        return _rows(block, find(block))

    return run


def _top(found: DataFrame, by: list[str], n: int) -> DataFrame:
    """With ``rank``: the n best of each group, merged from the groups' own."""
    first = Window.partitionBy(*by).orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= n)


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 5,
    low_share: int = 80,
    high_share: int = 100,
    scale: float = 256.0,
) -> DataFrame:
    """vectors: vec_id, embedding (array of numbers), label. For each anchor and each of its first ``positives``
    other rows of its label, the first ``negatives`` rows of other labels whose score lies between
    ``low_share`` and ``high_share`` hundredths of the positive's: anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score, positive_rank. Higher scores come first, ties by smaller vec_id."""
    spark = vectors.sparkSession
    workers_import(spark)
    own = vectors.where("label IS NOT NULL AND embedding IS NOT NULL").select(
        F.coalesce(F.col("vec_id").cast("long"), F.lit(NULL_ID)).alias("id"),
        F.col("label").cast("long").alias("label"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )
    whole = own.mapInArrow(_integers(scale), "id long, label long, anchor boolean, q binary")
    rows = whole.groupBy("id", "label", "q").agg(F.max("anchor").alias("anchor"))  # equal rows once
    rows = stored(rows.withColumn("key", F.xxhash64("label", "q")), "vectors")
    n, n_anchors, n_bytes = rows.agg(
        F.count("*"), F.count_if("anchor"), F.coalesce(F.sum(F.octet_length("q") + 32), F.lit(0))
    ).first()
    blocks = -(-n_anchors // BLOCK) or 1
    lanes = max(-(-n // LANE), min(2 * shuffle_partitions(spark), -(-n // LEAST_LANE))) or 1
    parts = max(shuffle_partitions(spark), int(n_bytes * blocks // TASK_BYTES))

    anchors = rows.where("anchor").withColumn("block", F.pmod(F.xxhash64("key", "id"), F.lit(blocks)).cast("int"))
    trees = anchors.select("block", "id", "key", "label", "q").groupBy("block").applyInArrow(
        _tree, "block int, id long, key long, label long, q binary, place long, parent long, edge double"
    )
    trees = stored(trees, "trees")
    everyone = rows.select(
        F.pmod(F.xxhash64("id", "key"), F.lit(lanes)).cast("int").alias("lane"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        "id", "key", "label", "q",
    ).repartition(parts, "lane", "block")

    def search(anchor_rows: DataFrame, find) -> DataFrame:
        dealt = anchor_rows.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).repartition(parts, "lane", "block")
        pairs = everyone.groupBy("lane", "block").cogroup(dealt.groupBy("lane", "block"))
        return pairs.applyInArrow(_search(find), FOUND)

    no_scores = F.array().cast("array<long>").alias("scores")
    near = search(trees.select("*", no_scores), lambda block: [[b] for b in block.positives(positives)])
    near = stored(_top(near, ["anchor", "anchor_key"], positives).drop("nth"), "positives")
    scores = near.groupBy(F.col("anchor").alias("id"), F.col("anchor_key").alias("key")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("scores")
    )
    # anchors without positives stay: others hang on them in the tree
    below = trees.join(scores, ["id", "key"], "left").withColumn("scores", F.coalesce("scores", no_scores))
    far = search(below, lambda block: block.negatives(negatives, low_share, high_share))
    far = _top(far, ["anchor", "anchor_key", "nth"], negatives)
    positive = near.select(
        "anchor", "anchor_key", (F.col("rank") - 1).alias("nth"), F.col("id").alias("positive"), F.col("score").alias("positive_score")
    )
    return far.join(positive, ["anchor", "anchor_key", "nth"]).select(
        public_id("anchor").alias("anchor_id"),
        public_id("positive").alias("positive_id"),
        "rank",
        public_id("id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
        (F.col("nth") + 1).alias("positive_rank"),
    )


#: The same from all scores of all anchors, for small tables: anchors by vec_id % 100, labels moved where
#: vec_id % 7 = 0, as the registered query has them.
ORACLE = """
WITH rows AS (
    SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
),
numbered AS (SELECT *, row_number() OVER () AS nr FROM rows),
scored AS (
    SELECT a.nr AS anchor, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
        list_dot_product(a.q, b.q)::BIGINT AS score
    FROM numbered a JOIN numbered b ON a.nr <> b.nr
    WHERE a.vec_id % 100 = 0
),
positives AS (
    SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS nth
    FROM scored WHERE same QUALIFY nth <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id,
    (row_number() OVER (PARTITION BY p.anchor, p.nth ORDER BY n.score DESC, n.vec_id))::INTEGER AS rank,
    n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n
    ON n.anchor = p.anchor AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
QUALIFY rank <= 5
"""
