"""Embedding near-duplicates against brute-force cosines."""

from __future__ import annotations

import math

import numpy as np
import pytest
from conftest import SF

from trailmark.llm import embedding_dedup
from trailmark.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, key string, id long, links int, strip int"


def _brute(rows, threshold=0.98):
    ok = [
        label is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
        for _, v, label in rows
    ]
    dim = max(len(v) for (_, v, _), good in zip(rows, ok) if good)
    x = np.array([list(v) + [0.0] * (dim - len(v)) if good else [0.0] * dim for (_, v, _), good in zip(rows, ok)])
    x = x.astype(np.float32).astype(float)
    norm = np.linalg.norm(x, axis=1)
    x[norm > 0] /= norm[norm > 0, None]
    label = np.array([-1 if r[2] is None else r[2] for r in rows])
    link = (x @ x.T >= threshold) & (label[:, None] == label[None])
    np.fill_diagonal(link, False)
    part = list(range(len(rows)))
    out = []
    for i in range(len(rows)):  # everything reachable
        seen, todo = {i}, [i]
        while todo:
            for j in np.flatnonzero(link[todo.pop()]).tolist():
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        part[i] = min((rows[j][0] for j in seen), key=lambda v: (v is not None, v))
        out.append((rows[i][0], int(link[i].sum()), part[i]))
    return sorted(out, key=str)


def _rows(seed=1, n=400, dim=24):
    rng = np.random.default_rng(seed)
    vector = lambda: rng.standard_normal(dim)
    near = lambda v, by: v / np.linalg.norm(v) + rng.standard_normal(len(v)) * by / math.sqrt(len(v))
    rows = [(i, vector(), int(rng.integers(3))) for i in range(n)]
    hub = vector()
    rows += [(1000 + i, near(hub, 0.1) * rng.uniform(0.01, 50), 1) for i in range(150)]  # dense, any length
    rows += [(2000 + i, near(hub, 0.17), i % 2) for i in range(60)]  # around the threshold, two labels
    step = vector()
    for i in range(30):  # a chain: neighbours link, its ends do not
        step = near(step, 0.15)
        rows.append((3000 - i, step, 2))
    rows += [(5000 + i, hub, 1) for i in range(25)] + [(5000, hub, 1)] * 3  # equal vectors, repeated rows
    rows += [(6000, None, 1), (6001, [], 1), (6002, [0.0] * dim, 1), (6003, [math.nan] * dim, 1), (6004, [math.inf] * dim, 1)]
    rows += [(6005, hub, None), (6006, hub, None), (6007, [None] * dim, 2), (6008, [0.0] * dim, 1), (6009, [1e30, 1e30], 0)]
    rows += [(6010, [1e-30, 1e-30, 0.0], 0), (None, vector(), 1), (None, rows[5][1], rows[5][2]), (7, rows[9][1], rows[9][2])]
    return [(i, None if v is None else [None if x is None else float(x) for x in v], y) for i, v, y in rows]


def _frame(spark, rows):
    """With columns whose names clash with the operator's own."""
    return spark.createDataFrame([(*r, "k", 1, 2, 3) for r in rows], SCHEMA).repartition(4)


def _got(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def want():
    return _brute(_rows())


@pytest.mark.parametrize("block", [4096, 20])
def test_against_brute_force(spark, monkeypatch, want, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "TILE", 256 if block > 100 else 7)
    got = _got(embedding_dedup.near_duplicates(_frame(spark, _rows()), recall=0.99999))
    assert sum(n for _, n, _ in want) > 10000
    assert got == want


def test_double_vectors_and_text_labels(spark, want):
    df = _frame(spark, _rows()).selectExpr("vec_id", "cast(embedding AS array<double>) AS embedding", "concat('l', label) AS label")
    assert _got(embedding_dedup.near_duplicates(df, recall=0.99999)) == want


def test_recall_at_the_threshold():
    """Pairs with a cosine of just the threshold are found as often as calibrated; unlike ones hardly ever."""
    rng = np.random.default_rng(6)
    x = embedding_dedup.unit(rng.standard_normal((4000, 64)))
    away = rng.standard_normal((4000, 64))
    away = embedding_dedup.unit(away - (away * x).sum(axis=1, keepdims=True) * x)
    y = 0.98 * x + math.sqrt(1 - 0.98**2) * away
    for recall in (0.9, 0.99, 0.999):
        half, asked = embedding_dedup.calibrated(0.98, embedding_dedup.PROJECTIONS, recall)
        count = embedding_dedup.Windows(y, x, half).collisions(slice(0, 4000))
        assert (np.diag(count) >= asked).mean() >= recall - 0.004
        assert (count >= asked).mean() < 0.001


def test_collisions_are_those_of_the_windows():
    rng = np.random.default_rng(7)
    x, y = (embedding_dedup.unit(rng.standard_normal((n, 10))) for n in (40, 50))
    to = embedding_dedup.directions(10, embedding_dedup.PROJECTIONS)[:, 1:]
    slow = (np.abs((x @ to)[:, None] - (y @ to)[None]) <= 0.3).sum(axis=2)
    assert embedding_dedup.Windows(y, x, 0.3).collisions(slice(0, 40)).tolist() == slow.tolist()


def test_merge_joins_all():
    a, b = np.array([3, 1, 5, 5, 8]), np.array([7, 3, 6, 0, 9])
    assert embedding_dedup.merge(np.arange(10), a, b).tolist() == [0, 1, 2, 1, 4, 0, 0, 1, 8, 8]


def test_empty_table_and_no_links(spark):
    assert embedding_dedup.near_duplicates(_frame(spark, _rows()[:1]).limit(0)).collect() == []
    lone = [(1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1), (3, [1.0, 0.0], 2), (None, None, None)]
    assert _got(embedding_dedup.near_duplicates(_frame(spark, lone))) == _brute(lone)
    with pytest.raises(ValueError):
        embedding_dedup.near_duplicates(_frame(spark, lone), threshold=1.0)


def test_query_against_brute_force_and_sql(spark):
    import duckdb

    path = f"{SF['0.01']}/embeddings.parquet"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(path).collect()]
    want = sorted([(*r, r[0] == r[2]) for r in _brute(rows)], key=str)
    assert _got(QUERIES["op13_embedding_near_dedup"](spark, SF["0.01"])) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}'")
    assert sorted(con.execute(ORACLE_SQL["op13_embedding_near_dedup"]).fetchall(), key=str) == want
