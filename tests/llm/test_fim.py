"""Fill-in-middle against a brute-force version, code point by code point."""

from __future__ import annotations

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from trailmark.llm import fim
from trailmark.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, row string, n long, form int, h1 string"


def _brute(doc_id, text, seed=1, plain_from=90, spm_below=20):
    text = text or ""
    hexed = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[8 * k : 8 * k + 8], 16) for k in range(4)]
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= plain_from:
        return n, "plain", None, None, text
    if h[3] % 100 < spm_below:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def _rows():
    rng = random.Random(5)
    alphabet = ["a", "Z", "bc", " ", "\n", "é", "ß", "漢", "😀", "<", "P>", "<S", ">", "\\", "'", "\x00", "́"]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    rows += [(1000 + i, "😀漢é" * i) for i in range(30)]
    rows += [(2000, None), (2001, ""), (2002, "x<M>y"), (2003, "<P"), (-3, "minus"), (None, "no id é"), (None, None)]
    rows += [(7, "same id, another text"), (7, "repeated"), (7, "repeated"), (3000, "ab c é " * 40000), (3001, "q" * 300000)]
    return rows


@pytest.fixture(scope="module")
def data():
    return _rows()


@pytest.fixture(scope="module")
def docs(spark, data):
    """With columns whose names clash with the operator's own."""
    return spark.createDataFrame([(i, t, "r", 1, 2, "h") for i, t in data], SCHEMA).repartition(5)


def _key(row):
    return tuple((x is None, x) for x in row)


def test_against_brute_force(docs, data):
    got = [tuple(r) for r in fim.transform(docs).collect()]
    want = [(i, *_brute(i, t)) for i, t in data]
    assert sorted(got, key=_key) == sorted(want, key=_key)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_parameters(docs, data):
    got = [tuple(r) for r in fim.transform(docs, seed=9, plain_from=100, spm_below=50).collect()]
    want = [(i, *_brute(i, t, 9, 100, 50)) for i, t in data]
    assert sorted(got, key=_key) == sorted(want, key=_key)


def test_texts_come_back(docs):
    made = fim.transform(docs, carry=["text"]).withColumn("back", fim.restored())
    assert made.where(F.col("back") != F.coalesce("text", F.lit(""))).count() == 0
    assert made.where("form <> 'plain'").count() > 300


def test_output_from_text_and_lengths(docs):
    made = fim.transform(docs, carry=["text"])
    again = fim.recut(made)
    assert sorted(map(str, again.collect())) == sorted(map(str, made.select("doc_id", "output").collect()))


def test_index_holds_multibyte_characters_only():
    text = "añb漢c😀d" * 3 + "plain"
    data = np.frombuffer(text.encode(), np.uint8)
    index = fim.Exceptions(data)
    assert len(index.bytes_at) == 9
    at = np.array([len(text[:k].encode()) for k in range(len(text) + 1)])
    assert index.points(at).tolist() == list(range(len(text) + 1))
    assert index.bytes(np.arange(len(text) + 1)).tolist() == at.tolist()
    assert len(fim.Exceptions(np.frombuffer(b"only ascii", np.uint8)).bytes_at) == 0


def test_empty_table(spark):
    empty = fim.transform(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and empty.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF['0.001']}/documents.parquet").select("doc_id", "text").collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted((i, n, f, p, m, sha(o), sha(t or "")) for i, t in docs for n, f, p, m, o in [_brute(i, t)])
    got = QUERIES["op11_fill_in_middle"](spark, SF["0.001"])
    assert got.columns[-2:] == ["output_sha256", "restored_sha256"]
    assert sorted(map(tuple, got.collect())) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF['0.001']}/documents.parquet'")
    assert sorted(con.execute(ORACLE_SQL["op11_fill_in_middle"]).fetchall()) == want
