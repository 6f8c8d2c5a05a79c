"""The pipeline's near-duplicate stage moves the texts once."""

from __future__ import annotations

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = [" ".join(f"w{i}x{k}" for k in range(40)) for i in range(3)]


def _stage(docs):
    return corpus_pipeline.simhash_near_dedup(docs.sparkSession, docs, "")


def test_texts_are_shuffled_once(spark):
    rows = [(i, TEXTS[i % 3], "en", "s", 1) for i in range(30)]
    off = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        todo = [_stage(spark.createDataFrame(rows, COLUMNS))._jdf.queryExecution().executedPlan()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    moved = []
    while todo:
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Exchange" and '"name":"text"' in node.schema().json():
            moved.append(node.schema().simpleString())
    assert len(moved) == 1, moved


def test_null_shared_and_repeated_ids(spark):
    a, b, c = TEXTS
    rows = [
        (None, a, "en", "z", 2), (None, a, "de", "y", 1), (1, a, "en", "x", 1),  # a null id sorts first; the least of its other columns
        (2, b, "en", "s", 1), (2, b, "en", "s", 1), (2, c, None, "s", 1), (3, c, "en", "s", 1),
    ]
    got = sorted(map(tuple, _stage(spark.createDataFrame(rows, COLUMNS).repartition(3)).collect()), key=str)
    assert got == sorted([(None, a, "de", "y", 1), (2, b, "en", "s", 1), (2, c, None, "s", 1)], key=str)
