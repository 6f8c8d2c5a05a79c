"""The training-data operators against brute force, on small tables with nulls, empty and long texts,
ties, repeated rows and extra columns."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trailmark.llm import (
    arrays,
    chunk_fingerprints,
    elias_fano,
    langid,
    lattice,
    line_dedup,
    lm_scoring,
    packing,
    pieces,
    quality,
    search,
    simhash,
    suffix_dedup,
)
from trailmark.llm.queries import remainder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kind int, bucket int, pos long"


def _rows(seed: int = 3, n: int = 80) -> list[tuple]:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(200)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(20, 60))) for _ in range(8)]
    rows = []
    for i in range(n):
        lines = [
            " ".join(rng.choice(passages) if rng.random() < 0.1 else rng.choice(words) for _ in range(rng.randint(1, 15)))
            for _ in range(rng.randint(1, 6))
        ]
        rows.append((i, "\n".join(lines)))
    rows += [(100 + i, rows[3][1]) for i in range(25)]  # exact copies
    rows += [(130 + i, rows[5][1] + f" {words[i]}") for i in range(25)]  # near copies
    rows += [(200, None), (201, ""), (202, " \n\t "), (203, "x"), (204, "ab " * 4000), (205, "é" * 700), (-7, "\n\n\n\n\n")]
    return rows


@pytest.fixture(scope="module")
def data():
    return _rows()


@pytest.fixture(scope="module")
def docs(spark, data):
    """With columns whose names clash with the operators' own."""
    rows = [(i, t, "en", "s", None, 1, 2, 3) for i, t in data]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _strip(rows, length):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            window = raw[i : i + length]
            if window in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(window)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[doc] = (len(raw), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), kept)
    return out


@pytest.mark.parametrize("seed", [4, 5, 6])
def test_suffix_dedup_is_exact_on_other_tables(spark, seed):
    rows = _rows(seed)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 100).collect()
    want = _strip([(i, t or "") for i, t in rows], 100)
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got} == want


def test_suffix_dedup_is_exact(docs, data):
    got = suffix_dedup.remove_repeats(docs, 100).collect()
    want = _strip([(i, t or "") for i, t in data], 100)
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got} == want
    assert sum(v[1] for v in want.values()) > 0


def test_suffix_dedup_with_many_small_buckets(docs, data, monkeypatch):
    """The sample for splitters grows with the number of buckets; runs reach over bucket boundaries."""
    monkeypatch.setattr(suffix_dedup, "SAMPLE_DOCS", 5)
    monkeypatch.setattr(suffix_dedup, "SAMPLE_ROWS", 1)
    monkeypatch.setattr(suffix_dedup, "BUCKET_ROWS", 60)
    got = suffix_dedup.remove_repeats(docs, 100).collect()
    want = _strip([(i, t or "") for i, t in data], 100)
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got} == want


def test_rows_are_placed_between_cuts_that_tie():
    """Several cuts with the same leading key, and others right after them."""
    rng = np.random.default_rng(1)
    for _ in range(200):
        cuts = sorted(tuple(int(x) for x in rng.integers(0, 3, 4)) for _ in range(rng.integers(0, 12)))
        rows = [tuple(int(x) for x in rng.integers(0, 4, 4)) for _ in range(50)]
        columns = lambda xs: [np.array([x[k] for x in xs], np.int64) for k in range(4)]
        assert arrays.place(columns(rows), columns(cuts)).tolist() == [sum(c < r for c in cuts) for r in rows]


def test_suffix_dedup_repeated_rows_null_ids_and_carried_columns(spark, empty):
    a, b = "0123456789" * 30, "abcdefghij" * 15
    df = spark.createDataFrame([(1, a, "x"), (1, a, "x"), (2, a + b, "y"), (None, b, "z")], "doc_id long, text string, kept string")
    got = suffix_dedup.remove_repeats(df.select("doc_id", "text", F.col("kept").alias("mark")), 100, as_text=True, carry=["mark"])
    rows = sorted(((r.doc_id or -1, r.n_bytes, r.n_removed, r.kept, r.mark) for r in got.collect()))
    want = _strip([(-1, b), (1, a), (2, a + b)], 100)  # a null id sorts first; equal rows are one document
    assert rows == [(i, *want[i][:2], want[i][3].decode(), m) for i, m in ((-1, "z"), (1, "x"), (1, "x"), (2, "y"))]
    assert suffix_dedup.remove_repeats(empty).collect() == []


def _fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(prints):
    parent = {i: i for i in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in prints}


def test_simhash_equals_brute_force(docs, data, empty):
    got = simhash.near_duplicates(docs).collect()
    prints = {i: _fingerprint(t) for i, t in data}
    assert {r.doc_id: r.fp & (2**64 - 1) for r in got} == prints
    assert {r.doc_id: r.component_id for r in got} == _components(prints)
    assert simhash.near_duplicates(empty).collect() == []


def test_simhash_links_in_large_variant_groups(spark):
    """Many fingerprints that share a variant: more than are compared pair by pair."""
    rng = random.Random(1)
    base = rng.getrandbits(64)
    prints = {}
    for i in range(150):
        fp = base
        for b in rng.sample(range(64), rng.randint(0, 4)):
            fp ^= 1 << b
        prints[i] = fp
    distinct = {}
    for i, fp in prints.items():
        distinct.setdefault(fp, i)
    df = spark.createDataFrame([(i, fp - 2**64 if fp >= 2**63 else fp) for fp, i in distinct.items()], "rep long, fp long")
    linked = {frozenset((r.u, r.v)) for r in simhash.links(df, 2).collect()}
    by_id = {i: fp for fp, i in distinct.items()}
    assert all((by_id[u] ^ by_id[v]).bit_count() <= 2 for u, v in map(tuple, linked))
    want = _components(by_id)
    parent = {i: i for i in by_id}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in map(tuple, linked):
        a, b = root(u), root(v)
        parent[max(a, b)] = min(a, b)
    assert {i: root(i) for i in by_id} == want


def test_forward_sums_all_segmentations():
    vocabulary = lattice.Pieces(["a", "b", "ab", "ba", "aba"])
    p = np.array([[0.3], [0.2], [0.1], [0.25], [0.15]])

    def total(word):
        if not word:
            return 1.0
        parts = [(t, p[i, 0]) for i, t in enumerate(vocabulary.texts) if word.startswith(t)]
        if not any(len(t) == 1 for t, _ in parts):
            parts.append((word[0], langid.UNKNOWN))
        return sum(q * total(word[len(t) :]) for t, q in parts)

    words = ["ab", "abab", "b", "abxba", "aabba"]
    for at, matrix in lattice.by_length(words):
        assert np.allclose(langid.forward(vocabulary, matrix, p)[-1][:, 0], [total(words[i]) for i in at], rtol=1e-12)


def test_language_id(spark, empty):
    rng = random.Random(2)
    stock = {"xx": ["the", "and", "over", "house", "water"], "yy": ["der", "und", "über", "haus", "wasser"]}
    rows = [(i, " ".join(rng.choices(stock[g], k=12)), g) for i in range(120) for g in [("xx", "yy")[i % 2]]]
    rows += [(500, None, "xx"), (501, "12 34 !", "yy"), (502, "", None), (503, "the the and", None), (None, "und der haus", "yy")]
    rows += [(504, "wasser" * 500, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(df, remainder(4) != 2).collect()}
    assert all(got[i].lang_pred == ("xx", "yy")[i % 2] and got[i].score > 0.9 for i in range(120))
    assert [(got[i].lang_pred, got[i].score) for i in (500, 501, 502)] == [("und", 0.0)] * 3
    assert got[503].lang_pred == "xx" and got[None].lang_pred == "yy" and got[504].lang_pred == "yy"
    assert langid.identify(empty, remainder(4) != 2).collect() == []
    unlearned = langid.identify(df.withColumn("lang", F.lit(None).cast("string")), remainder(4) != 2)
    assert {(r.lang_pred, r.score) for r in unlearned.collect()} == {("und", 0.0)}


def test_edited_texts_and_fingerprints(docs, data, empty):
    order = sorted(((i, t or "") for i, t in data), reverse=True)
    got = {r.doc_id: r for r in chunk_fingerprints.compare_edited(docs).collect()}
    prints = {i: chunk_fingerprints.fingerprints([t.encode()])[0] for i, t in order}
    assert len(got) == len(order)
    for (i, t), (j, nxt) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].fingerprint == chunk_fingerprints.as_text(prints[i])
        assert got[i].near_next == chunk_fingerprints.likeness(prints[i], prints[j])
        assert 0 <= got[i].near_edited <= 1
    assert got[100].fingerprint == got[3].fingerprint
    assert chunk_fingerprints.compare_edited(empty).collect() == []
    one = chunk_fingerprints.compare_edited(docs.where("doc_id = 4")).first()
    assert one.near_next == 1.0


def test_chunks_resist_shifts():
    rng = random.Random(5)
    text = bytes(rng.choice(b"abcdefghij ") for _ in range(20_000))
    a, b = chunk_fingerprints.fingerprints([text, b"inserted " + text])
    assert chunk_fingerprints.likeness(a, b) > 0.98
    assert chunk_fingerprints.from_text(chunk_fingerprints.as_text(a))[0].tolist() == a[0].tolist()
    ends, counts = chunk_fingerprints.chunk_ends(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    sizes = np.diff(np.append(0, ends))
    assert sizes[:-1].min() >= chunk_fingerprints.SMALLEST and sizes.max() <= chunk_fingerprints.LARGEST and counts[0] == len(ends)


def _bigram_scores(rows, mu):
    trained = lambda i: zlib.crc32(str(i).encode()) % 5 != 1
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in rows}
    one, two = Counter(), Counter()
    for i, _ in rows:
        if trained(i):
            one.update(tokens[i])
            two.update(zip(["start", *tokens[i]], tokens[i]))
    n, v = sum(one.values()), len(one)
    out = {}
    for i, _ in rows:
        base = score = 0.0
        for before, w in zip([0, *tokens[i]], tokens[i]):
            p = (one[w] + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            c = one[None] if before == 0 else one[before]
            score += math.log10((two["start" if before == 0 else before, w] + mu * p) / (c + mu))
        out[i] = (len(tokens[i]), sum(one[w] > 0 for w in tokens[i]), n, base, score)
    return out


def test_language_model_scores(docs, data, empty):
    got = lm_scoring.score(docs, remainder(5) != 1, mu=20.0).collect()
    want = _bigram_scores(data, 20.0)
    assert len(got) == len(want)
    for r in got:
        n, known, total, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, abs=2e-4 * n)
    assert lm_scoring.score(empty, remainder(5) != 1).collect() == []


def test_elias_fano_and_trie():
    rng = np.random.default_rng(0)
    values = np.sort(rng.integers(0, 1 << 62, 500, dtype=np.uint64))
    sequence = elias_fano.EliasFano.of(values, 1 << 64)
    assert (sequence[np.arange(500)] == values).all()
    asked = np.concatenate([values[:50], values[:50] + np.uint64(1), np.array([0, 1 << 63], np.uint64)])
    at = sequence.successor(asked, np.zeros(len(asked), np.int64), np.full(len(asked), 500))
    assert (at == np.searchsorted(values, asked)).all()
    pairs = sorted({(int(a), int(b)) for a, b in zip(rng.integers(0, 40, 300), rng.integers(0, 1 << 40, 300))})
    contexts, successors = (np.array(x, np.uint64) for x in zip(*pairs))
    codes = np.arange(1, len(pairs) + 1, dtype=np.uint16)
    trie = elias_fano.Trie(contexts, successors, codes)
    assert (trie.find(contexts, successors) == codes).all()
    assert not trie.find(contexts, successors ^ np.uint64(1 << 39)).any()
    assert not trie.find(contexts + np.uint64(1000), successors).any()
    trie.close()


def test_packing(docs, data, empty):
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*reference.encode(t or "", add_special_tokens=False).ids, 2] for i, t in data}
    got = packing.pack(docs, capacity=64).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert bytes(r.ids) == part and zlib.crc32(part) == r.ids_crc32
    for i, rows in by_doc.items():
        rows.sort(key=lambda r: r.piece)
        assert [r.piece for r in rows] == list(range(len(rows)))
        assert sum(r.length for r in rows) == len(ids[i]) and all(r.length == 64 for r in rows[1:])
    assert set(by_doc) == set(ids)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    least = math.ceil(sum(map(len, ids.values())) / 64)
    assert len(by_sequence) <= 1.05 * least + 2
    whole = packing.sequences(packing.pack(docs, capacity=64)).collect()
    assert sum(len(r.ids) // 4 for r in whole) == sum(map(len, ids.values()))
    assert packing.pack(empty).collect() == []


def test_packing_plan_places_every_rank_once():
    rng = random.Random(4)
    for _ in range(30):
        counts = {rng.randint(1, 50): rng.randint(1, 40) for _ in range(rng.randint(1, 25))}
        filled = defaultdict(list)
        for length, first, past, sequence, each, place in packing.plan(counts, 50):
            for t in range(past - first):
                filled[sequence + t // each].append((place + t % each * length, length))
        placed = Counter(length for parts in filled.values() for _, length in parts)
        assert placed == Counter(counts)
        for parts in filled.values():
            parts.sort()
            assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= 50


def test_word_cache_equals_the_tokenizer():
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.tokenizer(public_tokenizers.path(packing.VOCABULARY))
    rng = random.Random(6)
    parts = [" ", "\n", "\t", "a", "the", "é", "'s", "'", "1", ".", "$", " ", "　", "日", "  "]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(encode(text), "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids, repr(text)


def test_line_dedup(docs, data, empty):
    seen, want = set(), {}
    for i, text in sorted((i, t) for i, t in data):
        lines = text.split("\n") if text is not None else []
        gone = set()
        for k in range(len(lines) - 2):
            window = tuple(lines[k : k + 3])
            if window in seen:
                gone |= {k, k + 1, k + 2}
            seen.add(window)
        want[i] = (len(lines), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone))
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept) for r in line_dedup.remove_repeated_lines(docs).collect()}
    assert got == want and any(v[1] for v in want.values())
    assert line_dedup.remove_repeated_lines(empty).collect() == []
    plan = line_dedup.remove_repeated_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_search_equals_brute_force(docs, data, empty):
    counts = {i: Counter((t or "").encode().lower().split()) for i, t in data}
    length = {i: sum(c.values()) for i, c in counts.items()}
    mean, n = sum(length.values()) / len(counts), len(counts)
    df = Counter(w for c in counts.values() for w in c)
    got = defaultdict(list)
    for r in search.search(docs, F.col("doc_id") % 20 == 0, k=5).collect():
        got[r.query_id].append((r.rank, r.doc_id, r.score))
    for q in (i for i in counts if i % 20 == 0):
        scores = Counter()
        for w, times in counts[q].items():
            weight = float(np.float32(times * math.log1p((n - df[w] + 0.5) / (df[w] + 0.5))))
            for i, c in counts.items():
                if w in c:
                    scores[i] += weight * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * length[i] / mean))
        best = sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:5]
        mine = sorted(got[q])
        assert [s for *_, s in mine] == pytest.approx([s for _, s in best])
        assert [r for r, *_ in mine] == list(range(1, len(best) + 1))
    assert search.search(empty, F.col("doc_id") % 20 == 0).collect() == []


def test_pruned_search_equals_full_scores():
    import pyarrow as pa

    rng = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(400)], k=rng.randint(0, 60))) for _ in range(900)]
    index = search.Index(np.arange(900), pa.array(texts), 30.0)
    terms = index.words[::7]
    weights = np.linspace(0.1, 3, len(terms)).astype(np.float32)
    ids, scores = index.search(terms, weights, 10)
    full = np.zeros(900)
    for t, w in zip(terms, weights):
        at = int(np.searchsorted(index.words, t))
        a, b = index.first[index.entries[at]], index.first[index.entries[at + 1]]
        full[index.ids[index.doc[a:b]]] += float(w) * index.impact[a:b]
    order = sorted(range(900), key=lambda i: (-full[i], i))[:10]
    assert np.allclose(scores, full[order])


def test_quality(spark, empty):
    rng = random.Random(9)
    good = ["river", "stone", "garden", "window", "letter"]
    rows = [(i, " ".join(rng.choices(good, k=30)) if i % 3 else "!!! ### $$$ " * rng.randint(3, 9)) for i in range(240)]
    rows += [(900, None), (901, ""), (902, "ab"), (903, "river stone " * 3000), (None, "garden letter window river")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(240)] + [(5, 0), (None, 1), (7, None)], "doc_id long, label int")
    got = {r.doc_id: r.score for r in quality.score(df, labels, remainder(4) != 2).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all((got[i] >= 0.7) == (i % 3 > 0) for i in held)
    assert [got[i] for i in (900, 901, 902)] == [0.0] * 3 and got[903] > 0.7 and got[None] > 0.7
    assert quality.score(empty, labels, remainder(4) != 2).collect() == []
    assert {r.score for r in quality.score(df, labels.where("false"), remainder(4) != 2).collect()} == {0.0}


def test_pieces_round_trip(docs, data, empty):
    got = {r.doc_id: r for r in pieces.decode(pieces.encode(docs)).collect()}
    assert {i: r.text for i, r in got.items()} == dict(data)
    assert got[200].ids is None and got[201].ids == []
    odd = ["a▁b ▁", "\0 x\0", "  two  spaces ", "日本 語\n\r\t", "﷐ \U0001f600", "z" * 1000]
    path = public_tokenizers.path(pieces.VOCABULARY)
    ids, counts = pieces.encode_texts(odd, path)
    assert pieces.decode_ids(ids, counts, path) == odd
    assert pieces.encode(empty).collect() == []


def test_viterbi_finds_the_best_segmentation():
    vocabulary = lattice.Pieces(["a", "b", "ab", "ba", "aba", "bb"])
    scores = np.array([-3.0, -2.5, -4.0, -4.2, -6.0, -5.5])

    def best(word):
        table = [(0.0, [])]
        for j in range(1, len(word) + 1):
            options = [
                (table[i][0] + s, [*table[i][1], k])
                for k, (t, s) in enumerate(zip(vocabulary.texts, scores))
                for i in [j - len(t)]
                if i >= 0 and word[i:j] == t
            ]
            options.append((table[j - 1][0] + scores.min() - 10, [*table[j - 1][1], -1]))
            table.append(max(options, key=lambda o: o[0]))
        return table[-1][0]

    words = ["ab", "abab", "bbba", "axb", "ababab", "b"]
    for at, matrix in lattice.by_length(words):
        for i, path in zip(at, pieces.best_paths(vocabulary, scores, matrix)):
            used = [p for p in path if p >= 0]
            total = sum(scores[p] if p < 1 << 24 else scores.min() - 10 for p in used)
            assert total == pytest.approx(best(words[i]))
