"""The dedup operator against a brute-force version."""

import random

import numpy as np
import pyarrow as pa
import pytest

from cellgrid.llm import near_dedup, queries
from cellgrid.llm.common import words_ascii
from cellgrid.llm.near_dedup import connected_components, near_duplicates


def brute(rows, width=4, similarity=80):
    """All pairs, sets of word tuples, union-find. rows: (id, text)."""
    sets = {}
    for i, text in rows:
        w = words_ascii(text)
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            x, y = sets[i], sets[j]
            if x and y and min(len(x), len(y)) * 100 >= similarity * max(len(x), len(y)):
                n = len(x & y)
                if 100 * n >= similarity * (len(x) + len(y) - n):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed, groups=12, copies=9):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([2, 5, 30, 120, 400]))]
        for _ in range(rng.randint(1, copies)):
            now = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                now[rng.randrange(len(now))] = word()
            texts.append(" ".join(now))
            if rng.random() < 0.4:
                base = now  # chains: each is near the one before, not near the first
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed, 40)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("limits", [{"SMALL_BUCKET": 2, "BLOCK": 3}, {"FAMILY_ROWS": 3, "BLOCK": 2}, {"BROADCAST_IDS": 0, "FAMILY_ROWS": 2, "BLOCK": 1, "FAMILY_BYTES": 9000}])
def test_large_groups_go_block_by_block(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(near_dedup, name, value)
    rows = corpus(7, 25, 20)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None, 0), (2, "", 0), (3, " \n ", 0), (5, "One two", 0), (4, "one  TWO", 0), (6, "one two three", 0), (7, long, 0), (8, long + " end", 0), (9, "a b c d", 0), (9, "a b c d", 0), (None, "a b c d", 0)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, comp int"), shingle_words=4).collect()
    by = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str)
    assert by == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (5, 1, 4, False), (4, 1, 4, True), (6, 1, 6, True), (7, 29_997, 7, True), (8, 29_998, 7, False), (9, 1, 9, True), (9, 1, 9, True), (None, 1, None, True)], key=str)
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_id_ties_its_texts(spark):
    rows = [(1, "a b c d e"), (2, "a b c d e"), (2, "q r s t u"), (3, "q r s t u")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1)}


def test_query_equals_brute_force_on_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op4_minhash_dedup(spark, sf).collect()
    want = brute(rows)
    assert len(got) == len(rows) and {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert sum(k != c for k, (_, c) in want.items()) > 20


def test_buckets_over_batches_and_partitions():
    """Members of a key that goes over batches meet its first one; the first and last key of a partition say that they may go on."""
    rows = [(1, 5), (1, 6), (2, 1), (3, 1), (3, 4), (3, 9), (3, 9), (4, 2), (5, 7)]
    for size in range(1, len(rows) + 1):
        cut = [rows[i : i + size] for i in range(0, len(rows), size)]
        batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], pa.int64()) for i in (0, 1)], names=["key", "id"]) for part in cut]
        got = sorted(tuple(r.values()) for b in near_dedup._meet(iter(batches)) for r in b.to_pylist())
        assert got == [(1, 5, 5, True), (1, 6, 5, False), (3, 1, 1, False), (3, 4, 1, False), (3, 9, 1, False), (3, 9, 1, False), (5, 7, 7, True)]
    assert list(near_dedup._meet(iter([]))) == []


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(500, i) for i in range(501, 560)]
    root = list(range(600))
    for _ in range(600):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.id: r.comp for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root[i] for a, b in edges if a != b for i in (a, b)}


def test_signature_estimates():
    a, b = near_dedup.hash_family()
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**64, 1000, np.uint64)
    same = (near_dedup.signature(x[:900], a, b) == near_dedup.signature(x[100:], a, b)).mean()
    assert abs(same - 0.8) < 0.12
