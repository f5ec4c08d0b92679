"""Winnowing against all windows compared by brute force."""

import hashlib
import random
import re

import pytest

from cellgrid.llm.decontaminate import GRAM, SPAN, clean, contamination, item_digest, words_of

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = WORD.findall(lower(text))
        k = min(len(w), SPAN)
        for i in range(len(w) - k + 1) if w else ():
            windows.setdefault(tuple(w[i : i + k]), set()).add(item)
    out = []
    for doc, text in docs:
        w = WORD.findall(lower(text))
        hit, got = set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if found := windows.get(tuple(w[i : i + k])):
                    hit.update(range(i, i + k))
                    got |= found
        out.append((doc, len(w), len(hit), tuple(sorted(str(x) for x in got if x is not None))))
    return sorted(out, key=str)


def fixture(seed):
    rng = random.Random(seed)
    vocab = ["Alpha", "beta", "GAMMA", "délta", "ε", "x1", "7", "zeta", "ÄETA", "theta", "iota", "kappa"]
    text = lambda n: rng.choice([" ", ", ", "\n", "-"]).join(rng.choice(vocab) + (str(rng.randrange(40)) if rng.random() < 0.7 else "") for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 9, 10, 11, 30]))) for i in range(30)] + [(40, None), (41, ""), (None, "lone null item words"), (5, text(12))]
    docs = []
    for i in range(120):
        parts = [text(rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            w = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(w) + 1)
            parts += [" ".join(w[a : a + rng.choice([8, 9, 10, 14, 50])]).upper() if rng.random() < 0.3 else " ".join(w[a : a + rng.choice([9, 10, 14, 50])]), text(rng.randrange(20))]
        docs.append((i, " ".join(parts)))
    return docs + [(200, None), (201, ""), (202, " ... "), (7, docs[7][1]), (None, items[3][1]), (203, "lone null item words")], items


def result(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in df.collect()), key=str)


@pytest.mark.parametrize("limit", [1 << 20, 0])
@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed, limit):
    docs, items = fixture(seed)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert result(contamination(d, b, broadcast_bytes=limit)) == brute(docs, items)


def test_every_shared_span_of_ten_words_is_found():
    from cellgrid.llm.decontaminate import Codes, Index

    import numpy as np

    rng = random.Random(3)
    item = [f"w{rng.randrange(5)}" for _ in range(200)]
    index, codes = Index([("i", " ".join(item))]), Codes()
    for start in range(0, 190):
        words = [f"q{k}".encode() for k in range(7)] + words_of(" ".join(item[start : start + SPAN])) + [b"zz"] * 5
        n, got = index.hits(words, np.array([codes[w] for w in words], np.uint64))
        assert n == SPAN and got == {"i"}
    assert GRAM < SPAN


def test_every_window_picks_one_position_and_runs_are_kept_once():
    import numpy as np

    from cellgrid.llm.decontaminate import WINDOW, picked

    rng = np.random.default_rng(4)
    for n in [0, 1, WINDOW - 1, WINDOW, 50, 400]:
        for values in (3, 1 << 40):
            h = rng.integers(0, values, n).astype(np.uint64)
            want = sorted({max(range(i, i + WINDOW), key=lambda j: (-int(h[j]), j)) for i in range(n - WINDOW + 1)})
            assert picked(h).tolist() == want


def test_phrase_of_many_documents_and_many_items_by_shuffle(spark):
    phrase = " ".join(f"p{i}" for i in range(30))
    items = [(i, f"{phrase} own words of item {i}") for i in range(60)] + [(100, "p0 p1 p2"), (101, "p1 p1")]
    docs = [(i, f"d{i} {phrase if i % 4 else phrase[:40]} e{i}") for i in range(200)] + [(300, "a " * 3000 + phrase), (301, "p1 " * 40)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert result(contamination(d, b, broadcast_bytes=0)) == brute(docs, items)


def test_long_text_and_clashing_columns(spark):
    words = [f"w{i}" for i in range(60_000)]
    docs = spark.createDataFrame([(1, " ".join(words), "x", 3), (2, "nothing here", "y", 4)], "doc_id long, text string, items string, n_hit int")
    bench = spark.createDataFrame([(9, " ".join(words[50_000:50_020]), 1)], "item_id long, text string, doc_id int")
    assert result(contamination(docs, bench)) == [(1, 60_000, 20, ("9",)), (2, 2, 0, ())]
    assert [tuple(r) for r in clean(docs, bench).collect()] == [(2, "nothing here", "y", 4)]


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert result(contamination(docs, bench)) == [(1, 3, 0, ())]
    assert contamination(docs.where("false"), bench).count() == 0
    row = contamination(docs, bench).select(item_digest("items").alias("h")).first()
    assert row.h == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_clean_judges_rows_not_ids(spark, limit):
    leak = "one two three four five six seven eight nine ten eleven"
    rows = [(None, leak, 1), (None, "clean of null id", 2), (None, None, 3), (7, leak.upper(), 4), (7, "clean of id seven", 5), (7, "clean of id seven", 5), (8, "one two three", 6), (0, "", 7), (None, "clean of null id", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row int").repartition(3)
    bench = spark.createDataFrame([(1, leak), (None, None)], "item_id long, text string")
    got = clean(docs, bench, broadcast_bytes=limit)
    assert got.columns == docs.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(r) for r in rows if r[2] not in (1, 4))


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_clean_equals_brute_force(spark, limit):
    docs, items = fixture(3)
    rows = [(i if i % 5 else None, text, k) for k, (i, text) in enumerate((i or 0, text) for i, text in docs)]
    want = [r for r in rows if not brute([(1, r[1])], items)[0][2]]
    d, b = spark.createDataFrame(rows, "doc_id long, text string, k int"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(str, map(tuple, clean(d, b, broadcast_bytes=limit).collect()))) == sorted(map(str, want)) and len(want) < len(rows)
