"""The pipeline against brute-force versions of its stages, one after the other."""

import collections
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cellgrid.llm import mixing, pii

from .test_decontaminate import brute as leaks
from .test_near_dedup import brute as groups
from .test_pii import stated
from .test_texts import filled, sizes_of

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return tmp_path_factory.mktemp("sf")


@pytest.fixture(scope="module")
def rows(spark, folder):
    """Real documents, and some hard ones."""
    taken = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(COLUMNS).collect()
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    leak = bench.orderBy("item_id").first().text
    rng = random.Random(1)
    prose = lambda n: " ".join(rng.choice(["the", "of", "and"]) + rng.choice("abcdefgh") * rng.randrange(1, 5) for _ in range(n))
    base = prose(300)
    made = [(10_000 + i, base + f" tail{i}", "en", "src0", 5) for i in range(20)]
    made += [(20_000, None, "en", "src1", 0), (20_001, "", None, None, 0), (20_002, "12 !!", "de", "src1", 5), (20_003, "the of and " + leak, "en", None, 9)]
    made += [(20_004, "call +1 (017) 555-7713 or a.b@c.de of the and", "en", None, 9), (20_005, prose(20_000), "en", "src2", 9)]
    out = [tuple(r) for r in taken] + made
    spark.createDataFrame(out, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{folder}/documents.parquet")
    bench.write.parquet(f"{folder}/benchmark.parquet")
    return out, [tuple(r) for r in bench.collect()]


def test_stages(spark, folder, rows):
    docs, items = rows
    now = {r[0]: r for r in docs}
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, str(folder))
        frame.write.parquet(f"{folder}/{name.replace(' ', '-')}")
        frame = spark.read.parquet(f"{folder}/{name.replace(' ', '-')}")
        got[name] = frame
        if name != "mixing":
            assert frame.columns == COLUMNS
    rows_of = lambda name: {r.doc_id: tuple(r) for r in got[name].collect()}
    now = {i: r for i, r in now.items() if r[1] and any(c.isalpha() for c in r[1])}
    assert rows_of("language ID") == now
    heads = groups([(i, r[1]) for i, r in now.items()], width=5)
    now = {i: r for i, r in now.items() if heads[i][1] == i}
    assert rows_of("near-duplicates") == now and sum(10_000 <= i < 10_020 for i in now) == 1
    bad = {r[0] for r in leaks([(i, r[1]) for i, r in now.items()], items) if r[2]}
    now = {i: r for i, r in now.items() if i not in bad}
    assert rows_of("decontamination") == now and 20_003 in bad
    field, clean = pii.fit(), rows_of("personal data")
    assert set(clean) == set(now)
    for i, r in now.items():
        assert not stated(clean[i][1]) and clean[i][4] == (len(clean[i][1]) if clean[i][1] != r[1] else r[4])
        if not pii.all_spans([r[1]], pii.Tables(field))[0][0] and not pii.all_spans([r[1]], pii.Tables(field))[0][1]:
            assert clean[i] == r
    assert clean[20_004][1] == "call [PHONE] or [EMAIL] of the and"
    final = collections.Counter(r.doc_id for r in got["mixing"].collect())
    sizes = sizes_of([(i, r[1], r[3]) for i, r in clean.items()])
    goal = filled(sizes)
    for i, r in clean.items():
        rate = goal[r[3]] / sizes[r[3]]
        assert int(rate) <= final[i] <= -(-rate // 1)
    assert set(final) <= set(clean)


def test_run_gives_the_same_rows_again(spark, folder, rows):
    one = collections.Counter(tuple(r) for r in corpus_pipeline.run(spark, str(folder)).collect())
    assert one == collections.Counter(tuple(r) for r in corpus_pipeline.run(spark, str(folder)).collect()) and one
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_repeated_rows_and_null_ids(spark, folder):
    """Rows are judged by their texts: unlike texts of one id stay, like ones go whatever their ids."""
    text, other, third = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    docs = [(1, text), (1, text), (1, other), (None, text), (2, text + " x"), (None, third), (None, third + " y"), (3, other + " z"), (4, None), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], kind)
    got = corpus_pipeline.near_duplicates(spark, docs, str(folder)).collect()
    assert sorted((str(r.doc_id), str(r.text)[:2]) for r in got) == [("1", "a0"), ("1", "b0"), ("4", "No"), ("4", "No"), ("5", ""), ("None", "c0")]


def test_empty_documents(spark, folder, rows):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(folder))
        assert docs.count() == 0
    assert mixing.plan(docs.select(COLUMNS)).agg(F.sum("copies")).first()[0] is None


def test_language_stage_fills_and_keeps(spark, folder):
    en, fr = "the cat and the dog of the house", "le chat et le chien de la maison"
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, en, "en", "s", 1) for i in range(5)] + [(10 + i, fr, "und", "s", 1) for i in range(5)]
    more = [(20, en + " and the", None, "s", 1), (21, "le chien et " + fr, None, "s", 1), (22, "12 !! \u00b2", None, "s", 1), (23, None, "en", "s", 1), (None, en, None, None, 1)]
    kept = lambda r: sorted(map(str, map(tuple, corpus_pipeline.languages(spark, spark.createDataFrame(r, kind), str(folder)).collect())))
    assert kept(rows + more) == sorted(map(str, rows + [(20, en + " and the", "en", "s", 1), (21, "le chien et " + fr, "und", "s", 1), (None, en, "en", None, 1)]))
    bare = [(i, t, None, s, n) for i, t, _, s, n in rows + more]
    assert kept(bare) == sorted(str(r) for r in bare if r[0] not in (22, 23))
