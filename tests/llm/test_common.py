"""Tables in the shared folder, words."""

import os

from cellgrid.llm import common


def test_shared_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    common._made.clear()
    kept = common.materialise(spark.range(5), "one")
    gone = common.materialise(kept.where("id > 2"), "two")
    assert gone.count() == 2 and len(os.listdir(tmp_path)) == 2
    common.forget(gone)
    assert len(os.listdir(tmp_path)) == 1 and common.materialise(spark.range(0), "none").count() == 0
    assert common.drop_tables(spark) == 3 and os.listdir(tmp_path) == []


def test_shared_folder_is_the_named_one(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert common.shared_dir(spark) == (named.rstrip("/") if named else common.shared_dir(spark))


def test_words(spark):
    from pyspark.sql import functions as F

    texts = [None, "", " \t\n\x0b\x0c\r", "a b", " É\u00a0x  Y\n", "one"]
    got = [r.n for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(common.n_words(F.col("t")).alias("n")).collect()]
    assert got == [len(common.words_ascii(t)) for t in texts] == [0, 0, 0, 2, 2, 1]
    assert common.words_ascii(" ÉX Y") == ["Éx".encode(), b"y"]
