"""A training corpus from raw documents: five stages, each over all that the one before kept.

Every stage reads a table with the columns of ``documents`` and is written as Parquet in the shared folder before the next
one reads it, so a lost executor repeats work of one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.llm import decontaminate, language_id, mixing, near_dedup, pii
from cellgrid.llm.common import bound_batches, materialise, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go. The others stay, and those without a language get the predicted one; where no document has a
    language there is no model, and they stay as they are."""
    bound_batches(spark)
    model = language_id.fit(docs, text_col="text", lang_col="lang")
    if not model.languages:
        return language_id.lettered(docs.select(COLUMNS))
    # Undetermined is told by the score, since a corpus may name a language of its own ``und``.
    judged = language_id.apply(docs.select(COLUMNS), model).where("score > 0")
    return judged.withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate rows the one with the smallest id stays; 5-word shingles, similarity 0.8. Rows that only share an id all stay."""
    bound_batches(spark)
    return near_dedup.representatives(docs.select(COLUMNS), shingle_words=5, similarity=80)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    bound_batches(spark)
    return decontaminate.clean(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by the name of its kind; all documents stay."""
    bound_batches(spark)
    return pii.redact(docs.select(COLUMNS), pii.fit())


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them, numbered by ``copy``."""
    return mixing.mix(docs.select(COLUMNS))


STAGES = [
    ("language ID", languages),
    ("near-duplicates", near_duplicates),
    ("decontamination", benchmark_free),
    ("personal data", private_data),
    ("mixing", mixture),
]

#: Language scores, minima and a random field can't be put in SQL; tests/llm compares the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
