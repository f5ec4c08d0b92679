"""The queries opN_<name> of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle, quality_sql
from .common import bound_batches, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import apply, fit

    bound_batches(spark)
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = fit(docs.where(~held_out), text_col="text", lang_col="lang")
    return apply(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


#: The list that the method holds: of the corpus's hosts and their parents those of three labels or more whose MD5 begins with one of these
#: digits, and LISTED_ELSEWHERE hosts that the corpus doesn't know.
LISTED_DIGITS, LISTED_ELSEWHERE = "0123", 5_000
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge, universe

    bound_batches(spark)
    pages = table(spark, sf_dir, "pages")
    known = universe(pages).where(F.size(F.split("key", "[.]")) >= 3).where(F.substring(F.md5("key"), 1, 1).isin(*LISTED_DIGITS)).distinct()
    elsewhere = spark.range(LISTED_ELSEWHERE).select(F.concat(F.md5(F.col("id").cast("string")), F.lit(".listed.invalid")).alias("key"))
    return judge(pages, known.union(elsewhere), URL_RULES, keep=["page_id"])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import plan

    taken = F.col("copies") * F.col("size")
    return plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    bound_batches(spark)
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4, similarity=80)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination, item_digest

    bound_batches(spark)
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), item_digest("items").alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find, fit, summary

    bound_batches(spark)
    return summary(find(table(spark, sf_dir, "documents").select("doc_id", "text"), fit()))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import perspectives

    return perspectives(table(spark, sf_dir, "conversations"), pieces=False)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_archives, write_archives

    bound_batches(spark)
    return read_archives(spark, write_archives(table(spark, sf_dir, "pages")))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract, fit

    bound_batches(spark)
    return extract(table(spark, sf_dir, "pages"), fit())


def queries() -> dict:
    return {
        f.__name__: f
        for f in (op1_language_id, op2_url_filter, op3_mixing, op4_minhash_dedup, op5_quality, op6_decontaminate, op7_pii, op8_chat, op9_warc, op10_html_extract)
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filter": oracle.url_filter(URL_RULES, LISTED_DIGITS),
        "op3_mixing": oracle.MIXING,
        "op5_quality": quality_sql.sql(),
        "op6_decontaminate": oracle.DECONTAMINATE,
        "op8_chat": oracle.CHAT,
        "op9_warc": oracle.WARC,
    }
