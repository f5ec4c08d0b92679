r"""Quality rules by distribution divergence, with DataFrame functions only.

Each document's characters fall into eight classes and its words into the commonest words of its language and the rest.
Both histograms are compared with the language's reference, the sum over all documents of that language that pass
the base rules, by Jensen-Shannon distance (square root of the divergence in bits, 0 to 1). A document is kept if it passes the base
rules and neither distance is beyond its limit. Histograms of short documents scatter, so distances count only from
``LEAST_WORDS`` words on, the limit of words is ``WORD_LIMIT`` and ``WORD_SCATTER`` over the root of their number, and a
reference counts only if it holds ``LEAST_REFERENCE`` words.

The common words of a language are learned: the ``COMMON`` most frequent ones of all its documents that pass the base rules, among words
of at least a ``LEAST_SHARE``-th of all (so at most that many of a language are ranked). Any value of lang gets a list of its own.

Base rules: fewer than 50 words, or more than half of the words inside 3-word windows that occur twice.

The texts are read twice: to learn the lists (words are counted by partial sums before one shuffle), and for the features, which are kept
once, as a narrow table in the shared folder. Lists and references are one row per language. Words of a document are counted in the row they
stand in, which takes about 60 bytes a word: a text of any length is judged whole as long as a task can hold that.

Defined results: null text has no words and fails the base rules; null languages are one language; a language without a document that passes the
base rules has no reference, so only the base rules judge it; words that are equally frequent go by their text; repeated rows are judged alike;
documents that repeat an id stay apart; other columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import looked_up, materialise

LEAST_WORDS = 50
LEAST_REFERENCE = 1_000
CHAR_LIMIT = 0.32
WORD_LIMIT, WORD_SCATTER = 0.30, 0.40

COMMON, LEAST_SHARE = 16, 500
#: Regular expressions of the classes, taken away one after the other; what is left over is the eighth.
CHAR_CLASSES = (r"[a-z]+", r"[\x20\x09-\x0D]+", r"[A-Z]+", r"[.,;:!?'\"()-]+", r"[\x80-\x{10FFFF}]+", r"[#*$%&|<>]+", r"[0-9]+")


def _worded(docs: DataFrame) -> DataFrame:
    """docs with the words of their texts, n_words, n_repeat_words and base_failed."""
    at = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    at = at.withColumn("words", F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')")).withColumn("n_words", F.size("words").cast("long"))
    hashes = "CASE WHEN size(words) >= 4 THEN transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])) END"
    at = at.withColumn("windows", F.expr(hashes))
    # Only where two windows have one hash are their places looked at: sorted by hash, equal neighbours are the repeated ones.
    again = "CASE WHEN size(array_distinct(windows)) < size(windows) THEN sort_array(transform(windows, (h, i) -> struct(h AS h, i AS i))) END"
    at = at.withColumn("again", F.expr(again))
    at = at.withColumn("pairs", F.expr("CASE WHEN again IS NOT NULL THEN filter(sequence(0, size(again) - 2), j -> again[j].h = again[j + 1].h) END"))
    starts = "sort_array(array_distinct(concat(transform(pairs, j -> again[j].i), transform(pairs, j -> again[j + 1].i))))"
    at = at.withColumn("twice", F.expr(f"CASE WHEN pairs IS NOT NULL THEN {starts} END"))
    covered = "aggregate(twice, struct(0L AS n, 0 AS stop), (a, p) -> struct(a.n + p + 3 - greatest(a.stop, p) AS n, p + 3 AS stop)).n"
    at = at.withColumn("n_repeat_words", F.expr(f"CASE WHEN twice IS NOT NULL THEN {covered} ELSE 0L END")).drop("windows", "again", "pairs", "twice")
    return at.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def common_words(docs: DataFrame) -> DataFrame:
    """(list_lang, listed): the commonest words of each language, the most frequent first."""
    # Not by a filter on base_failed, which the optimizer would push below the columns it is made of and so write out in full, lambda in lambda.
    words = _worded(docs).select("lang", F.explode_outer(F.expr("CASE WHEN NOT base_failed THEN words END")).alias("word")).where("word IS NOT NULL")
    told = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    told = materialise(told, "vocabulary")
    totals = materialise(told.groupBy("lang").agg(F.sum("n").alias("total")).select(F.col("lang").alias("total_lang"), "total"), "totals")
    often = told.join(looked_up(totals), F.col("lang").eqNullSafe(F.col("total_lang"))).where(F.col("n") * LEAST_SHARE >= F.col("total"))
    ranked = often.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("rank") <= COMMON)
    lists = ranked.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "word"))).alias("listed"))
    return materialise(lists.select(F.col("lang").alias("list_lang"), F.col("listed.word").alias("listed")), "lists")


def features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the base counts, base_failed, char_counts and word_counts of each document."""
    at = _worded(docs).join(looked_up(common_words(docs)), F.col("lang").eqNullSafe(F.col("list_lang")), "left").withColumn("r0", F.length("text"))
    rest = F.col("text")
    for i, pattern in enumerate(CHAR_CLASSES):
        at = at.withColumn(f"t{i}", F.regexp_replace(rest, F.lit(pattern), F.lit(""))).withColumn(f"r{i + 1}", F.length(f"t{i}"))
        rest = F.col(f"t{i}")
        if i:
            at = at.drop(f"t{i - 1}")
    n = len(CHAR_CLASSES)
    at = at.withColumn("char_counts", F.array(*[(F.col(f"r{i}") - F.col(f"r{i + 1}")).cast("long") for i in range(n)], F.col(f"r{n}").cast("long")))
    at = at.withColumn("lines", F.expr(r"filter(split(text, '\\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')"))
    at = at.withColumn("listed", F.coalesce("listed", F.array().cast("array<string>")))
    at = at.withColumn("common", F.expr("filter(words, w -> array_contains(listed, w))"))
    at = at.withColumn("found", F.expr("transform(listed, w -> CAST(size(common) - size(array_remove(common, w)) AS long))"))
    at = at.withColumn("word_counts", F.expr("concat(found, array(n_words - size(common)))"))
    return at.select(
        "doc_id", "lang", "n_words", (F.col("r0") - (F.col("r1") - F.col("r2"))).cast("long").alias("word_chars"), (F.col("r5") - F.col("r6")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words", "base_failed", "char_counts", "word_counts",
    )


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts, 0 where one of them is empty."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    x, y = F.transform(p, lambda v: v / total(p)), F.transform(q, lambda v: v / total(q))
    terms = F.zip_with(x, y, lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2)
    return F.when((total(p) > 0) & (total(q) > 0), F.sqrt(F.greatest(total(terms), F.lit(0.0)))).otherwise(0.0)


def references(rows: DataFrame) -> DataFrame:
    """lang, ref_chars, ref_words, ref_size: sums over the documents that pass the base rules. One row per language."""
    good = rows.where("NOT base_failed")
    n, k = len(CHAR_CLASSES) + 1, COMMON + 1
    sums = [F.coalesce(F.sum(F.get("char_counts", F.lit(i))), F.lit(0)).alias(f"c{i}") for i in range(n)]
    # Lists differ in length by language, the last place being the rest: sums are taken by place, and places beyond the list are null.
    sums += [F.sum(F.get("word_counts", F.lit(i))).alias(f"w{i}") for i in range(k)]
    by = good.groupBy(F.col("lang").alias("ref_lang")).agg(*sums, F.sum("n_words").alias("ref_size"))
    words = F.filter(F.array(*[f"w{i}" for i in range(k)]), lambda v: v.isNotNull())
    return by.select("ref_lang", F.array(*[f"c{i}" for i in range(n)]).alias("ref_chars"), words.alias("ref_words"), "ref_size")


def quality(docs: DataFrame, char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT) -> DataFrame:
    """doc_id, n_words, the base counts, base_failed and kept."""
    return judged(docs, char_limit, word_limit).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def judged(docs: DataFrame, char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT) -> DataFrame:
    """As quality(), with both distances."""
    rows = materialise(features(docs), "features")
    both = rows.join(looked_up(materialise(references(rows), "references")), F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    counts = (F.col("n_words") >= LEAST_WORDS) & (F.coalesce("ref_size", F.lit(0)) >= LEAST_REFERENCE)
    no = F.array().cast("array<bigint>")
    both = both.withColumn("ref_chars", F.coalesce("ref_chars", no)).withColumn("ref_words", F.coalesce("ref_words", no))
    chars = F.when(counts, distance(F.col("char_counts"), F.col("ref_chars"))).otherwise(0.0)
    words = F.when(counts & (F.size("word_counts") > 1), distance(F.col("word_counts"), F.col("ref_words"))).otherwise(0.0)
    both = both.withColumn("char_distance", chars).withColumn("word_distance", words)
    return both.withColumn("kept", ~F.col("base_failed") & (F.col("char_distance") <= char_limit) & (F.col("word_distance") <= F.lit(word_limit) + F.lit(WORD_SCATTER) / F.sqrt(F.greatest("n_words", F.lit(1)))))
