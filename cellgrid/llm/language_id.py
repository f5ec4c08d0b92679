"""Language identification, word first with backoff.

A word that was seen in training is scored by its log frequency in each language. An unseen word falls back to
character n-grams of itself between ``^`` and ``$``, of four characters, then three, two and one: the longest
length of which any n-gram is known scores it, by the mean log frequency of the known ones. A word of which not even a
letter is known tells nothing. The score of a text is the sum over all its words; the confidence is a softmax of the mean
score a word times the number of words up to ``CERTAIN``. Scores are whole numbers of 1 / ``UNIT``, so that sums are exact and
don't depend on the order or on the way they are taken.

Training reads the labelled rows it is given: of each language ``TRAIN_ROWS`` texts at most, those with the smallest digests among
its different texts (a documented bound of a classifier's sample; copies count as one text). Every language, every word
and every n-gram of the sample is kept. Counting is by partial counts in each task and one grouping of (language, word).

A model of up to ``BROADCAST_ENTRIES`` (token, language) pairs and ``DENSE_LANGUAGES`` languages is broadcast, as sorted 64-bit hashes of
its tokens (two different tokens are taken for one another with a probability of 1e-12 a look-up at a million tokens), and texts
stream past it. A larger one stays a table: the different words of the texts meet it by joins, and the texts their
words' scores, with the same answer.

Defined results: null text and text without a letter give ``und`` with score 0; rows with null language or null text
don't train; with no training rows every text with a letter is ``und``; ties go to the first language by name; repeated rows are
judged alike; texts and words of any length are read whole; columns named lang_pred and score are replaced, others kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, share, shared

TRAIN_ROWS = 5_000
BROADCAST_ENTRIES = 3_000_000
DENSE_LANGUAGES = 4_096
LONGEST = 4
#: Where a word's score comes from: words, then n-grams from the longest to the shortest.
SIZES = (0, *range(LONGEST, 0, -1))
UNIT = 1 << 20
CERTAIN = 20
MEMO = 1 << 18
#: Numbers held at once while words are scored.
CELLS = 1 << 21
UNDETERMINED = "und"
_WORD = re.compile(r"[^\W\d_]+")
_SIGN = re.compile(r"[^\W\d_]")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def has_letter(text: str) -> bool:
    """Word characters of the pattern are letters but for some signs like superscript digits."""
    return any(m[0].isalpha() for m in _SIGN.finditer(text))


def ngrams(word: str, n: int) -> list[str]:
    """Of length one the letters themselves; longer ones see where the word begins and ends."""
    if n > 1:
        word = f"^{word}$"
    return [word[i : i + n] for i in range(len(word) - n + 1)]


def decide(languages: list[str], total: np.ndarray, n: int) -> tuple[str, float]:
    """Language and confidence from the summed scores of n words."""
    best = int(total.argmax())
    lead = (total - total[best]) / (n * UNIT) * min(n, CERTAIN)
    return languages[best], 1.0 / math.fsum(np.exp(np.maximum(lead, -700)).tolist())


class Model:
    """languages: in order of name. base: by size of token, the score of an unseen token in each language. table: (size, token,
    lang, gain), a materialised table of what a seen token scores above that; lang is the language's number."""

    def __init__(self, languages: list[str], base: dict[int, np.ndarray], table: DataFrame | None, entries: int):
        self.languages, self.base, self.table, self.entries = languages, base, table, entries

    def lookup(self) -> Lookup:
        """The whole table in the driver; for models within the bound."""
        return Lookup(self.languages, self.base, self.table.select("size", "token", "lang", "gain").toArrow() if self.entries else None)


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS) -> Model:
    spark = labelled.sparkSession
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL").withColumn("digest", F.xxhash64("text"))
    digests = materialise(rows.select("lang", "digest").distinct(), "digests")
    sizes = digests.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    # A first cut by value leaves little more than train_rows digests of a language to be ranked, so no language is a hot key.
    likely = F.col("n") <= 2 * train_rows
    near = digests.join(F.broadcast(sizes), "lang").where(likely | (F.col("digest") < F.lit(-(2.0**63)) + F.lit(2.0**64 * 1.2 * train_rows + 2.0**64 * 40) / F.col("n")))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("digest"))).where(F.col("rank") <= train_rows)
    cuts = materialise(ranked.groupBy("lang").agg(F.max("digest").alias("cut")), "cuts")
    languages = sorted(r.lang for r in cuts.select("lang").collect())
    if not languages:
        return Model([], {}, None, 0)
    sample = rows.join(F.broadcast(cuts), "lang").where("digest <= cut").groupBy("lang", "digest").agg(F.first("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}

        def told() -> pa.RecordBatch:
            flat = [(lang, w, n) for lang, c in seen.items() for w, n in c.items()]
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in flat], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "token", "n"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                seen.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, seen.values())) > MEMO:
                yield told()
                seen.clear()
        yield told()

    counted = materialise(sample.select("lang", "text").mapInArrow(count, "lang string, token string, n long").groupBy("lang", "token").agg(F.sum("n").alias("n")), "words")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "token", "n"))):
                for size in range(1, LONGEST + 1):
                    for g in ngrams(word, size):
                        seen[lang, size, g] += n
            flat = [(*k, n) for k, n in seen.items()]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in flat], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.int64()))], names=["lang", "size", "token", "n"])

    pieces = counted.mapInArrow(split, "lang string, size int, token string, n long").groupBy("lang", "size", "token").agg(F.sum("n").alias("n"))
    numbers = spark.createDataFrame(list(enumerate(languages)), "number int, lang string")
    both = pieces.union(counted.select("lang", F.lit(0).alias("size"), "token", "n")).join(F.broadcast(numbers), "lang")
    # Frequencies are smoothed by a half: log((n + 1/2) / total) is the base log(1/2 / total) and the gain log(2 n + 1).
    table = materialise(both.select("size", "token", F.col("number").alias("lang"), "n", F.rint(F.log(2.0 * F.col("n") + 1.0) * UNIT).cast("long").alias("gain")), "model")
    kinds = {r.size: r.k for r in table.groupBy("size").agg(F.count_distinct("token").alias("k")).collect()}
    total = {n: np.zeros(len(languages)) for n in SIZES}
    entries = 0
    for size, lang, n, k in table.groupBy("size", "lang").agg(F.sum("n"), F.count(F.lit(1))).collect():
        total[size][lang] = n
        entries += k
    base = {n: np.rint(UNIT * -np.log(2 * np.maximum(total[n] + 0.5 * kinds.get(n, 0), 0.5))).astype(np.int64) for n in SIZES}
    return Model(languages, base, table, entries)


def token_hash(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass"))


class Tokens:
    """Gains of the tokens of one size: sorted hashes, and for each the languages that have it."""

    def __init__(self, base: np.ndarray, tokens: list[str], langs: np.ndarray, gains: np.ndarray):
        hashes = np.fromiter(map(token_hash, tokens), np.uint64, len(tokens))
        order = np.lexsort((langs, hashes))
        self.base, self.langs, self.gains = base, langs[order].astype(np.int32), gains[order].astype(np.int32)
        self.hashes, starts = np.unique(hashes[order], return_index=True)
        self.starts = np.append(starts, len(tokens)).astype(np.int64)

    def find(self, tokens: list[str]) -> np.ndarray:
        """Their numbers, -1 for an unseen one."""
        if not len(self.hashes) or not tokens:
            return np.full(len(tokens), -1, np.int64)
        h = np.fromiter(map(token_hash, tokens), np.uint64, len(tokens))
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == h, at, -1)

    def add(self, out: np.ndarray, rows: np.ndarray, at: np.ndarray) -> None:
        """Add the gains of the tokens at to the rows of out."""
        n = self.starts[at + 1] - self.starts[at]
        flat = np.arange(n.sum()) + np.repeat(self.starts[at] - np.cumsum(n) + n, n)
        np.add.at(out, (np.repeat(rows, n), self.langs[flat]), self.gains[flat])


class Lookup:
    """A model as arrays, for executors."""

    def __init__(self, languages: list[str], base: dict[int, np.ndarray], table: pa.Table | None):
        self.languages, self.sizes = languages, {}
        for n in SIZES if languages else ():
            own = table.filter(pc.equal(table["size"], n))
            self.sizes[n] = Tokens(base[n], own["token"].to_pylist(), own["lang"].to_numpy(), own["gain"].to_numpy())


class Scorer(dict):
    """word -> row of its scores; a bounded number of words is remembered."""

    def __init__(self, model: Lookup):
        super().__init__()
        self.model = model
        self.most = max(1, min(MEMO, CELLS // max(1, len(model.languages))))
        self.scores = np.zeros((min(1024, self.most), len(model.languages)), np.int64)

    def learn(self, words: list[str]) -> None:
        """Score words that are not known yet, all of them at each step down."""
        first = len(self)
        while first + len(words) > len(self.scores):
            self.scores = np.concatenate((self.scores, np.zeros_like(self.scores)))
        self.update(zip(words, range(first, first + len(words))))
        out = self.scores[first : first + len(words)]
        out[:] = 0
        whole = self.model.sizes[0]
        at = whole.find(words)
        seen = np.flatnonzero(at >= 0)
        out[seen] = whole.base
        whole.add(out, seen, at[seen])
        left = np.flatnonzero(at < 0)
        for n in SIZES[1:]:
            if not len(left):
                break
            tokens, grams = self.model.sizes[n], [ngrams(words[i], n) for i in left]
            owner = np.repeat(np.arange(len(left)), [len(g) for g in grams])
            at = tokens.find([x for g in grams for x in g])
            owner, at = owner[at >= 0], at[at >= 0]
            known = np.bincount(owner, minlength=len(left))
            sums = np.zeros((len(left), out.shape[1]), np.int64)
            tokens.add(sums, owner, at)
            hit = np.flatnonzero(known)
            out[left[hit]] = tokens.base + sums[hit] // known[hit, None]
            left = left[known == 0]

    def row(self, word: str) -> np.ndarray:
        if word not in self:
            self.learn([word])
        return self.scores[self[word]]

    def judge(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.model.languages or not has_letter(text):
            return UNDETERMINED, 0.0
        total = 0
        for i in range(0, len(words), self.most):
            part = words[i : i + self.most]
            if len(self) > self.most:
                self.clear()
            new = [w for w in dict.fromkeys(part) if w not in self]
            if new:
                self.learn(new)
            total = total + self.scores[np.fromiter(map(self.__getitem__, part), np.int64, len(part))].sum(axis=0)
        return decide(self.model.languages, total, len(words))


def _kept(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]


def _schema(docs: DataFrame, keep: list[str]) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in keep] + ["lang_pred string", "score double"])


def apply(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (in place of columns of these names); nothing but the text is looked at."""
    if model.entries > BROADCAST_ENTRIES or len(model.languages) > DENSE_LANGUAGES:
        return _by_shuffle(docs, model, text_col)
    held, keep = share(docs.sparkSession, model.lookup()), _kept(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared(held))
        for batch in batches:
            said = [scorer.judge(t) for t in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())], names=[*keep, "lang_pred", "score"])

    return docs.mapInArrow(run, _schema(docs, keep))


def _by_shuffle(docs: DataFrame, model: Model, text_col: str) -> DataFrame:
    """For models too large to broadcast."""
    number, keep = "_row", _kept(docs)
    while number in map(str.lower, docs.columns):
        number = "_" + number
    numbered = materialise(docs.withColumn(number, F.monotonically_increasing_id()), "docs")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist()):
                if text and has_letter(text):
                    n = Counter(words_of(text))
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(n), pa.int64()), pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["row", "word", "k"])

    def pieces(size: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                flat = [(w, g, k) for w in batch.column("word").to_pylist() for g, k in Counter(ngrams(w, size)).items()]
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in flat], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["word", "token", "k"])

        return run

    said = materialise(numbered.select(F.col(number).alias("row"), F.col(f"`{text_col}`").alias("text")).mapInArrow(words, "row long, word string, k long"), "doc-words")
    # What a token gains in the languages that have it: one row a token, with one place a language at most.
    tokens = materialise(model.table.groupBy("size", "token").agg(F.collect_list(F.struct("lang", "gain")).alias("gains")), "tokens")
    left = materialise(said.select("word").distinct(), "left")
    levels, gains = [], []
    for size in SIZES:
        asked = left.select("word", F.col("word").alias("token"), F.lit(1).cast("long").alias("k")) if size == 0 else left.mapInArrow(pieces(size), "word string, token string, k long")
        met = materialise(asked.join(tokens.where(F.col("size") == size).drop("size"), "token").select("word", "k", "gains"), "met")
        known = materialise(met.groupBy("word").agg(F.sum("k").alias("known")), "known")
        levels.append(known.select("word", F.lit(size).alias("size")))
        sums = met.select("word", "k", F.inline("gains")).groupBy("word", "lang").agg(F.sum(F.col("k") * F.col("gain")).alias("gain"))
        gains.append(sums.join(known, "word").select("word", "lang", F.expr("gain div known").alias("gain")))
        left = materialise(left.join(known, "word", "left_anti"), "left")
    levels.append(left.select("word", F.lit(-1).alias("size")))
    level, gain = levels[0], gains[0]
    for x in levels[1:]:
        level = level.union(x)
    for x in gains[1:]:
        gain = gain.union(x)
    level, gain = materialise(level, "levels"), materialise(gain, "gains")
    by_size = said.join(level, "word").groupBy("row", "size").agg(F.sum("k").alias("n")).groupBy("row").agg(F.collect_list(F.struct("size", "n")).alias("sizes"))
    by_lang = said.join(gain, "word").groupBy("row", "lang").agg(F.sum(F.col("k") * F.col("gain")).alias("gain")).groupBy("row").agg(F.collect_list(F.struct("lang", "gain")).alias("langs"))
    held = share(docs.sparkSession, (model.languages, model.base))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, base = shared(held)
        for batch in batches:
            out = []
            for sizes, langs in zip(batch.column("sizes").to_pylist(), batch.column("langs").to_pylist()):
                total = np.zeros(len(languages), np.int64)
                for x in sizes:
                    if x["size"] >= 0:
                        total += x["n"] * base[x["size"]]
                for x in langs or ():
                    total[x["lang"]] += x["gain"]
                out.append(decide(languages, total, sum(x["n"] for x in sizes)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], names=["row", "lang_pred", "score"])

    judged = by_size.join(by_lang, "row", "left").mapInArrow(judge, "row long, lang_pred string, score double").withColumnRenamed("row", number)
    whole = numbered.select(number, *[F.col(f"`{c}`") for c in keep]).join(judged, number, "left")
    return whole.select(*[F.col(f"`{c}`") for c in keep], F.coalesce("lang_pred", F.lit(UNDETERMINED)).alias("lang_pred"), F.coalesce("score", F.lit(0.0)).alias("score"))


def lettered(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the rows whose text has no letter; needs no model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([has_letter(t or "") for t in batch.column(text_col).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
