r"""Benchmark decontamination by winnowing.

Texts are words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z. Of every text the hashes of its
k-grams (k = 5 words) are taken, and in each window of w = 6 consecutive hashes the least one (the last of equal
ones) is picked as a fingerprint, once for a run of windows that pick the same. Two texts that share a span of
k + w - 1 = 10 words share a whole window and so the fingerprint it picks: every sufficiently long shared span is
guaranteed to meet. Fingerprints of documents and of the benchmark are joined, and each meeting is extended to the left
and to the right over the words themselves, as far as windows of 10 equal words hold it. An item with fewer than 10
words is one window of its own length, whose hash is kept whole.

The benchmark side of the join is broadcast while its texts hold at most ``BROADCAST_BYTES``; documents then
stream past it and nothing is shuffled. A larger benchmark is joined by shuffles: fingerprints by their hash, then the
windows around those that meet by 128-bit hashes of their words. No text is paired with another. What the benchmark
brings to a join has one row a key and is repeated ``SALTS`` times, so a phrase that very many documents hold is spread;
the items of a window are met by way of the set they form, once a document and set, so a long span of a document that many items hold
doesn't give all pairs of its windows and these items.

Defined results: null or wordless documents have no words and no hits; null or wordless items match nothing; items
that repeat an id count once; a null item id is not listed in ``items`` but its words count as hit; rows are
judged one by one, repeated rows alike; an empty benchmark gives no hits; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, share, shared

SPAN, GRAM = 10, 5
WINDOW = SPAN - GRAM + 1
BROADCAST_BYTES = 16 << 20
#: Copies of the benchmark's side of a shuffled join; a hot key of the documents is dealt over so many tasks.
SALTS = 16
MEMO = 1 << 19
_TO = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    """One pass over the UTF-8 bytes: separators become spaces, A-Z become a-z, all bytes of other code points stay."""
    return text.encode("utf-8", "surrogatepass").translate(_TO).split() if text else []


class Codes(dict):
    """word -> 64-bit hash, remembered up to MEMO words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def grams(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = codes[:n].copy()
    for i in range(1, k):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        h += codes[i : i + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def picked(h: np.ndarray) -> np.ndarray:
    """Positions of the grams that windows pick: the least hash, the last of equal ones; ascending, each position once."""
    n = len(h) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.int64)
    least, at = h[:n].copy(), np.zeros(n, np.int64)
    for i in range(1, WINDOW):
        at[h[i : i + n] <= least] = i
        np.minimum(least, h[i : i + n], out=least)
    at += np.arange(n)
    return at[np.flatnonzero(np.diff(at, prepend=-1))]


def fingerprints(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the fingerprints for windows of k words: picked grams, or for short items all grams of their length."""
    if k < SPAN:
        h = grams(codes, k)
        return np.arange(len(h)), h
    h = grams(codes, GRAM)
    at = picked(h)
    return at, h[at]


def extended(at: np.ndarray, k: int, n: int) -> list[int]:
    """Starts of the windows of k words, in a text of n, that hold a fingerprint at one of the positions."""
    if k < SPAN:
        return at.tolist()
    starts = np.unique(at[:, None] - np.arange(WINDOW))
    return starts[(starts >= 0) & (starts <= n - SPAN)].tolist()


class Index:
    """Fingerprints and windows of benchmark items."""

    def __init__(self, items: list[tuple[str | None, str | None]]):
        codes = Codes()
        self.windows: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
        prints: dict[int, set] = {SPAN: set()}
        for item, text in items:
            w = words_of(text)
            if not w:
                continue
            k = min(len(w), SPAN)
            c = np.array([codes[x] for x in w], np.uint64)
            for i in range(len(w) - k + 1):
                self.windows[k][tuple(w[i : i + k])].add(item)
            prints.setdefault(k, set()).update(fingerprints(c, k)[1].tolist())
        self.windows = {k: dict(v) for k, v in self.windows.items()}
        self.prints = {k: np.array(sorted(v), np.uint64) for k, v in prints.items() if v}

    def found(self, codes: np.ndarray) -> Iterator[tuple[int, int]]:
        """(window length, start) of the windows around fingerprints that a text shares with the items."""
        for k, prints in self.prints.items():
            at, h = fingerprints(codes, k)
            if len(h):
                near = np.searchsorted(prints, h)
                near[near == len(prints)] = 0
                met = at[prints[near] == h]
                if len(met):
                    yield from ((k, i) for i in extended(met, k, len(codes)))

    def hits(self, words: list[bytes], codes: np.ndarray) -> tuple[int, set]:
        """Words inside windows that occur, and the items of these windows; each window around a meeting is compared word by word."""
        covered, items = set(), set()
        for k, i in self.found(codes):
            got = self.windows[k].get(tuple(words[i : i + k]))
            if got is not None:
                covered.update(range(i, i + k))
                items |= got
        return len(covered), items


def _scan(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, idx = Codes(), shared(index)
        for batch in batches:
            n, hit, items = [], [], []
            for text in batch.column("text").to_pylist():
                w = words_of(text)
                k, got = idx.hits(w, np.array(list(map(codes.__getitem__, w)), np.uint64)) if w else (0, set())
                n.append(len(w))
                hit.append(k)
                items.append(sorted(x for x in got if x is not None))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "n_words", "n_hit", "items"])

    return run


_PRINTS = "row long, k int, pos int, print long"
_WINDOWS = "row long, k int, pos int, a long, b long"


def _prints(lengths: list[int]):
    """Fingerprints of texts (row, text), for windows of each of the lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist()):
                c = np.array([codes[w] for w in words_of(text)], np.uint64)
                for k in lengths:
                    at, h = fingerprints(c, k)
                    if len(h):
                        yield pa.RecordBatch.from_arrays([pa.array([row] * len(h), pa.int64()), pa.array([k] * len(h), pa.int32()), pa.array(at.astype(np.int32)), pa.array(h.view(np.int64))], names=["row", "k", "pos", "print"])

    return run


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (row, text, hits) -> their windows with two halves of a hash. hits: (k, pos) of fingerprints whose windows are wanted; null: all
    windows of SPAN words, or the whole of a shorter text."""
    for batch in batches:
        for row, text, hits in zip(*(batch.column(c).to_pylist() for c in ("row", "text", "hits"))):
            w = words_of(text)
            if hits is None:
                k = min(len(w), SPAN)
                wanted = {k: range(len(w) - k + 1)} if w else {}
            else:
                wanted = {k: extended(np.array(sorted(h["pos"] for h in hits if h["k"] == k), np.int64), k, len(w)) for k in sorted({h["k"] for h in hits})}
            for k, starts in wanted.items():
                raw = b"".join(xxhash.xxh3_128_digest(b" ".join(w[i : i + k])) for i in starts)
                ab = np.frombuffer(raw, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(ab), pa.int64()), pa.array([k] * len(ab), pa.int32()), pa.array(np.array(starts, np.int32)), pa.array(ab[:, 0].copy()), pa.array(ab[:, 1].copy())], names=["row", "k", "pos", "a", "b"])


def contamination(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit and items, the sorted ids (as text) of items with occurring windows."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("item_text"))
    held = items.agg(F.sum(F.octet_length("item_text") + 64)).first()[0] or 0
    if held <= broadcast_bytes:
        index = share(spark, Index([tuple(r) for r in items.collect()]))
        return rows.mapInArrow(_scan(index), _SCHEMA)
    return _by_shuffle(rows, items)


def _count(c: str) -> Column:
    """How many words a text column has."""
    return F.size(F.expr(f"filter(split(translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\\\x00-\\\\x2F\\\\x3A-\\\\x60\\\\x7B-\\\\x7F]+'), x -> x <> '')"))


def _salted(many: DataFrame, few: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join rows of documents with rows of the benchmark. A key that very many documents share is dealt over SALTS tasks."""
    dealt = many.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    copies = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, [*on, "salt"], how).drop("salt")


def _by_shuffle(rows: DataFrame, items: DataFrame) -> DataFrame:
    numbered = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "docs")
    met, items_of = _meetings(numbered.select("row", "text"), items)
    covered = met.select("row", F.explode(F.expr("sequence(pos, pos + k - 1)")).alias("at")).groupBy("row").agg(F.countDistinct("at").alias("n_hit"))
    listed = _salted(met.select("row", "held_by").distinct(), items_of.where("item IS NOT NULL"), ["held_by"]).select("row", "item").distinct()
    named = listed.groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    out = numbered.select("row", "doc_id", _count("text").cast("long").alias("n_words")).join(covered, "row", "left").join(named, "row", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _meetings(numbered: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of a materialised table (row, text): its windows that occur in items (row, k, pos, held_by), and (held_by, item).

    held_by stands for the set of items that hold a window: its size and two hashes that don't depend on order.
    """
    listed = materialise(items.withColumn("row", F.monotonically_increasing_id()).withColumn("words", _count("item_text")).where("words > 0"), "items")
    lengths = sorted(r[0] for r in listed.select(F.least("words", F.lit(SPAN))).distinct().collect())
    texts = listed.select("row", F.col("item_text").alias("text"), F.least("words", F.lit(SPAN)).alias("window"))
    known = texts.mapInArrow(_prints(lengths), _PRINTS).join(texts.select("row", "window"), "row").where("k = window").select("k", "print").distinct()
    own = numbered.select("row", "text").mapInArrow(_prints(lengths), _PRINTS)
    hits = _salted(own, known, ["k", "print"], "left_semi").groupBy("row").agg(F.collect_list(F.struct("k", "pos")).alias("hits"))
    around = numbered.join(hits, "row").select("row", "text", "hits").mapInArrow(_windows, _WINDOWS)
    no_hits = F.lit(None).cast("array<struct<k:int,pos:int>>").alias("hits")
    held = texts.select("row", "text", no_hits).mapInArrow(_windows, _WINDOWS).join(listed.select("row", "item"), "row").select("k", "a", "b", "item").distinct()
    held = materialise(held, "held")
    one, two = F.xxhash64("item"), F.xxhash64("item", F.lit(1))
    sets = materialise(held.groupBy("k", "a", "b").agg(F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor(one).alias("one"), F.bit_xor(two).alias("two")).alias("held_by")), "sets")
    first = sets.groupBy("held_by").agg(F.min(F.struct("k", "a", "b")).alias("w")).select("held_by", "w.*")
    met = materialise(_salted(around, sets, ["k", "a", "b"]).select("row", "k", "pos", "held_by"), "met")
    return met, first.join(held, ["k", "a", "b"]).select("held_by", "item")


def item_digest(items: str) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.col(items)), ","), 256)


def clean(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs without the rows that hold a benchmark window, whatever the benchmark's size and the rows' ids. All columns stay."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("item_text"))
    held = items.agg(F.sum(F.octet_length("item_text") + 64)).first()[0] or 0
    if held > broadcast_bytes:
        number = "_row"
        while number in map(str.lower, docs.columns):
            number = "_" + number
        numbered = materialise(docs.withColumn(number, F.monotonically_increasing_id()), "docs")
        bad = _meetings(numbered.select(F.col(number).alias("row"), "text"), items)[0].select(F.col("row").alias(number)).distinct()
        return numbered.join(bad, number, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    index = share(spark, Index([tuple(r) for r in items.collect()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, idx = Codes(), shared(index)
        for batch in batches:
            keep = []
            for text in batch.column("text").to_pylist():
                w = words_of(text)
                keep.append(not (w and idx.hits(w, np.array(list(map(codes.__getitem__, w)), np.uint64))[0]))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
