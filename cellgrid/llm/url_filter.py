"""URL filter: path rules, then a Bloom filter cascade over hosts.

A cascade holds a set exactly over a known universe of keys. Level 1 is a Bloom filter of the listed keys; the
keys of the universe that it wrongly admits go to level 2, the listed keys that level 2 wrongly admits to
level 3, and so on until no key is left. A key of the universe is listed iff the first level that lacks it is
even (or it passes an odd number of levels in all). Membership is exact without keys and without a join.

The universe is complete: every host of the corpus and every parent domain of it, since a listed host blocks
its subdomains. Keys are dealt by hash into shards of about ``SHARD_KEYS``; each shard's cascade is built in a task
of its own, so tasks are bounded and keys, being distinct, are spread evenly whatever the pages of a host.
Whether a key is listed is settled by one grouping of the universe with the list.

Judging: cascades of at most ``BROADCAST_BYTES`` together are broadcast, and pages stream past them. Beyond that
size pages are dealt by (shard, salt) to copies of the shard's cascade, one shard of keys for each domain
depth, so that a hot host is spread over ``SALTS`` tasks.

Defined results: a null url or one without :// has empty host and path, fits no rule, and is allowed; A-Z in keys of the
list are lower-cased as in hosts, other letters stay; null and empty keys list nothing; an empty list blocks nothing; repeated pages
are judged alike; urls of any length are read whole; rules of one length that fit go by their text; other columns
are kept as asked by ``keep``; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, share, shared

SHARD_KEYS = 100_000
BROADCAST_BYTES = 16 << 20
SALTS = 16
FIRST_RATE, NEXT_RATE = 0.1, 0.5


def shard_of(key: str, shards: int) -> int:
    return xxhash.xxh3_64_intdigest(key, 99) % shards


def parents(host: str) -> list[str]:
    """The host and its parent domains."""
    parts = host.split(".")
    return [".".join(parts[i:]) for i in range(len(parts))] if host else []


def split_url(url: str | None) -> tuple[str, str]:
    if not url or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[end:]
    stop = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return rest[:end].translate(_LOWER), path[:stop]


_LOWER = {c: c + 32 for c in range(65, 91)}


class Bloom:
    """A Bloom filter as bytes: level number as seed, k probes by double hashing."""

    def __init__(self, level: int, k: int, bits: int, data: bytes | bytearray):
        self.level, self.k, self.bits, self.data = level, k, bits, data

    @classmethod
    def of(cls, keys: list[str], level: int, rate: float) -> Bloom:
        bits = max(64, 8 * math.ceil(-len(keys) * math.log(rate) / math.log(2) ** 2 / 8))
        made = cls(level, max(1, round(-math.log2(rate))), bits, bytearray(bits // 8))
        for key in keys:
            for i in made._at(key):
                made.data[i >> 3] |= 1 << (i & 7)
        return made

    def _at(self, key: str):
        h = xxhash.xxh3_128_intdigest(key, self.level)
        a, b = h & 0xFFFFFFFFFFFFFFFF, (h >> 64) | 1
        return [(a + i * b) % self.bits for i in range(self.k)]

    def __contains__(self, key: str) -> bool:
        return all(self.data[i >> 3] >> (i & 7) & 1 for i in self._at(key))


def build(listed: list[str], others: list[str]) -> list[Bloom]:
    """The cascade of one shard: exact on listed and others together."""
    levels: list[Bloom] = []
    inside, outside = listed, others
    while inside:
        level = len(levels) + 1
        bloom = Bloom.of(inside, level, FIRST_RATE if level == 1 else NEXT_RATE)
        levels.append(bloom)
        inside, outside = [k for k in outside if k in bloom], inside
    return levels


def holds(levels: list[Bloom], key: str) -> bool:
    for depth, bloom in enumerate(levels):
        if key not in bloom:
            return depth % 2 == 1
    return len(levels) % 2 == 1


def _build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    shard = int(pdf["shard"].iloc[0])
    levels = build(sorted(pdf.loc[pdf["listed"], "key"]), sorted(pdf.loc[~pdf["listed"], "key"]))
    return pd.DataFrame([(shard, b.level, b.k, b.bits, bytes(b.data)) for b in levels], columns=["shard", "level", "k", "bits", "data"])


def _universe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        hosts = {split_url(u)[0] for u in pdf["url"]}
        yield pd.DataFrame({"key": sorted({p for h in hosts for p in parents(h)})}, dtype=object)


def universe(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """(key): hosts of urls and their parent domains; a key may come from several tasks."""
    return urls.select(F.col(url_col).alias("url")).mapInPandas(_universe, "key string")


def cascade(urls: DataFrame, listed: DataFrame, url_col: str = "url") -> tuple[DataFrame, int]:
    """Cascades (shard, level, k, bits, data) of the list (key) over the universe of urls, and the number of shards."""
    seen = universe(urls, url_col).withColumn("listed", F.lit(False))
    told = listed.select(F.translate("key", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("key"), F.lit(True).alias("listed")).where("key IS NOT NULL AND key <> ''")
    keys = materialise(seen.union(told).groupBy("key").agg(F.max("listed").alias("listed")), "keys")
    shards = max(1, -(-keys.count() // SHARD_KEYS))

    @F.pandas_udf("int")
    def shard(key: pd.Series) -> pd.Series:
        return key.map(lambda k: shard_of(k, shards)).astype("int32")

    levels = keys.withColumn("shard", shard("key")).groupBy("shard").applyInPandas(_build_shard, "shard int, level int, k int, bits long, data binary")
    return materialise(levels, "cascade"), shards


def _as_levels(rows) -> dict[int, list[Bloom]]:
    out: dict[int, list[Bloom]] = {}
    for shard, level, k, bits, data in sorted((tuple(r) for r in rows), key=lambda r: r[:2]):
        out.setdefault(int(shard), []).append(Bloom(int(level), int(k), int(bits), data))
    return out


def decide(host: str, path: str, rules, listed) -> tuple[str | None, str]:
    """The longest rule that fits, else whether the host or a parent is listed."""
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return max(fits)[1:]
    return None, "block" if any(map(listed, parents(host))) else "allow"


def judge(pages: DataFrame, listed: DataFrame, rules, keep: list[str], url_col: str = "url", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """keep columns, host, path, rule and verdict of each page."""
    spark = pages.sparkSession
    levels, shards = cascade(pages, listed, url_col)
    rules = tuple(rules)
    size = levels.agg(F.sum(F.length("data"))).first()[0] or 0
    rows = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{url_col}`").alias("_url"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", host string, path string, rule string, verdict string"
    if size > broadcast_bytes:
        return _by_shuffle(rows, levels, shards, rules, keep)
    held = share(spark, _as_levels(levels.collect()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, memo = shared(held), {}

        def in_list(key: str) -> bool:
            if key not in memo:
                if len(memo) > 200_000:
                    memo.clear()
                memo[key] = holds(known.get(shard_of(key, shards), []), key)
            return memo[key]

        for batch in batches:
            parts = [split_url(u) for u in batch.column("_url").to_pylist()]
            said = [decide(h, p, rules, in_list) for h, p in parts]
            made = [[p[0] for p in parts], [p[1] for p in parts], [s[0] for s in said], [s[1] for s in said]]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(m, pa.string()) for m in made], names=[*keep, "host", "path", "rule", "verdict"])

    return rows.mapInArrow(run, schema)


def _by_shuffle(rows: DataFrame, levels: DataFrame, shards: int, rules, keep: list[str]) -> DataFrame:
    """For cascades too large to broadcast: distinct hosts meet the cascade of each of their parents' shards."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hosts = {split_url(u)[0] for u in pdf["_url"]}
            yield pd.DataFrame([(h, p, shard_of(p, shards)) for h in sorted(hosts) for p in parents(h)], columns=["host", "key", "shard"])

    def tell(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        by = _as_levels(known[["shard", "level", "k", "bits", "data"]].itertuples(index=False))
        hit = [holds(by.get(s, []), k) for k, s in zip(asked["key"], asked["shard"])]
        return pd.DataFrame({"host": asked.loc[hit, "host"]}, dtype=object)

    asked = rows.select("_url").mapInPandas(ask, "host string, key string, shard int").distinct()
    salted = asked.withColumn("salt", F.pmod(F.xxhash64("host"), F.lit(SALTS)).cast("int"))
    copies = levels.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = salted.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInPandas(tell, "host string").distinct().withColumn("_hit", F.lit(True))

    @F.pandas_udf("host string, path string, rule string, fits string")
    def parse(url: pd.Series) -> pd.DataFrame:
        parts = [split_url(u) for u in url]
        said = [decide(h, p, rules, lambda _: False) for h, p in parts]
        return pd.DataFrame({"host": [p[0] for p in parts], "path": [p[1] for p in parts], "rule": [s[0] for s in said], "fits": [s[1] for s in said]}, dtype=object)

    quoted = [F.col(f"`{c}`") for c in keep]
    parsed = rows.withColumn("_p", parse("_url")).select(*quoted, "_p.host", "_p.path", "_p.rule", "_p.fits")
    verdict = F.when(F.col("rule").isNotNull(), F.col("fits")).when(F.col("_hit"), "block").otherwise("allow")
    return parsed.join(hits, "host", "left").select(*quoted, "host", "path", "rule", verdict.alias("verdict"))
