"""Near-duplicate documents: minima of many universal hashes, banding, signature verification, exact
verification on the full shingle sets, and connected components by alternating large-star and small-star.

The work is cut so that no group of copies has to meet in one task and no group emits all its pairs:

1. Documents with equal shingle sets (exact copies) form a class; only its smallest id goes on.
2. Each class has a signature of 128 minima, read as 32 bands of 4. A link at similarity 0.8 shares no
   band with probability (1 - 0.8^4)^32 = 5e-8. A sketch keeps the low byte of each minimum.
3. Stars: (band key, id) is sorted over all partitions by one range shuffle on both columns, so a bucket of any size
   is spread over as many partitions as its rows fill. In each partition the members of a bucket are paired with the
   smallest one there, and the smallest ones of a bucket that reaches over partitions with the least of them: a bucket of
   m members gives m - 1 pairs. Pairs whose sketches agree make families, the connected components of these pairs.
4. Families: the members of a family meet with their full shingle sets and links are verified there, only between
   members that no link connects yet, so a family of m members gives m - 1 links at most. A family beyond
   ``FAMILY_ROWS`` or ``FAMILY_BYTES`` has its stars verified first; then blocks of the members outside its largest
   component meet blocks of all members, each of bounded size.
5. Rest: two members of a bucket that are in different families are paired if their sketches agree, small buckets by
   a join in which a row has at most ``SMALL_BUCKET`` partners, large ones block by block, and verified. So every
   pair that shares a bucket is in one family or is tested: nothing is capped or dropped.

Sketch check: a pair that agrees in fewer than ``SIG_LEAST`` of 128 places is not verified. At similarity 0.8 the
agreement has mean 102 and deviation 4.5, so a loss is a case beyond 4.9 deviations, 5e-7.

Defined results: null, empty or wordless text has an empty set, n_shingles 0, and is its own component; a text
with fewer words than a shingle has the whole sequence as its one shingle; a null id is linked with nothing,
its component_id is null and it is kept; rows that repeat an id with another text join the classes of both
texts under that id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import batches_of, forget, materialise, words_ascii

BANDS, ROWS = 32, 4
SIG_LEAST = 80
SMALL_BUCKET = 32
BLOCK = 1024
FAMILY_ROWS, FAMILY_BYTES = 4096, 16 << 20
BROADCAST_IDS = common.BROADCAST_IDS
#: Rows of a batch of keys and ids, without texts.
NARROW_ROWS = 1 << 15
SEED = 20_240_601


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text."""
    words = words_ascii(text)
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh3_64_intdigest(joined)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    h = xxhash.xxh3_64_intdigest
    return np.unique(np.array([h(joined[s:e]) for s, e in zip(starts, ends[width - 1 :].tolist())], np.uint64))


def hash_family() -> tuple[np.ndarray, np.ndarray]:
    """Multiply-shift hashing: odd factors and addends modulo 2^64, of which the upper half is used."""
    rng = np.random.default_rng(SEED)
    a = rng.integers(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(1)
    return a, rng.integers(0, 2**64, BANDS * ROWS, np.uint64)


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    best = np.full(len(a), 0xFFFFFFFF, np.uint64)
    for i in range(0, len(hashes), 256):
        part = hashes[i : i + 256, None] * a + b
        part >>= np.uint64(32)
        np.minimum(best, part.min(axis=0), out=best)
    return best.astype(np.uint32)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band: its number and its minima."""
    minima = sig.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for r in range(ROWS):
        key = (key ^ minima[:, r]) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(29)
        key *= np.uint64(0x94D049BB133111EB)
        key ^= key >> np.uint64(32)
    return key


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = hash_family()
        for batch in batches:
            n, digest, bands, sketch = [], [], [], []
            for text in batch.column("text").to_pylist():
                h = shingle_hashes(text, width)
                n.append(len(h))
                sig = signature(h, a, b) if len(h) else None
                digest.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                bands.append(band_keys(sig).view(np.int64) if len(h) else None)
                sketch.append(sig.astype(np.uint8).tobytes() if len(h) else None)
            made = [batch.column("id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())]
            yield pa.RecordBatch.from_arrays(made, names=["id", "n", "digest", "bands", "sketch"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = pa.array([shingle_hashes(t, width).tobytes() for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), hashes], names=["id", "hashes"])

    return run


_MET = "key long, id long, a long, edge boolean"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition of (key, id), sorted -> the rows of keys that have several, with the key's smallest id here as a. Of the first and the last
    key of the partition, which may go on in its neighbours, the row of a itself has edge and is told in any case."""

    def told(parts: list[tuple]) -> pa.RecordBatch:
        key, id_, a, edge = (np.concatenate(x) if parts else [] for x in zip(*parts)) if parts else ([],) * 4
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(id_, pa.int64()), pa.array(a, pa.int64()), pa.array(edge, pa.bool_())], names=["key", "id", "a", "edge"])

    now = None  # key, a, members so far, first of the partition: the run that may go on in the next batch
    for batch in batches:
        key, id_ = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(key):
            continue
        starts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
        lengths = np.diff(np.append(starts, len(key)))
        tops, counts, first = id_[starts].copy(), lengths.copy(), np.zeros(len(starts), bool)
        inner = np.ones(len(key), bool)
        inner[starts] = False
        parts = []
        if now is None:
            first[0] = True
        elif now[0] == key[0]:
            tops[0], counts[0], first[0], inner[0] = now[1], counts[0] + now[2], now[3], True
        elif now[2] > 1 or now[3]:
            parts.append(([now[0]], [now[1]], [now[1]], [now[3]]))
        ended = np.flatnonzero((counts[:-1] > 1) | first[:-1])
        parts.append((key[inner], id_[inner], np.repeat(tops, lengths)[inner], np.zeros(int(inner.sum()), bool)))
        parts.append((key[starts][ended], tops[ended], tops[ended], first[ended]))
        now = (key[-1], tops[-1], counts[-1], bool(first[-1]))
        yield told(parts)
    if now:
        yield told([([now[0]], [now[1]], [now[1]], [True])])


def _matrix(sketches) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), BANDS * ROWS)


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = (_matrix(batch.column(c).to_pylist()) for c in ("sketch_a", "sketch_b"))
        yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= SIG_LEAST))


def _verify(similarity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("hashes_a"), batch.column("hashes_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = int(overlaps(x, [y])[0])
                ok.append(100 * common >= similarity * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def overlaps(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of the sorted set x with each of others."""
    flat = np.concatenate(others)
    at = np.searchsorted(x, flat)
    at[at == len(x)] = 0
    return np.add.reduceat((x[at] == flat).astype(np.int64), np.concatenate(([0], np.cumsum([len(o) for o in others])[:-1])))


def _family_links(similarity: int):
    """Rows sorted by (family, qb, tb) -> links that connect members not connected before. side: 0 asks, 1 is asked, 2 both."""

    def links(rows: list[dict]) -> list[tuple[int, int]]:
        root: dict[int, int] = {}

        def find(i: int) -> int:
            while root.setdefault(i, i) != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for r in rows:
            a, b = find(r["id"]), find(r["comp"])
            root[max(a, b)] = min(a, b)
        told = [r for r in rows if r["side"] != 0]
        sketches = _matrix([r["sketch"] for r in told])
        sets = [np.frombuffer(r["hashes"], np.uint64) for r in told]
        sizes = np.array([len(x) for x in sets])
        out = []
        for q in rows:
            if q["side"] == 1:
                continue
            x = np.frombuffer(q["hashes"], np.uint64)
            agree = (sketches == np.frombuffer(q["sketch"], np.uint8)).sum(axis=1)
            near = (agree >= SIG_LEAST) & (100 * np.minimum(sizes, len(x)) >= similarity * np.maximum(sizes, len(x)))
            near = np.flatnonzero(near)
            near = near[np.argsort(-agree[near], kind="stable")].tolist()
            step = 1
            while near:  # the likeliest first, then more at a time; what got connected meanwhile is left out
                own = find(q["id"])
                near = [t for t in near if find(told[t]["id"]) != own]
                now, near = near[:step], near[step:]
                step = min(4 * step, 256)
                if not now:
                    break
                for t, common in zip(now, overlaps(x, [sets[t] for t in now]).tolist()):
                    if 100 * common >= similarity * (len(x) + sizes[t] - common):
                        a, b = find(q["id"]), find(told[t]["id"])
                        if a != b:
                            root[max(a, b)] = min(a, b)
                            out.append((q["id"], told[t]["id"]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                key = (r["family"], r["qb"], r["tb"])
                if key != now:
                    out += links(rows)
                    now, rows = key, []
                rows.append(r)
            yield _pairs(out)
        yield _pairs(links(rows) if rows else [])

    return run


def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([min(p) for p in out], pa.int64()), pa.array([max(p) for p in out], pa.int64())], names=["a", "b"])


def _block_pairs(rows: pa.Table) -> pa.Table:
    """One block of members outside a bucket's largest family against one block of all its members: alike pairs of different families."""
    rows = rows.to_pylist()
    q, t = [r for r in rows if r["side"] == 0], [r for r in rows if r["side"] == 1]
    out = []
    if q and t:
        y, ids, fams = _matrix([r["sketch"] for r in t]), np.array([r["id"] for r in t]), np.array([r["family"] for r in t])
        for r in q:
            near = ((y == np.frombuffer(r["sketch"], np.uint8)).sum(axis=1) >= SIG_LEAST) & (fams != r["family"])
            out += [(min(r["id"], other), max(r["id"], other)) for other in ids[near].tolist()]
    return pa.Table.from_batches([_pairs(out)])


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (id, comp): comp is the smallest id reachable. Ids without a link are not returned.

    Alternates large-star and small-star until the links stay the same; each round is a table in the shared folder. The least
    neighbours are as many as links at most: they are broadcast while links are few, else written first, so that both sides of
    the join come from shuffles that adaptive execution can split at the centre of a large star.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc")
    mark = _mark(now)
    while True:
        few = 2 * mark[0] <= BROADCAST_IDS
        meant = F.broadcast if few else lambda df: materialise(df, "cc-least")
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = meant(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(large, "cc")
        low = meant(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        then = materialise(small, "cc")
        for used in (large, now, least, low):
            forget(used)
        now, was, mark = then, mark, _mark(then)
        if mark == was:
            break
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(roots)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 998_244_353)).first())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = materialise(rows.mapInArrow(_sign(shingle_words), "id long, n long, digest binary, bands array<long>, sketch binary"), "signatures")
    full = signed.where("n > 0 AND id IS NOT NULL")
    classes = materialise(full.select("id", "digest").groupBy("digest").agg(F.min("id").alias("rep"), F.max("id").alias("last")), "classes")
    # (id, digest) is no hot key, however many copies a text has.
    firsts = full.join(classes.select(F.col("rep").alias("id"), "digest"), ["id", "digest"], "left_semi")
    reps = materialise(firsts.select("id", "digest", "n", "bands", "sketch").distinct().drop("digest"), "reps")
    links = _links(rows, reps, shingle_words, similarity)
    # Rows with one id but several texts tie the classes of these texts together.
    repeated = full.groupBy("id").agg(F.min("digest").alias("one"), F.max("digest").alias("other")).where("one <> other").select("id")
    tied = full.select("id", "digest").join(repeated, "id").join(classes, "digest").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    comps = connected_components(links.union(tied))
    # Only the classes of several ids, or with links, change the component of a row.
    moved = classes.join(comps, classes["rep"] == comps["id"], "left").where("comp IS NOT NULL OR rep <> last").select("digest", F.coalesce("comp", "rep").alias("of_class"))
    out = signed.select("id", "n", "digest").join(looked_up(materialise(moved, "moved")), "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("of_class", "id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: int = 80) -> DataFrame:
    """docs with one row of each group of near-duplicates: the one with the smallest id, null ids last. Rows are told apart by number and not by
    id, so rows of one id, or of null id, with unlike texts stay, and rows without a word all stay. All columns stay."""
    row = "_row"
    while row in map(str.lower, docs.columns):
        row = "_" + row
    numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "docs")
    judged = near_duplicates(numbered, row, text_col, shingle_words, similarity).select(F.col("doc_id").alias("row"), F.col("component_id").alias("comp"))
    judged = materialise(judged, "judged")
    several = looked_up(materialise(judged.where("row <> comp").select("comp").distinct(), "several"))
    ids = numbered.select(F.col(row).alias("row"), F.col(f"`{id_col}`").alias("id"))
    members = materialise(judged.join(several, "comp", "left_semi").join(ids, "row"), "members")
    first = looked_up(materialise(members.groupBy("comp").agg(F.min(F.struct(F.col("id").isNull(), "id", "row"))["row"].alias("first")), "firsts"))
    gone = looked_up(materialise(members.join(first, "comp").where("row <> first").select(F.col("row").alias(row)), "gone"))
    return numbered.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def looked_up(table: DataFrame) -> DataFrame:
    return common.looked_up(table, BROADCAST_IDS)


def _links(rows: DataFrame, reps: DataFrame, width: int, similarity: int) -> DataFrame:
    """Verified links between classes, enough of them to connect what is connected."""
    met = _buckets(reps)
    joints = met.where("edge").groupBy("key").agg(F.min("a").alias("least")).join(met.where("edge").select("key", "a"), "key").where("a <> least")
    pairs = met.where("id <> a").select("a", F.col("id").alias("b")).union(joints.select(F.col("least").alias("a"), F.col("a").alias("b")))
    stars = materialise(_alike_pairs(pairs.distinct(), reps, similarity), "stars")
    families = materialise(connected_components(stars).select("id", F.col("comp").alias("family")), "families")
    sets = _set_table(rows, families.select("id"), width)
    inside = _inside_families(families, stars, sets, reps, similarity)
    placed = met.select("key", "id").join(looked_up(families), "id", "left").select("key", "id", F.coalesce("family", "id").alias("family"))
    mixed = placed.groupBy("key").agg(F.min("family").alias("lo"), F.max("family").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo <> hi").select("key", "m")
    mixed = looked_up(materialise(mixed, "mixed"))
    rest = materialise(placed.join(mixed, "key"), "rest")
    few = rest.where(F.col("m") <= SMALL_BUCKET).select("key", "id", "family")
    x, y = few.toDF("key", "a", "family_a"), few.toDF("key", "b", "family_b")
    small = x.join(y, "key").where("a < b AND family_a <> family_b").select("a", "b").distinct()
    across = _alike_pairs(small, reps, similarity)
    large = rest.where(F.col("m") > SMALL_BUCKET)
    if not large.isEmpty():
        across = across.union(_large_buckets(large, reps))
    across = materialise(across.distinct(), "across")
    more = _set_table(rows, across.select(F.col("a").alias("id")).union(across.select("b")).distinct(), width)
    return inside.union(_verified(across, more, similarity))


def _buckets(reps: DataFrame) -> DataFrame:
    """(key, id, a, edge) of the buckets in which documents meet."""
    spread = reps.select(F.explode("bands").alias("key"), "id").repartitionByRange("key", "id").sortWithinPartitions("key", "id")
    with batches_of(reps.sparkSession, NARROW_ROWS):
        return materialise(spread.mapInArrow(_meet, _MET), "buckets")


def _alike_pairs(pairs: DataFrame, reps: DataFrame, similarity: int) -> DataFrame:
    """Pairs whose sizes admit the similarity and whose sketches agree."""
    slim = reps.select("id", "n", "sketch")
    a, b = slim.toDF("a", "n_a", "sketch_a"), slim.toDF("b", "n_b", "sketch_b")
    sized = pairs.join(a, "a").join(b, "b").where(f"100 * least(n_a, n_b) >= {similarity} * greatest(n_a, n_b)")
    return sized.select("a", "b", "sketch_a", "sketch_b").mapInArrow(_alike, "a long, b long")


def _set_table(rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(id, hashes) of the wanted ids: a few are looked up where the texts are read, more meet them by a shuffle."""
    texts = rows.join(looked_up(materialise(wanted.distinct(), "wanted")), "id", "left_semi")
    return materialise(texts.mapInArrow(_sets(width), "id long, hashes binary").distinct(), "sets")


def _inside_families(families: DataFrame, stars: DataFrame, sets: DataFrame, reps: DataFrame, similarity: int) -> DataFrame:
    sizes = families.join(reps.select("id", "n"), "id").groupBy("family").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("n") * 8 + 256).alias("bytes"))
    sizes = materialise(sizes.withColumn("large", (F.col("rows") > FAMILY_ROWS) | (F.col("bytes") > FAMILY_BYTES)), "family-sizes")
    member = families.join(sets, "id").join(reps.select("id", "sketch"), "id")
    zero = F.lit(0).alias
    small = member.join(sizes.where("NOT large").select("family"), "family").select("family", zero("qb"), zero("tb"), F.lit(2).alias("side"), "id", F.col("id").alias("comp"), "sketch", "hashes")
    found = _by_family(small, similarity)
    if sizes.where("large").isEmpty():
        return materialise(found, "links")
    big = families.join(sizes.where("large").select("family", "rows", "bytes"), "family")
    first = materialise(_verified(stars.join(big.select(F.col("id").alias("a")), "a", "left_semi"), sets, similarity), "links")
    comps = connected_components(first).join(big.select("id", "family"), "id", "right").select("id", "family", F.coalesce("comp", "id").alias("comp"))
    by_comp = comps.groupBy("family", "comp").agg(F.count(F.lit(1)).alias("k"))
    main = by_comp.groupBy("family").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"))
    open_ = comps.join(main, "family").join(sizes.select("family", "rows", "bytes"), "family")
    # Blocks hold BLOCK askers or 4 * BLOCK members by number, and a share of FAMILY_BYTES by weight.
    parts = F.greatest(F.ceil(F.col("rows") / F.lit(4 * BLOCK)), F.ceil(F.col("bytes") / F.lit(FAMILY_BYTES))).cast("int")
    open_ = open_.withColumn("nt", parts).withColumn("nq", F.col("nt") * 4)
    spread = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asks = open_.where("comp <> main").withColumn("qb", spread("nq")).withColumn("tb", every("nt")).withColumn("side", F.lit(0))
    asked = asks.select("family", "qb", "tb").distinct()
    told = open_.withColumn("tb", spread("nt")).withColumn("side", F.lit(1)).join(asked, ["family", "tb"])
    both = asks.select("family", "qb", "tb", "side", "id", "comp").union(told.select("family", "qb", "tb", "side", "id", "comp"))
    blocks = both.join(sets, "id").join(reps.select("id", "sketch"), "id").select("family", "qb", "tb", "side", "id", "comp", "sketch", "hashes")
    return materialise(found.union(first).union(_by_family(blocks, similarity)), "links")


def _by_family(rows: DataFrame, similarity: int) -> DataFrame:
    dealt = rows.repartition("family", "qb", "tb").sortWithinPartitions("family", "qb", "tb", "id")
    return dealt.mapInArrow(_family_links(similarity), "a long, b long")


def _large_buckets(rest: DataFrame, reps: DataFrame) -> DataFrame:
    by_family = rest.groupBy("key", "family").agg(F.count(F.lit(1)).alias("k"))
    main = by_family.groupBy("key").agg(F.max_by("family", F.struct("k", "family")).alias("main"), F.max("k").alias("k"), F.sum("k").alias("all"))
    members = rest.join(looked_up(materialise(main, "main")), "key").join(reps.select("id", "sketch"), "id")
    members = members.withColumn("nq", F.ceil((F.col("all") - F.col("k")) / BLOCK).cast("int")).withColumn("nt", F.ceil(F.col("all") / (4 * BLOCK)).cast("int"))
    spread = lambda n: F.pmod(F.xxhash64("id"), F.greatest(F.col(n), F.lit(1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.greatest(F.col(n), F.lit(1)) - 1))
    asks = members.where("family <> main").withColumn("qb", spread("nq")).withColumn("tb", every("nt")).withColumn("side", F.lit(0))
    told = members.withColumn("tb", spread("nt")).withColumn("qb", every("nq")).withColumn("side", F.lit(1))
    cols = ["key", "qb", "tb", "side", "id", "family", "sketch"]
    return asks.select(cols).union(told.select(cols)).groupBy("key", "qb", "tb").applyInArrow(_block_pairs, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Sets of b are joined first: a is the centre of a star, whose set would else be copied for each of its pairs."""
    a, b = sets.toDF("a", "hashes_a"), sets.toDF("b", "hashes_b")
    return pairs.join(b, "b").join(a, "a").select("a", "b", "hashes_a", "hashes_b").mapInArrow(_verify(similarity), "a long, b long").distinct()
