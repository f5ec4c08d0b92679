r"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, ``target / source size``. The
documents of a source stand in a fixed order; the expected copies are summed along it, one offset drawn
per source is added, and a document is emitted once for each integer that the running sum crosses. So a
document gets floor or ceiling of its expectation, and the copies of a whole source miss their sum by
less than one.

The order puts documents of like size together (size classes of an eighth of an octave), so that the
words taken come near the target as well, not only the copies.

The running sum of a hot source is not computed in one task: documents are dealt into blocks (source,
size class, hash of the id), ranks are counted inside blocks, and blocks are placed by running sums over
small tables: of the blocks of a class, and of the classes of a source. Blocks hold ``BLOCK_ROWS`` rows at most
on average, whatever the source's share.

Defined results: null text, empty text and text without a word have size 0 and take 0 words; a source of
size 0 has target 0; the null source is a source of its own and stands last; documents with equal ids are
placed by size, and fully equal rows are interchangeable; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, n_words

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
BLOCK_ROWS = 1_000
SEED = "mix-1"


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size) -> the same with weight and target.

    The level L with sum(min(cap * size, L * weight)) = share * all sizes is found in closed form: sources
    are ordered by the level at which they reach their cap, and the running sums of capped words and of
    remaining weights give the first level that is not beyond the next cap; later ones are lower, so it is the
    largest of those. One row per source: bounded by the number of sources, not of documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    level = Window.orderBy("full_at", "source").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    full = (F.col("source_size") * F.lit(cap)).alias("full")
    at = (
        sizes.withColumn("weight", w).withColumn("full", full).withColumn("full_at", F.col("full") / F.col("weight"))
        .withColumn("capped", F.coalesce(F.sum("full").over(level), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(level), F.lit(0.0)))
        .withColumn("all_words", F.sum("source_size").over(everything))
        .withColumn("level", (F.col("all_words") * F.lit(share) - F.col("capped")) / F.col("left_weight"))
    )
    return (
        at.withColumn("the_level", F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(everything))
        .withColumn("target", F.coalesce(F.least("full", F.col("the_level") * F.col("weight")), F.col("full")))
        .select("source", "source_size", "weight", "target")
    )


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, row_col: str | None = None, **rule) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target and copies.

    With row_col that column is carried along as ``row``, and null ids are dealt by their texts, so that many of them don't
    meet in one block. Sizes are counted once and kept as a narrow table in the shared folder, since the totals, the block
    counts and the ranks all read them.
    """
    own = F.col(id_col).cast("string")
    carried = [F.col(row_col).alias("row")] if row_col else []
    key = F.substring(F.md5(F.concat_ws("|", F.coalesce(own, F.md5(text_col)) if row_col else own, F.lit(seed))), 1, 16)
    sized = docs.select(*carried, F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), key.alias("key"))
    rows = materialise(sized.withColumn("cls", _size_class()), "mix-sizes")
    per_class = rows.groupBy("source", "cls").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("words"))
    # Hex digits of the id's digest deal a size class into 1, 16, 256 ... blocks, by its number of rows.
    digits = sum((F.col("rows") > BLOCK_ROWS * 16**p).cast("int") for p in range(8))
    per_class = per_class.withColumn("digits", digits)
    goal = targets(per_class.groupBy("source").agg(F.sum("words").alias("source_size")), **rule)
    drawn = F.md5(F.concat_ws("|", F.coalesce("source", F.lit("")), F.lit(seed)))
    offset = F.conv(F.substring(drawn, 1, 8), 16, 10).cast("double") / 4294967296.0
    classes = Window.partitionBy("source").orderBy("cls").rowsBetween(Window.unboundedPreceding, -1)
    firsts = per_class.withColumn("first", F.coalesce(F.sum("rows").over(classes), F.lit(0))).drop("rows", "words")
    about = (
        _null_safe(firsts, goal.drop("weight"), ["source"])
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .withColumn("offset", offset)
    )
    dealt = _null_safe(rows, about, ["source", "cls"]).withColumn("block", F.expr("substring(key, 1, digits)")).drop("digits")
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("source", "cls", "block").orderBy("size", "key")).cast("long"))
    along = Window.partitionBy("source", "cls").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("source", "cls", "block", "first").agg(F.count(F.lit(1)).alias("rows"))
    starts = starts.select("source", "cls", "block", (F.col("first") + F.coalesce(F.sum("rows").over(along), F.lit(0))).alias("before"))
    placed = _null_safe(ranked.drop("first"), starts, ["source", "cls", "block"])
    end = F.col("before") + F.col("rank")
    copies = F.floor(end * F.col("rate") + F.col("offset")) - F.floor((end - 1) * F.col("rate") + F.col("offset"))
    return placed.select(*["row"] * bool(row_col), "doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"))


def _size_class():
    """The octave of the size and its next three bits, in integers: equal on any engine."""
    octave = "length(bin(size)) - 1"
    return F.expr(f"CASE WHEN size > 0 THEN ({octave}) * 8 + (shiftright(size, greatest({octave} - 3, 0)) & 7) ELSE -1 END").cast("int")


def _null_safe(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join on keys of which the source may be null. Joined on a filled text, so that it stays an equi-join with hashable keys."""
    r = right.select(*[F.col(c).alias(f"r_{c}") if c in on else F.col(c) for c in right.columns])
    same = [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in on]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return left.join(r, cond).drop(*[f"r_{c}" for c in on])


def mix(docs: DataFrame, **rule) -> DataFrame:
    """The mixed corpus: every column of docs once per copy, with ``copy`` counting from 0 (in place of a column of that name). Documents without a copy are gone."""
    # The document travels as one struct, so that no column of its own can clash, and meets its copies by its row's number.
    whole = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "copy"]).alias("doc"))
    rows = materialise(whole, "mix-docs")
    counts = plan(rows.select("row", "doc.doc_id", "doc.text", "doc.source"), row_col="row", **rule).where("copies > 0").select("row", F.col("copies").cast("int").alias("copies"))
    return rows.join(counts, "row").select("doc", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy")).select("doc.*", "copy")
