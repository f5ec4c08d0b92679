"""Version vectors as DataFrames (origin, seq): the highest sequence number seen of each origin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEGACY_BIT = -(2**63)


def of_log(rows: DataFrame, legacy_origin: int | None = None) -> DataFrame:
    """The vector that a log or state covers; rows without a stamp (origin 0) count for legacy_origin if it is given."""
    origin = F.col("origin") if legacy_origin is None else F.when(F.col("origin") == 0, F.lit(legacy_origin)).otherwise(F.col("origin"))
    return rows.select(origin.alias("origin"), "seq").groupBy("origin").agg(F.max("seq").alias("seq"))


def legacy_origin(node_id: int) -> int:
    """The pseudo-origin of unstamped data of a node: its id with the top bit set, as a signed number."""
    return node_id | LEGACY_BIT


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pointwise maximum."""
    return a.select("origin", "seq").union(b.select("origin", "seq")).groupBy("origin").agg(F.max("seq").alias("seq"))


def meet(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pointwise minimum over the origins of both."""
    return a.join(b.withColumnRenamed("seq", "_s"), "origin").select("origin", F.least("seq", "_s").alias("seq"))


def missing(a: DataFrame, b: DataFrame) -> DataFrame:
    """What b has beyond a: origin, and by how much. An absent origin counts its whole number."""
    lack = b.join(a.withColumnRenamed("seq", "_s"), "origin", "left").select("origin", (F.col("seq") - F.coalesce("_s", F.lit(0))).alias("behind"))
    return lack.where("behind > 0")


def covers(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (covers): whether a has all that b has."""
    return missing(a, b).agg((F.count(F.lit(1)) == 0).alias("covers"))


def has(a: DataFrame, origin: int, seq: int) -> DataFrame:
    return a.where(F.col("origin") == origin).agg(F.coalesce(F.max("seq") >= seq, F.lit(False)).alias("has"))


def compare(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """One row (state, behind_by, ahead_by)."""
    both = mine.withColumnRenamed("seq", "m").join(theirs.withColumnRenamed("seq", "t"), "origin", "full_outer")
    m, t = F.coalesce("m", F.lit(0)), F.coalesce("t", F.lit(0))
    sums = both.agg(
        F.coalesce(F.sum(F.greatest(t - m, F.lit(0))), F.lit(0)).alias("behind_by"), F.coalesce(F.sum(F.greatest(m - t, F.lit(0))), F.lit(0)).alias("ahead_by")
    )
    state = F.when((F.col("behind_by") == 0) & (F.col("ahead_by") == 0), "in_sync").when(F.col("ahead_by") == 0, "behind").when(F.col("behind_by") == 0, "ahead").otherwise("diverged")
    return sums.select(state.alias("state"), "behind_by", "ahead_by")


#: A vector of at most so many origins is put into the condition of a scan.
NAMED_ORIGINS = 256


def changes_since(rows: DataFrame, known: DataFrame, legacy: int | None = None) -> DataFrame:
    """Rows whose stamp the vector lacks. A vector of few origins becomes a condition on origin and seq, by which a Parquet scan skips
    row groups that hold nothing newer; a larger one is joined."""
    few = known.select("origin", "seq").limit(NAMED_ORIGINS + 1).collect()
    if len(few) <= NAMED_ORIGINS:
        real = [(r.origin, r.seq) for r in few if r.origin != legacy]
        own = [r.seq for r in few if legacy is not None and r.origin == legacy]
        names = [o for o, _ in real] + [0] * (legacy is not None and 0 not in [o for o, _ in real])
        lacks = ~F.col("origin").isin(names) if names else F.lit(True)
        for o, seq in real:
            if not (legacy is not None and o == 0):
                lacks = lacks | ((F.col("origin") == o) & (F.col("seq") > seq))
        if legacy is not None:  # unstamped rows count for the pseudo-origin
            lacks = lacks | ((F.col("origin") == 0) & (F.col("seq") > own[0] if own else F.lit(True)))
            lacks = lacks & ~((F.col("origin") == legacy) & (F.col("seq") <= own[0])) if own else lacks
        return rows.where(lacks)
    origin = F.col("origin") if legacy is None else F.when(F.col("origin") == 0, F.lit(legacy)).otherwise(F.col("origin"))
    seen = known.select(F.col("origin").alias("_origin"), F.col("seq").alias("_seen"))
    return rows.join(seen, origin == F.col("_origin"), "left").where("_seen IS NULL OR seq > _seen").drop("_origin", "_seen")


def stamp(batch: DataFrame, origin: int, confirmed: int, order_by: str = "nth") -> DataFrame:
    """Local writes with their stamps: numbers confirmed + 1, + 2 ... in order. A batch is what one publication carries, so it is small."""
    from pyspark.sql import Window

    return batch.withColumn("origin", F.lit(origin).cast("long")).withColumn("seq", (F.row_number().over(Window.orderBy(order_by)) + confirmed).cast("long"))
