"""Content digests: XOR of one hash for each (cell, key), so independent of order and additive over chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..grid import Grid
from ..registry import META


def entry_hash(coords: list[str]) -> Column:
    kind = F.coalesce(*[F.when(F.col(f"v_{k}").isNotNull(), F.lit(k)) for k in ("str", "f64", "i64", "bool")])
    return F.xxhash64(*coords, "key", kind, "v_str", "v_f64", "v_i64", "v_bool", *META)


def content_digest(grid: Grid) -> DataFrame:
    """One row (digest); 0 for an empty grid."""
    return grid.entries().agg(F.coalesce(F.bit_xor(entry_hash(grid.shape.coords)), F.lit(0)).alias("digest"))


def chunk_digests(grid: Grid) -> DataFrame:
    """(c0.., digest) of each chunk; their XOR is the content digest."""
    chunks = [grid.shape.chunk_of(i).alias(f"c{i}") for i in range(grid.shape.axes)]
    return grid.entries().groupBy(*chunks).agg(F.bit_xor(entry_hash(grid.shape.coords)).alias("digest"))


def differing_chunks(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Chunks whose digests differ or that one side lacks."""
    by = [c for c in mine.columns if c != "digest"]
    both = mine.withColumnRenamed("digest", "_m").join(theirs.withColumnRenamed("digest", "_t"), by, "full_outer")
    return both.where(~F.col("_m").eqNullSafe(F.col("_t"))).select(*by)


def chunk_stats(grid: Grid) -> DataFrame:
    """One row: total_chunks that hold a cell, total_cells."""
    chunks = [grid.shape.chunk_of(i).alias(f"c{i}") for i in range(grid.shape.axes)]
    per = grid.cells.groupBy(*chunks).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("total_chunks"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_cells"))
