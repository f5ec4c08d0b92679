"""Coordinates of a box, dense reads, writes and removals of a region."""

from __future__ import annotations

from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BadRequest
from ..grid import Grid, any_key, cell
from ..registry import type_of
from ..shape import Region

I32_VOLUME = 2**63 - 1


def coordinates(spark: SparkSession, region: Region) -> DataFrame:
    """pos and x0.. of every coordinate, axis 0 fastest. A range and arithmetic: nothing is stored or joined."""
    if region.volume > I32_VOLUME:
        raise BadRequest("the region is too large to be enumerated")
    return spark.range(region.volume).select(F.col("id").alias("pos"), *at_position(F.col("id"), region))


def at_position(pos: Column, region: Region) -> list[Column]:
    out = []
    for i, (o, e) in enumerate(zip(region.origin, region.extent)):
        step = prod(max(1, x) for x in region.extent[:i])
        digit = F.floor(pos / F.lit(step)) if step < 2**53 else F.expr(f"pos div {step}")
        out.append((F.pmod(digit.cast("long"), F.lit(max(1, e))) + F.lit(o)).cast("int").alias(f"x{i}"))
    return out


def read_region(grid: Grid, region: Region, key: str) -> DataFrame:
    """pos, x0.., value: one row a coordinate of the box, null where the key is unset or unknown."""
    region.check(grid.shape)
    dense = coordinates(grid.spark, region)
    if grid.registry.kind(key) is None:
        return dense.withColumn("value", F.lit(None).cast("string"))
    inside = grid.within(region.box).select(*grid.shape.coords, F.col(f"`{key}`.v").alias("value"))
    return dense.join(inside, grid.shape.coords, "left").select("pos", *grid.shape.coords, "value")


def write_region(grid: Grid, region: Region, key: str, values: list, now_ms: int) -> Grid:
    """Values of a box in order of position, all of one type."""
    region.check(grid.shape)
    if len(values) != region.volume:
        raise BadRequest(f"{len(values)} values for a region of {region.volume} cells")
    if not values:
        return grid
    kinds = {type_of(v) for v in values}
    if len(kinds) > 1:
        raise BadRequest("the values of a region must have one type")
    kind = kinds.pop()
    registry = grid.registry.intern(key, kind)
    sql = {"str": "string", "f64": "double", "i64": "long", "bool": "boolean"}[kind]
    given = grid.spark.createDataFrame(list(enumerate(values)), f"pos long, _new {sql}")
    return write_values(grid, region.box, given.select(*at_position(F.col("pos"), region), "_new"), key, registry, now_ms)


def write_values(grid: Grid, box, given: DataFrame, key: str, registry, now_ms: int) -> Grid:
    """Set key from given (x0.., _new) inside box; cells outside are not joined."""
    at = with_columns(grid, registry)
    inside = at.where(box.holds(grid.edge, grid.chunk_axes)).drop(*_chunks(grid))
    outside = at.where(~box.holds()).drop(*_chunks(grid))
    old = F.col(f"`{key}`")
    new = cell(F.col("_new"), F.coalesce(old["created"], F.lit(now_ms)), F.lit(now_ms), F.coalesce(old["version"] + 1, F.lit(0)))
    joined = inside.join(given, grid.shape.coords, "full_outer").withColumn(key, F.when(F.col("_new").isNotNull(), new).otherwise(old))
    return grid.with_cells(joined.drop("_new").unionByName(outside), registry)


def _chunks(grid: Grid) -> list[str]:
    return [f"c{i}" for i in range(grid.chunk_axes)]


def with_columns(grid: Grid, registry) -> DataFrame:
    """The cells with a null column for each key that the registry has and the grid lacks."""
    from ..registry import cell_type

    out = grid.cells
    for k in registry.keys():
        if k not in grid.registry.live:
            out = out.withColumn(k, F.lit(None).cast(cell_type(registry.kind(k))))
    return out


def remove_region(grid: Grid, region: Region, key: str) -> tuple[Grid, DataFrame]:
    """The grid without key in the box, and the coordinates that held it."""
    region.check(grid.shape)
    if grid.registry.kind(key) is None or not region.volume:
        return grid, grid.cells.select(*grid.shape.coords).where("false")
    box = region.box
    held = grid.within(box).where(F.col(f"`{key}`").isNotNull()).select(*grid.shape.coords)
    left = grid.cells.withColumn(key, F.when(~box.holds(), F.col(f"`{key}`")))
    return grid.with_cells(left.where(any_key(grid.keys))), held


def drop_column(grid: Grid, key: str) -> Grid:
    """Without a column; cells that had no other key are gone."""
    registry = grid.registry.remove(key)
    left = grid.cells.drop(key)
    return grid.with_cells(left.where(any_key(registry.keys())), registry)


def add_column(grid: Grid, key: str, kind: str) -> Grid:
    registry = grid.registry.add(key, kind)
    return grid.with_cells(with_columns(grid, registry), registry)
