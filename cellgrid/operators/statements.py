"""Statements over a grid. Reads give DataFrames, writes give the grid that results; nothing is carried out here."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BadRequest
from ..grid import Grid, any_key, cell
from ..plans.ast import Delete, Select, SetCells, Update
from ..registry import type_of
from .aggregate import aggregate
from .predicate import compile_where
from .region import coordinates, with_columns


@dataclass(frozen=True)
class Change:
    """What a write leads to: the new grid, and (affected_cells) as one row."""

    grid: Grid
    affected: DataFrame


def check_axes(grid: Grid, box) -> None:
    if box is not None and len(box.lo) != grid.shape.axes:
        raise BadRequest(f"a box of {len(box.lo)} axes in a grid of {grid.shape.axes}")


def matching(grid: Grid, box, where) -> DataFrame:
    cells = grid.within(box)
    return cells if where is None else cells.where(compile_where(where, grid.registry, grid.shape))


def select(grid: Grid, statement: Select) -> DataFrame:
    """Rows of coordinates and keys in the asked order (a row stays although it has none of them), or one row of aggregates."""
    check_axes(grid, statement.box)
    cells = matching(grid, statement.box, statement.where)
    if statement.aggregates is not None:
        return aggregate(cells, statement.aggregates, grid.registry)
    keys = grid.keys if statement.keys is None else [k for k in dict.fromkeys(statement.keys) if k in grid.registry.live]
    return cells.select(*grid.shape.coords, *[F.col(f"`{k}`") for k in keys])


def _interned(grid: Grid, assignments):
    """All assignments are checked before anything is written."""
    return reduce(lambda r, a: r.intern(a[0], type_of(a[1])), assignments, grid.registry)


def _assign(df: DataFrame, assignments, target, now_ms: int) -> DataFrame:
    """Assignments in order; a key assigned twice is written twice."""
    for key, value in assignments:
        old = F.col(f"`{key}`")
        new = cell(F.lit(value), F.coalesce(old["created"], F.lit(now_ms)), F.lit(now_ms), F.coalesce(old["version"] + 1, F.lit(0)))
        df = df.withColumn(key, new if target is None else F.when(target, new).otherwise(old))
    return df


def set_cells(grid: Grid, statement: SetCells, now_ms: int) -> Change:
    """Upsert of all coordinates of a box, or of those where the predicate holds on the cell (an empty one where there is none)."""
    check_axes(grid, statement.box)
    region = statement.box.region
    region.check(grid.shape)
    spark = grid.spark
    if not region.volume:
        return Change(grid, spark.createDataFrame([(0,)], "affected_cells long"))
    registry = _interned(grid, statement.assignments)
    at = with_columns(grid, registry)
    chunks = [f"c{i}" for i in range(grid.chunk_axes)]
    inside = at.where(statement.box.holds(grid.edge, grid.chunk_axes)).drop(*chunks)
    outside = at.where(~statement.box.holds()).drop(*chunks)
    joined = coordinates(spark, region).drop("pos").join(inside, grid.shape.coords, "left")
    if statement.where is None:
        return Change(grid.with_cells(_assign(joined, statement.assignments, None, now_ms).unionByName(outside), registry), spark.createDataFrame([(region.volume,)], "affected_cells long"))
    # The predicate is decided once, before any assignment, on the columns that the grid had.
    marked = joined.withColumn("_hit", F.coalesce(compile_where(statement.where, grid.registry, grid.shape), F.lit(False)))
    written = _assign(marked, statement.assignments, F.col("_hit"), now_ms).where(any_key(registry.keys())).drop("_hit")
    affected = marked.agg(F.count_if("_hit").alias("affected_cells"))
    return Change(grid.with_cells(written.unionByName(outside), registry), affected)


def update(grid: Grid, statement: Update, now_ms: int) -> Change:
    """Existing cells only; a cell may get a key that it lacked. One pass, without a join."""
    check_axes(grid, statement.box)
    registry = _interned(grid, statement.assignments)
    hit = statement.box.holds() if statement.box else F.lit(True)
    if statement.where is not None:
        hit = hit & compile_where(statement.where, grid.registry, grid.shape)
    marked = with_columns(grid, registry).withColumn("_hit", F.coalesce(hit, F.lit(False)))
    written = _assign(marked, statement.assignments, F.col("_hit"), now_ms).drop("_hit")
    affected = matching(grid, statement.box, statement.where).agg(F.count(F.lit(1)).alias("affected_cells"))
    return Change(grid.with_cells(written, registry), affected)


def delete(grid: Grid, statement: Delete) -> Change:
    """Matching cells lose every key, and so are gone."""
    check_axes(grid, statement.box)
    stays = compile_where(statement.where, grid.registry, grid.shape, negate=True) if statement.where is not None else F.lit(False)
    if statement.box:
        stays = stays | ~statement.box.holds()
    affected = matching(grid, statement.box, statement.where).agg(F.count(F.lit(1)).alias("affected_cells"))
    return Change(grid.with_cells(grid.cells.where(stays)), affected)
