"""A grid: shape, registry and the wide table of its cells."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .errors import BadRequest
from .registry import META, Registry
from .shape import Shape


@dataclass(frozen=True)
class Grid:
    """cells: one row a cell with x0.. and, for each key, struct<v, created, updated, version> or null. Partition columns
    c0.. may stand beside them (chunk_axes of them, numbers of tiles of an edge of ``tile``), so that boxes prune directories."""

    shape: Shape
    registry: Registry
    cells: DataFrame
    chunk_axes: int = 0
    tile: int | None = None

    @property
    def keys(self) -> list[str]:
        return self.registry.keys()

    @property
    def edge(self) -> int:
        return self.tile or self.shape.chunk_dim

    @property
    def spark(self):
        return self.cells.sparkSession

    def with_cells(self, cells: DataFrame, registry: Registry | None = None) -> Grid:
        registry = registry or self.registry
        return Grid(self.shape, registry, cells.select(*self.shape.coords, *[F.col(f"`{k}`") for k in registry.keys()]), tile=self.tile)

    def within(self, box) -> DataFrame:
        """The cells of a box; all where box is None."""
        if box is None:
            return self.cells
        if len(box.lo) != self.shape.axes:
            raise BadRequest(f"a box of {len(box.lo)} axes in a grid of {self.shape.axes}")
        return self.cells.where(box.holds(self.edge, self.chunk_axes))

    def chunks(self, n: int) -> list[Column]:
        """Tile numbers c0.. of the first n axes: the partition columns where the cells have them."""
        return [F.col(f"c{i}") if i < self.chunk_axes else self.shape.chunk_of(i, self.edge).alias(f"c{i}") for i in range(n)]

    def around(self, box) -> Grid:
        """The grid of the tiles that a box meets, along the partitioned axes: what a write to the box can touch."""
        met, dim = F.lit(True), self.edge
        for i in range(min(self.chunk_axes, len(box.lo))):
            met = met & F.col(f"c{i}").between(box.lo[i] // dim, (box.hi[i] - 1) // dim)
        return Grid(self.shape, self.registry, self.cells.where(met), self.chunk_axes, self.tile)

    def of_chunks(self, chunks: list[tuple]) -> Grid:
        """The grid of some tiles, given by their partition numbers; the condition prunes directories."""
        met = F.lit(False)
        for values in chunks:
            one = F.lit(True)
            for i, v in enumerate(values):
                one = one & (F.col(f"c{i}") == v)
            met = met | one
        return Grid(self.shape, self.registry, self.cells.where(met), self.chunk_axes, self.tile)

    def entries(self) -> DataFrame:
        """The long form: x0.., key, v_str, v_f64, v_i64, v_bool, created, updated, version; one row a (cell, key)."""
        each = [
            F.struct(F.lit(k).alias("key"), *[(F.col(f"`{k}`.v") if kind == self.registry.kind(k) else F.lit(None).cast(sql)).alias(f"v_{kind}") for kind, sql in SQL_TYPES.items()], *[F.col(f"`{k}`.{m}").alias(m) for m in META], F.col(f"`{k}`").isNotNull().alias("_set"))
            for k in self.keys
        ]
        coords = [F.col(c) for c in self.shape.coords]
        if not each:
            each = [F.struct(F.lit("").alias("key"), *[F.lit(None).cast(sql).alias(f"v_{kind}") for kind, sql in SQL_TYPES.items()], *[F.lit(None).cast("bigint").alias(m) for m in META], F.lit(False).alias("_set"))]
        return self.cells.select(*coords, F.inline(F.array(*each))).where("_set").drop("_set")


SQL_TYPES = {"str": "string", "f64": "double", "i64": "bigint", "bool": "boolean"}


def cell(value: Column, created: Column, updated: Column, version: Column) -> Column:
    return F.struct(value.alias("v"), created.cast("long").alias("created"), updated.cast("long").alias("updated"), version.cast("long").alias("version"))


def any_key(keys: list[str]) -> Column:
    """A cell exists if at least one key is set."""
    return reduce(or_, (F.col(f"`{k}`").isNotNull() for k in keys)) if keys else F.lit(False)


def wide(entries: DataFrame, shape: Shape, registry: Registry) -> Grid:
    """Long form -> grid: one grouping by coordinate, each key the one entry it has there."""
    out = []
    for k in registry.keys():
        own = F.struct(F.col(f"v_{registry.kind(k)}").alias("v"), *[F.col(m) for m in META])
        out.append(F.first(F.when(F.col("key") == k, own), ignorenulls=True).alias(k))
    if not out:
        return Grid(shape, registry, entries.select(*shape.coords).where("false"))
    cells = entries.where(F.col("key").isin(registry.keys())).groupBy(*shape.coords).agg(*out)
    return Grid(shape, registry, cells)


def flat(df: DataFrame, coords: list[str], keys: list[str], meta: bool = True) -> DataFrame:
    """Structs of keys as plain columns: key and, with meta, key_created, key_updated, key_version."""
    out = [F.col(c) for c in coords]
    for k in keys:
        out.append(F.col(f"`{k}`.v").alias(k))
        out += [F.col(f"`{k}`.{m}").alias(f"{k}_{m}") for m in META] * meta
    return df.select(*out)
