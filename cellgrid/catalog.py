"""The library's front door: a catalog of databases, and databases that answer statements."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import BadRequest, Forbidden, NotFound
from .grid import Grid
from .operators import digest, region, statements
from .plans.ast import And, Compare, Delete, IndexStatement, Or, Select, SetCells, Update, is_write
from .plans.parser import parse
from .registry import META, type_of
from .shape import DEFAULT_AXES, DEFAULT_CHUNK_DIM, DEFAULT_WORLD_DIM, Box, Region, Shape, parse_coords
from .sources.storage import Root, Store


#: A write without a box rewrites the tiles that hold a match if there are at most so many, else the table; a statement is narrowed to the
#: tiles that indexes name if there are at most so many.
MAX_NAMED_TILES = 256


class Catalog:
    """All databases below a root path. read_only handles refuse writes."""

    def __init__(self, spark: SparkSession, root: str, read_only: bool = False, clock: Callable[[], float] = time.time):
        self.spark, self.root, self.read_only, self.clock = spark, Root(spark, root), read_only, clock

    def health(self) -> dict:
        return {"status": "ok", "databases": len(self.databases())}

    def databases(self) -> list[str]:
        return self.root.names()

    def create(self, name: str, axes: int = DEFAULT_AXES, world_dim: int = DEFAULT_WORLD_DIM, chunk_dim: int = DEFAULT_CHUNK_DIM, tile_dim: int | None = None) -> Database:
        """tile_dim: the edge of the tiles by which cells are stored, a multiple of chunk_dim; for hundreds of MB a tile."""
        self._writable()
        return Database(self, name, self.root.create(name, Shape(axes, world_dim, chunk_dim), tile_dim))

    def open(self, name: str) -> Database:
        return Database(self, name, self.root.open(name))

    def remove(self, name: str) -> bool:
        self._writable()
        return self.root.remove(name)

    def _writable(self) -> None:
        if self.read_only:
            raise Forbidden("this handle is read-only")


class Database:
    def __init__(self, catalog: Catalog, name: str, store: Store):
        self.catalog, self.name, self.store = catalog, name, store

    @property
    def shape(self) -> Shape:
        return self.store.load().shape

    def grid(self) -> Grid:
        return self.store.grid()

    def now_ms(self) -> int:
        return int(self.catalog.clock() * 1000)

    # statements

    def query(self, text: str):
        """A DataFrame for SELECT, ``{"affected_cells": n}`` for writes, ``{}`` for index statements."""
        statement = parse(text, self.catalog.clock)
        if is_write(statement):
            self.catalog._writable()
        if isinstance(statement, IndexStatement):
            if statement.action == "create":
                self.create_index(statement.key)
            elif statement.action == "drop":
                if not self.drop_index(statement.key):
                    raise NotFound(f"no index on {statement.key!r}")
            else:
                self.rebuild_index(statement.key)
            return {}
        grid = self.grid()
        if isinstance(statement, Select):
            return statements.select(self._narrowed(grid, statement.where), statement)
        statements.check_axes(grid, statement.box)
        part, touched = self._scope(grid, statement)
        now = self.now_ms()
        if isinstance(statement, SetCells):
            change = statements.set_cells(part, statement, now)
        elif isinstance(statement, Update):
            change = statements.update(part, statement, now)
        else:
            assert isinstance(statement, Delete)
            change = statements.delete(part, statement)
        affected = change.affected.first()[0]
        if affected:
            self._keep(part, change.grid, touched)
        return {"affected_cells": affected}

    def _scope(self, grid: Grid, statement) -> tuple[Grid, bool]:
        """The part of the grid that a write can touch, and whether it is less than all: the tiles of its box, or else those
        that hold a matching cell, if these are few enough to be named in a condition."""
        if statement.box is not None:
            return grid.around(statement.box), True
        n = self.store.chunk_axes(grid.shape)
        hit = statements.matching(self._narrowed(grid, statement.where), None, statement.where).select(*grid.chunks(n)).distinct().limit(MAX_NAMED_TILES + 1).collect()
        return (grid.of_chunks([tuple(r) for r in hit]), True) if len(hit) <= MAX_NAMED_TILES else (grid, False)

    def _narrowed(self, grid: Grid, where) -> Grid:
        """The grid of the tiles that indexes leave for a condition, which is still to be applied; all of it where they don't help."""
        manifest = self.store.load()
        tiles = self._tiles(manifest, where) if manifest.indexes else None
        return grid if tiles is None else grid.of_chunks(sorted(tiles))

    def _tiles(self, manifest, where) -> set | None:
        """Tiles outside which a condition holds nowhere, by the indexes; None: not known, or too many to be named."""
        if isinstance(where, (And, Or)):
            left, right = self._tiles(manifest, where.left), self._tiles(manifest, where.right)
            if left is None or right is None:
                return (right if left is None else left) if isinstance(where, And) else None
            both = left & right if isinstance(where, And) else left | right
            return both if len(both) <= MAX_NAMED_TILES else None
        if not isinstance(where, Compare) or where.op != "=" or where.operand[0] != "key" or where.operand[1] not in manifest.indexes:
            return None
        numbers = [f"c{i}" for i in range(self.store.chunk_axes(manifest.shape))]
        found = self._found(manifest, where.operand[1], where.value).select(*numbers).distinct().limit(MAX_NAMED_TILES + 1).collect()
        return {tuple(r) for r in found} if len(found) <= MAX_NAMED_TILES else None

    def select(self, text: str) -> DataFrame:
        """SELECT only."""
        if is_write(parse(text, self.catalog.clock)):
            raise Forbidden("only SELECT is allowed here")
        return self.query(text)

    def _keep(self, before: Grid, after: Grid, part: bool = True) -> None:
        """Store what a write led to: the tiles of the grid it was applied to (part), or all; indexes follow."""
        manifest = self.store.load()
        manifest = replace(manifest, registry=after.registry)
        n = self.store.chunk_axes(manifest.shape)
        touched = before.cells.select(*before.chunks(n)) if part else None
        self.store.replace(after.cells, manifest, touched)

    # cells

    def get(self, coord, key: str):
        """A value, or None. The coordinate (numbers, or text like ``1,2,3``) is checked before the key is looked at."""
        coord = parse_coords(coord) if isinstance(coord, str) else coord
        found = self.get_with_meta(coord, key)
        return found["v"] if found else None

    def get_with_meta(self, coord, key: str) -> dict | None:
        coord = self.shape.check(coord)
        grid = self.grid()
        if grid.registry.kind(key) is None:
            return None
        row = grid.within(_point(coord)).select(F.col(f"`{key}`").alias("c")).first()
        return row.c.asDict() if row and row.c is not None else None

    def get_meta(self, coord, key: str) -> dict | None:
        found = self.get_with_meta(coord, key)
        return {m: found[m] for m in META} if found else None

    def cell_entry(self, coord) -> dict:
        """All keys of a cell with their metadata; empty where there is no cell."""
        grid = self.grid()
        row = grid.within(_point(self.shape.check(coord))).select(*[F.col(f"`{k}`") for k in grid.keys]).first()
        return {k: row[k].asDict() for k in grid.keys if row[k] is not None} if row else {}

    def list_cells(self) -> DataFrame:
        grid = self.grid()
        return grid.cells.select(*grid.shape.coords, *[F.col(f"`{k}`") for k in grid.keys]).orderBy(*grid.shape.coords)

    def set(self, coord, key: str, value) -> None:
        self.set_region(coord, [1] * len(coord), key, [value])

    def remove(self, coord, key: str) -> bool:
        return self.remove_region(coord, [1] * len(coord), key) > 0

    # regions

    def get_region(self, origin, extent, key: str) -> DataFrame:
        return region.read_region(self.grid(), Region(tuple(origin), tuple(extent)), key)

    def set_region(self, origin, extent, key: str, values: list) -> int:
        self.catalog._writable()
        at = Region(tuple(origin), tuple(extent)).check(self.shape)
        grid = self.grid().around(at.box)
        after = region.write_region(grid, at, key, values, self.now_ms())
        if values:
            self._keep(grid, after)
        return len(values)

    def remove_region(self, origin, extent, key: str) -> int:
        """How many cells held the key."""
        self.catalog._writable()
        at = Region(tuple(origin), tuple(extent)).check(self.shape)
        grid = self.grid().around(at.box)
        after, held = region.remove_region(grid, at, key)
        n = held.count()
        if n:
            self._keep(grid, after)
        return n

    # columns

    def columns(self) -> list[tuple[str, str]]:
        registry = self.store.load().registry
        return [(k, registry.kind(k)) for k in registry.keys()]

    def add_column(self, key: str, kind: str) -> None:
        self.catalog._writable()
        manifest = self.store.load()
        self.store.save(replace(manifest, registry=manifest.registry.add(key, kind)))

    def remove_column(self, key: str) -> bool:
        """Stored data under the column's number is never read again; cells without another key are gone."""
        self.catalog._writable()
        manifest = self.store.load()
        if key not in manifest.registry.live:
            return False
        self.drop_index(key)
        after = region.drop_column(self.grid(), key)
        self.store.replace(after.cells, replace(self.store.load(), registry=after.registry))
        return True

    # indexes

    def indexes(self) -> list[str]:
        return sorted(self.store.load().indexes)

    def create_index(self, key: str) -> None:
        """Nothing happens for a key that was never written or has an index."""
        self.catalog._writable()
        manifest = self.store.load()
        if key in manifest.registry.live and key not in manifest.indexes:
            self.store.build_index(key, manifest)
            self.store.save(replace(manifest, indexes=(*manifest.indexes, key)))

    def rebuild_index(self, key: str) -> None:
        self.catalog._writable()
        manifest = self.store.load()
        if key in manifest.registry.live:
            # Not listed while it is built, so that nobody reads half of it.
            manifest = replace(manifest, indexes=tuple(k for k in manifest.indexes if k != key))
            self.store.save(manifest)
            self.store.build_index(key, manifest)
            self.store.save(replace(manifest, indexes=(*manifest.indexes, key)))

    def drop_index(self, key: str) -> bool:
        self.catalog._writable()
        manifest = self.store.load()
        if key not in manifest.indexes:
            return False
        self.store.save(replace(manifest, indexes=tuple(k for k in manifest.indexes if k != key)))
        self.store.files.delete(self.store.index_path(manifest.registry.live[key][1]))
        return True

    def lookup_eq(self, key: str, value) -> DataFrame | None:
        """Coordinates at which key has the value, from the index; None where there is no index."""
        manifest = self.store.load()
        if key not in manifest.indexes:
            return None
        return self._found(manifest, key, value).select(*manifest.shape.coords)

    def _found(self, manifest, key: str, value) -> DataFrame:
        """The rows of an index that have a value; numbers of both types count as doubles."""
        kind, table = manifest.registry.kind(key), self.store.index(key, manifest)
        given = type_of(value)
        if given != kind and not {given, kind} <= {"i64", "f64"}:
            return table.where("false")
        column = F.col("value") if given == kind == "i64" and abs(value) < 2**53 or kind in ("str", "bool") else F.col("value").cast("double")
        return table.where(column == (float(value) if {given, kind} <= {"i64", "f64"} and not (given == kind == "i64" and abs(value) < 2**53) else value))

    # the rest

    def stats(self) -> dict:
        row = digest.chunk_stats(self.grid()).first()
        return {"total_chunks": row.total_chunks, "total_cells": row.total_cells, "total_bytes": self.store.files.bytes(f"{self.store.path}/cells")}

    def content_digest(self) -> int:
        return digest.content_digest(self.grid()).first().digest

    def sync_report(self, other: Database) -> dict:
        """The chunks in which two databases differ, and the indexes that only one of them has."""
        mine, theirs = set(self.indexes()), set(other.indexes())
        return {"differing_chunks": self.sync_status(other), "indexes_only_here": sorted(mine - theirs), "indexes_only_there": sorted(theirs - mine)}

    def sync_status(self, other: Database) -> DataFrame:
        """Chunks in which two databases differ."""
        if self.shape != other.shape:
            raise BadRequest("the databases have different shapes")
        return digest.differing_chunks(digest.chunk_digests(self.grid()), digest.chunk_digests(other.grid()))


def _point(coord) -> Box:
    return Box(tuple(coord), tuple(c + 1 for c in coord))
