"""Databases on a file system: a manifest, the wide table partitioned by tile, and index tables.

The directory of a database holds ``manifest.json`` (shape, tile, columns, indexes) and ``cells`` as Parquet, partitioned
by the tile numbers c0.. of the first axes. A tile is a whole number of chunks along these axes; by default as many as leave MAX_TILES
tiles at most, whatever the extent of the world. Inside a tile rows stand chunk by chunk, so that row groups are pruned by their
coordinates. Stored columns are named by their number, so a key that was dropped and added again with another type is another column.
A write replaces the tiles that it touches and no others, directory by directory from a staged copy; tiles that lost their last cell are
deleted. A tile of very many rows is dealt over several tasks and files. Index tables are partitioned alike, and the tiles that a
write touches are replaced in them by the same write. Before the first directory is moved a journal names the staged copy, the
directories and the manifest that will hold; whoever opens the database next carries out what a journal has left undone, so a driver that
dies leaves the state before the write or the one after it. There is one writer at a time. All paths go through Hadoop's file systems,
so the root may be on any store that Spark reads.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BadRequest, Conflict, NotFound
from ..grid import SQL_TYPES, Grid, any_key
from ..registry import Registry, cell_type
from ..shape import Shape

NAME = re.compile(r"[A-Za-z0-9_-]+")
MANIFEST, JOURNAL = "manifest.json", "journal.json"
CHUNK_AXES = 2
MAX_TILES = 4096


def default_tile(shape: Shape) -> int:
    """The least edge, in whole chunks, at which the partitioned axes have MAX_TILES tiles at most."""
    most = round(MAX_TILES ** (1 / min(shape.axes, CHUNK_AXES)))
    chunks = -(-shape.world_dim // shape.chunk_dim)
    return shape.chunk_dim * -(-chunks // most)


class Files:
    """The few file operations that are needed, by Hadoop's FileSystem."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark.sparkContext._jvm

    def _at(self, path: str):
        where = self.jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        where, fs = self._at(path)
        return fs.exists(where)

    def delete(self, path: str) -> bool:
        where, fs = self._at(path)
        return fs.delete(where, True)

    def names(self, path: str) -> list[str]:
        where, fs = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def bytes(self, path: str) -> int:
        where, fs = self._at(path)
        return fs.getContentSummary(where).getLength() if fs.exists(where) else 0

    def move(self, old: str, new: str) -> None:
        where, fs = self._at(new)
        fs.mkdirs(where.getParent())
        if not fs.rename(self._at(old)[0], where):
            raise OSError(f"can't move {old} to {new}")

    def has_text(self, path: str) -> bool:
        """Whether write() has ever put a text there."""
        return self.exists(path) or self.exists(path + ".next")

    def read(self, path: str) -> str:
        """The text that was last written whole."""
        where, fs = self._at(path + ".next" if self.exists(path + ".next") else path)
        stream = fs.open(where)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """A reader sees the old text or the new, also if this ends halfway: a whole file is renamed to ``.next``, which counts before the
        path itself, and then takes its place."""
        if self.exists(path + ".next"):  # left by a write that ended halfway
            self.delete(path)
            self.move(path + ".next", path)
        temp = f"{path}.{uuid.uuid4().hex}"
        where, fs = self._at(temp)
        stream = fs.create(where, True)
        stream.write(text.encode())
        stream.close()
        self.move(temp, path + ".next")
        self.delete(path)
        self.move(path + ".next", path)


@dataclass(frozen=True)
class Manifest:
    shape: Shape
    registry: Registry
    indexes: tuple = ()
    tile: int | None = None  # None: a chunk

    def to_json(self) -> str:
        s, r = self.shape, self.registry
        columns = {k: list(v) for k, v in sorted(r.live.items())}
        return json.dumps({"axes": s.axes, "world_dim": s.world_dim, "chunk_dim": s.chunk_dim, "tile": self.tile, "columns": columns, "next": r.next_number, "indexes": sorted(self.indexes)}, indent=1)

    @classmethod
    def of(cls, text: str) -> Manifest:
        d = json.loads(text)
        return cls(Shape(d["axes"], d["world_dim"], d["chunk_dim"]), Registry({k: tuple(v) for k, v in d["columns"].items()}, d["next"]), tuple(d["indexes"]), d.get("tile"))


class Store:
    """One database's directory."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)

    # manifest

    def load(self) -> Manifest:
        if not self.files.has_text(f"{self.path}/{MANIFEST}"):
            raise NotFound(f"no database at {self.path}")
        self.recover()
        return Manifest.of(self.files.read(f"{self.path}/{MANIFEST}"))

    def save(self, manifest: Manifest) -> None:
        self.files.write(f"{self.path}/{MANIFEST}", manifest.to_json())

    def create_or_open(self, shape: Shape, tile: int | None = None) -> Manifest:
        """A stored shape must agree with the given one. tile: the edge of a tile, a multiple of a chunk's; None: the default."""
        if self.files.has_text(f"{self.path}/{MANIFEST}"):
            manifest = self.load()
            if manifest.shape != shape:
                raise BadRequest(f"the database has the shape {manifest.shape}")
            return manifest
        if tile is not None and (tile < 1 or tile % shape.chunk_dim):
            raise BadRequest("the edge of a tile must be a multiple of a chunk's")
        self.save(Manifest(shape, Registry(), tile=tile or default_tile(shape)))
        return self.load()

    # cells

    def chunk_axes(self, shape: Shape) -> int:
        return min(shape.axes, CHUNK_AXES)

    def _schema(self, m: Manifest) -> T.StructType:
        fields = [T.StructField(c, T.IntegerType()) for c in m.shape.coords]
        fields += [T.StructField(f"k{m.registry.live[k][1]}", cell_type(m.registry.kind(k))) for k in m.registry.keys()]
        return T.StructType(fields + [T.StructField(f"c{i}", T.IntegerType()) for i in range(self.chunk_axes(m.shape))])

    def grid(self, manifest: Manifest | None = None) -> Grid:
        """The stored cells under the names of today's registry; a column that a file lacks is unset."""
        m = manifest or self.load()
        where, schema, n = f"{self.path}/cells", self._schema(m), self.chunk_axes(m.shape)
        if any(name.startswith("c0=") for name in self.files.names(where)):
            table = self.spark.read.schema(schema).parquet(where)
        else:
            table = self.spark.createDataFrame([], schema)
        named = [F.col(f"k{m.registry.live[k][1]}").alias(k) for k in m.registry.keys()]
        cells = table.select(*m.shape.coords, *[f"c{i}" for i in range(n)], *named)
        return Grid(m.shape, m.registry, cells.where(any_key(m.registry.keys())), n, m.tile)

    def _parts(self, path: str, n: int) -> set[str]:
        """The tile directories of a table, below its path."""
        out = {x for x in self.files.names(path) if x.startswith("c0=")}
        for _ in range(n - 1):
            out = {f"{x}/{y}" for x in out for y in self.files.names(f"{path}/{x}") if y.startswith("c")}
        return out

    def replace(self, cells: DataFrame, manifest: Manifest, touched: DataFrame | None = None) -> None:
        """Write cells. touched: (c0..) of the tiles that cells replaces as a whole, beside those it has rows in; None: all of the table.

        The new rows are staged beside the table first, since they are usually computed from it, and evaluated once: which tiles they fill
        is read from the staged directories.
        """
        m, n = manifest, self.chunk_axes(manifest.shape)
        tiles, staged = [f"c{i}" for i in range(n)], f"staged-{uuid.uuid4().hex}"
        numbers = [m.shape.chunk_of(i, m.tile).alias(f"c{i}") for i in range(n)]
        stored = cells.select(*m.shape.coords, *[F.col(f"`{k}`").alias(f"k{m.registry.live[k][1]}") for k in m.registry.keys()], *numbers)
        order = [*tiles, *[m.shape.chunk_of(i) for i in range(m.shape.axes)], *m.shape.coords]
        self._stage(stored.hint("rebalance", *tiles).sortWithinPartitions(*order), f"{staged}/cells", tiles)
        tables = ["cells"]
        for key in m.indexes:
            number = m.registry.live[key][1]
            if self._parts(f"{self.path}/{staged}/cells", 1):
                fresh = self.spark.read.schema(self._schema(m)).parquet(f"{self.path}/{staged}/cells")
                self._stage(self._index_rows(fresh, f"k{number}", m), f"{staged}/index-{number}", tiles)
            tables.append(f"index-{number}")
        filled = {t: sorted(self._parts(f"{self.path}/{staged}/{t}", n)) for t in tables}
        parts = None
        if touched is not None:
            named = {"/".join(f"{c}={v}" for c, v in zip(tiles, r)) for r in touched.select(*tiles).distinct().collect()}
            parts = sorted(named.union(*filled.values()))
        self.files.write(f"{self.path}/{JOURNAL}", json.dumps({"staged": staged, "parts": parts, "tables": filled, "manifest": m.to_json()}))
        self.recover()

    def _stage(self, rows: DataFrame, name: str, tiles: list[str]) -> None:
        rows.write.mode("overwrite").partitionBy(*tiles).parquet(f"{self.path}/{name}")

    def recover(self) -> None:
        """Carry out the journal of a write, as far as that was not done; each step may be done again."""
        journal = f"{self.path}/{JOURNAL}"
        if not self.files.has_text(journal):
            return
        plan = json.loads(self.files.read(journal))
        for table, filled in plan["tables"].items():
            where, staged = f"{self.path}/{table}", f"{self.path}/{plan['staged']}/{table}"
            # A part that is no longer staged has been moved already.
            for part, full in ((f"/{p}", p in filled) for p in plan["parts"]) if plan["parts"] is not None else [("", bool(filled))]:
                if not full:
                    self.files.delete(where + part)
                elif self.files.exists(staged + part):
                    self.files.delete(where + part)
                    self.files.move(staged + part, where + part)
        self.files.write(f"{self.path}/{MANIFEST}", plan["manifest"])
        self.files.delete(f"{self.path}/{plan['staged']}")
        self.files.delete(f"{journal}.next")
        self.files.delete(journal)

    # equality indexes: side tables by tile, sorted by value inside one; they never change an answer

    def index_path(self, number: int) -> str:
        return f"{self.path}/index-{number}"

    def _index_rows(self, cells: DataFrame, column: str, m: Manifest) -> DataFrame:
        tiles = [f"c{i}" for i in range(self.chunk_axes(m.shape))]
        rows = cells.where(F.col(f"`{column}`").isNotNull()).select(F.col(f"`{column}`.v").alias("value"), *m.shape.coords, *tiles)
        return rows.hint("rebalance", *tiles).sortWithinPartitions(*tiles, "value")

    def build_index(self, key: str, manifest: Manifest) -> None:
        number = manifest.registry.live[key][1]
        tiles = [f"c{i}" for i in range(self.chunk_axes(manifest.shape))]
        self._stage(self._index_rows(self.grid(manifest).cells, key, manifest), f"index-{number}", tiles)

    def index(self, key: str, manifest: Manifest) -> DataFrame:
        """(value, x0.., c0..) of an index."""
        m, path = manifest, self.index_path(manifest.registry.live[key][1])
        tiles = [f"c{i}" for i in range(self.chunk_axes(m.shape))]
        schema = ", ".join([f"value {SQL_TYPES[m.registry.kind(key)]}", *(f"{c} int" for c in [*m.shape.coords, *tiles])])
        return self.spark.read.schema(schema).parquet(path) if self._parts(path, 1) else self.spark.createDataFrame([], schema)


class Root:
    """A directory of databases."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)

    def _checked(self, name: str) -> str:
        if not NAME.fullmatch(name):
            raise BadRequest(f"not a database name: {name!r}")
        return f"{self.path}/{name}"

    def names(self) -> list[str]:
        return [n for n in self.files.names(self.path) if NAME.fullmatch(n) and self.files.has_text(f"{self.path}/{n}/{MANIFEST}")]

    def create(self, name: str, shape: Shape, tile: int | None = None) -> Store:
        store = Store(self.spark, self._checked(name))
        if self.files.has_text(f"{store.path}/{MANIFEST}"):
            raise Conflict(f"database {name!r} exists")
        store.create_or_open(shape, tile)
        return store

    def open(self, name: str) -> Store:
        store = Store(self.spark, self._checked(name))
        store.load()
        return store

    def remove(self, name: str) -> bool:
        path = self._checked(name)
        return self.files.has_text(f"{path}/{MANIFEST}") and self.files.delete(path)
