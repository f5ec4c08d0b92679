"""A replica that follows a change log: Structured Streaming with a last-write-wins sink.

Changes are files of rows (x0.., key, v_str, v_f64, v_i64, v_bool, created, updated, version, origin, seq, removed). Each
micro-batch is folded into the state, which stands in generations beside a pointer file; the pointer names the generation and the
last batch, so a batch that is delivered again changes nothing, and the fold would not change anything either, since it is
idempotent. A value for a key that is new declares its column; the pointer keeps the columns. Changes that can't be applied (a coordinate
outside the grid, a value of another type than its key's, a name that can't be a column) go to a table of rejects with their error. Late changes lose to what is newer, tombstones included, until these are purged after the retention.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..grid import Grid
from ..operators import merge, vector
from ..registry import Registry
from ..shape import Shape
from ..sources.storage import Files

WEEK_MS = 7 * 24 * 3600 * 1000


def change_schema(shape: Shape) -> T.StructType:
    long = ("created", "updated", "version", "origin", "seq")
    values = [("v_str", T.StringType()), ("v_f64", T.DoubleType()), ("v_i64", T.LongType()), ("v_bool", T.BooleanType())]
    fields = [*((c, T.IntegerType()) for c in shape.coords), ("key", T.StringType()), *values, *((c, T.LongType()) for c in long), ("removed", T.BooleanType())]
    return T.StructType([T.StructField(n, t) for n, t in fields])


class Replica:
    """State of one database at path, fed by batches of changes."""

    def __init__(self, spark: SparkSession, path: str, shape: Shape, registry: Registry, retention_ms: int = WEEK_MS):
        self.spark, self.path, self.shape, self.given, self.retention_ms = spark, path.rstrip("/"), shape, registry, retention_ms
        self.files = Files(spark)

    @property
    def registry(self) -> Registry:
        """The columns it was given, and those that changes have declared since."""
        at = self._pointer()
        return Registry({k: tuple(v) for k, v in at["columns"].items()}, at["next"]) if "columns" in at else self.given

    def _pointer(self) -> dict:
        where = f"{self.path}/pointer.json"
        return json.loads(self.files.read(where)) if self.files.has_text(where) else {"generation": 0, "batch": -1}

    def state(self) -> DataFrame:
        n = self._pointer()["generation"]
        schema = change_schema(self.shape)
        return self.spark.read.schema(schema).parquet(f"{self.path}/state-{n}") if n else self.spark.createDataFrame([], schema)

    def grid(self) -> Grid:
        return merge.visible(self.state(), self.shape, self.registry)

    def confirmed(self) -> DataFrame:
        """The version vector of what is stored: what a peer need not send again."""
        return vector.of_log(self.state())

    def rejects(self) -> DataFrame:
        """Changes that were not applied, with ``error`` and the ``batch`` they came in."""
        schema = T.StructType([*change_schema(self.shape).fields, T.StructField("error", T.StringType()), T.StructField("batch", T.LongType())])
        where = f"{self.path}/rejects"
        return self.spark.read.schema(schema).parquet(where) if self.files.names(where) else self.spark.createDataFrame([], schema)

    def apply(self, changes: DataFrame, batch: int) -> None:
        at = self._pointer()
        if batch <= at["batch"]:
            return
        names = change_schema(self.shape).names
        registry, _ = merge.interned(changes, self.shape, self.registry, merge.order_of())
        told = merge.judged(changes.select(names), self.shape, registry)
        bad = told.where("error IS NOT NULL")
        if not bad.isEmpty():
            bad.write.mode("overwrite").parquet(f"{self.path}/rejects/batch={batch}")
        # A removal of a key that nobody has declared has nothing to remove.
        good = told.where(F.col("error").isNull() & F.col("key").isin(registry.keys())).select(names)
        merged = merge.fold_lww(self.state().select(names).unionByName(good), self.shape.coords)
        newest = good.agg(F.max("updated")).first()[0]
        if newest is not None:
            merged = merge.purge(merged, newest - self.retention_ms)
        n = at["generation"] + 1
        merged.select(names).write.mode("overwrite").parquet(f"{self.path}/state-{n}")
        columns = {k: list(v) for k, v in sorted(registry.live.items())}
        self.files.write(f"{self.path}/pointer.json", json.dumps({"generation": n, "batch": batch, "columns": columns, "next": registry.next_number}))
        if n > 2:
            self.files.delete(f"{self.path}/state-{n - 2}")

    def follow(self, log: str, checkpoint: str, max_files: int = 256) -> StreamingQuery:
        """Start following a directory of change files; the trigger takes what is there and ends."""
        changes = self.spark.readStream.schema(change_schema(self.shape)).option("maxFilesPerTrigger", max_files).parquet(log)
        return changes.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class ReplicaSet:
    """Replicas of many databases, fed by one log whose rows name their ``database``. A value for a database that was never
    seen creates it; a removal does not."""

    def __init__(self, spark: SparkSession, root: str, shape: Shape, registry: Registry, retention_ms: int = WEEK_MS):
        self.spark, self.root, self.shape, self.registry, self.retention_ms = spark, root.rstrip("/"), shape, registry, retention_ms
        self.files = Files(spark)

    def names(self) -> list[str]:
        return [n for n in self.files.names(self.root) if self.files.has_text(f"{self.root}/{n}/pointer.json")]

    def replica(self, name: str) -> Replica:
        return Replica(self.spark, f"{self.root}/{name}", self.shape, self.registry, self.retention_ms)

    def apply(self, changes: DataFrame, batch: int) -> None:
        """The names in a batch are as many as databases, not as rows."""
        known = set(self.names())
        for row in changes.groupBy("database").agg(F.bool_or(~F.col("removed")).alias("sets")).collect():
            if row.database in known or row.sets:
                self.replica(row.database).apply(changes.where(F.col("database") == row.database).drop("database"), batch)
