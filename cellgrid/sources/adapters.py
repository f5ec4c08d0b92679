"""Relational tables as grids: which columns are coordinates, which are keys, and where metadata comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import Grid, any_key, cell
from ..operators.merge import fold_local
from ..registry import VALUE_TYPES, Registry
from ..shape import Shape

WIDE = Shape(1, 400_000_000, 32)


def millis(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / 1000).cast("long")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_rows(rows: DataFrame, axes: list[Column], keys: dict[str, tuple[str, Column]], at_ms: Column | None = None, shape: Shape | None = None) -> Grid:
    """rows -> grid. keys: name -> (type, value). Null values are unset keys; rows with none are no cells. A coordinate that
    is no 32-bit integer is an error, never a wrong cell."""
    when = F.lit(0) if at_ms is None else at_ms
    shape = shape or Shape(len(axes), WIDE.world_dim, WIDE.chunk_dim)
    registry = Registry.of({k: kind for k, (kind, _) in keys.items()})
    cells = [F.when(v.isNotNull(), cell(v.cast(VALUE_TYPES[kind]), when, when, F.lit(0))).alias(k) for k, (kind, v) in keys.items()]
    table = rows.select(*[a.cast("int").alias(f"x{i}") for i, a in enumerate(axes)], *cells)
    return Grid(shape, registry, table.where(any_key(registry.keys())).select(*shape.coords, *registry.keys()))


def orders(spark: SparkSession, sf_dir: str) -> Grid:
    c, at = F.col, millis(F.col("o_orderdate"))
    keys = {"status": ("str", c("o_orderstatus")), "totalprice": ("f64", c("o_totalprice")), "priority": ("str", c("o_orderpriority")), "custkey": ("i64", c("o_custkey")), "orderdate": ("i64", at)}
    return from_rows(read(spark, sf_dir, "orders"), [c("o_orderkey")], keys, at)


def lineitem(spark: SparkSession, sf_dir: str) -> Grid:
    c, at = F.col, millis(F.col("l_shipdate"))
    keys = {k: ("f64", c(f"l_{col}")) for k, col in (("quantity", "quantity"), ("extendedprice", "extendedprice"), ("discount", "discount"), ("tax", "tax"))}
    keys |= {"returnflag": ("str", c("l_returnflag")), "linestatus": ("str", c("l_linestatus")), "shipdate": ("i64", at)}
    return from_rows(read(spark, sf_dir, "lineitem"), [c("l_orderkey"), c("l_partkey"), c("l_suppkey"), c("l_linenumber")], keys, at)


def part(spark: SparkSession, sf_dir: str) -> Grid:
    c = F.col
    keys = {"name": ("str", c("p_name")), "brand": ("str", c("p_brand")), "type": ("str", c("p_type")), "size": ("i64", c("p_size")), "retailprice": ("f64", c("p_retailprice"))}
    return from_rows(read(spark, sf_dir, "part"), [c("p_partkey")], keys)


def docs(spark: SparkSession, sf_dir: str) -> Grid:
    """Sparse: quality and toxic are set for labelled documents only."""
    c = F.col
    both = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    keys = {"lang": ("str", c("lang")), "source": ("str", c("source")), "n_chars": ("i64", c("n_chars")), "quality": ("i64", c("quality")), "toxic": ("bool", c("toxic") == 1)}
    return from_rows(both, [c("doc_id")], keys)


def conversations(spark: SparkSession, sf_dir: str) -> Grid:
    c = F.col
    return from_rows(read(spark, sf_dir, "conversations"), [c("conv_id"), c("turn")], {"role": ("str", c("role")), "text": ("str", c("text"))})


def event_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a log of writes: cell (user_id), key event_type, value, in order of (ts, event_id)."""
    rows = read(spark, sf_dir, "events")
    null = lambda t: F.lit(None).cast(t)
    return rows.select(
        F.col("user_id").cast("int").alias("x0"), F.col("event_type").alias("key"), null("string").alias("v_str"), F.col("value").alias("v_f64"), null("long").alias("v_i64"), null("boolean").alias("v_bool"),
        millis(F.col("ts")).alias("at_ms"), F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("event_id").alias("e")).alias("nth"), F.col("event_id"),
    )


def event_registry(writes: DataFrame) -> Registry:
    """The keys of the log; their number is bounded by the event types, as columns always are."""
    return Registry.of({r.key: "f64" for r in writes.select("key").distinct().orderBy("key").collect()})


def events(spark: SparkSession, sf_dir: str) -> Grid:
    from ..grid import wide

    writes = event_writes(spark, sf_dir)
    return wide(fold_local(writes, ["x0"]), Shape(1, WIDE.world_dim, 32), event_registry(writes))


def event_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as replicated changes: two origins by parity of the event id; a sequence number is the id + 1."""
    w = event_writes(spark, sf_dir)
    return w.select(
        "x0", "key", "v_str", "v_f64", "v_i64", "v_bool", F.col("at_ms").alias("created"), F.col("at_ms").alias("updated"), F.lit(0).cast("long").alias("version"),
        (F.pmod("event_id", F.lit(2)) + 1).cast("long").alias("origin"), (F.col("event_id") + 1).cast("long").alias("seq"), F.lit(False).alias("removed"),
    )
