"""What the operators of this subpackage share: shared-folder tables, batch limits, words, spans."""

from __future__ import annotations

import os
import pickle
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch that goes to a Python worker. Whole texts travel in these batches, so the
#: default of 10,000 rows would let a run of long documents fill a worker.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of so many rows, for what is planned and carried out inside; for rows without texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def share(spark: SparkSession, value):
    """A broadcast of a value whose class travels with it, so that executors need not have this package. Only for values of a proven size."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shared(broadcast):
    """The value of share(), on an executor."""
    return pickle.loads(broadcast.value)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset: a folder of the warehouse, which executors share
    too, or in local mode (tests), where all is one machine, a temporary folder."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/cellgrid-shared"
    return "file://" + os.path.join(tempfile.gettempdir(), "cellgrid-shared")


_made: list[str] = []


def new_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/cellgrid-{what}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def drop_tables(spark: SparkSession) -> int:
    """Delete what this driver has put into the shared folder so far, archives included; for when all results have been stored."""
    n = len(_made)
    while _made:
        drop_path(spark, _made.pop())
    return n


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: the lineage ends there, so a lost executor repeats only reads."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cellgrid_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a materialised table that nothing reads any more."""
    path = getattr(df, "_cellgrid_path", None)
    if path:
        drop_path(df.sparkSession, path)


#: Rows of ids, keys or counts that are looked up by a broadcast; more are joined by a shuffle.
BROADCAST_IDS = 500_000


def looked_up(table: DataFrame, most: int | None = None) -> DataFrame:
    """A materialised table of narrow rows, to be broadcast if it has BROADCAST_IDS (or most) of them at most."""
    return F.broadcast(table) if table.count() <= (BROADCAST_IDS if most is None else most) else table


def words_ascii(text: str | None) -> list[bytes]:
    r"""Words ``[^\x20\x09-\x0D]+`` with A-Z lower-cased, as UTF-8. bytes.split() parts at exactly these six characters."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def n_words(text):
    r"""Column: how many words ``[^\x20\x09-\x0D]+`` a text has; null counts as none."""
    gone = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(F.regexp_replace(gone, r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long")
