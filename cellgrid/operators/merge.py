"""Folding writes: local ones in order of arrival, replicated ones by last-write-wins.

The long form of a state: x0.., key, v_str, v_f64, v_i64, v_bool, created, updated, version, origin, seq, removed. A row is
a value or, with removed, a tombstone whose time of removal is ``updated``. Origins are unsigned 64-bit numbers
kept in a bigint; they are ordered with the sign bit flipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..grid import Grid, wide
from ..registry import Registry, valid_name
from ..shape import Shape

VALUES = ["v_str", "v_f64", "v_i64", "v_bool"]
PAYLOAD = [*VALUES, "created", "updated", "version", "origin", "seq", "removed"]
SIGN = -(2**63)


def order_of(prefix: str = "") -> Column:
    """(time, origin unsigned, seq): the total order of writes."""
    c = lambda name: F.col(prefix + name)
    return F.struct(c("updated").alias("updated"), c("origin").bitwiseXOR(F.lit(SIGN)).alias("origin"), c("seq").bitwiseXOR(F.lit(SIGN)).alias("seq"))


def fold_local(writes: DataFrame, coords: list[str]) -> DataFrame:
    """Writes (coords, key, VALUES, at_ms, nth, removed) in order of nth -> values with created, updated and version.

    Writes are unconditional. A removal ends a history: what is left are the writes after the last one, of which the first
    gives created, the last the value and updated, and their number less one the version. One shuffle: a grouping whose
    partial results are two extrema and the writes after the last removal are found by a join on the same keys.
    """
    by = [*coords, "key"]
    if "removed" in writes.columns:
        last = writes.groupBy(*by).agg(F.max(F.when(F.col("removed"), F.col("nth"))).alias("_cut"))
        writes = writes.join(last, by).where("_cut IS NULL OR nth > _cut").drop("_cut")
    newest = F.max_by(F.struct(*VALUES, "at_ms"), F.col("nth"))
    oldest = F.min_by(F.col("at_ms"), F.col("nth"))
    out = writes.groupBy(*by).agg(newest.alias("_n"), oldest.alias("created"), (F.count(F.lit(1)) - 1).alias("version"))
    return out.select(*by, *[F.col(f"_n.{v}") for v in VALUES], "created", F.col("_n.at_ms").alias("updated"), "version")


def fold_lww(rows: DataFrame, coords: list[str]) -> DataFrame:
    """State and changes together, in any order -> the row of each (cell, key) that was written last; tombstones stay."""
    by = [*coords, "key"]
    best = F.max_by(F.struct(*PAYLOAD), order_of())
    return rows.groupBy(*by).agg(best.alias("_b")).select(*by, *[F.col(f"_b.{p}") for p in PAYLOAD])


def purge(state: DataFrame, cutoff_ms: int) -> DataFrame:
    """Without the tombstones that are older than the retention allows."""
    return state.where((~F.col("removed")) | (F.col("updated") >= cutoff_ms))


def changes_between(before: Grid, after: Grid, now_ms: int) -> DataFrame:
    """What turns one grid into another, as unstamped changes: values that are new or differ, and removals at now_ms."""
    by = [*before.shape.coords, "key"]
    rest = [*VALUES, "created", "updated", "version"]
    old = before.entries().select(*by, F.struct(*rest).alias("_old"))
    both = old.join(after.entries().select(*by, F.struct(*rest).alias("_new")), by, "full_outer").where(~F.col("_old").eqNullSafe(F.col("_new")))
    gone = F.col("_new").isNull()
    at = lambda c: F.when(gone, F.lit(now_ms)).otherwise(F.col(f"_new.{c}")).alias(c)
    return both.select(*by, *[F.col(f"_new.{v}") for v in VALUES], at("created"), at("updated"), F.coalesce("_new.version", F.lit(0)).cast("long").alias("version"), gone.alias("removed"))


def visible(state: DataFrame, shape: Shape, registry: Registry) -> Grid:
    return wide(state.where("NOT removed"), shape, registry)


KINDS = ("str", "f64", "i64", "bool")


def kind_of() -> Column:
    """The type of a change's value, null where it has none."""
    return F.coalesce(*[F.when(F.col(f"v_{k}").isNotNull(), F.lit(k)) for k in KINDS])


def interned(batch: DataFrame, shape: Shape, registry: Registry, order: Column) -> tuple[Registry, dict[str, object]]:
    """The registry with the columns that a batch declares, and what their first value's order is. A new key gets the type of the first
    value for it inside the grid; names that can't be columns are left out. Columns are as many as the schema's, not as rows."""
    sets = batch.where(~F.col("removed") & shape.inside() & kind_of().isNotNull() & F.col("key").isNotNull())
    if registry.live:
        sets = sets.where(~F.col("key").isin(registry.keys()))
    firsts = sets.groupBy("key").agg(F.min_by(F.struct(kind_of().alias("kind"), order.alias("at")), order).alias("f"))
    out = {}
    for r in sorted(firsts.collect(), key=lambda r: (r.f.at, r.key)):
        if valid_name(r.key):
            registry = registry.add(r.key, r.f.kind)
            out[r.key] = r.f.at
    return registry, out


def judged(batch: DataFrame, shape: Shape, registry: Registry) -> DataFrame:
    """The batch with ``error``: why a change can't be applied. registry: with the columns that the batch declares."""
    expected = _typed(registry)
    bad = F.when(~shape.inside(), "coordinate out of range").when(~F.col("removed") & kind_of().isNull(), "no value")
    return batch.withColumn("error", bad.when(~F.col("removed") & expected.isNull(), "not a column name").when(~F.col("removed") & (expected != kind_of()), "wrong type"))


def _typed(registry: Registry) -> Column:
    known = F.create_map(*[x for k in registry.keys() for x in (F.lit(k), F.lit(registry.kind(k)))]) if registry.live else F.create_map().cast("map<string,string>")
    return F.try_element_at(known, F.col("key"))


def apply_changes(state: DataFrame, batch: DataFrame, shape: Shape, registry: Registry, keep_tombstones: bool = True) -> tuple[DataFrame, DataFrame]:
    """An ordered batch of changes (state's columns and nth) -> (new state, results (nth, applied, error)).

    Changes are taken in order of nth. A value declares its key if that is new; one of another type than its key's has an error, as has
    one with a bad coordinate, and does not touch the others. A change is applied if it is later than the value or tombstone that stands
    at its key. A removal of a key that nothing has declared yet is not applied; without tombstones, nor is one where nothing
    stands, and after one that is applied nothing does. ``interned`` gives the registry that results.
    """
    by = [*shape.coords, "key"]
    was_known = registry.keys()
    registry, declared = interned(batch, shape, registry, F.col("nth"))
    told = judged(batch, shape, registry)
    since = F.create_map(*[x for k, n in declared.items() for x in (F.lit(k), F.lit(n).cast("long"))]) if declared else F.create_map().cast("map<string,bigint>")
    known = F.col("key").isin(was_known) | F.coalesce(F.try_element_at(since, F.col("key")) < F.col("nth"), F.lit(False))
    told = told.withColumn("_known", ~F.col("removed") | known)
    refused = told.where("error IS NOT NULL OR NOT _known").select("nth", F.lit(False).alias("applied"), "error")
    good = told.where("error IS NULL AND _known").select(*by, *PAYLOAD, F.col("nth").cast("long").alias("nth"))
    old = state.select(*by, *PAYLOAD, F.lit(-1).cast("long").alias("nth"))
    if not keep_tombstones:
        return _in_order(old.where("NOT removed"), good, by, refused)
    # With tombstones something stands at a key ever after, so what stands is the latest of all that came before.
    before = Window.partitionBy(*by).orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    all_ = old.join(good.select(*by).distinct(), by, "left_semi").unionByName(good).withColumn("_was", F.max(order_of()).over(before))
    done = all_.where("nth >= 0").withColumn("applied", F.col("_was").isNull() | (order_of() > F.col("_was")))
    results = done.select("nth", "applied", F.lit(None).cast("string").alias("error")).union(refused)
    merged = fold_lww(state.select(*by, *PAYLOAD).unionByName(done.where("applied").select(*by, *PAYLOAD)), shape.coords)
    return merged, results


def _in_order(old: DataFrame, good: DataFrame, by: list[str], refused: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without tombstones each change depends on the outcome of those before it: the changes of a (cell, key) stream through one task in order,
    of which one row is held. Keys that the batch doesn't touch stay where they are."""
    stamp = order_of()
    touched = good.select(*by).distinct()
    rows = old.join(touched, by, "left_semi").unionByName(good).select("*", *[stamp[c].alias(f"_{c}") for c in ("updated", "origin", "seq")])
    schema = rows.select(*by, *PAYLOAD, "nth").withColumn("applied", F.lit(None).cast("boolean")).schema
    names = schema.names

    def run(batches):
        import pyarrow as pa

        kinds = None
        at = stands = None

        def told(out: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], kinds[n]) for n in names], names=names)

        for batch in batches:
            kinds = kinds or {n: pa.bool_() if n == "applied" else batch.schema.field(n).type for n in names}
            out = []
            for r in batch.to_pylist():
                own = tuple(r[c] for c in by)
                if own != at:
                    out += [stands | {"applied": None}] if stands else []
                    at, stands = own, None
                time = (r["_updated"], r["_origin"], r["_seq"])
                if r["nth"] < 0:
                    stands = r | {"_time": time}
                    continue
                ok = not r["removed"] if stands is None else time > stands["_time"]
                if ok:
                    stands = None if r["removed"] else r | {"_time": time}
                out.append(r | {"applied": ok})
            yield told(out)
        if stands:
            yield told([stands | {"applied": None}])

    dealt = rows.repartition(*by).sortWithinPartitions(*by, "nth").mapInArrow(run, schema)
    # Rows with applied tell what became of a change, those without what stands at the end.
    results = dealt.where("applied IS NOT NULL").select("nth", "applied", F.lit(None).cast("string").alias("error")).union(refused)
    state = old.join(touched, by, "left_anti").select(*by, *PAYLOAD).unionByName(dealt.where("applied IS NULL").select(*by, *PAYLOAD))
    return state, results
