"""Global aggregates of matching cells, as doubles."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ast import Aggregate
from ..registry import NUMERIC, Registry


def compile_aggregate(agg: Aggregate, registry: Registry) -> Column:
    if agg.func == "count":
        return F.count(F.lit(1)).cast("double")
    what, name = agg.target
    if what == "meta":  # over every key of every cell: partial results of each key are put together
        columns = [F.col(f"`{k}`.{name}").cast("double") for k in registry.keys()]
    else:
        columns = [F.col(f"`{name}`.v").cast("double")] if registry.kind(name) in NUMERIC else []
    nothing = F.lit(None).cast("double")
    sums = reduce(add, (F.coalesce(F.sum(c), F.lit(0.0)) for c in columns), F.lit(0.0))
    if agg.func == "sum":
        return sums
    if agg.func == "mean":
        n = reduce(add, (F.count(c) for c in columns), F.lit(0))
        return F.when(n > 0, sums / n)
    pick, across = (F.max, F.greatest) if agg.func == "max" else (F.min, F.least)
    # NaN is left out, unless there is nothing else.
    each = [F.coalesce(pick(F.when(~F.isnan(c), c)), pick(c)) for c in columns]
    return nothing if not each else each[0] if len(each) == 1 else across(*each)


def aggregate(cells: DataFrame, aggregates, registry: Registry) -> DataFrame:
    """One row, one column a label (labels said twice are given once)."""
    named = {a.label: a for a in aggregates}
    return cells.agg(*[compile_aggregate(a, registry).alias(label) for label, a in named.items()])


def as_rows(wide: DataFrame) -> DataFrame:
    """(label, value), one row an aggregate, in order of position."""
    pairs = F.array(*[F.struct(F.lit(c).alias("label"), F.col(f"`{c}`").alias("value")) for c in wide.columns])
    return wide.select(F.inline(pairs))
