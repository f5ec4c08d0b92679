"""WHERE expressions -> Columns.

The language is two-valued: a comparison with an unset key is false, its negation true. NOT is pushed down to the
leaves. A positive leaf stays a bare comparison, which a filter treats as false where it is null and which reaches the
Parquet scan; only a negated leaf is made null-safe. Types are resolved here, so that no implicit cast decides.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, eq, ge, gt, le, lt, ne, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.ast import And, Compare, Exists, Not, Or
from ..registry import NUMERIC, Registry
from ..shape import Shape

OPS = {"=": eq, "!=": ne, "<": lt, "<=": le, ">": gt, ">=": ge}
EXACT = 2**53


def compile_where(expr, registry: Registry, shape: Shape, negate: bool = False) -> Column:
    """A Column that is true exactly where expr (or with negate: NOT expr) is; elsewhere false or, without negation, null."""
    if isinstance(expr, Not):
        return compile_where(expr.inner, registry, shape, not negate)
    if isinstance(expr, (And, Or)):
        join = and_ if isinstance(expr, And) != negate else or_
        return join(compile_where(expr.left, registry, shape, negate), compile_where(expr.right, registry, shape, negate))
    if isinstance(expr, Exists):
        if registry.kind(expr.key) is None:
            return F.lit(negate)
        cell = F.col(f"`{expr.key}`")
        return cell.isNull() if negate else cell.isNotNull()
    return _compare(expr, registry, shape, negate)


def _compare(expr: Compare, registry: Registry, shape: Shape, negate: bool) -> Column:
    what, name = expr.operand
    if what == "axis":
        if name >= shape.axes or not _is_number(expr.value):
            return F.lit(negate)
        test = _number(F.col(f"x{name}"), "i64", expr.op, expr.value)
        return ~test if negate else test
    if what == "meta":
        if not _is_number(expr.value) or not registry.live:
            return F.lit(negate)
        # True if any key at the cell satisfies it; negated, if none does.
        each = [_number(F.col(f"`{k}`.{name}"), "i64", expr.op, expr.value) for k in registry.keys()]
        return reduce(and_, (~F.coalesce(t, F.lit(False)) for t in each)) if negate else reduce(or_, each)
    kind = registry.kind(name)
    value = F.col(f"`{name}`.v")
    if kind in NUMERIC and _is_number(expr.value):
        test = _number(value, kind, expr.op, expr.value)
    elif kind is not None and (kind, type(expr.value)) in (("str", str), ("bool", bool)):
        test = OPS[expr.op](value, F.lit(expr.value))
    else:
        return F.lit(negate)
    if not negate:
        return test
    if expr.op == "=" and kind in ("str", "bool"):
        return ~value.eqNullSafe(F.lit(expr.value))
    return ~F.coalesce(test, F.lit(False))


def _is_number(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def _number(column: Column, kind: str, op: str, value) -> Column:
    """Both sides count as doubles. Integer columns stay uncast where that gives the same answer, so that the scan can prune."""
    if kind == "i64":
        if isinstance(value, int) and abs(value) < EXACT:
            return OPS[op](column, F.lit(value))
        return OPS[op](column.cast("double"), F.lit(float(value)))
    test = OPS[op](column, F.lit(float(value)))
    return test & ~F.isnan(column) if op in (">", ">=") else test
