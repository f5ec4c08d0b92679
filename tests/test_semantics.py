"""Predicates and aggregates against a direct evaluation of cells, and the fixed answers of the design notes."""

import math
import random

import pytest

from cellgrid.errors import BadRequest
from cellgrid.grid import Grid
from cellgrid.operators import statements
from cellgrid.operators.predicate import OPS, compile_where
from cellgrid.plans.ast import And, Compare, Exists, Not, Or
from cellgrid.plans.parser import parse
from cellgrid.registry import Registry, cell_type
from cellgrid.shape import Shape

KINDS = {"s": "str", "f": "f64", "i": "i64", "b": "bool"}
SHAPE = Shape(2, 100, 8)
BIG = 2**53


def make(spark, cells, kinds=KINDS, shape=SHAPE):
    """cells: {coord: {key: value or (value, created, updated, version)}}."""
    full = lambda v: v if isinstance(v, tuple) else (v, 0, 0, 0)
    rows = [(*at, *[full(own[k]) if k in own else None for k in sorted(kinds)]) for at, own in cells.items()]
    schema = ", ".join([*(f"{c} int" for c in shape.coords), *(f"{k} {cell_type(kinds[k]).simpleString()}" for k in sorted(kinds))])
    return Grid(shape, Registry.of(kinds), spark.createDataFrame(rows, schema))


def holds(expr, at, own):
    """The two-valued meaning of an expression at one cell."""
    if isinstance(expr, Not):
        return not holds(expr.inner, at, own)
    if isinstance(expr, And):
        return holds(expr.left, at, own) and holds(expr.right, at, own)
    if isinstance(expr, Or):
        return holds(expr.left, at, own) or holds(expr.right, at, own)
    if isinstance(expr, Exists):
        return expr.key in own
    what, name = expr.operand
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    test = lambda a: OPS[expr.op](float(a), float(expr.value))
    if what == "axis":
        return name < len(at) and number(expr.value) and test(at[name])
    if what == "meta":
        place = {"created": 1, "updated": 2, "version": 3}[name]
        return number(expr.value) and any(test(v[place]) for v in own.values())
    if name not in own:
        return False
    value = own[name][0]
    if number(value) and number(expr.value):
        return test(value)
    return type(value) is type(expr.value) and OPS[expr.op](value, expr.value)


def test_random_predicates_equal_direct_evaluation(spark):
    rng = random.Random(5)
    pools = {
        "s": ["", "a", "b", "ß", "true"], "f": [0.0, -0.0, 1.0, 2.5, math.nan, float(BIG), math.inf], "i": [0, 1, -1, BIG, BIG + 1, -BIG - 1], "b": [True, False],
    }
    cells = {}
    for n in range(300):
        own = {k: (rng.choice(p), rng.choice([1, 5, 9]), rng.choice([5, 9]), rng.randrange(3)) for k, p in pools.items() if rng.random() < 0.6}
        if own:
            cells[n % 20, n // 20] = own
    grid = make(spark, cells)
    values = ["", "a", "true", 0, 1, 5, 9, BIG, BIG + 1, 0.0, 2.5, -1.5, True, False]

    def tree(depth):
        if depth == 0 or rng.random() < 0.25:
            if rng.random() < 0.15:
                return Exists(rng.choice("sfibz"))
            operand = rng.choice([("key", rng.choice("sfibz")), ("key", rng.choice("sfib")), ("axis", rng.randrange(3)), ("meta", rng.choice(["created", "updated", "version"]))])
            return Compare(operand, rng.choice(list(OPS)), rng.choice(values))
        if rng.random() < 0.3:
            return Not(tree(depth - 1))
        return rng.choice([And, Or])(tree(depth - 1), tree(depth - 1))

    trees = [tree(3) for _ in range(160)]
    both = [c for t in trees for c in (compile_where(t, grid.registry, SHAPE), compile_where(t, grid.registry, SHAPE, negate=True))]
    got = grid.cells.select("x0", "x1", *[c.alias(f"p{i}") for i, c in enumerate(both)]).collect()
    for row in got:
        at = (row.x0, row.x1)
        for i, t in enumerate(trees):
            want = holds(t, at, cells[at])
            assert bool(row[f"p{2 * i}"]) == want, (t, at, cells[at])
            assert bool(row[f"p{2 * i + 1}"]) == (not want), ("NOT", t, at, cells[at])


def one(grid, text):
    return statements.select(grid, parse(text)).first().asDict()


def test_aggregate_answers(spark):
    g = make(spark, {(0, 0): {"f": 2.0}, (1, 0): {"f": 5.0}, (2, 0): {"f": -1.0}, (3, 0): {"s": "x"}})
    assert one(g, "SELECT sum(f), mean(f), max(f), min(f), count(*)") == {"sum(f)": 6.0, "mean(f)": 2.0, "max(f)": 5.0, "min(f)": -1.0, "count(*)": 4.0}
    g = make(spark, {(0, 0): {"s": "only"}})
    assert one(g, "SELECT sum(f), mean(f), max(f), min(f), sum(s), max(nope)") == {"sum(f)": 0.0, "mean(f)": None, "max(f)": None, "min(f)": None, "sum(s)": 0.0, "max(nope)": None}
    g = make(spark, {(0, 0): {"s": ("a", 1000, 5000, 4)}, (1, 0): {"s": ("b", 2000, 2000, 0)}, (2, 0): {"i": (1, 500, 9000, 2)}})
    assert one(g, "SELECT max(updated), min(created), max(version), sum(version), mean(version)") == {"max(updated)": 9000.0, "min(created)": 500.0, "max(version)": 4.0, "sum(version)": 6.0, "mean(version)": 2.0}
    g = make(spark, {(0, 0): {"f": math.nan}, (1, 0): {"f": 3.0}})
    assert one(g, "SELECT max(f), min(f)") == {"max(f)": 3.0, "min(f)": 3.0}
    g = make(spark, {(0, 0): {"i": 2**62}, (1, 0): {"i": 2**62}, (2, 0): {"i": 2**62}})
    assert one(g, "SELECT sum(i)")["sum(i)"] == 3.0 * 2**62


def coords(grid):
    return {(r.x0, r.x1) for r in grid.cells.collect()}


def test_boxes(spark):
    g = make(spark, {(x, y): {"i": 1} for x in range(-3, 4) for y in range(-3, 4)})
    sel = lambda t: {(r.x0, r.x1) for r in statements.select(g, parse(t)).collect()}
    assert sel("SELECT * FROM (-1,0) TO (1,2)") == {(-1, 0), (-1, 1), (0, 0), (0, 1)}
    assert sel("SELECT * FROM (1,1) TO (1,5)") == sel("SELECT * FROM (2,2) TO (0,0)") == set()
    assert len(sel("SELECT * FROM (-999,-999) TO (999,999)")) == 49
    with pytest.raises(BadRequest):
        sel("SELECT * FROM (0) TO (1)")


def write(grid, text, now=77):
    s = parse(text, lambda: now / 1000)
    f = {"SetCells": statements.set_cells, "Update": statements.update}.get(type(s).__name__)
    change = f(grid, s, now) if f else statements.delete(grid, s)
    return change.grid, change.affected.first()[0]


def test_set(spark):
    g = make(spark, {(0, 0): {"s": ("stone", 1, 2, 3)}})
    out, n = write(g, "SET (i=7) WHERE s = 'stone' IN (0,0) TO (2,2)")
    assert n == 1 and coords(out) == {(0, 0)}
    out, n = write(g, "SET (i=7) WHERE NOT s = 'stone' IN (0,0) TO (2,2)")
    assert n == 3 and coords(out) == {(0, 0), (0, 1), (1, 0), (1, 1)}
    out, n = write(g, "SET (s='sand', s='mud') IN (0,0) TO (2,1)")
    cells = {(r.x0, r.x1): tuple(r.s) for r in out.cells.collect()}
    assert n == 2 and cells == {(0, 0): ("mud", 1, 77, 5), (1, 0): ("mud", 77, 77, 1)}
    assert write(g, "SET (i=7) IN (0,0) TO (0,5)")[1] == 0
    for bad in ("SET (i=7) IN (2,2) TO (0,0)", "SET (i=7) WHERE x0=0 IN (2,2) TO (0,0)", "SET (i=7) IN (0,0) TO (999,1)", "SET (f=1) IN (0,0) TO (1,1)", "SET (new=1, s=2) IN (0,0) TO (1,1)"):
        with pytest.raises(BadRequest):
            write(g, bad)


def test_update_and_delete(spark):
    g = make(spark, {(0, 0): {"s": "a"}, (1, 0): {"i": 1}, (2, 0): {"s": "b", "i": 2}})
    out, n = write(g, "UPDATE (b=true) WHERE EXISTS(s)")
    assert n == 2 and coords(out) == coords(g) and {r.x0: r.b and r.b.v for r in out.cells.collect()} == {0: True, 1: None, 2: True}
    out, n = write(g, "DELETE WHERE NOT s = 'a'")
    assert n == 2 and coords(out) == {(0, 0)}
    assert write(g, "DELETE")[1] == 3
    assert coords(write(g, "DELETE IN (1,0) TO (9,9)")[0]) == {(0, 0)}
    assert write(g, "UPDATE (i=1) WHERE nope = 1")[1] == 0


def test_pushdown(spark, tmp_path):
    g = make(spark, {(x, 0): {"s": "a", "i": x} for x in range(50)})
    g.cells.write.parquet(str(tmp_path / "t"))
    g = Grid(SHAPE, g.registry, spark.read.parquet(str(tmp_path / "t")))
    plan = statements.select(g, parse("SELECT i WHERE s = 'a' AND x0 < 9"))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(s.v,a)" in plan and "LessThan(x0,9)" in plan and "b:struct" not in plan
