"""The language: precedence, ordered choice, keywords that are no keywords, limits."""

import pytest

from cellgrid.errors import BadRequest
from cellgrid.plans.ast import Aggregate, And, Compare, Delete, Exists, IndexStatement, Not, Or, Select, SetCells, Update, is_write
from cellgrid.plans.parser import parse
from cellgrid.shape import Box

key = lambda k, op, v: Compare(("key", k), op, v)


def where(text):
    return parse(f"SELECT * WHERE {text}", lambda: 12.5).where


def test_precedence():
    a, b, c = key("a", "=", 1), key("b", "=", 2), key("c", "=", 3)
    assert where("a = 1 OR b = 2 AND c = 3") == Or(a, And(b, c))
    assert where("(a = 1 OR b = 2) AND c = 3") == And(Or(a, b), c)
    assert where("NOT a = 1 AND b = 2") == And(Not(a), b)
    assert where("not not a=1") == Not(Not(a))
    assert where("a = 1 and b = 2 and c = 3") == And(And(a, b), c)


def test_words_are_not_reserved():
    assert where("not = 1") == key("not", "=", 1)
    assert where("exists = 1 AND EXISTS(exists)") == And(key("exists", "=", 1), Exists("exists"))
    assert where("notable = 1") == key("notable", "=", 1)
    assert parse("SELECT count, sum").keys == ("count", "sum")
    assert parse("SELECT from FROM (0) TO (1)").box == Box((0,), (1,))
    assert parse("select Select where WHERE = 'x'").where == key("WHERE", "=", "x")


def test_operands():
    assert where("x12 >= -3.5") == Compare(("axis", 12), ">=", -3.5)
    assert where("X0 = 1") == key("X0", "=", 1)
    assert where("Created > now()") == Compare(("meta", "created"), ">", 12500)
    assert where("x = 'it'") == key("x", "=", "it")
    for bad in ("x0abc = 1", "a = 'it''s'", "a = 1.", "a = .5", "a = 1e3", "a == 1", "1 = a", "EXISTS(x 0)"):
        with pytest.raises(BadRequest):
            where(bad)


def test_literals():
    assert where("a = TRUE") == key("a", "=", True)
    assert where("a = ''") == key("a", "=", "")
    assert where("a = -9223372036854775808") == key("a", "=", -(2**63))
    for bad in ("a = 9223372036854775808", "x99999999999999999999 = 1"):
        with pytest.raises(BadRequest):
            where(bad)


def test_aggregates():
    s = parse("SELECT Count ( * ), SUM(density), max(UPDATED), min(x0)")
    assert s.aggregates == (Aggregate("count", ("all",)), Aggregate("sum", ("key", "density")), Aggregate("max", ("meta", "updated")), Aggregate("min", ("key", "x0")))
    assert [a.label for a in s.aggregates] == ["count(*)", "sum(density)", "max(updated)", "min(x0)"]
    for bad in ("SELECT count(*), a", "SELECT a, count(*)", "SELECT sum(*)", "SELECT median(a)", "SELECT"):
        with pytest.raises(BadRequest):
            parse(bad)


def test_statements():
    box = Box((0, -1), (2, 3))
    assert parse("SELECT * FROM (0,-1) TO (2, 3) WHERE a = 1") == Select(None, None, box, key("a", "=", 1))
    assert parse("SET (a = 1, b = 'x') WHERE EXISTS(a) IN (0,-1) TO (2,3)") == SetCells((("a", 1), ("b", "x")), Exists("a"), box)
    assert parse("update (a=1.5)") == Update((("a", 1.5),), None, None)
    assert parse("DELETE\n\tIN (0,-1) TO (2,3)\r\n") == Delete(None, box)
    assert parse("ReBuild INDEX ON a") == IndexStatement("rebuild", "a")
    assert [is_write(parse(t)) for t in ("SELECT a", "DELETE", "DROP INDEX ON a")] == [False, True, True]


@pytest.mark.parametrize(
    "bad",
    ["", "SET (a=1)", "SET () IN (0) TO (1)", "SELECT * WHERE a=1 FROM (0) TO (1)", "UPDATE (a=1) IN (0) TO (1) WHERE a=1", "DELETE x", "SELECT * LIMIT 5", "SELECT * FROM (0) TO (1,2)", "SELECT * FROM (3000000000) TO (1)", "INDEX ON a", "SELECT a; SELECT b", "SET (a = b) IN (0) TO (1)"],
)
def test_errors(bad):
    with pytest.raises(BadRequest):
        parse(bad)


def test_deep_nesting():
    with pytest.raises(BadRequest):
        where("(" * 20_000 + "a = 1" + ")" * 20_000)
