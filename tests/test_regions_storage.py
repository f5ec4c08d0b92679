"""Regions, columns, storage by chunks, catalog, indexes."""

import pytest

from cellgrid import catalog as catalog_module
from cellgrid.catalog import Catalog
from cellgrid.errors import BadRequest, Conflict, Forbidden, NotFound
from cellgrid.operators import region
from cellgrid.shape import Box, Region, Shape, parse_coords
from cellgrid.sources import storage


@pytest.fixture()
def catalog(spark, tmp_path):
    ticks = iter(range(1, 10_000))
    return Catalog(spark, f"file://{tmp_path}/root", clock=lambda: next(ticks))


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_shape_and_coords():
    s = Shape(2, 5, 2)
    assert (s.low, s.high) == (-2, 3)
    assert s.check([-2, 2]) == (-2, 2)
    for bad in ([-3, 0], [0], [0, 3]):
        with pytest.raises(BadRequest):
            s.check(bad)
    assert parse_coords(" 1,-2 , 3") == (1, -2, 3)
    for bad in ("", "1,,2", "a", "1,3000000000"):
        with pytest.raises(BadRequest):
            parse_coords(bad)
    assert Region((0, 0), (3, -1)).volume == 0
    with pytest.raises(BadRequest):
        Shape(0)
    with pytest.raises(BadRequest):
        Box((0,), (0, 1))


def test_coordinates_run_along_axis_zero(spark):
    got = region.coordinates(spark, Region((-1, 5), (2, 3))).orderBy("pos").collect()
    assert [(r.x0, r.x1) for r in got] == [(-1, 5), (0, 5), (-1, 6), (0, 6), (-1, 7), (0, 7)]
    assert region.coordinates(spark, Region((0, 0), (0, 4))).count() == 0


def test_life_of_a_database(catalog):
    db = catalog.create("one", axes=2, world_dim=100, chunk_dim=8)
    assert catalog.databases() == ["one"] and db.list_cells().count() == 0
    assert db.query("SET (material='stone', weight=2.5) IN (-9,-1) TO (1,1)") == {"affected_cells": 20}
    assert db.get((-9, -1), "material") == "stone" and db.get((1, 1), "material") is None and db.get((0, 0), "nope") is None
    assert db.stats()["total_chunks"] == 6 and db.stats()["total_cells"] == 20
    first = db.get_meta((0, 0), "weight")
    db.set((0, 0), "weight", 3.5)
    again = db.get_with_meta((0, 0), "weight")
    assert again["v"] == 3.5 and again["version"] == 1 and again["created"] == first["created"] < again["updated"]
    with pytest.raises(BadRequest):
        db.set((0, 0), "weight", 1)
    assert set(db.cell_entry((0, 0))) == {"material", "weight"} and db.cell_entry((40, 40)) == {}
    assert db.query("UPDATE (hot=true) WHERE weight > 3")["affected_cells"] == 1
    assert rows(db.query("SELECT hot WHERE EXISTS(hot)"), "x0", "x1") == [(0, 0)]
    assert db.query("DELETE WHERE x0 < -8 IN (-9,-1) TO (-7,1)")["affected_cells"] == 2
    assert db.stats()["total_cells"] == 18 and db.stats()["total_chunks"] == 4, "chunks without cells are gone"
    assert db.query("DELETE")["affected_cells"] == 18 and db.list_cells().count() == 0
    assert catalog.remove("one") and not catalog.remove("one") and catalog.databases() == []


def test_regions(catalog):
    db = catalog.create("r", axes=2, world_dim=100, chunk_dim=8)
    assert db.set_region((-1, 0), (2, 2), "v", [1, 2, 3, 4]) == 4
    got = db.get_region((-1, 0), (3, 2), "v").orderBy("pos").collect()
    assert [r.value for r in got] == [1, 2, None, 3, 4, None]
    assert db.remove_region((0, 0), (1, 5), "v") == 2 and db.remove_region((0, 0), (1, 5), "v") == 0
    assert rows(db.list_cells(), "x0", "x1") == [(-1, 0), (-1, 1)]
    assert db.remove((-1, 0), "v") and not db.remove((-1, 0), "v")
    db.set((-1, 0), "v", 9)
    assert db.get_meta((-1, 0), "v")["version"] == 0, "a removal ends the history"
    for bad in (((0, 0), (2, 2), "v", [1]), ((0, 0), (1, 2), "v", [1, "a"]), ((49, 0), (2, 1), "v", [1, 2])):
        with pytest.raises(BadRequest):
            db.set_region(*bad)
    assert db.get_region((0, 0), (2, 1), "nope").where("value IS NULL").count() == 2


def test_columns(catalog):
    db = catalog.create("c", axes=1, world_dim=100, chunk_dim=8)
    db.add_column("a", "i64")
    assert db.columns() == [("a", "i64")]
    for bad, error in ((("a", "str"), Conflict), (("b", "date"), BadRequest), (("", "str"), BadRequest), (("x\ty", "str"), BadRequest)):
        with pytest.raises(error):
            db.add_column(*bad)
    db.query("SET (a=1) IN (0) TO (4)")
    db.query("SET (b='x') IN (3) TO (5)")
    assert db.remove_column("a") and not db.remove_column("a")
    assert rows(db.list_cells(), "x0") == [(3,), (4,)]
    db.query("SET (a='text now') IN (3) TO (4)")
    assert db.get((3,), "a") == "text now" and db.get((4,), "a") is None


def test_indexes_never_change_answers(catalog):
    db = catalog.create("i", axes=1, world_dim=100, chunk_dim=8)
    db.query("CREATE INDEX ON never")
    assert db.indexes() == [] and db.lookup_eq("n", 1) is None
    db.query("SET (n=1, s='a') IN (0) TO (5)")
    db.query("SET (n=2) IN (3) TO (8)")
    want = rows(db.query("SELECT n WHERE n = 2.0 AND s = 'a'"), "x0")
    assert db.query("CREATE INDEX ON n") == {} and db.indexes() == ["n"]
    assert rows(db.query("SELECT n WHERE n = 2.0 AND s = 'a'"), "x0") == want
    assert rows(db.lookup_eq("n", 2.0), "x0") == [(3,), (4,), (5,), (6,), (7,)] and db.lookup_eq("n", "a").count() == 0
    db.query("DELETE WHERE x0 = 4")
    assert rows(db.lookup_eq("n", 2), "x0") == [(3,), (5,), (6,), (7,)]
    db.query("REBUILD INDEX ON n")
    db.query("DROP INDEX ON n")
    with pytest.raises(NotFound):
        db.query("DROP INDEX ON n")


def test_tiles_are_bounded_by_default(catalog, tmp_path):
    for shape in (Shape(), Shape(1), Shape(5, 10**6, 16), Shape(2, 10, 32), Shape(1, 1, 1)):
        tile = storage.default_tile(shape)
        assert tile % shape.chunk_dim == 0 and (-(-shape.world_dim // tile)) ** min(shape.axes, 2) <= storage.MAX_TILES
    with pytest.raises(BadRequest):
        catalog.create("bad", chunk_dim=32, tile_dim=48)
    db = catalog.create("t", axes=3, chunk_dim=4, world_dim=1000)
    edge = db.store.load().tile
    assert edge > 4
    db.query(f"SET (n=1) IN (-3,-3,0) TO ({edge + 1},2,2)")
    assert {p.parent.parent.name + "/" + p.parent.name for p in (tmp_path / "root/t/cells").glob("c0=*/c1=*/part*")} == {f"c0={a}/c1={b}" for a in (-1, 0, 1) for b in (-1, 0)}
    assert db.query("DELETE IN (0,0,0) TO (1,1,1)") == {"affected_cells": 1} and db.query("DELETE WHERE x0 < 0") == {"affected_cells": 30}
    want = {(x, y, z) for x in range(edge + 1) for y in range(-3, 2) for z in range(2)} - {(0, 0, 0)}
    assert set(rows(db.list_cells(), "x0", "x1", "x2")) == want
    assert db.get((edge, 1, 1), "n") == 1 and db.query("SELECT count(*) FROM (0,0,0) TO (2,2,2)").first()[0] == 7


@pytest.mark.parametrize("named", [256, 1, 0])
def test_statements_read_the_tiles_that_indexes_name(catalog, monkeypatch, named):
    monkeypatch.setattr(catalog_module, "MAX_NAMED_TILES", named)
    plain, db = (catalog.create(n, axes=2, world_dim=200, chunk_dim=8) for n in ("plain", "indexed"))
    for d in (plain, db):
        d.catalog.clock = lambda: 5
        d.query("SET (n=1, s='a') IN (0,0) TO (40,3)")
        d.query("SET (n=2) IN (20,0) TO (24,2)")
        d.query("UPDATE (s='b') WHERE x0 > 30")
    db.query("CREATE INDEX ON n")
    db.query("CREATE INDEX ON s")
    wheres = ["n = 2", "n = 2.0 AND s = 'a'", "n = 2 OR s = 'b'", "n = 2 OR x1 = 1", "NOT n = 1", "n = 3", "n = 'x'", "n = 2 AND NOT (s = 'a' AND x0 = 21)", "s = 'b' AND x0 < 35 AND n >= 1"]
    same = lambda: all(rows(plain.query(f"SELECT n WHERE {w}"), "x0", "x1") == rows(db.query(f"SELECT n WHERE {w}"), "x0", "x1") for w in wheres)
    assert same()
    for write in ("UPDATE (n=3) WHERE n = 2 AND x1 = 0", "DELETE WHERE s = 'b' AND x0 > 36", "SET (n=2, s='c') IN (60,0) TO (62,1)", "DELETE WHERE n = 3", "SET (s='b') WHERE n = 2 IN (0,0) TO (80,3)"):
        assert plain.query(write) == db.query(write)
    assert same() and plain.content_digest() == db.content_digest()
    for key, value in (("n", 2), ("n", 3), ("s", "b"), ("s", "c")):
        w = f"{key} = {value!r}"
        assert rows(db.lookup_eq(key, value), "x0", "x1") == rows(plain.query(f"SELECT n WHERE {w}"), "x0", "x1")
    report = db.sync_report(plain)
    assert report["indexes_only_here"] == ["n", "s"] and report["indexes_only_there"] == [] and report["differing_chunks"].isEmpty()
    plan = db.query("SELECT n WHERE s = 'b'")._jdf.queryExecution().executedPlan().toString()
    assert ("c0" in plan[plan.index("PartitionFilters") : plan.index("PushedFilters")]) == (named > 1), "matches stand in several tiles"


def test_access_and_names(catalog, spark):
    catalog.create("d", axes=1)
    reader = Catalog(spark, catalog.root.path, read_only=True)
    for write in ("DELETE", "SET (a=1) IN (0) TO (1)", "CREATE INDEX ON a"):
        with pytest.raises(Forbidden):
            reader.open("d").query(write)
    assert reader.open("d").query("SELECT count(*)").first()[0] == 0.0
    with pytest.raises(Forbidden):
        catalog.open("d").select("DELETE")
    with pytest.raises(Conflict):
        catalog.create("d")
    with pytest.raises(NotFound):
        catalog.open("e")
    with pytest.raises(BadRequest):
        catalog.create("a/b")
    assert catalog.health()["status"] == "ok"


def test_digests(catalog):
    a, b = catalog.create("a", axes=2, world_dim=100, chunk_dim=8), catalog.create("b", axes=2, world_dim=100, chunk_dim=8)
    ticks = lambda: 5
    a.catalog.clock = ticks
    a.query("SET (n=1) IN (0,0) TO (20,2)")
    b.query("SET (n=1) IN (10,0) TO (20,2)")
    b.query("SET (n=1) IN (0,0) TO (10,2)")
    assert a.content_digest() == b.content_digest() and a.sync_status(b).count() == 0
    b.query("UPDATE (n=2) IN (17,1) TO (18,2)")
    assert rows(a.sync_status(b), "c0", "c1") == [(2, 0)] and a.content_digest() != b.content_digest()


def test_box_reads_prune_directories(catalog):
    db = catalog.create("p", axes=2, world_dim=1000, chunk_dim=8, tile_dim=8)
    db.query("SET (n=1) IN (0,0) TO (64,2)")
    plan = db.query("SELECT n FROM (9,0) TO (12,1)")._jdf.queryExecution().executedPlan().toString()
    part = plan[plan.index("PartitionFilters") : plan.index("PushedFilters")]
    assert "c0" in part and ">= 1" in part and "<= 1" in part


def test_writes_rewrite_only_the_chunks_they_touch(catalog, tmp_path):
    db = catalog.create("w", axes=1, world_dim=1000, chunk_dim=8)
    db.query("SET (n=1) IN (0) TO (64)")
    files = lambda: {p.parent.name: p.name for p in (tmp_path / "root/w/cells").glob("c0=*/part*.parquet")}
    old = files()
    db.query("SET (n=2) IN (9) TO (11)")
    db.query("UPDATE (n=3) WHERE n = 2")
    db.query("DELETE WHERE x0 = 40")
    db.remove((63,), "n")
    new = files()
    assert {c for c in old if old[c] != new[c]} == {"c0=1", "c0=5", "c0=7"} and db.list_cells().count() == 62
    assert db.get("9", "n") == 3
    with pytest.raises(BadRequest):
        db.get("999", "never")


@pytest.mark.parametrize("named", [256, 0])
def test_a_write_that_dies_is_whole_or_not_there(spark, tmp_path, monkeypatch, named):
    """The driver dies at one file operation of a write after the other (chunk by chunk, or the whole table); the next one to open sees the
    state before or after it."""
    monkeypatch.setattr(catalog_module, "MAX_NAMED_TILES", named)
    late = 0
    for fatal in range(0, 60, 3):
        at = f"file://{tmp_path}/{fatal}"
        db = Catalog(spark, at, clock=lambda: 1.0).create("db", axes=2, world_dim=100, chunk_dim=8)
        db.query("SET (a = 1) IN (6, 0) TO (10, 1)")
        count = [0]

        def dying(f):
            def step(self, *args):
                count[0] += 1
                if count[0] > fatal:
                    raise KeyboardInterrupt
                return f(self, *args)

            return step

        with monkeypatch.context() as m:
            for name in ("delete", "move"):
                m.setattr(storage.Files, name, dying(getattr(storage.Files, name)))
            try:
                db.query("UPDATE (a = 2) WHERE a < 9")
                done = True
            except KeyboardInterrupt:
                done = False
        left = [r.a.v for r in Catalog(spark, at).open("db").list_cells().collect()]
        assert left == [2] * 4 if done else left in ([1] * 4, [2] * 4)
        late += left == [2] * 4 and not done
        if done:
            break
    assert done and late, "some deaths come after the journal is written"
