"""The catalogue of queries over the driver's tables as grids, each with DuckDB SQL that states the same answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .grid import Grid, flat
from .operators import digest, merge, region, statements, vector
from .plans.parser import parse
from .shape import Region, Shape
from .sources import adapters as worlds

NOW = 1_700_000_000_000
CATALOGUE: dict[str, tuple[Callable, str]] = {}


def clock() -> float:
    return NOW / 1000


def add(name: str, sql: str):
    def keep(f):
        CATALOGUE[name] = (f, sql)
        return f

    return keep


def run(grid: Grid, text: str) -> DataFrame:
    """A SELECT; structs of keys as plain columns with their metadata."""
    out = statements.select(grid, parse(text, clock))
    keys = [c for c in out.columns if c in grid.registry.live and c not in grid.shape.coords]
    return flat(out, grid.shape.coords, keys) if grid.shape.coords[0] in out.columns else out


def change(grid: Grid, text: str) -> statements.Change:
    s = parse(text, clock)
    if hasattr(s, "assignments"):
        return (statements.set_cells if type(s).__name__ == "SetCells" else statements.update)(grid, s, NOW)
    return statements.delete(grid, s)


def values(grid: Grid, meta: bool = True) -> DataFrame:
    return flat(grid.cells, grid.shape.coords, grid.keys, meta)


def simple(name: str, world: Callable, text: str, sql: str) -> None:
    CATALOGUE[name] = (lambda spark, sf: run(world(spark, sf), text), sql)


def keyed(key: str, expr: str, at: str = "0", version: str = "0") -> str:
    """SQL of a key's value and metadata, all null where the key is unset."""
    m = lambda what, e: f"CASE WHEN ({expr}) IS NOT NULL THEN CAST({e} AS BIGINT) END AS {key}_{what}"
    return f"{expr} AS {key}, {m('created', at)}, {m('updated', at)}, {m('version', version)}"


ODATE, SDATE = "epoch_ms(CAST(o_orderdate AS TIMESTAMP))", "epoch_ms(CAST(l_shipdate AS TIMESTAMP))"
ORDER_KEYS = {"custkey": "o_custkey", "orderdate": ODATE, "priority": "o_orderpriority", "status": "o_orderstatus", "totalprice": "o_totalprice"}
ORDERS = ", ".join(["CAST(o_orderkey AS INT) AS x0", *(keyed(k, e, ODATE) for k, e in ORDER_KEYS.items())])
DOC_KEYS = {"lang": "lang", "n_chars": "n_chars", "quality": "CAST(quality AS BIGINT)", "source": "source", "toxic": "toxic = 1"}
DOCS_FROM = "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


def docs_sql(*keys: str) -> str:
    return ", ".join(["CAST(d.doc_id AS INT) AS x0", *(keyed(k, DOC_KEYS[k]) for k in keys)])


PART = ", ".join(["CAST(p_partkey AS INT) AS x0", *(keyed(k, e) for k, e in (("size", "CAST(p_size AS BIGINT)"), ("retailprice", "p_retailprice")))])
LINE_X = "CAST(l_orderkey AS INT) AS x0, CAST(l_partkey AS INT) AS x1, CAST(l_suppkey AS INT) AS x2, CAST(l_linenumber AS INT) AS x3"
#: The log of events folded to one row a (user, type).
FOLD = """fold AS (SELECT CAST(user_id AS INT) AS x0, event_type AS key, arg_max(value, (ts, event_id)) AS v_f64,
    CAST(floor(epoch_us(CAST(min(ts) AS TIMESTAMP)) / 1000) AS BIGINT) AS created, CAST(floor(epoch_us(CAST(max(ts) AS TIMESTAMP)) / 1000) AS BIGINT) AS updated, count(*) - 1 AS version
    FROM events GROUP BY user_id, event_type)"""

# scans and reads
simple("select_star_box", worlds.orders, "SELECT * FROM (100) TO (2000)", f"SELECT {ORDERS} FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 2000")
simple("select_star", worlds.part, "SELECT size, retailprice", f"SELECT {PART} FROM part")
simple("select_named_sparse", worlds.docs, "SELECT quality, toxic", f"SELECT {docs_sql('quality', 'toxic')} {DOCS_FROM}")
simple("select_unknown_key", worlds.docs, "SELECT nothing, lang, lang", f"SELECT {docs_sql('lang')} {DOCS_FROM}")
simple("select_inverted_box", worlds.orders, "SELECT status FROM (100) TO (50)", f"SELECT CAST(o_orderkey AS INT) AS x0, {keyed('status', 'o_orderstatus', ODATE)} FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 50")
simple("point_get", worlds.orders, "SELECT totalprice FROM (7) TO (8)", f"SELECT CAST(o_orderkey AS INT) AS x0, {keyed('totalprice', 'o_totalprice', ODATE)} FROM orders WHERE o_orderkey = 7")


@add("cell_entry", f"""SELECT CAST(o_orderkey AS INT) AS x0, unnest(['custkey', 'orderdate', 'priority', 'status', 'totalprice']) AS key, unnest([NULL, NULL, o_orderpriority, o_orderstatus, NULL]) AS v_str,
    unnest([NULL, NULL, NULL, NULL, o_totalprice]) AS v_f64, unnest([o_custkey, {ODATE}, NULL, NULL, NULL]) AS v_i64, {ODATE} AS created, {ODATE} AS updated, CAST(0 AS BIGINT) AS version FROM orders WHERE o_orderkey = 7""")  # fmt: skip
def _cell_entry(spark: SparkSession, sf: str) -> DataFrame:
    grid = worlds.orders(spark, sf)
    return Grid(grid.shape, grid.registry, grid.within(Region((7,), (1,)).box)).entries().drop("v_bool")


@add("list_cells", f"SELECT {docs_sql('lang', 'n_chars', 'quality', 'source', 'toxic')} {DOCS_FROM}")
def _list_cells(spark, sf):
    return values(worlds.docs(spark, sf))


# predicates
simple("where_eq_str", worlds.docs, "SELECT lang, quality WHERE lang = 'en'", f"SELECT {docs_sql('lang', 'quality')} {DOCS_FROM} WHERE lang = 'en'")
simple("where_str_order", worlds.orders, "SELECT priority WHERE priority >= '3' AND priority < '5'", f"SELECT CAST(o_orderkey AS INT) AS x0, {keyed('priority', 'o_orderpriority', ODATE)} FROM orders WHERE o_orderpriority >= '3' AND o_orderpriority < '5'")
simple("where_ne_missing", worlds.docs, "SELECT quality WHERE quality != 1", f"SELECT {docs_sql('quality')} {DOCS_FROM} WHERE quality <> 1")
simple("where_not_eq_missing", worlds.docs, "SELECT quality WHERE NOT quality = 1", f"SELECT {docs_sql('quality')} {DOCS_FROM} WHERE NOT coalesce(quality = 1, false)")
simple("where_cross_numeric", worlds.part, "SELECT size, retailprice WHERE size = 5.0 OR retailprice < 1000", f"SELECT {PART} FROM part WHERE p_size::DOUBLE = 5.0 OR p_retailprice < 1000.0")
simple("where_bool_order", worlds.docs, "SELECT toxic WHERE toxic < TRUE", f"SELECT {docs_sql('toxic')} {DOCS_FROM} WHERE toxic = 0")
simple("where_type_mismatch", worlds.orders, "SELECT status WHERE status > 5 OR priority = true OR custkey = 'a'", f"SELECT CAST(o_orderkey AS INT) AS x0, {keyed('status', 'o_orderstatus', ODATE)} FROM orders WHERE typeof(o_orderstatus) IN ('BIGINT', 'DOUBLE') OR typeof(o_orderpriority) = 'BOOLEAN' OR typeof(o_custkey) = 'VARCHAR'")
simple("where_not_mismatch", worlds.orders, "SELECT status WHERE NOT status > 5", f"SELECT CAST(o_orderkey AS INT) AS x0, {keyed('status', 'o_orderstatus', ODATE)} FROM orders")
simple("where_axis", worlds.lineitem, "SELECT quantity WHERE x0 < 100 AND x3 >= 2.5", f"SELECT {LINE_X}, {keyed('quantity', 'l_quantity', SDATE)} FROM lineitem WHERE l_orderkey < 100 AND l_linenumber >= 2.5")
simple("where_axis_out_of_range", worlds.lineitem, "SELECT quantity WHERE x7 = 1 OR x0 = 'a'", f"SELECT {LINE_X}, {keyed('quantity', 'l_quantity', SDATE)} FROM lineitem WHERE false")
simple("where_exists", worlds.docs, "SELECT toxic WHERE EXISTS(toxic)", f"SELECT {docs_sql('toxic')} {DOCS_FROM} WHERE toxic IS NOT NULL")
simple("where_not_exists", worlds.docs, "SELECT lang WHERE NOT EXISTS(toxic) AND NOT exists(never)", f"SELECT {docs_sql('lang')} {DOCS_FROM} WHERE toxic IS NULL")
simple(
    "where_and_or_not_mix", worlds.docs, "SELECT lang, quality WHERE NOT (lang = 'en' AND quality >= 1 OR n_chars > 3000) AND (NOT toxic = true OR lang != 'de')",
    f"""SELECT {docs_sql('lang', 'quality')} {DOCS_FROM} WHERE NOT (coalesce(lang = 'en', false) AND coalesce(quality >= 1, false) OR coalesce(n_chars > 3000, false))
    AND (NOT coalesce(toxic = 1, false) OR coalesce(lang <> 'de', false))""",
)
simple("where_now", worlds.orders, "SELECT status WHERE orderdate < now() AND NOT orderdate < 820000000000", f"SELECT CAST(o_orderkey AS INT) AS x0, {keyed('status', 'o_orderstatus', ODATE)} FROM orders WHERE {ODATE} < {NOW} AND {ODATE} >= 820000000000")

EVENT_VALUES = "x0, max(CASE WHEN key = 'click' THEN v_f64 END) AS click, max(CASE WHEN key = 'click' THEN created END) AS click_created, max(CASE WHEN key = 'click' THEN updated END) AS click_updated, max(CASE WHEN key = 'click' THEN version END) AS click_version"
simple("where_meta_any", worlds.events, "SELECT click WHERE version >= 18 AND version <= 10", f"WITH {FOLD} SELECT {EVENT_VALUES} FROM fold GROUP BY x0 HAVING bool_or(version >= 18) AND bool_or(version <= 10)")
simple("where_not_meta", worlds.events, "SELECT click WHERE NOT version < 8", f"WITH {FOLD} SELECT {EVENT_VALUES} FROM fold GROUP BY x0 HAVING NOT bool_or(version < 8)")
simple("where_meta_time", worlds.events, "SELECT click WHERE created > 1704200000000 OR updated <= 1704100000000.5", f"WITH {FOLD} SELECT {EVENT_VALUES} FROM fold GROUP BY x0 HAVING bool_or(created > 1704200000000) OR bool_or(updated <= 1704100000000.5)")


# aggregates
def aggregated(name: str, world: Callable, text: str, sql: str) -> None:
    """Sums are rounded on both sides, since engines add in different orders."""

    def f(spark: SparkSession, sf: str) -> DataFrame:
        out = run(world(spark, sf), text)
        return out.select(*[F.round(F.col(f"`{c}`"), 2).alias(c) for c in out.columns])

    CATALOGUE[name] = (f, sql)


DBL = "CAST(count(*) AS DOUBLE)"
aggregated("agg_box_where", worlds.orders, "SELECT count(*), sum(totalprice), mean(totalprice) FROM (0) TO (5000) WHERE status = 'F'", f'SELECT {DBL} AS "count(*)", round(sum(o_totalprice), 2) AS "sum(totalprice)", round(avg(o_totalprice), 2) AS "mean(totalprice)" FROM orders WHERE o_orderkey < 5000 AND o_orderstatus = \'F\'')
aggregated("agg_count", worlds.lineitem, "SELECT COUNT(*)", f'SELECT {DBL} AS "count(*)" FROM lineitem')
aggregated("agg_sum_mean_min_max", worlds.lineitem, "SELECT sum(quantity), mean(extendedprice), max(discount), min(shipdate)", f'SELECT round(sum(l_quantity), 2) AS "sum(quantity)", round(avg(l_extendedprice), 2) AS "mean(extendedprice)", max(l_discount) AS "max(discount)", CAST(min({SDATE}) AS DOUBLE) AS "min(shipdate)" FROM lineitem')
aggregated("agg_sparse", worlds.docs, "SELECT count(*), sum(quality), mean(quality), max(toxic), sum(lang)", f'SELECT {DBL} AS "count(*)", CAST(sum(quality) AS DOUBLE) AS "sum(quality)", round(avg(quality), 2) AS "mean(quality)", CAST(NULL AS DOUBLE) AS "max(toxic)", CAST(0 AS DOUBLE) AS "sum(lang)" {DOCS_FROM}')
aggregated("agg_empty", worlds.orders, "SELECT count(*), sum(totalprice), mean(totalprice), min(custkey), sum(x0) WHERE status = 'nope'", 'SELECT CAST(0 AS DOUBLE) AS "count(*)", CAST(0 AS DOUBLE) AS "sum(totalprice)", CAST(NULL AS DOUBLE) AS "mean(totalprice)", CAST(NULL AS DOUBLE) AS "min(custkey)", CAST(0 AS DOUBLE) AS "sum(x0)"')
aggregated("agg_meta", worlds.events, "SELECT max(updated), min(created), max(version), sum(version), mean(version)", f'WITH {FOLD} SELECT CAST(max(updated) AS DOUBLE) AS "max(updated)", CAST(min(created) AS DOUBLE) AS "min(created)", CAST(max(version) AS DOUBLE) AS "max(version)", CAST(sum(version) AS DOUBLE) AS "sum(version)", round(avg(version), 2) AS "mean(version)" FROM fold')


@add("agg_result_frame", "SELECT 'count(*)' AS label, CAST(count(*) AS DOUBLE) AS value FROM lineitem UNION ALL SELECT 'max(tax)', max(l_tax) FROM lineitem UNION ALL SELECT 'min(quantity)', min(l_quantity) FROM lineitem")
def _agg_rows(spark, sf):
    from .operators.aggregate import as_rows

    return as_rows(run(worlds.lineitem(spark, sf), "SELECT count(*), max(tax), min(quantity)"))


# regions
@add("coordinates", "SELECT z.r * 12 + y.r * 3 + x.r AS pos, CAST(x.r - 2 AS INT) AS x0, CAST(y.r - 1 AS INT) AS x1, CAST(z.r + 5 AS INT) AS x2 FROM range(3) x(r), range(4) y(r), range(5) z(r)")
def _coordinates(spark, sf):
    return region.coordinates(spark, Region((-2, -1, 5), (3, 4, 5)))


@add("region_read_dense", "SELECT r AS pos, CAST(r - 50 AS INT) AS x0, o_totalprice AS value FROM range(300) t(r) LEFT JOIN orders ON o_orderkey = r - 50")
def _dense(spark, sf):
    return region.read_region(worlds.orders(spark, sf), Region((-50,), (300,)), "totalprice")


@add("set_region_write", f"""SELECT coalesce(x0, CAST(r - 10 AS INT)) AS x0, coalesce(r * 10, custkey) AS custkey, coalesce(custkey_created, {NOW}) AS custkey_created,
    CASE WHEN r IS NOT NULL THEN {NOW} ELSE custkey_updated END AS custkey_updated, CASE WHEN r IS NULL THEN custkey_version WHEN x0 IS NULL THEN 0 ELSE 1 END AS custkey_version, status
    FROM (SELECT {ORDERS} FROM orders) o FULL JOIN range(40) t(r) ON o.x0 = r - 10""")  # fmt: skip
def _set_region(spark, sf):
    grid = region.write_region(worlds.orders(spark, sf), Region((-10,), (40,)), "custkey", [i * 10 for i in range(40)], NOW)
    return values(grid).select("x0", "custkey", "custkey_created", "custkey_updated", "custkey_version", "status")


@add("remove_region", "SELECT CAST(d.doc_id AS INT) AS x0, lang, CASE WHEN NOT (d.doc_id >= 10 AND d.doc_id < 90) THEN quality END::BIGINT AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def _remove_region(spark, sf):
    grid, _ = region.remove_region(worlds.docs(spark, sf), Region((10,), (80,)), "quality")
    return values(grid, meta=False).select("x0", "lang", "quality")


@add("remove_region_cells", "SELECT CAST(doc_id AS INT) AS x0 FROM labels WHERE doc_id >= 10 AND doc_id < 90 AND quality IS NOT NULL")
def _remove_region_cells(spark, sf):
    return region.remove_region(worlds.docs(spark, sf), Region((10,), (80,)), "quality")[1]


# writes
def written(name: str, world: Callable, text: str, sql: str, columns: list[str]) -> None:
    CATALOGUE[name] = (lambda spark, sf: values(change(world(spark, sf), text).grid).select(*columns), sql)


def affected(name: str, world: Callable, text: str, sql: str) -> None:
    CATALOGUE[name] = (lambda spark, sf: change(world(spark, sf), text).affected, sql)


BOX = "(SELECT CAST(a.r - 5 AS INT) AS b0, CAST(b.r AS INT) AS b1 FROM range(40) a(r), range(6) b(r))"
CONV = "(SELECT CAST(conv_id AS INT) AS x0, CAST(turn AS INT) AS x1, role FROM conversations)"
TURNS = f"{CONV} c FULL JOIN {BOX} b ON c.x0 = b.b0 AND c.x1 = b.b1"
X01 = "coalesce(x0, b0) AS x0, coalesce(x1, b1) AS x1"
ROLE = ["x0", "x1", "role", "role_created", "role_updated", "role_version"]


def role_sql(hit: str, stays: str = "true") -> str:
    return f"""SELECT {X01}, CASE WHEN {hit} THEN 'system' ELSE role END AS role, CAST(CASE WHEN role IS NOT NULL THEN 0 ELSE {NOW} END AS BIGINT) AS role_created,
        CAST(CASE WHEN {hit} THEN {NOW} ELSE 0 END AS BIGINT) AS role_updated, CAST(CASE WHEN {hit} AND role IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS role_version FROM {TURNS} WHERE x0 IS NOT NULL OR {hit}"""


IN = "b0 IS NOT NULL"
written("set_box_upsert", worlds.conversations, "SET (role = 'system') IN (-5, 0) TO (35, 6)", role_sql(IN), ROLE)
written("set_where_axis", worlds.conversations, "SET (role = 'system') WHERE x1 > 2 AND x0 <= 3 IN (-5, 0) TO (35, 6)", role_sql(f"({IN} AND b1 > 2 AND b0 <= 3)"), ROLE)
written("set_where_key", worlds.conversations, "SET (role = 'system') WHERE role = 'user' IN (-5, 0) TO (35, 6)", role_sql(f"({IN} AND coalesce(role = 'user', false))"), ROLE)
written("set_where_not_key", worlds.conversations, "SET (role = 'system') WHERE NOT role = 'user' IN (-5, 0) TO (35, 6)", role_sql(f"({IN} AND NOT coalesce(role = 'user', false))"), ROLE)
affected("set_affected", worlds.conversations, "SET (role = 'system') WHERE NOT role = 'user' IN (-5, 0) TO (35, 6)", f"SELECT count(*) AS affected_cells FROM {BOX} b LEFT JOIN {CONV} c ON c.x0 = b.b0 AND c.x1 = b.b1 WHERE NOT coalesce(role = 'user', false)")
written("set_twice", worlds.conversations, "SET (seen = 1, seen = 2) IN (0, 0) TO (2, 2)", "SELECT coalesce(x0, b0) AS x0, coalesce(x1, b1) AS x1, role, CASE WHEN b0 IS NOT NULL THEN 2 END::BIGINT AS seen, CASE WHEN b0 IS NOT NULL THEN 1 END::BIGINT AS seen_version"
        f" FROM {CONV} c FULL JOIN (SELECT CAST(a.r AS INT) AS b0, CAST(b.r AS INT) AS b1 FROM range(2) a(r), range(2) b(r)) b ON c.x0 = b.b0 AND c.x1 = b.b1", ["x0", "x1", "role", "seen", "seen_version"])  # fmt: skip
UPD = "o_orderstatus = 'F' AND o_totalprice > 200000 AND o_orderkey < 3000"
written("update_where", worlds.orders, "UPDATE (totalprice = 1.5, priority = 'none') WHERE status = 'F' AND totalprice > 200000 IN (0) TO (3000)",
        f"SELECT CAST(o_orderkey AS INT) AS x0, CASE WHEN {UPD} THEN 1.5 ELSE o_totalprice END AS totalprice, {ODATE} AS totalprice_created, CASE WHEN {UPD} THEN {NOW} ELSE {ODATE} END AS totalprice_updated, CAST({UPD} AS BIGINT) AS totalprice_version, CASE WHEN {UPD} THEN 'none' ELSE o_orderpriority END AS priority FROM orders",
        ["x0", "totalprice", "totalprice_created", "totalprice_updated", "totalprice_version", "priority"])
written("update_adds_key", worlds.orders, "UPDATE (rush = true, at = now()) WHERE priority = '1-URGENT'",
        f"SELECT CAST(o_orderkey AS INT) AS x0, CASE WHEN o_orderpriority = '1-URGENT' THEN true END AS rush, CASE WHEN o_orderpriority = '1-URGENT' THEN {NOW} END AS at, CASE WHEN o_orderpriority = '1-URGENT' THEN 0 END::BIGINT AS at_version FROM orders", ["x0", "rush", "at", "at_version"])
affected("update_affected", worlds.orders, "UPDATE (totalprice = 1.5) WHERE status = 'F' AND totalprice > 200000 IN (0) TO (3000)", f"SELECT count(*) AS affected_cells FROM orders WHERE {UPD}")
written("delete_where", worlds.docs, "DELETE WHERE lang = 'en' AND quality = 0", "SELECT CAST(d.doc_id AS INT) AS x0, lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE NOT coalesce(lang = 'en' AND quality = 0, false)", ["x0", "lang"])
written("delete_where_missing", worlds.docs, "DELETE WHERE NOT quality = 1 IN (0) TO (500)", "SELECT CAST(d.doc_id AS INT) AS x0, lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE NOT (NOT coalesce(quality = 1, false) AND d.doc_id < 500)", ["x0", "lang"])
affected("delete_affected", worlds.docs, "DELETE WHERE NOT quality = 1 IN (0) TO (500)", "SELECT count(*) AS affected_cells FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE NOT coalesce(quality = 1, false) AND d.doc_id < 500")


@add("add_remove_column", "SELECT CAST(d.doc_id AS INT) AS x0, CAST(quality AS BIGINT) AS quality, CAST(NULL AS BOOLEAN) AS checked FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NOT NULL")
def _columns(spark, sf):
    grid = worlds.docs(spark, sf)
    for key in ("lang", "source", "n_chars", "toxic"):
        grid = region.drop_column(grid, key)
    return values(region.add_column(grid, "checked", "bool"), meta=False)


# logs and replication
ENTRY = ["x0", "key", "v_f64", "created", "updated", "version"]


@add("write_log_fold", f"WITH {FOLD} SELECT * FROM fold")
def _fold(spark, sf):
    return merge.fold_local(worlds.event_writes(spark, sf), ["x0"]).select(*ENTRY)


@add("write_log_with_removes", """WITH w AS (SELECT CAST(user_id AS INT) AS x0, event_type AS key, value, event_id, ts, event_id % 7 = 3 AS removed FROM events),
    c AS (SELECT *, max(CASE WHEN removed THEN (ts, event_id) END) OVER (PARTITION BY x0, key) AS cut FROM w)
    SELECT x0, key, arg_max(value, (ts, event_id)) AS v_f64, CAST(floor(epoch_us(CAST(min(ts) AS TIMESTAMP)) / 1000) AS BIGINT) AS created, CAST(floor(epoch_us(CAST(max(ts) AS TIMESTAMP)) / 1000) AS BIGINT) AS updated, count(*) - 1 AS version
    FROM c WHERE cut IS NULL OR (ts, event_id) > cut GROUP BY x0, key""")  # fmt: skip
def _fold_removes(spark, sf):
    return merge.fold_local(worlds.event_writes(spark, sf).withColumn("removed", F.col("event_id") % 7 == 3), ["x0"]).select(*ENTRY)


CHANGES = """changes AS (SELECT CAST(user_id AS INT) AS x0, event_type AS key, value AS v_f64, CAST(floor(epoch_us(CAST(ts AS TIMESTAMP)) / 1000) AS BIGINT) AS updated, event_id % 2 + 1 AS origin, event_id + 1 AS seq, event_id FROM events)"""
BEST = "(updated, origin, seq)"


@add("lww_merge", f"WITH {CHANGES} SELECT x0, key, arg_max(v_f64, {BEST}) AS v_f64, max(updated) AS updated, arg_max(origin, {BEST}) AS origin, arg_max(seq, {BEST}) AS seq FROM changes GROUP BY x0, key")
def _lww(spark, sf):
    return merge.fold_lww(worlds.event_changes(spark, sf), ["x0"]).select("x0", "key", "v_f64", "updated", "origin", "seq")


@add("lww_with_tombstones", f"WITH {CHANGES} SELECT x0, key, arg_max(v_f64, {BEST}) AS v_f64, max(updated) AS updated FROM changes GROUP BY x0, key HAVING arg_max(event_id % 5, {BEST}) <> 0")
def _lww_tombs(spark, sf):
    rows = worlds.event_changes(spark, sf).withColumn("removed", F.col("seq") % 5 == 1)
    return merge.fold_lww(rows, ["x0"]).where("NOT removed").select("x0", "key", "v_f64", "updated")


def _halves(spark, sf):
    rows = worlds.event_changes(spark, sf)
    return merge.fold_lww(rows.where("seq % 3 <> 0"), ["x0"]), rows.where("seq % 3 = 0").withColumn("nth", F.col("seq"))


LATE = f"""WITH {CHANGES}, s AS (SELECT x0, key, arg_max(v_f64, {BEST}) AS v_f64, max({BEST}) AS best FROM changes WHERE seq % 3 <> 0 GROUP BY x0, key),
    b AS (SELECT *, max({BEST}) OVER (PARTITION BY x0, key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM changes WHERE seq % 3 = 0)"""


@add("late_write_loses", f"WITH {CHANGES} SELECT x0, key, arg_max(v_f64, {BEST}) AS v_f64, max(updated) AS updated FROM changes GROUP BY x0, key")
def _late(spark, sf):
    state, batch = _halves(spark, sf)
    shape, registry = Shape(1, worlds.WIDE.world_dim, 32), worlds.event_registry(worlds.event_writes(spark, sf))
    return merge.apply_changes(state, batch, shape, registry)[0].select("x0", "key", "v_f64", "updated")


@add("apply_results", f"{LATE} SELECT b.seq AS nth, (best IS NULL OR {BEST} > best) AND (was IS NULL OR {BEST} > was) AS applied, CAST(NULL AS VARCHAR) AS error FROM b LEFT JOIN s ON b.x0 = s.x0 AND b.key = s.key")
def _results(spark, sf):
    state, batch = _halves(spark, sf)
    shape, registry = Shape(1, worlds.WIDE.world_dim, 32), worlds.event_registry(worlds.event_writes(spark, sf))
    return merge.apply_changes(state, batch, shape, registry)[1]


@add("tombstone_purge", f"WITH {CHANGES}, m AS (SELECT median(updated) AS cut FROM changes) SELECT x0, key, max(updated) AS updated, arg_max(event_id % 5, {BEST}) = 0 AS removed FROM changes GROUP BY x0, key HAVING arg_max(event_id % 5, {BEST}) <> 0 OR max(updated) >= 1705000000000")
def _purge(spark, sf):
    rows = worlds.event_changes(spark, sf).withColumn("removed", F.col("seq") % 5 == 1)
    return merge.purge(merge.fold_lww(rows, ["x0"]), 1705000000000).select("x0", "key", "updated", "removed")


VEC = "(SELECT event_id % 2 + 1 AS origin, max(event_id + 1) AS seq FROM events WHERE {} GROUP BY 1)"


def _vec(spark, sf, where="true"):
    return vector.of_log(worlds.event_changes(spark, sf).where(where))


EARLY, OTHER = "seq <= 500", "seq <= 300 OR origin = 1"
EARLY_SQL, OTHER_SQL = VEC.format("event_id + 1 <= 500"), VEC.format("event_id + 1 <= 300 OR event_id % 2 + 1 = 1")
CATALOGUE["vector_of_log"] = (_vec, VEC.format("true")[1:-1])
CATALOGUE["vector_merge"] = (lambda s, d: vector.merge(_vec(s, d, EARLY), _vec(s, d, OTHER)), f"SELECT origin, max(seq) AS seq FROM (SELECT * FROM {EARLY_SQL} UNION ALL SELECT * FROM {OTHER_SQL}) GROUP BY origin")
CATALOGUE["vector_meet"] = (lambda s, d: vector.meet(_vec(s, d, EARLY), _vec(s, d, OTHER)), f"SELECT a.origin, least(a.seq, b.seq) AS seq FROM {EARLY_SQL} a JOIN {OTHER_SQL} b ON a.origin = b.origin")
CATALOGUE["vector_compare"] = (
    lambda s, d: vector.compare(_vec(s, d, EARLY), _vec(s, d, OTHER)),
    f"""WITH v AS (SELECT CAST(sum(greatest(coalesce(b.seq, 0) - coalesce(a.seq, 0), 0)) AS BIGINT) AS behind_by, CAST(sum(greatest(coalesce(a.seq, 0) - coalesce(b.seq, 0), 0)) AS BIGINT) AS ahead_by FROM {EARLY_SQL} a FULL JOIN {OTHER_SQL} b ON a.origin = b.origin)
    SELECT CASE WHEN behind_by = 0 AND ahead_by = 0 THEN 'in_sync' WHEN ahead_by = 0 THEN 'behind' WHEN behind_by = 0 THEN 'ahead' ELSE 'diverged' END AS state, behind_by, ahead_by FROM v""",
)


def covers_sql(a: str, b: str) -> str:
    return f"NOT EXISTS (SELECT 1 FROM {b} b LEFT JOIN {a} a ON a.origin = b.origin WHERE b.seq > coalesce(a.seq, 0)) AS covers"


@add("vector_covers", f"SELECT 'all, early' AS pair, {covers_sql(VEC.format('true'), EARLY_SQL)} UNION ALL SELECT 'early, all', {covers_sql(EARLY_SQL, VEC.format('true'))} UNION ALL SELECT 'early, other', {covers_sql(EARLY_SQL, OTHER_SQL)}")
def _covers(spark, sf):
    whole, early, other = _vec(spark, sf), _vec(spark, sf, EARLY), _vec(spark, sf, OTHER)
    told = [vector.covers(a, b).select(F.lit(pair).alias("pair"), "covers") for pair, a, b in (("all, early", whole, early), ("early, all", early, whole), ("early, other", early, other))]
    return told[0].union(told[1]).union(told[2])


CATALOGUE["changes_since"] = (
    lambda s, d: vector.changes_since(worlds.event_changes(s, d), _vec(s, d, EARLY).where("origin = 2")).select("x0", "key", "origin", "seq"),
    f"WITH {CHANGES} SELECT x0, key, origin, seq FROM changes WHERE origin = 1 OR seq > (SELECT max(seq) FROM changes WHERE seq <= 500 AND origin = 2)",
)


# chunks, indexes, digests
@add("chunk_stats", "SELECT count(DISTINCT (floor(l_orderkey / 32), floor(l_partkey / 32), floor(l_suppkey / 32), floor(l_linenumber / 32))) AS total_chunks, count(*) AS total_cells FROM lineitem")
def _stats(spark, sf):
    return digest.chunk_stats(worlds.lineitem(spark, sf))


simple("where_equal", worlds.orders, "SELECT status WHERE custkey = 42.0", f"SELECT CAST(o_orderkey AS INT) AS x0, {keyed('status', 'o_orderstatus', ODATE)} FROM orders WHERE o_custkey = 42")


@add("where_equal_intersect", "SELECT CAST(o_orderkey AS INT) AS x0 FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def _intersect(spark, sf):
    grid = worlds.orders(spark, sf)
    one, two = (run(grid, f"SELECT nothing WHERE {w}").select("x0") for w in ("status = 'F'", "priority = '1-URGENT'"))
    return one.join(two, "x0", "left_semi")


@add("digest_drilldown", "SELECT DISTINCT CAST(floor(o_orderkey / 32) AS INT) AS c0 FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey < 2000")
def _drilldown(spark, sf):
    grid = worlds.orders(spark, sf)
    other = change(grid, "UPDATE (totalprice = 0.5) WHERE priority = '1-URGENT' IN (0) TO (2000)").grid
    return digest.differing_chunks(digest.chunk_digests(grid), digest.chunk_digests(other))


@add("digest_order_free", """WITH g AS (SELECT p_partkey, p_size FROM part), changed AS (SELECT p_partkey, CASE WHEN p_partkey = 7 THEN p_size + 1 ELSE p_size END AS p_size FROM part)
    SELECT 'reordered' AS what, NOT EXISTS (SELECT * FROM g EXCEPT SELECT * FROM g ORDER BY p_partkey DESC) AS equal UNION ALL SELECT 'one value changed', NOT EXISTS (SELECT * FROM g EXCEPT SELECT * FROM changed)""")
def _digest(spark, sf):
    grid = worlds.part(spark, sf)
    other = grid.cells.withColumn("size", F.when(F.col("x0") == 7, F.col("size").withField("v", F.col("size.v") + 1)).otherwise(F.col("size")))
    told = []
    for what, cells in (("reordered", grid.cells.orderBy(F.desc("x0"))), ("one value changed", other)):
        both = digest.content_digest(grid).union(digest.content_digest(Grid(grid.shape, grid.registry, cells)))
        told.append(both.agg((F.count_distinct("digest") == 1).alias("equal")).select(F.lit(what).alias("what"), "equal"))
    return told[0].union(told[1])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in CATALOGUE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CATALOGUE.items()}
