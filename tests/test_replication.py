"""Folds, last-write-wins, version vectors and the stream."""

import random

import pytest
from pyspark.sql import functions as F

from cellgrid.operators import merge, vector
from cellgrid.registry import Registry
from cellgrid.shape import Shape
from cellgrid.streaming.sequence import Sequencer
from cellgrid.streaming.replica import Replica, ReplicaSet, change_schema

SHAPE, REGISTRY = Shape(1, 100, 8), Registry.of({"a": "i64", "b": "str"})


def change(x, key, value, at, origin, seq, removed=False):
    s, i = (value, None) if isinstance(value, str) else (None, value)
    return (x, key, s, None, i, None, at, at, 0, origin, seq, removed)


def random_changes(seed, n=200):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        key, gone = rng.choice("ab"), rng.random() < 0.25
        value = None if gone else k if key == "a" else f"v{k}"
        out.append(change(rng.randrange(6), key, value, rng.randrange(40), rng.choice([1, 2, -5]), k + 1, gone))
    return out


def unsigned(v):
    return v % 2**64


def sequential(changes, keep=True):
    """Strictly later writes win, one after the other."""
    state, said = {}, []
    for c in changes:
        at, stamp = (c[0], c[1]), (c[7], unsigned(c[9]), unsigned(c[10]))
        old = state.get(at)
        known = c[1] in REGISTRY.live or old
        ok = bool((old is None or stamp > old[0]) and (not c[11] or (known if keep else old and not old[1][11])))
        said.append(ok)
        if ok:
            state[at] = (stamp, c)
            if c[11] and not keep:
                del state[at]
    return {at: c for at, (_, c) in state.items()}, said


def frame(spark, changes):
    return spark.createDataFrame(changes, change_schema(SHAPE))


def as_dict(df):
    return {(r.x0, r.key): tuple(r[c] for c in change_schema(SHAPE).names) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_gives_the_same_state(spark, seed):
    changes = random_changes(seed)
    want = sequential(changes)[0]
    for k in range(3):
        random.Random(k).shuffle(changes)
        assert as_dict(merge.fold_lww(frame(spark, changes), ["x0"])) == want == sequential(changes)[0]


def test_batches_say_what_was_applied(spark):
    changes = random_changes(3)
    old, batch = changes[:80], changes[80:]
    state, _ = sequential(old)
    numbered = frame(spark, batch).withColumn("nth", F.col("seq"))
    bad = frame(spark, [change(500, "a", 1, 99, 1, 900), change(1, "a", "text", 99, 1, 901), change(1, "b", None, 99, 1, 902)]).withColumn("nth", F.col("seq"))
    new, results = merge.apply_changes(merge.fold_lww(frame(spark, old), ["x0"]), numbered.union(bad), SHAPE, REGISTRY)
    end, said = sequential(old + batch)
    assert as_dict(new) == end
    got = {r.nth: (r.applied, r.error) for r in results.collect()}
    assert [got[c[10]] for c in batch] == [(ok, None) for ok in said[80:]]
    assert [got[n] for n in (900, 901, 902)] == [(False, "coordinate out of range"), (False, "wrong type"), (False, "no value")]


def model(old, batch, keep):
    """The batch one change after the other: (values and tombstones by key, answers). old: changes that were applied before."""
    kinds = {k: REGISTRY.kind(k) for k in REGISTRY.keys()}
    state, said = {}, []
    for n, c in enumerate(old + batch):
        kind = "str" if c[2] is not None else "f64" if c[3] is not None else "i64" if c[4] is not None else None
        stamp, at = (c[7], unsigned(c[9]), unsigned(c[10])), (c[0], c[1])
        if not -50 <= c[0] < 50:
            answer = (False, "coordinate out of range")
        elif c[11] and c[1] not in kinds:
            answer = (False, None)
        elif not c[11] and kinds.setdefault(c[1], kind) != kind:
            answer = (False, "wrong type")
        else:
            now = state.get(at)
            ok = stamp > now[0] if now else keep or not c[11]
            if ok:
                state[at] = (stamp, c)
                if c[11] and not keep:
                    del state[at]
            answer = (ok, None)
        if n >= len(old):
            said.append(answer)
    return {at: c for at, (_, c) in state.items()}, said


@pytest.mark.parametrize("keep", [True, False])
@pytest.mark.parametrize("seed", [5, 6])
def test_batches_equal_the_model(spark, seed, keep):
    """Known and new keys, values of several types, bad coordinates, removals before and after values, with and without tombstones."""
    rng = random.Random(seed)
    changes = []
    for k in range(260):
        key, gone = rng.choice("aabbnm"), rng.random() < 0.35
        value = None if gone else f"v{k}" if key == "b" or key == "n" and rng.random() < 0.3 else k
        changes.append(change(rng.choice([0, 1, 2, 3, 60]) if rng.random() < 0.1 else rng.randrange(4), key, value, rng.randrange(30), rng.choice([1, 2, -5]), k + 1, gone))
    old = [c for c in changes[:60] if c[1] in "ab" and c[0] < 50]
    batch = changes[60:]
    before, _ = model(old, [], keep)
    state = frame(spark, list(before.values()))
    numbered = frame(spark, batch).withColumn("nth", F.col("seq"))
    new, results = merge.apply_changes(state, numbered.repartition(3), SHAPE, REGISTRY, keep_tombstones=keep)
    end, said = model(old, batch, keep)
    assert as_dict(new) == end
    assert {r.nth: (r.applied, r.error) for r in results.collect()} == {c[10]: x for c, x in zip(batch, said)}


def test_cases_without_tombstones_and_of_new_keys(spark):
    def answers(state, batch, keep):
        numbered = frame(spark, batch).withColumn("nth", F.col("seq"))
        new, results = merge.apply_changes(frame(spark, state), numbered, SHAPE, REGISTRY, keep_tombstones=keep)
        return [r.applied for r in results.orderBy("nth").collect()], [r.error for r in results.orderBy("nth").collect()], {k: v[4] for k, v in as_dict(new).items() if not v[11]}

    gone, late = change(1, "a", None, 10, 1, 1, True), change(1, "a", 7, 5, 1, 2)
    assert answers([], [gone, late], False) == ([False, True], [None, None], {(1, "a"): 7})
    assert answers([change(1, "a", 3, 3, 1, 0)], [gone, late], False) == ([True, True], [None, None], {(1, "a"): 7})
    new_gone, new_late = change(1, "z", None, 10, 1, 1, True), change(1, "z", 7, 5, 1, 2)
    assert answers([], [new_gone, new_late], True) == ([False, True], [None, None], {(1, "z"): 7})
    assert answers([], [change(1, "z", 7, 5, 1, 1), change(2, "z", "text", 6, 1, 2)], True) == ([True, False], [None, "wrong type"], {(1, "z"): 7})


def test_replica_takes_new_keys_and_keeps_rejects(spark, tmp_path):
    replica = Replica(spark, f"file://{tmp_path}/new", SHAPE, REGISTRY)
    replica.apply(frame(spark, [change(1, "a", 1, 10, 1, 1), change(1, "z", "new", 11, 1, 2), change(2, "z", 5, 12, 1, 3), change(500, "a", 1, 13, 1, 4), change(1, "y", None, 14, 1, 5, True)]), 0)
    replica.apply(frame(spark, [change(2, "z", "more", 20, 1, 6), change(1, "z", 9, 21, 1, 7)]), 1)
    again = Replica(spark, f"file://{tmp_path}/new", SHAPE, REGISTRY)
    assert again.registry.kind("z") == "str" and again.registry.kind("y") is None
    assert {(r.x0, r.z.v if r.z else None) for r in again.grid().cells.select("x0", "z").collect()} == {(1, "new"), (2, "more")}
    assert sorted((r.seq, r.error, r.batch) for r in again.rejects().collect()) == [(3, "wrong type", 0), (4, "coordinate out of range", 0), (7, "wrong type", 1)]


def test_late_and_early(spark):
    fold = lambda *c: as_dict(merge.fold_lww(frame(spark, list(c)), ["x0"]))
    gone = change(1, "a", None, 20, 1, 2, True)
    assert fold(gone, change(1, "a", 7, 10, 2, 1))[1, "a"] == gone, "a late write loses to the tombstone"
    assert fold(change(1, "a", 7, 30, 2, 1), gone)[1, "a"][4] == 7
    assert fold(change(1, "a", 7, 10, 1, 5), change(1, "a", 8, 10, 2, 1))[1, "a"][4] == 8, "a tie goes to the larger stamp"
    assert fold(change(1, "a", 7, 10, -1, 1), change(1, "a", 8, 10, 2, 9))[1, "a"][4] == 7, "origins are unsigned"
    state = merge.fold_lww(frame(spark, [gone]), ["x0"])
    assert merge.purge(state, 20).count() == 1 and merge.purge(state, 21).count() == 0
    assert merge.visible(state, SHAPE, REGISTRY).cells.count() == 0


def test_local_fold_with_removals(spark):
    rng = random.Random(4)
    writes = [(rng.randrange(4), rng.choice("ab"), None, None, k, None, 100 + rng.randrange(9), k, rng.random() < 0.3) for k in range(400)]
    want = {}
    for x, key, _, _, v, _, at, _, gone in writes:
        if gone:
            want.pop((x, key), None)
        else:
            created, version = (want[x, key][1], want[x, key][3] + 1) if (x, key) in want else (at, 0)
            want[x, key] = (v, created, at, version)
    df = spark.createDataFrame(writes, "x0 int, key string, v_str string, v_f64 double, v_i64 long, v_bool boolean, at_ms long, nth long, removed boolean")
    got = merge.fold_local(df.repartition(5), ["x0"]).collect()
    assert {(r.x0, r.key): (r.v_i64, r.created, r.updated, r.version) for r in got} == want


def vec(spark, d):
    return spark.createDataFrame(list(d.items()), "origin long, seq long")


def test_vectors(spark, monkeypatch):
    a, b = vec(spark, {1: 10, 2: 5}), vec(spark, {1: 7, 3: 4})
    d = lambda df: {r.origin: r.seq for r in df.collect()}
    assert d(vector.merge(a, b)) == {1: 10, 2: 5, 3: 4} and d(vector.meet(a, b)) == {1: 7}
    said = lambda x, y: tuple(vector.compare(x, y).first())
    assert said(a, a) == ("in_sync", 0, 0) and said(a, b) == ("diverged", 4, 8)
    assert said(vec(spark, {}), a) == ("behind", 15, 0) and said(a, vec(spark, {})) == ("ahead", 0, 15)
    assert vector.covers(vector.merge(a, b), a).first()[0] and not vector.covers(a, b).first()[0]
    assert vector.has(a, 1, 10).first()[0] and not vector.has(a, 1, 11).first()[0] and not vector.has(a, 9, 1).first()[0]
    log = frame(spark, [change(1, "a", 1, 1, 0, 3), change(1, "a", 1, 1, 1, 8), change(1, "a", 1, 1, 2, 9)])
    legacy = vector.legacy_origin(4)
    assert legacy < 0 and d(vector.of_log(log, legacy)) == {legacy: 3, 1: 8, 2: 9}
    for limit in (256, 0):
        monkeypatch.setattr(vector, "NAMED_ORIGINS", limit)
        since = lambda v, *legacy: {r.seq for r in vector.changes_since(log, v, *legacy).collect()}  # noqa: E731, B023
        assert since(a, legacy) == {3, 9} and since(a) == {3, 9} and since(vec(spark, {})) == {3, 8, 9} and since(vec(spark, {}), legacy) == {3, 8, 9}
        assert since(vec(spark, {legacy: 3, 1: 7, 2: 9}), legacy) == {8} and since(vec(spark, {legacy: 2, 0: 50}), legacy) == {3, 8, 9} and since(vec(spark, {0: 3})) == {8, 9}
    numbered = vector.stamp(log.drop("origin", "seq").withColumn("nth", F.monotonically_increasing_id()), 6, 40).collect()
    assert {(r.origin, r.seq) for r in numbered} == {(6, 41), (6, 42), (6, 43)}


def test_stream_equals_batch(spark, tmp_path):
    changes = random_changes(9, 120) + [change(900, "a", 1, 50, 1, 500), change(1, "a", "bad", 50, 1, 501)]
    replica = Replica(spark, f"file://{tmp_path}/replica", SHAPE, REGISTRY)
    for k in range(3):
        frame(spark, changes[k::3]).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/log")
        replica.follow(f"file://{tmp_path}/log", f"file://{tmp_path}/checkpoint", 1).awaitTermination()
    want = sequential(changes[:120])[0]
    assert as_dict(replica.state()) == want
    replica.apply(frame(spark, [change(1, "a", 5, 99, 1, 999)]), 0)
    assert as_dict(replica.state()) == want, "a batch that was taken already changes nothing"
    assert {r.origin for r in replica.confirmed().collect()} <= {1, 2, -5}
    assert replica.grid().cells.count() == len({x for x, k in want if not want[x, k][11]})


def test_databases_are_created_by_values_only(spark, tmp_path):
    many = ReplicaSet(spark, f"file://{tmp_path}/many", SHAPE, REGISTRY)
    rows = [("one", *change(1, "a", 5, 1, 1, 1)), ("two", *change(1, "a", None, 1, 1, 2, True)), ("one", *change(1, "a", None, 2, 1, 3, True)), ("one", *change(2, "b", "x", 2, 1, 4))]
    schema = f"database string, {', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in change_schema(SHAPE))}"
    many.apply(spark.createDataFrame(rows, schema), 0)
    assert many.names() == ["one"] and {r.x0 for r in many.replica("one").grid().cells.collect()} == {2}
    many.apply(spark.createDataFrame([("one", *change(2, "b", None, 9, 1, 5, True))], schema), 1)
    assert many.replica("one").grid().cells.count() == 0


def test_sequence_numbers_are_never_given_twice(spark, tmp_path):
    path = f"file://{tmp_path}/seq.json"
    one = Sequencer(spark, path, 7, lease=10)
    assert list(one.assign(3)) == [1, 2, 3] and one.confirmed_through() == 0
    one.published([2, 3])
    assert one.confirmed_through() == 0
    one.released([1])
    assert one.confirmed_through() == 3
    assert list(Sequencer(spark, path, 7, lease=10).assign(2)) == [11, 12], "a lost node's lease is skipped"
    big = Sequencer(spark, path, 7, lease=10)
    assert list(big.assign(25))[-1] == 45
    assert {(r.origin, r.seq) for r in big.stamp(spark.range(2).withColumnRenamed("id", "nth")).collect()} == {(7, 46), (7, 47)}


def test_differences_of_grids_replay(spark, tmp_path):
    from cellgrid.operators import statements
    from cellgrid.plans.parser import parse

    changes = random_changes(11, 150)
    start = merge.visible(merge.fold_lww(frame(spark, changes), ["x0"]), SHAPE, REGISTRY)
    end = statements.update(start, parse("UPDATE (a=-1) WHERE x0 < 3"), 500).grid
    end = statements.delete(end, parse("DELETE WHERE x0 = 1")).grid
    diff = merge.changes_between(start, end, 600)
    stamped = diff.withColumn("origin", F.lit(9).cast("long")).withColumn("seq", F.monotonically_increasing_id() + 1000)
    replica = Replica(spark, f"file://{tmp_path}/r", SHAPE, REGISTRY)
    replica.apply(frame(spark, changes), 0)
    replica.apply(stamped.select(*change_schema(SHAPE).names), 1)
    as_rows = lambda grid: sorted(map(str, grid.entries().collect()))
    assert as_rows(replica.grid()) == as_rows(end) and merge.changes_between(end, end, 1).count() == 0
