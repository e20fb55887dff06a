"""Edges of relational rewrites, change statements, copying and streams."""

import random

import pytest
from pyspark.sql import Window, functions as F

from orrery.operators import changes as C, rewrites as R
from orrery.plans import integrity as I
from orrery.sources import copying, storage
from orrery.streaming import feeds


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_lockstep_pads_with_nulls(spark):
    df = spark.createDataFrame([(1, [1, 2, 3], ["a"]), (2, [], [])], "k int, x array<int>, y array<string>")
    got = R.lockstep(df.select("k", "x", "y"), a=F.col("x"), b=F.col("y")).select("k", "a", "b")
    assert rows(got) == [(1, 1, "a"), (1, 2, None), (1, 3, None)]


def test_row_less_is_three_valued(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (0, None)], "a int, b int")
    got = df.select(R.row_less([F.col("a"), F.col("b")], [F.lit(1), F.lit(3)]).alias("v"))
    assert [r["v"] for r in got.collect()] == [None, False, True]


def test_greater_than_all_of_nothing_and_of_nulls(spark):
    df = spark.createDataFrame([(1,), (5,)], "v int")
    none, nulls = spark.createDataFrame([], "w int"), spark.createDataFrame([(1,), (None,)], "w int")
    assert R.greater_than_all(df, "v", none, "w").count() == 2
    assert R.greater_than_all(df, "v", nulls, "w").count() == 0
    assert R.greater_than_any(df, "v", none, "w").count() == 0


def test_overlap_join_gives_each_pair_once(spark):
    a = spark.createDataFrame([(1, 0.0, 100.0), (2, 5.0, 6.0), (3, 7.0, 7.0)], "a int, l double, h double")
    b = spark.createDataFrame([(1, 6.0, 50.0), (2, 99.5, 200.0)], "b int, l2 double, h2 double")
    got = R.overlap_join(a, b, 3.0, "l", "h", "l2", "h2").select("a", "b")
    assert rows(got) == [(1, 1), (1, 2)]


def test_recursive_union_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 8)], "u int, v int")
    start = spark.createDataFrame([(1,)], "n int")
    got = R.recursive_union(start, lambda t: t.join(edges, t["n"] == edges["u"]).select(F.col("v").alias("n")))
    assert rows(got) == [(1,), (2,), (3,)]
    with pytest.raises(RuntimeError):
        R.recursive_union(start, lambda t: t.select((F.col("n") + 1).alias("n")), max_rounds=3)


@pytest.mark.parametrize("start,end", [(-100, 100), (Window.unboundedPreceding, Window.unboundedFollowing)])
def test_exclude_frames_with_nulls(spark, start, end):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 1, None), (1, 2, 7.0)], "g int, o int, v double")
    for kind, want in (("current row", [7.0, 12.0, 5.0]), ("group", [7.0, 7.0, 5.0]), ("ties", [12.0, 7.0, 12.0])):
        got = R.excluded(df, "sum", "v", ["g"], ["o"], start, end, kind, "s").orderBy("o", F.col("v").asc_nulls_last())
        assert [r["s"] for r in got.collect()] == want, kind
    assert [r["s"] for r in R.excluded(df, "count", "v", ["g"], ["o"], start, end, "group", "s").orderBy("o").collect()] == [1, 1, 1]


def test_exclude_frames_against_brute_force(spark):
    rng = random.Random(5)
    rows_ = [(g, i, rng.randrange(4), rng.choice([None, *range(9)])) for g in range(3) for i in range(12)]
    df = spark.createDataFrame(rows_, "g int, i int, o int, v int")
    for start, end in ((-2, 3), (Window.unboundedPreceding, 0), (-1, Window.unboundedFollowing)):
        for kind in ("current row", "group", "ties"):
            for f, plain in (("sum", sum), ("min", min), ("max", max), ("count", len), ("avg", lambda x: sum(x) / len(x))):
                got = {(r["g"], r["i"]): r["s"] for r in R.excluded(df, f, "v", ["g"], ["o", "i"] if kind == "current row" else ["o"], start, end, kind, "s").collect()}
                if kind != "current row" and (start, end) == (-2, 3):
                    continue  # which rows of a peer group lie in a short frame is open
                for g in range(3):
                    own = sorted((r for r in rows_ if r[0] == g), key=lambda r: (r[2], r[1]))
                    for k, r in enumerate(own):
                        low, high = max(0, k + start), min(len(own), k + end + 1)
                        frame = [x for j, x in enumerate(own) if low <= j < high and not (j == k if kind == "current row" else x[2] == r[2] and (kind == "group" or j != k))]
                        if kind != "current row" and end == 0:
                            frame = [x for x in frame if x[2] < r[2] or x is r]
                        if kind != "current row" and start == -1:
                            frame = None  # the row before may be a peer or not: only peers of full groups are checked
                        if frame is not None:
                            values = [x[3] for x in frame if x[3] is not None]
                            assert got[g, r[1]] == (plain(values) if values or f == "count" else None), (start, end, kind, f)


def test_quantified_with_nulls(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "v int")
    for other, sign, q, want in (([1, 5], "=", "any", [1, 5]), ([1, None], "=", "any", [1]), ([1], "<>", "all", [5]), ([1, None], "<>", "all", []), ([], "<>", "all", [1, 5, None]), ([5, 5], "=", "all", [5]), ([1, 5], "<>", "any", [1, 5]), ([1], "<>", "any", [5]), ([3], "<=", "all", [1]), ([3, 9], "<", "any", [1, 5]), ([], "<", "any", [])):
        table = spark.createDataFrame([(x,) for x in other], "w int")
        assert sorted((r["v"] for r in R.quantified(df, "v", sign, q, table, "w").collect()), key=str) == sorted(want, key=str), (other, sign, q)


def test_overlap_join_of_very_wide_ranges(spark):
    rng = random.Random(7)
    a = [(i, low, low + 2.0 ** rng.randrange(0, 40)) for i, low in enumerate(rng.uniform(-1e6, 1e6) for _ in range(60))]
    b = [(i, low, low + 2.0 ** rng.randrange(0, 40)) for i, low in enumerate(rng.uniform(-1e6, 1e6) for _ in range(60))]
    got = R.overlap_join(spark.createDataFrame(a, "a int, l double, h double"), spark.createDataFrame(b, "b int, l2 double, h2 double"), 1.0, "l", "h", "l2", "h2").select("a", "b")
    assert rows(got) == sorted(((i, j) for i, l, h in a for j, l2, h2 in b if l < h2 and l2 < h), key=str)


def test_nearest_join_with_ties(spark):
    rng = random.Random(8)
    a = [(i, rng.choice([None, *range(8)]), rng.randrange(2)) for i in range(40)]
    b = [(i, rng.choice([None, *range(8)]), rng.randrange(3)) for i in range(25)]
    got = R.nearest_join(spark.createDataFrame(a, "a int, x int, k int"), spark.createDataFrame(b, "b int, y int, k int"), ["k"], "x", "y", 3, "a", "b").select("a", "b")
    want = [(i, j) for i, x, k in a if x is not None for _, j in sorted((abs(x - y), j) for j, y, m in b if m == k and y is not None)[:3]]
    assert rows(got) == sorted(want, key=str)


def test_connect_by_goes_to_the_bottom_and_finds_cycles(spark):
    edges = spark.range(41).select(F.col("id").alias("k"), F.when(F.col("id") > 0, F.col("id") - 1).alias("p"))
    assert R.connect_by(edges, "k", "p", 0).count() == 41 and R.connect_by(edges, "k", "p", 0, max_depth=3).count() == 4
    ring = spark.createDataFrame([(1, 3), (2, 1), (3, 2)], "k int, p int")
    with pytest.raises(RuntimeError):
        R.connect_by(ring, "k", "p", 1)
    assert R.connect_by(ring, "k", "p", 1, max_depth=2).count() == 3


def test_null_keys_do_not_conflict(spark):
    t = spark.createDataFrame([(None, "a"), (1, "b")], "k int, v string")
    s = spark.createDataFrame([(None, "c"), (None, "c"), (1, "d"), (2, "e"), (2, "e")], "k int, v string")
    assert rows(C.insert_ignore(t, s, ["k"]).table) == [(1, "b"), (2, "e"), (None, "a"), (None, "c"), (None, "c")]
    done = C.upsert(t, s.distinct(), ["k"])
    assert rows(done.table) == [(1, "d"), (2, "e"), (None, "a"), (None, "c")] and done.returning.count() == 3


def test_upsert_and_apply_changes(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    s = spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string")
    done = C.upsert(t, s, ["k"])
    assert rows(done.table) == [(1, "a"), (2, "B"), (3, "c")] and rows(done.returning) == [(2, "B"), (3, "c")]
    assert rows(C.insert_ignore(t, s, ["k"]).table) == [(1, "a"), (2, "b"), (3, "c")]
    log = spark.createDataFrame([("insert", 1, 5, "x"), ("update", 2, 1, "y"), ("delete", 3, 5, None), ("update", 4, 2, None)], "op string, seq long, k int, v string")
    assert rows(C.apply_changes(t, log, ["k"])) == [(1, "y"), (2, None)]
    cut = log.union(spark.createDataFrame([("truncate", 3, None, None)], log.schema))
    assert rows(C.apply_changes(t, cut, ["k"])) == [(2, None)]


def test_identity_is_dense(spark):
    df = spark.range(0, 1000, 3).select((F.col("id") * 7 % 1009).alias("x"))
    got = C.identity(df, "n", ["x"]).orderBy("x").collect()
    assert [r["n"] for r in got] == list(range(1, 335))


def test_connect_by_of_unknown_start(spark):
    edges = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b")], "k string, p string")
    assert [r["branch"] for r in R.connect_by(edges, "k", "p", "a").orderBy("level").collect()] == ["a", "a~b", "a~b~c"]
    assert R.connect_by(edges, "k", "p", "zzz").count() == 1


def test_copy_text_escapes(spark, tmp_path):
    (tmp_path / "in.txt").write_text("1\ta\\tb\\\\c\n2\t\\N\n\\.\n")
    got = copying.copy_from(spark, str(tmp_path / "in.txt"), "k int, v string")
    assert rows(got) == [(1, "a\tb\\c"), (2, None)]
    with pytest.raises(ValueError):
        copying.copy_from(spark, "x", "k int", "binary")


def test_cursor(spark):
    c = copying.Cursor(spark.range(10), "id")
    assert [r["id"] for r in c.fetch(3)] == [0, 1, 2] and c.move(5) == 5 and [r["id"] for r in c.fetch(9)] == [8, 9]


@pytest.mark.parametrize("every", [1, 2, 16])
def test_stream_restarts_from_its_checkpoint(spark, tmp_path, every):
    """Files come in between two runs; the state equals that of all rows at once, however often its parts are merged."""
    source, tree = tmp_path / "in", I.Tree(("k",), 2, 4)
    df = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 7).cast("string").alias("v"))
    state, checkpoint = feeds.tree_state(spark, every=every), storage.new_path(spark, "offsets")
    for part in range(4):
        df.filter(F.col("k") % 4 == part).coalesce(1).write.mode("append").parquet(str(source))
        feeds.maintain_tree(feeds.files(spark, str(source), "*.parquet", df.schema), tree, state, checkpoint)
    assert I.differences(state.read(), I.leaves(df, tree)).count() == 0
    state.add(state.last(), I.leaves(df.filter(F.col("k") % 4 == 3), tree))
    assert I.differences(state.read(), I.leaves(df, tree)).count() == 0  # the last batch again: still once
    kept = storage.names(spark, state.path)
    assert len([n for n in kept if n[0] == "v"]) <= 2 and (every > 2 or len(kept) <= 2 + 2 * every)


def test_replica_over_batches(spark):
    changes = "op string, seq long, k int, v string"
    schema = spark.createDataFrame([], changes).schema
    state = feeds.replica_state(spark, spark.createDataFrame([], "k int, v string").schema, schema, ["k"], every=2)
    log = [("insert", 1, 1, "a"), ("insert", 2, 2, "b"), ("update", 3, 1, "c"), ("delete", 4, 2, None), ("insert", 5, 3, "d"), ("truncate", 6, None, None), ("insert", 7, 4, "e")]
    for i in range(0, len(log), 2):
        state.add(i // 2, spark.createDataFrame(log[i : i + 2], schema))
        want = {}
        for op, _, k, v in log[: i + 2]:
            want = {} if op == "truncate" else {**{x: y for x, y in want.items() if x != k}, **({} if op == "delete" else {k: v})}
        assert dict(map(tuple, state.read().collect())) == want


def test_aggregates_without_peers_share_their_passes(spark, sf_dir, monkeypatch):
    """A few passes for all aggregates of a frame, and as many tasks as the table's size asks for."""
    from orrery.operators import rewrites as R
    from orrery.queries import load

    for kind in ("current_row", "group", "ties"):
        plan = load()[0][f"window_exclude_{kind}"](spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("Window [") <= 5
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    assert R.dealt(rows, ["l_orderkey"]).rdd.getNumPartitions() <= 4
    monkeypatch.setattr(R, "TASK_BYTES", 8192)
    assert R.dealt(rows, ["l_orderkey"]).rdd.getNumPartitions() > 10
