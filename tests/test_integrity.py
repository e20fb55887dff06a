"""Metamorphic tests of integrity trees."""

import pytest
from pyspark.sql import functions as F

from orrery.plans import integrity as I

TREE = I.Tree(("k",), 3, 4)


@pytest.fixture()
def rows(spark):
    return spark.createDataFrame([(i, f"v{i % 7}", None if i % 5 == 0 else i * 1.5) for i in range(200)], "k long, v string, x double")


def digest(df, tree=TREE):
    return I.root_hash(I.leaves(df, tree)).first()["hash"]


def test_order_does_not_matter(rows):
    assert digest(rows) == digest(rows.orderBy(F.desc("v"), "k").repartition(7))


def test_insert_then_delete_restores(rows):
    before = I.leaves(rows, TREE)
    extra = rows.filter("k < 20").withColumn("k", F.col("k") + 1000)
    after = I.apply_changes(I.apply_changes(before, extra, None, TREE), None, extra, TREE)
    assert I.differences(before, after).count() == 0
    assert I.differences(before, I.apply_changes(before, extra, None, TREE)).count() > 0


def test_one_cell_changes_one_path(rows):
    changed = rows.withColumn("v", F.when(F.col("k") == 77, "tampered").otherwise(F.col("v")))
    a, b = I.build(rows, TREE), I.build(changed, TREE)
    bad = I.differences(a, b, ("partition", "node")).collect()
    assert len({r["partition"] for r in bad}) == 1
    assert sorted(r["node"] for r in bad)[0] == 1 and len(bad) == TREE.depth + 1
    assert I.differences(I.leaves(rows, TREE), I.leaves(changed, TREE)).count() == 1


def test_duplicate_rows_cancel(rows):
    leaf = I.leaves(rows.union(rows), TREE)
    assert leaf.filter(F.greatest(*I.WORDS) != 0).count() == 0
    assert leaf.agg(F.sum("n")).first()[0] == 400


def test_rows_added_twice_are_found(rows):
    more = rows.filter("k = 7")
    found = I.verify(rows.union(more).union(more), I.leaves(rows, TREE), TREE).first()
    assert (found["intact"], found["bad_leaves"]) == (False, 1)


def test_null_cell_differs_from_text(spark):
    a = spark.createDataFrame([(1, None, 1.0)], "k long, v string, x double")
    for v in ("", "~", "="):
        assert digest(a) != digest(spark.createDataFrame([(1, v, 1.0)], "k long, v string, x double"))
    b, c = (spark.createDataFrame([r], "k long, a string, b string") for r in ((1, "x|=y", "z"), (1, "x", "y|=z")))
    assert digest(b) != digest(c)


def test_empty_table(rows):
    empty = rows.limit(0)
    assert I.leaves(empty, TREE).count() == 0
    assert I.root_hash(I.leaves(empty, TREE)).first()["hash"] == "0" * 64
    assert I.verify(empty, I.leaves(empty, TREE), TREE).first()["intact"]


def test_null_key_has_a_leaf(spark):
    df = spark.createDataFrame([(None, "a"), (1, "b")], "k long, v string")
    assert I.leaves(df, TREE).agg(F.sum("n")).first()[0] == 2


def test_disabled_tree_ignores_changes(rows):
    off = I.Tree(("k",), 3, 4, enabled=False)
    before = I.leaves(rows, off)
    assert I.differences(before, I.apply_changes(before, rows, None, off)).count() == 0


@pytest.mark.parametrize("partitions,leaves", [(0, 4), (10_001, 4), (3, 3), (3, 1), (3, 2048)])
def test_bad_shapes(partitions, leaves):
    with pytest.raises(ValueError):
        I.Tree(("k",), partitions, leaves)


def test_parent_is_xor_of_children(rows):
    nodes = {(r["partition"], r["node"]): r for r in I.build(rows, TREE).collect()}
    zero = dict.fromkeys(I.WORDS, 0)
    for (p, n), r in nodes.items():
        if n < TREE.leaves:
            a, b = nodes.get((p, 2 * n), zero), nodes.get((p, 2 * n + 1), zero)
            assert all(r[w] == a[w] ^ b[w] for w in I.WORDS)
