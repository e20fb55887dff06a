"""Integrity trees over whole tables: XOR-aggregated hashes, order-free and incremental.

A table's rows are hashed over all columns and put into partitions x leaves by their
key; a leaf is the XOR of its rows' hashes, and a node the XOR of its children. A
256-bit hash is held as eight 32-bit words, which `bit_xor` aggregates natively. An
empty leaf is all zero. Two equal rows cancel in the hash, which is over the parity of rows, as
XOR is its own inverse; that makes inserts and deletes cheap. Each leaf also counts its rows, and
verification compares both. It finds
accidents and plain tampering; it isn't a defence against one who can choose rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

WORDS = [f"w{i}" for i in range(8)]


@dataclass(frozen=True)
class Tree:
    """Shape of a tree: `partitions` subtrees of `leaves` leaves each, and the key columns."""

    keys: tuple[str, ...]
    partitions: int = 58
    leaves: int = 4
    enabled: bool = True

    def __post_init__(self) -> None:
        if not self.keys:
            raise ValueError("an integrity tree needs at least one key column")
        if not 1 <= self.partitions <= 10_000:
            raise ValueError("partitions must lie between 1 and 10000")
        if not 2 <= self.leaves <= 1024 or self.leaves & (self.leaves - 1):
            raise ValueError("leaves must be a power of two between 2 and 1024")

    @property
    def nodes_per_partition(self) -> int:
        return 2 * self.leaves - 1

    @property
    def depth(self) -> int:
        return self.leaves.bit_length() - 1

    def leaf_id(self) -> Column:
        """The leaf of a row: a plain integer key modulo the leaves, other keys by their hash."""
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.partitions * self.leaves)).cast("long")

    def integer_leaf_id(self) -> Column:
        return F.pmod(F.col(self.keys[0]), F.lit(self.partitions * self.leaves)).cast("long")


def row_text(columns: Sequence[str]) -> Column:
    """All columns as text; nulls and separators are marked so that no two rows share a text."""
    parts = [F.coalesce(F.concat(F.lit("="), F.regexp_replace(F.col(c).cast("string"), r"([\\|])", r"\\$1")), F.lit("~")) for c in columns]
    return F.concat_ws("|", *parts)


def hash_words(text: Column) -> list[Column]:
    digest = F.sha2(text, 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(w) for i, w in enumerate(WORDS)]


def xor_words() -> list[Column]:
    return [F.bit_xor(w).alias(w) for w in WORDS]


def leaves(df: DataFrame, tree: Tree, integer_key: bool = False, columns: Sequence[str] | None = None) -> DataFrame:
    """leaf, w0..w7, n: one shuffle of at most one row per leaf and task."""
    leaf = tree.integer_leaf_id() if integer_key else tree.leaf_id()
    hashed = df.select(leaf.alias("leaf"), *hash_words(row_text(columns or df.columns)))
    return hashed.groupBy("leaf").agg(*xor_words(), F.count("*").alias("n"))


def nodes(leaf_table: DataFrame, tree: Tree) -> DataFrame:
    """All nodes above and at the given leaves: partition, node, is_leaf, leaf, w0..w7, n.

    Nodes are numbered from 1 in heap order inside a partition, leaf j at node
    `leaves` + j; each leaf is added to all its ancestors at once. Nodes without rows are absent, as they are zero.
    """
    at = leaf_table.withColumn("partition", F.expr(f"leaf DIV {tree.leaves}")).withColumn("_own", F.col("leaf") % tree.leaves + tree.leaves)
    up = F.transform(F.sequence(F.lit(0), F.lit(tree.depth)), lambda d: F.floor(F.col("_own") / F.pow(F.lit(2.0), d)).cast("long"))
    spread = at.withColumn("node", F.explode(up))
    summed = spread.groupBy("partition", "node").agg(*xor_words(), F.sum("n").alias("n"))
    is_leaf = F.col("node") >= tree.leaves
    leaf = F.when(is_leaf, F.col("partition") * tree.leaves + F.col("node") - tree.leaves)
    return summed.select("partition", "node", is_leaf.alias("is_leaf"), leaf.alias("leaf"), *WORDS, "n")


def build(df: DataFrame, tree: Tree, **options: object) -> DataFrame:
    return nodes(leaves(df, tree, **options), tree)


def hex_hash(prefix: str = "") -> Column:
    return F.concat(*(F.lpad(F.lower(F.hex(F.col(prefix + w))), 8, "0") for w in WORDS))


def roots(node_table: DataFrame) -> DataFrame:
    """Roots of partitions whose hash isn't zero: what a commit reports."""
    some = F.greatest(*WORDS) > 0
    return node_table.filter((F.col("node") == 1) & some).select("partition", hex_hash().alias("hash"), "n")


def root_hash(leaf_table: DataFrame) -> DataFrame:
    """One row: the XOR of all leaves."""
    zero = [F.coalesce(F.bit_xor(w), F.lit(0).cast("long")).alias(w) for w in WORDS]
    return leaf_table.agg(*zero, F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(hex_hash().alias("hash"), "n")


def stats(leaf_table: DataFrame, tree: Tree) -> DataFrame:
    """One row: the tree's shape and how its leaves are filled."""
    size = tree.partitions * tree.leaves
    return leaf_table.agg(F.count("*").alias("used_leaves"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.max("n").alias("most_rows")).select(
        F.lit(tree.partitions).alias("partitions"), F.lit(tree.leaves).alias("leaves_per_partition"), F.lit(tree.nodes_per_partition).alias("nodes_per_partition"), F.lit(size).alias("total_leaves"), F.lit(tree.partitions * tree.nodes_per_partition).alias("total_nodes"), "used_leaves", "rows", "most_rows"
    )


def locate(df: DataFrame, tree: Tree, integer_key: bool = False) -> DataFrame:
    """df with leaf, partition and node of each row."""
    leaf = tree.integer_leaf_id() if integer_key else tree.leaf_id()
    return df.withColumn("leaf", leaf).withColumn("partition", F.expr(f"leaf DIV {tree.leaves}")).withColumn("node", F.col("leaf") % tree.leaves + tree.leaves)


def leaf_tuples(df: DataFrame, tree: Tree, integer_key: bool = False) -> DataFrame:
    """Keys of each leaf, sorted. The lists grow with the table: meant for a few leaves, so filter first."""
    return locate(df, tree, integer_key).groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct(*tree.keys))).alias("tuples"))


def apply_changes(leaf_table: DataFrame, inserted: DataFrame | None, deleted: DataFrame | None, tree: Tree, **options: object) -> DataFrame:
    """Leaves after a batch of inserts and deletes; an update is both. Only the changes are hashed."""
    parts = [leaf_table]
    if tree.enabled:
        if inserted is not None:
            parts.append(leaves(inserted, tree, **options))
        if deleted is not None:
            parts.append(leaves(deleted, tree, **options).withColumn("n", -F.col("n")))
    together = parts[0]
    for p in parts[1:]:
        together = together.unionByName(p)
    return merged(together)


def merged(leaf_tables: DataFrame) -> DataFrame:
    """One table of leaves from the rows of several; leaves that come out empty are left out."""
    out = leaf_tables.groupBy("leaf").agg(*xor_words(), F.sum("n").alias("n"))
    return out.filter((F.col("n") != 0) | (F.greatest(*WORDS) != 0))


def differences(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("leaf",)) -> DataFrame:
    """Leaves (or nodes) that differ in their hash or their number of rows between two tables of them; absent ones are zero.

    Rows that were added twice leave the hash as it was: their number tells.
    """
    joined = a.alias("a").join(b.alias("b"), list(keys), "full")
    zero = F.lit(0).cast("long")
    same = [F.coalesce(F.col(f"a.{w}"), zero) == F.coalesce(F.col(f"b.{w}"), zero) for w in (*WORDS, "n")]
    together = same[0]
    for s in same[1:]:
        together = together & s
    return joined.filter(~together).select(*keys, F.coalesce("a.n", zero).alias("n_a"), F.coalesce("b.n", zero).alias("n_b"))


def verify(df: DataFrame, stored: DataFrame, tree: Tree, **options: object) -> DataFrame:
    """One row: whether the table still has the stored leaves, and how many differ."""
    bad = differences(leaves(df, tree, **options), stored)
    return bad.agg(F.count("*").alias("bad_leaves")).select((F.col("bad_leaves") == 0).alias("intact"), "bad_leaves")
