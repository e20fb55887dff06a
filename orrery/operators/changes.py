"""INSERT, UPDATE, DELETE and upsert as rewrites of whole tables, and change rows.

Each function returns the new table; `returning` gives the rows it touched. Tables are keyed by
columns that identify their rows. Nothing is updated in place: write the result over the table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from orrery.sources.storage import new_path


@dataclass
class Changed:
    """The table after a statement, and the rows that it inserted, updated or deleted."""

    table: DataFrame
    returning: DataFrame


def insert(target: DataFrame, rows: DataFrame) -> Changed:
    new = rows.select(*target.columns)
    return Changed(target.unionByName(new), new)


def insert_ignore(target: DataFrame, rows: DataFrame, keys: Sequence[str]) -> Changed:
    """ON CONFLICT DO NOTHING: rows whose key exists are left out, and so are later ones of one key.

    A key with a null conflicts with none.
    """
    keys = list(keys)
    new = rows.select(*target.columns)
    partly = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    fresh = new.filter(~partly).dropDuplicates(keys).join(target.select(*keys), keys, "left_anti").select(*target.columns).unionByName(new.filter(partly))
    return Changed(target.unionByName(fresh), fresh)


def upsert(target: DataFrame, rows: DataFrame, keys: Sequence[str], assign: dict[str, Column] | None = None) -> Changed:
    """ON CONFLICT DO UPDATE. assign: new values from old ('t.x') and proposed ('s.x') columns; all are taken over by default.

    rows must not hold a key twice. A key with a null conflicts with none: such rows are inserted.
    """
    keys = list(keys)
    t, s = target.withColumn("_t", F.lit(True)).alias("t"), rows.select(*target.columns).withColumn("_s", F.lit(True)).alias("s")
    on = [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys]
    joined = t.join(s, on, "full")
    both, new = F.col("t._t").isNotNull() & F.col("s._s").isNotNull(), F.col("t._t").isNull()

    def value(c: str) -> Column:
        changed = assign.get(c, F.col(f"t.{c}")) if assign is not None else F.col(f"s.{c}")
        kept = F.col(f"t.{c}") if c not in keys else F.coalesce(F.col(f"t.{c}"), F.col(f"s.{c}"))
        return F.when(new, F.col(f"s.{c}")).when(both & F.lit(c not in keys), changed).otherwise(kept).alias(c)

    out = joined.select(*(value(c) for c in target.columns), F.col("s._s").isNotNull().alias("_touched"))
    return Changed(out.drop("_touched"), out.filter("_touched").drop("_touched"))


def update_from(target: DataFrame, source: DataFrame, keys: Sequence[str], assign: dict[str, Column]) -> Changed:
    """UPDATE ... FROM: rows with a partner in source get new values; source has one row per key."""
    s = source.withColumn("_s", F.lit(True)).alias("s")
    joined = target.alias("t").join(s, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys], "left")
    hit = F.col("s._s").isNotNull()
    out = joined.select(*(F.when(hit, assign[c]).otherwise(F.col(f"t.{c}")).alias(c) if c in assign else F.col(f"t.{c}").alias(c) for c in target.columns), hit.alias("_hit"))
    return Changed(out.drop("_hit"), out.filter("_hit").drop("_hit"))


def update_where(target: DataFrame, where: Column, assign: dict[str, Column]) -> Changed:
    hit = F.coalesce(where, F.lit(False))
    out = target.select(*(F.when(hit, assign[c]).otherwise(F.col(c)).alias(c) if c in assign else F.col(c) for c in target.columns))
    return Changed(out, target.filter(hit).select(*(assign[c].alias(c) if c in assign else F.col(c) for c in target.columns)))


def delete_where(target: DataFrame, where: Column) -> Changed:
    hit = F.coalesce(where, F.lit(False))
    return Changed(target.filter(~hit), target.filter(hit))


def delete_using(target: DataFrame, source: DataFrame, on: Sequence[str]) -> Changed:
    return Changed(target.join(source, list(on), "left_anti"), target.join(source, list(on), "left_semi"))


def truncate(target: DataFrame) -> Changed:
    return Changed(target.limit(0), target.limit(0))


def apply_changes(target: DataFrame, changes: DataFrame, keys: Sequence[str], order: str = "seq", op: str = "op") -> DataFrame:
    """Replica after change rows (op: insert, update, delete or truncate; the table's columns; an order).

    The last change of each key decides; a truncate discards all that stands before it.
    """
    cut = changes.agg(F.max(F.when(F.col(op) == "truncate", F.col(order))).alias("_cut"))
    live = changes.filter(F.col(op) != "truncate").crossJoin(F.broadcast(cut)).filter(F.col("_cut").isNull() | (F.col(order) > F.col("_cut"))).drop("_cut")
    last = live.groupBy(*keys).agg(F.max_by(F.struct(op, *[c for c in target.columns if c not in keys]), order).alias("_last"))
    base = target.crossJoin(F.broadcast(cut)).filter(F.col("_cut").isNull()).drop("_cut")
    joined = base.withColumn("_t", F.lit(True)).alias("t").join(last.alias("c"), list(keys), "full")
    rest = [c for c in target.columns if c not in keys]
    out = joined.select(*keys, F.col(f"_last.{op}").alias("_op"), *(F.when(F.col("_last").isNotNull(), F.col(f"_last.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in rest))
    return out.filter(F.col("_op").isNull() | (F.col("_op") != "delete")).select(*target.columns)


def difference(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Change rows (op and the new values) that lead from one table to another."""
    rest = [c for c in before.columns if c not in keys]
    a, b = before.withColumn("_a", F.lit(True)).alias("a"), after.withColumn("_b", F.lit(True)).alias("b")
    joined = a.join(b, list(keys), "full")
    same = F.struct(*(F.col(f"a.{c}") for c in rest)).eqNullSafe(F.struct(*(F.col(f"b.{c}") for c in rest)))
    op = F.when(F.col("_a").isNull(), "insert").when(F.col("_b").isNull(), "delete").when(~same, "update")
    return joined.select(op.alias("op"), *keys, *(F.col(f"b.{c}").alias(c) for c in rest)).filter("op IS NOT NULL")


def check_violations(df: DataFrame, **checks: Column) -> DataFrame:
    """Rows that break a check (false, not null) with the names of the broken ones."""
    broken = F.filter(F.array(*(F.when(~c, F.lit(n)) for n, c in checks.items())), lambda x: x.isNotNull())
    return df.withColumn("violations", broken).filter(F.size("violations") > 0)


def foreign_key_violations(child: DataFrame, parent: DataFrame, columns: Sequence[str], references: Sequence[str]) -> DataFrame:
    """Rows of child whose reference isn't null and has no parent."""
    keys = parent.select(*(F.col(r).alias(f"_{c}") for c, r in zip(columns, references, strict=True))).distinct()
    on = [F.col(c) == F.col(f"_{c}") for c in columns]
    known = F.lit(True)
    for c in columns:
        known = known & F.col(c).isNotNull()
    return child.filter(known).join(keys, on, "left_anti")


def unique_violations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    known = df.dropna(subset=list(columns))
    return known.groupBy(*columns).agg(F.count("*").alias("rows")).filter("rows > 1")


def identity(df: DataFrame, name: str, order: Sequence[str], start: int = 1, step: int = 1) -> DataFrame:
    """A dense sequence in the given order, by sums over ranges: no task sees all rows.

    The ranges are written to the shared folder, so that a row's range is the same wherever it is read.
    """
    path = new_path(df.sparkSession, "ranges")
    df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()).write.parquet(path)
    ranged = df.sparkSession.read.parquet(path)
    own = ranged.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))  # a row per range
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return own.join(F.broadcast(before), "_p").withColumn(name, (F.col("_before") + F.col("_i") - 1) * step + start).drop("_p", "_i", "_before")
