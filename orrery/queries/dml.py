"""Queries for statements that change tables, and for constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from orrery.operators import changes as C
from orrery.queries.registry import query, table


def _nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation")


@query("SELECT * FROM nation UNION ALL SELECT n_nationkey + 100, lower(n_name), n_regionkey FROM nation WHERE n_regionkey = 1")
def insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _nation(spark, sf_dir)
    return C.insert(n, n.filter("n_regionkey = 1").select((F.col("n_nationkey") + 100).alias("n_nationkey"), F.lower("n_name").alias("n_name"), "n_regionkey")).table


@query("SELECT * FROM nation UNION ALL SELECT n_nationkey + 20, 'x', n_regionkey FROM nation WHERE n_nationkey + 20 NOT IN (SELECT n_nationkey FROM nation)")
def insert_on_conflict_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _nation(spark, sf_dir)
    return C.insert_ignore(n, n.select((F.col("n_nationkey") + 20).alias("n_nationkey"), F.lit("x").alias("n_name"), "n_regionkey"), ["n_nationkey"]).table


_NULLS = "SELECT CASE WHEN n_nationkey % 5 > 0 THEN n_nationkey + {0} END AS k, n_name || '{1}' AS v FROM nation"


def _with_nulls(spark: SparkSession, sf_dir: str, step: int, mark: str) -> DataFrame:
    return _nation(spark, sf_dir).select(F.when(F.col("n_nationkey") % 5 > 0, F.col("n_nationkey") + step).alias("k"), F.concat("n_name", F.lit(mark)).alias("v"))


@query(f"WITH t AS ({_NULLS.format(0, '')}), s AS ({_NULLS.format(15, '+')}) SELECT * FROM t UNION ALL SELECT * FROM s WHERE k IS NULL OR NOT EXISTS (SELECT 1 FROM t WHERE t.k = s.k)")
def insert_ignore_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.insert_ignore(_with_nulls(spark, sf_dir, 0, ""), _with_nulls(spark, sf_dir, 15, "+"), ["k"]).table


@query(f"WITH t AS ({_NULLS.format(0, '')}), s AS ({_NULLS.format(15, '+')}) SELECT coalesce(t.k, s.k) AS k, coalesce(s.v, t.v) AS v FROM t FULL JOIN s ON t.k = s.k")
def upsert_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.upsert(_with_nulls(spark, sf_dir, 0, ""), _with_nulls(spark, sf_dir, 15, "+"), ["k"]).table


_UPSERT = "SELECT coalesce(t.n_nationkey, s.k) AS n_nationkey, CASE WHEN t.n_nationkey IS NULL THEN 'x' WHEN s.k IS NULL THEN t.n_name ELSE t.n_name || '+x' END AS n_name, coalesce(t.n_regionkey, s.r) AS n_regionkey FROM nation t FULL JOIN (SELECT n_nationkey + 20 AS k, n_regionkey AS r FROM nation) s ON t.n_nationkey = s.k"


def _upserted(spark: SparkSession, sf_dir: str) -> C.Changed:
    n = _nation(spark, sf_dir)
    rows = n.select((F.col("n_nationkey") + 20).alias("n_nationkey"), F.lit("x").alias("n_name"), "n_regionkey")
    return C.upsert(n, rows, ["n_nationkey"], {"n_name": F.concat("t.n_name", F.lit("+"), "s.n_name")})


@query(_UPSERT)
def insert_on_conflict_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upserted(spark, sf_dir).table


@query(f"SELECT * FROM ({_UPSERT}) u WHERE n_nationkey >= 20")
def upsert_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upserted(spark, sf_dir).returning


@query("SELECT c_custkey, c_acctbal + coalesce(n, 0) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey")
def update_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return C.update_from(c, n, ["c_custkey"], {"c_acctbal": F.col("t.c_acctbal") + F.col("s.n")}).table


@query("SELECT p_partkey, p_size + 1 AS p_size FROM part WHERE p_brand = 'Brand#11'")
def update_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return C.update_where(p, F.col("p_brand") == "Brand#11", {"p_size": F.col("p_size") + 1}).returning.select("p_partkey", "p_size")


@query("SELECT o_orderkey FROM orders WHERE NOT (o_totalprice < 50000)")
def delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.delete_where(table(spark, sf_dir, "orders"), F.col("o_totalprice") < 50000).table.select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
def delete_using(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = table(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.col("s_nationkey").alias("c_nationkey"))
    return C.delete_using(table(spark, sf_dir, "customer"), bad, ["c_nationkey"]).table.select("c_custkey")


@query("SELECT * FROM nation WHERE false")
def truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.truncate(_nation(spark, sf_dir)).table


@query("SELECT user_id AS k, max(value) FILTER (WHERE rn = 1) AS v FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) e GROUP BY user_id HAVING max(event_id % 7) FILTER (WHERE rn = 1) <> 0")
def replica_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_id") % 7 == 0, "delete").otherwise("update")
    rows = e.select(op.alias("op"), F.col("event_id").alias("seq"), F.col("user_id").alias("k"), F.col("value").alias("v"))
    return C.apply_changes(spark.createDataFrame([], "k long, v double"), rows, ["k"])


@query("SELECT 'insert' AS op, n_nationkey + 100 AS n_nationkey, n_name FROM nation WHERE n_regionkey = 0 UNION ALL SELECT 'delete', n_nationkey, NULL FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'update', n_nationkey, lower(n_name) FROM nation WHERE n_regionkey = 2")
def change_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _nation(spark, sf_dir)
    kept = n.filter("n_regionkey <> 1").select("n_nationkey", F.when(F.col("n_regionkey") == 2, F.lower("n_name")).otherwise(F.col("n_name")).alias("n_name"))
    after = kept.union(n.filter("n_regionkey = 0").select(F.col("n_nationkey") + 100, "n_name"))
    return C.difference(n.select("n_nationkey", "n_name"), after, ["n_nationkey"])


@query("SELECT p_partkey, CASE WHEN p_size >= 45 AND p_retailprice >= 1500 THEN 'size,price' WHEN p_size >= 45 THEN 'size' ELSE 'price' END AS violations FROM part WHERE p_size >= 45 OR p_retailprice >= 1500")
def check_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = C.check_violations(table(spark, sf_dir, "part"), size=F.col("p_size") < 45, price=F.col("p_retailprice") < 1500)
    return bad.select("p_partkey", F.array_join("violations", ",").alias("violations"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 20)")
def foreign_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = table(spark, sf_dir, "supplier").filter("s_nationkey < 20")
    return C.foreign_key_violations(table(spark, sf_dir, "lineitem"), parents, ["l_suppkey"], ["s_suppkey"]).select("l_orderkey", "l_linenumber")


@query("SELECT l_partkey, l_suppkey, count(*) AS rows FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(*) > 1")
def unique_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.unique_violations(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"])


@query("SELECT o_orderkey, 10 + 5 * (row_number() OVER (ORDER BY o_orderkey) - 1) AS id FROM orders")
def identity_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.identity(table(spark, sf_dir, "orders").select("o_orderkey"), "id", ["o_orderkey"], 10, 5)
