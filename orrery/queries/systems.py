"""Queries for sources, sinks, routines and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from orrery.functions import routines as U
from orrery.operators.rewrites import tasks
from orrery.queries import distinguishing as Q
from orrery.queries.registry import query, table
from orrery.sources import copying as C
from orrery.sources.storage import MaterializedView, new_path
from orrery.streaming import feeds as S

NATION = "n_nationkey int, n_name string, n_regionkey int"
_NULLED = "SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_name || chr(9) || '\\' || n_regionkey END AS n_name, n_regionkey FROM nation"


def _nulled(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("n_nationkey") % 5 != 0, F.concat("n_name", F.lit("\t\\"), "n_regionkey"))
    return table(spark, sf_dir, "nation").withColumn("n_name", name)


@query(_NULLED)
def copy_text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "copy")
    C.copy_to(_nulled(spark, sf_dir), path)
    return C.copy_from(spark, path, NATION)


@query(f"SELECT * FROM ({_NULLED}) t WHERE n_regionkey > 1")
def copy_csv_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "copy")
    C.copy_to(_nulled(spark, sf_dir), path, "csv", header=True)
    return C.copy_from(spark, path, NATION, "csv", header=True, where=F.col("n_regionkey") > 1)


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def materialized_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = MaterializedView(spark, "by-status")
    orders = table(spark, sf_dir, "orders")
    view.refresh(orders.filter("o_orderkey < 100").groupBy("o_orderstatus").agg(F.count("*").alias("n")))
    return view.refresh(orders.groupBy("o_orderstatus").agg(F.count("*").alias("n")))


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 15 OFFSET 20")
def cursor_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.page(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_custkey"], 21, 35)


@query("SELECT count(*) AS n, count(*) AS places FROM lineitem")
def row_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.with_row_location(spark, f"{sf_dir}/lineitem.parquet")
    return rows.agg(F.count("*").alias("n"), F.count_distinct("file", "row_index").alias("places"))


@query("SELECT generate_series AS n FROM generate_series(5, 500, 7)")
def custom_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.dataSource.register(C.SeriesSource)
    return spark.read.format("series").options(start="5", stop="500", step="7").load()


@query("SELECT p_brand, round(exp(avg(ln(p_size))), 6) AS g FROM part GROUP BY p_brand")
def user_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(U.geometric_mean(F.col("p_size").cast("double")).alias("g")).select("p_brand", F.round("g", 6).alias("g"))


@query("SELECT n_regionkey, round(exp(sum(ln(n_nationkey + 1))), 0) AS p FROM nation GROUP BY n_regionkey")
def folded_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.round(U.product(F.col("n_nationkey") + 1), 0).alias("p"))


@query("SELECT n_nationkey, unnest(string_split(n_name, ' ')) AS word, unnest(generate_series(1, len(string_split(n_name, ' ')))) AS place FROM nation")
def table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.udtf.register("split_words", U.SplitWords)
    return spark.sql("SELECT n_nationkey, t.word, t.place FROM {nation}, LATERAL split_words(n_name) t", nation=table(spark, sf_dir, "nation"))


@query("SELECT * FROM (VALUES (1, 'x'), (2, NULL)) AS v(a, b)")
def record_set_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.udtf.register("record_set", U.RecordSet)
    return spark.sql("""SELECT * FROM record_set('a int, b string', '[{"a":1,"b":"x"},{"a":2}]')""")


@query("SELECT p_partkey, p_retailprice * (1 + p_size / 100) AS v FROM part")
def sql_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    U.create_sql_function(spark, "marked_up", "price DOUBLE, size INT", "DOUBLE", "price * (1 + size / 100)")
    return table(spark, sf_dir, "part").selectExpr("p_partkey", "marked_up(p_retailprice, p_size) AS v")


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 7 AND o_totalprice > 1000")
def prepared_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "orders").createOrReplaceTempView("prepared_orders")
    return U.call(spark, "SELECT o_orderkey FROM prepared_orders WHERE o_custkey = :customer AND o_totalprice > :price", customer=7, price=1000)


@query(Q.CUSTOMER_LEAVES)
def stream_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "customer").schema
    state = S.tree_state(spark)
    S.maintain_tree(S.files(spark, sf_dir, "customer.parquet", schema), Q.TREE, state, new_path(spark, "offsets"), integer_key=True, columns=Q.CUSTOMER)
    return state.read()


@query(f"SELECT bid, tx_id, waw, raw, war, committed FROM {Q._FLAGS} t")
def stream_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "sets")
    n = max(3, tasks(table(spark, sf_dir, "lineitem")))
    Q._sets(spark, sf_dir).repartitionByRange(n, "bid").sortWithinPartitions("bid").write.parquet(path)
    schema = spark.read.parquet(path).schema
    state = S.flag_state(spark)
    S.commit_blocks(S.files(spark, path, "*.parquet", schema, min(16, -(-n // 3))), state, new_path(spark, "offsets"))
    return state.read()


@query("SELECT user_id AS k, value AS v FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) e WHERE rn = 1 AND event_id % 7 <> 0")
def stream_replica(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = S.files(spark, sf_dir, "events.parquet", table(spark, sf_dir, "events").schema)
    rows = events.select(F.when(F.col("event_id") % 7 == 0, "delete").otherwise("update").alias("op"), F.col("event_id").alias("seq"), F.col("user_id").alias("k"), F.col("value").alias("v"))
    changes = T.StructType.fromDDL("op string, seq long, k long, v double")
    state = S.replica_state(spark, T.StructType.fromDDL("k long, v double"), changes, ["k"])
    S.replicate(rows, ["k"], state, new_path(spark, "offsets"))
    return state.read()


@query("SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.tumbling_counts(table(spark, sf_dir, "events"), "ts", "6 hours", "event_type")
    return found.select(F.col("start").cast("string").alias("start"), "event_type", "n")


@query("SELECT user_id, min(ts)::VARCHAR AS start, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > ts - INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events) a) b GROUP BY user_id, s")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.sessions(table(spark, sf_dir, "events"), "ts", "2 hours", "user_id")
    return found.select("user_id", F.col("start").cast("string").alias("start"), "n")


@query("WITH k AS (SELECT o_orderkey AS tx_id, o_orderkey // 50 AS bid, 'r' AS rel, unnest([o_custkey, o_orderkey % 9]) AS key, unnest(['R', 'W']) AS mode FROM orders) SELECT bid, tx_id, rel, CAST(key AS VARCHAR) AS key, mode FROM k")
def procedure_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    calls = table(spark, sf_dir, "orders").select(F.expr("o_orderkey DIV 50").alias("bid"), k.alias("tx_id"), F.lit("r").alias("rel"), F.array("o_custkey").alias("reads"), F.array(k % 9).alias("writes"))
    return U.expand_operations(calls)
