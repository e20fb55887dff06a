"""Further queries: maps, XML rows, documents, JSON edits, addresses, codes and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from orrery.functions import arrays as A, extras as X, fuzzy as Z, jsonpath as P, jsons as J, network as N, search as T, strings as S
from orrery.operators import changes as H
from orrery.queries.registry import query, sql, table
from orrery.sources import copying as C

col, lit = F.col, F.lit


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN 'name' ELSE 'name,region' END AS keys, n_regionkey = 2 AS two, n_nationkey || '' AS v FROM nation")
def key_value_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = col("n_regionkey").cast("string")
    m = X.hstore_merge(F.create_map(lit("name"), col("n_name")), F.create_map(lit("region"), r))
    kept = F.when(col("n_regionkey") == 0, X.hstore_delete(m, "region")).otherwise(m)
    rows = table(spark, sf_dir, "nation").select("n_nationkey", kept.alias("k"), m.alias("m"))
    two = X.hstore_contains(col("m"), F.create_map(lit("region"), lit("2")))
    return rows.select("n_nationkey", F.array_join(F.sort_array(F.map_keys("k")), ",").alias("keys"), two.alias("two"), col("n_nationkey").cast("string").alias("v"))


@query("SELECT n_regionkey, n_name AS name FROM nation")
def xml_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = X.xmlelement("n", col("n_name"))
    docs = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.concat(lit("<r>"), F.concat_ws("", F.collect_list(item)), lit("</r>")).alias("x"))
    return docs.select("n_regionkey", F.explode(F.xpath("x", lit("r/n/text()"))).alias("name"))


@query("SELECT n_nationkey, '<b>' || n_name || '</b> is here' AS h FROM nation")
def text_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of a name that begin with `nation` are marked."""
    return table(spark, sf_dir, "nation").select("n_nationkey", T.headline(F.concat("n_name", lit(" is here")), T.to_tsquery("nation:*", "simple")).alias("h"))


@query("SELECT event_id, len(string_split(props, ':')) - 1 AS members, json_keys(props)[1] AS first FROM events")
def json_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = J.object_keys(col("props"))
    return table(spark, sf_dir, "events").select("event_id", F.size(keys).alias("members"), keys[0].alias("first"))


@query("SELECT n_nationkey, unnest([n_nationkey, n_regionkey])::VARCHAR AS e FROM nation")
def json_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = J.build_array(col("n_nationkey"), col("n_regionkey"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.explode(J.array_elements(text)).alias("e"))


@query("SELECT n_nationkey, json_object('k', 99, 'r', n_regionkey)::VARCHAR AS j FROM nation")
def json_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = J.build_object(k=col("n_nationkey"), r=col("n_regionkey"), gone=lit(None).cast("string"))
    return table(spark, sf_dir, "nation").select("n_nationkey", J.set_path(J.strip_nulls(doc), ["k"], 99).alias("j"))


@query("SELECT c_custkey, c_custkey % 256 < 128 AS inside, '10.0.' || (c_custkey % 256) || '.0/24' AS net FROM customer")
def network_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.concat(lit("10.0."), (col("c_custkey") % 256).cast("string"), lit(".7/24"))
    return table(spark, sf_dir, "customer").select("c_custkey", N.contained(a, lit("10.0.0.0/17")).alias("inside"), N.network(a).alias("net"))


@query("SELECT c_custkey, (SELECT sum(digit::INT * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END) % 10 = 0 FROM (SELECT unnest(string_split(d, '')) AS digit, unnest(generate_series(1, 13)) AS i) t) AS ok FROM (SELECT c_custkey, lpad(CAST(400638133000 + c_custkey * 7 AS VARCHAR) || (c_custkey % 10), 13, '0') AS d FROM customer) c")
def check_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = col("c_custkey")
    code = F.concat((lit(400638133000) + k * 7).cast("string"), (k % 10).cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", X.ean13_valid(code).alias("ok"))


@query("SELECT doc_id, strip_accents(text) = text AS plain FROM documents")
def unaccented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", (S.strip_accents(col("text")) == col("text")).alias("plain"))


@query("SELECT k, m FROM (VALUES ('phone', 'FN'), ('wrap', 'RP')) AS v(k, m)")
def metaphone_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([("phone",), ("wrap",)], "k string").select("k", Z.metaphone(col("k")).alias("m"))


@query("SELECT n_nationkey, right((n_nationkey::INT::BIT)::VARCHAR, 8) AS k, right((~(n_nationkey::INT::BIT))::VARCHAR, 8) AS b, right(xor(n_nationkey::INT::BIT, 165::INT::BIT)::VARCHAR, 8) AS x FROM nation")
def bit_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, m = F.lpad(F.bin("n_nationkey"), 8, "0"), F.lpad(F.bin(lit(165)), 8, "0")
    return table(spark, sf_dir, "nation").select("n_nationkey", k.alias("k"), S.bits_not(k).alias("b"), S.bits_xor(k, m).alias("x"))


@query("SELECT n_regionkey, len(list_sort(list(n_nationkey))[2:3]) AS n, list_contains(list(n_nationkey), 7) AS seven FROM nation GROUP BY n_regionkey")
def integer_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_nationkey")).alias("a"))
    return lists.select("n_regionkey", F.size(A.subarray(col("a"), 2, 2)).alias("n"), A.query_int(col("a"), "7").alias("seven"))


sql("collations", "SELECT c_custkey FROM {customer} WHERE lower(c_mktsegment) = 'building' AND c_mktsegment COLLATE UTF8_LCASE = 'building'", "SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE 'building'")
sql("nested_grouping_sets", "SELECT o_orderstatus, o_orderpriority, year(o_orderdate) AS y, count(*) AS n FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus, year(o_orderdate)), (o_orderpriority), (o_orderstatus, o_orderpriority), ())", "SELECT o_orderstatus, o_orderpriority, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, y), (o_orderpriority), (o_orderstatus, o_orderpriority), ())")


@query("SELECT o_custkey, count(*) AS n, rank() OVER (ORDER BY count(*) DESC, o_custkey) AS r FROM orders GROUP BY o_custkey")
def window_over_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rank over all groups, by ranges: the order has no ties, so it is the place."""
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    ranked = H.identity(counts.withColumn("_down", -col("n")), "r", ["_down", "o_custkey"])
    return ranked.select("o_custkey", "n", "r")


sql("partitioned_aggregate", "SELECT l_returnflag, l_linenumber, count(*) AS n FROM {lineitem} WHERE l_returnflag IN ('A', 'R') GROUP BY l_returnflag, l_linenumber HAVING count(*) > 10")
sql("exists_or", "SELECT c_custkey FROM {customer} WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
sql("conversation_turns", "SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, length(text) AS n FROM {conversations}")


@query()
def explain_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "orders").createOrReplaceTempView("explained_orders")
    return spark.sql("EXPLAIN FORMATTED SELECT o_custkey, count(*) FROM explained_orders WHERE o_orderkey > 5 GROUP BY o_custkey")


@query("SELECT n_nationkey, CASE WHEN n_regionkey >= 2 THEN '[' || n_regionkey || ']' ELSE '[]' END AS big, n_nationkey > 10 AS m FROM nation")
def json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = J.build_object(k=col("n_nationkey"), r=F.array("n_regionkey"))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", doc.alias("d"))
    big = P.path_query_array(col("d"), "$.r[*] ? (@ >= $low)", {"low": 2})
    return rows.select("n_nationkey", F.concat(lit("["), F.array_join(big, ","), lit("]")).alias("big"), P.path_match(col("d"), "$.k > 10").alias("m"))


@query()
def sample_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sample_blocks(spark, f"{sf_dir}/lineitem.parquet", 50, 7, 512).select("l_orderkey", "l_linenumber")
