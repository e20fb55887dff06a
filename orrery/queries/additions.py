"""Queries for sequences, tables from queries, binary COPY, changes inside queries, templates, types and block services."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

from orrery.functions import arrays as A, datetimes as D, jsons as J, maths as M, strings as S, system as Y
from orrery.functions import extras as X, routines as U, search as T
from orrery.operators import changes as C, rewrites as R
from orrery.operators.policies import Policies, Policy, published
from orrery.plans import blocks as B
from orrery.queries.distinguishing import _FLAGS, _sets, _transactions
from orrery.queries.registry import ORACLE, query, sql, table
from orrery.sources import copying, tables as K
from orrery.sources.storage import new_path

col, lit = F.col, F.lit


@query("SELECT o_orderkey, 100 + 3 * (row_number() OVER (ORDER BY o_orderkey) + 1) AS id, 100 + 3 * (count(*) OVER () + 2) AS after FROM orders")
def sequence_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two values are taken by hand, then one for each row, then one more."""
    s = Y.Sequence(start=100, increment=3)
    s.nextval()
    s.setval(s.nextval())
    rows = s.assign(table(spark, sf_dir, "orders").select("o_orderkey"), "id", ["o_orderkey"])
    return rows.withColumn("after", lit(s.nextval()).cast("long"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderstatus UNION ALL SELECT 'none', 0")
def create_table_as(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = K.Tables(spark)
    big = t.create_as("big", table(spark, sf_dir, "orders").filter("o_totalprice > 100000"))
    t.select_into("none", big, with_data=False)
    return t.read("big").groupBy("o_orderstatus").agg(F.count("*").alias("n")).unionByName(t.read("none").agg(F.count("*").alias("n")).withColumn("o_orderstatus", lit("none")))


@query("SELECT c_custkey, CASE WHEN c_nationkey > 2 THEN c_name END AS c_name, c_acctbal, c_nationkey > 4 AS flag, CASE WHEN c_nationkey <> 7 THEN c_nationkey END AS c_nationkey FROM customer")
def copy_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(col("c_nationkey") > 2, col("c_name")).alias("c_name"), "c_acctbal", (col("c_nationkey") > 4).alias("flag"), F.when(col("c_nationkey") != 7, col("c_nationkey")).alias("c_nationkey"))
    path = new_path(spark, "binary")
    K.copy_binary_to(rows).write.parquet(path)
    return K.copy_binary_from(spark.read.parquet(path), rows.schema)


@query("SELECT n_nationkey, n_name || '!' AS n_name, n_regionkey FROM nation WHERE n_regionkey = 2")
def copy_of_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, path = table(spark, sf_dir, "nation"), new_path(spark, "changed")
    K.copy_changes(C.update_where(n, col("n_regionkey") == 2, {"n_name": F.concat("n_name", lit("!"))}), path)
    return copying.copy_from(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("SELECT 'kept' AS t, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 'moved', o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def data_modifying_cte(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WITH gone AS (DELETE ... RETURNING *) INSERT INTO archive SELECT * FROM gone: both statements see the tables as they were."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    gone = C.delete_where(orders, col("o_orderstatus") == "F")
    archive = C.insert(orders.limit(0), gone.returning)
    return gone.table.select(lit("kept").alias("t"), "o_orderkey", "o_totalprice").unionByName(archive.table.select(lit("moved").alias("t"), "o_orderkey", "o_totalprice"))


@query("SELECT n_regionkey, '[' || string_agg(CASE WHEN n_nationkey % 4 = 0 THEN 'null' ELSE '\"' || n_name || '\"' END, ', ' ORDER BY n_nationkey) || ']' AS a, '{ ' || string_agg('\"' || n_name || '\" : ' || n_nationkey, ', ' ORDER BY n_name) || ' }' AS o FROM nation GROUP BY n_regionkey")
def json_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(col("n_nationkey") % 4 != 0, col("n_name"))
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(J.json_agg(name, col("n_nationkey")).alias("a"), J.json_object_agg(col("n_name"), col("n_nationkey")).alias("o"))


@query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k, CAST(NULL AS VARCHAR) AS other, 2::INT AS n FROM events")
def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = J.populate_record(col("props"), "k int, other string")
    many = J.populate_recordset(F.concat(lit("["), col("props"), lit(","), col("props"), lit("]")), "k int, other string")
    return table(spark, sf_dir, "events").select("event_id", one["k"].alias("k"), one["other"].alias("other"), F.size(many).alias("n"))


@query("SELECT p_partkey, array_to_string([upper(w[1]) || w[2:] for w in string_split(p_name, ' ')], ' ') AS i, starts_with(p_name, 'red') AS s, strlen(p_name) AS bytes FROM part")
def string_capitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = col("p_name")
    back = S.convert_from(S.convert_to(n, "LATIN1"), "LATIN1")
    return table(spark, sf_dir, "part").select("p_partkey", S.initcap(F.upper(back)).alias("i"), S.starts_with(n, lit("red")).alias("s"), F.octet_length(S.convert_to(n, "UTF8")).alias("bytes"))


@query("SELECT p_partkey, round(acosh(p_size), 9) AS a, CASE WHEN p_size = 1 THEN 'inf' ELSE round(atanh(1.0 / p_size), 9)::VARCHAR END AS t, round(asinh(p_size), 9) AS s FROM part")
def math_hyperbolic(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = col("p_size").cast("double")
    shown = F.when(col("p_size") == 1, F.when(M.atanh(p) > 1e300, "inf"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(M.acosh(p), 9).alias("a"), F.coalesce(shown, F.round(M.atanh(1.0 / p), 9).cast("string")).alias("t"), F.round(M.asinh(p), 9).alias("s"))


ORACLE["math_hyperbolic"] = "SELECT p_partkey, round(acosh(p_size), 9) AS a, CASE WHEN p_size = 1 THEN 'inf' ELSE CAST(round(atanh(1.0 / p_size), 9) AS VARCHAR) END AS t, round(asinh(p_size), 9) AS s FROM part"


@query("SELECT c_custkey, [c_nationkey, 7] AS p, CASE WHEN c_nationkey > 3 THEN [c_nationkey, 7] ELSE [7] END AS n, CASE WHEN c_nationkey > 3 THEN [1, c_nationkey] ELSE [1] END AS f, CASE WHEN c_nationkey > 3 THEN 1 END AS low, CASE WHEN c_nationkey > 3 THEN 1 END AS high FROM customer")
def array_building(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = col("c_nationkey")
    some = F.when(n > 3, F.array(n))
    return table(spark, sf_dir, "customer").select("c_custkey", A.cat(F.array(n), F.array(lit(7))).alias("p"), A.append(some, lit(7)).alias("n"), A.prepend(lit(1), some).alias("f"), A.lower(some).alias("low"), A.ndims(some).alias("high"))


@query("SELECT o_orderkey, o_orderdate::DATE AS d, date_trunc('day', o_orderdate) + INTERVAL 1 HOUR * (13 + o_orderkey % 10) + INTERVAL 1 MINUTE * (o_orderkey % 60) AS t, CAST(-(o_orderkey % 90000) - 0.25 AS DOUBLE) AS n FROM orders")
def read_by_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = col("o_orderkey")
    day = D.to_char(col("o_orderdate"), "DD Mon YYYY")
    clock = F.concat(F.date_format("o_orderdate", "yyyy.MM.dd"), lit(" "), (1 + k % 10).cast("string"), lit(":"), F.lpad((k % 60).cast("string"), 2, "0"), lit(" PM"))
    number = F.concat(lit("-"), F.format_number(k % 90000, 0), lit(".25"))
    return table(spark, sf_dir, "orders").select("o_orderkey", D.to_date(day, "DD Mon YYYY").alias("d"), D.from_template(clock, "YYYY.MM.DD HH12:MI PM").alias("t"), D.to_number(number, "S99G999D99").cast("double").alias("n"))


@query("SELECT o_orderkey, make_date(year(o_orderdate), month(o_orderdate), 1) AS d, make_timestamp(year(o_orderdate), 2, 28, o_orderkey % 24, 30, 1.5) AS t, o_orderdate + INTERVAL 2 HOUR AS z FROM orders")
def make_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.year("o_orderdate")
    made = F.make_timestamp_ntz(y, lit(2), lit(28), (col("o_orderkey") % 24).cast("int"), lit(30), lit(1.5).cast("decimal(16,6)"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.make_date(y, F.month("o_orderdate"), lit(1)).alias("d"), made.alias("t"), D.timezone("+02:00", col("o_orderdate")).alias("z"))


@query("SELECT c_custkey, 'bigint' AS a, 'text' AS b, 'double precision' AS c, 'integer[]' AS d, 'numeric' AS e, 36::INT AS u FROM customer")
def type_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", Y.pg_typeof(col("c_custkey")).alias("a"), Y.pg_typeof(col("c_name")).alias("b"), Y.pg_typeof(col("c_acctbal")).alias("c"), Y.pg_typeof(F.array("c_nationkey")).alias("d"), Y.pg_typeof(lit(1).cast("decimal(5,2)")).alias("e"), F.length(Y.gen_random_uuid()).alias("u"))


@query("SELECT '<nation><n_nationkey>' || n_nationkey || '</n_nationkey>' || CASE WHEN n_regionkey > 0 THEN '<n_name>' || n_name || '</n_name>' ELSE '' END || '</nation>' AS xml FROM nation")
def table_as_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.when(col("n_regionkey") > 0, col("n_name")).alias("n_name"))
    return Y.table_to_xml(rows, "nation").select("xml")


@query("SELECT 1000::BIGINT AS n, true AS centred, true AS spread")
def normal_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.normal_rand(spark, 1000, 50.0, 5.0, 7).agg(F.count("*").alias("n"), F.avg("normal_rand").alias("a"), F.stddev("normal_rand").alias("s"))
    return found.select("n", F.abs(col("a") - 50).cast("double").between(0, 1).alias("centred"), col("s").between(4, 6).alias("spread"))


# Sampling: what SQL can check of a sample


def _sampled(name: str, low: float, high: float, base: str, sample) -> None:
    """Rows of the sample stand in the table, each once, and are about as many as asked for."""

    @query(f"SELECT true AS known, true AS once, true AS size, count(*) AS rows FROM {base}", f"{name}_invariants")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        got, whole = sample(spark, sf_dir), table(spark, sf_dir, base)
        keys = got.columns
        n = whole.count()
        found = got.groupBy(*keys).agg(F.count("*").alias("_n")).join(whole.select(*keys).groupBy(*keys).agg(F.count("*").alias("_w")), keys, "left")
        some = found.agg(F.coalesce(F.min(F.coalesce("_w", lit(0))) > 0, lit(True)).alias("known"), F.coalesce(F.min(F.coalesce("_w", lit(0)) - col("_n")) >= 0, lit(True)).alias("once"), F.coalesce(F.sum("_n"), lit(0)).alias("_s"))
        return some.select("known", "once", col("_s").between(int(low * n) if low < 1 else int(min(low, n)), int(high * n) + 1 if high <= 1 else int(high)).alias("size"), lit(n).alias("rows"))


_sampled("sample_bernoulli", 0.07, 0.13, "lineitem", lambda spark, d: table(spark, d, "lineitem").sample(False, 0.1, 42).select("l_orderkey", "l_linenumber"))
_sampled("sample_system", 0.2, 0.8, "lineitem", lambda spark, d: copying.sample_blocks(spark, f"{d}/lineitem.parquet", 50, 7, 512).select("l_orderkey", "l_linenumber"))
_sampled("sample_system_rows", 100, 100, "orders", lambda spark, d: copying.sample_rows(table(spark, d, "orders"), 100, 7).select("o_orderkey"))


@query("SELECT abs(0) < 1 AS close, count(DISTINCT l_partkey) AS parts FROM lineitem")
def approximate_distinct_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sketch lies within a tenth of the exact number. It does not see repeats, so both are taken of the distinct values: else every value would carry a sketch."""
    found = table(spark, sf_dir, "lineitem").select("l_partkey").distinct().agg(F.approx_count_distinct("l_partkey", 0.02).alias("a"), F.count("l_partkey").alias("parts"))
    return found.select((F.abs(col("a") - col("parts")) <= 0.1 * col("parts")).alias("close"), "parts")


# Block services


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 40 + 5 AS bid, ((row_number() OVER (ORDER BY o_orderkey) - 1) % 40)::INT AS position, round((row_number() OVER (ORDER BY o_orderkey) - 1) / 80.0, 6) AS due FROM orders")
def block_submit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half a second at eighty a second is a block of forty."""
    pending = C.identity(table(spark, sf_dir, "orders").select("o_orderkey"), "seq", ["o_orderkey"], 0)
    return B.submit(pending, 5, seconds=0.5, per_second=80.0).select("o_orderkey", "bid", "position", F.round("due", 6).alias("due"))


@query("SELECT c_nationkey AS bid, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1)::INT AS position, 'h' || c_custkey AS hash FROM customer UNION ALL SELECT 3, ((SELECT count(*) FROM customer WHERE c_nationkey = 3) + row_number() OVER (ORDER BY n_name) - 1)::INT, n_name FROM nation")
def block_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    place = (F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1).cast("int")
    block = table(spark, sf_dir, "customer").select(col("c_nationkey").alias("bid"), place.alias("position"), F.concat(lit("h"), "c_custkey").alias("hash"), lit("x").alias("sql"))
    more = table(spark, sf_dir, "nation").select(col("n_name").alias("hash"), lit("y").alias("sql"))
    return B.attach(more, 3, block).select("bid", "position", "hash")


@query()
def block_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions by hash; those of odd blocks are not decided yet, and some hashes are of none."""
    txs = _transactions(spark, sf_dir).withColumn("hash", F.concat(lit("t"), "o_orderkey"))
    flags = B.conflicts(_sets(spark, sf_dir).filter("bid % 2 = 0"))
    asked = table(spark, sf_dir, "orders").select(F.concat(F.when(col("o_orderkey") % 10 == 0, "u").otherwise("t"), "o_orderkey").alias("hash"))
    return B.results(txs, flags, asked).select("hash", "status")


ORACLE["block_results"] = f"WITH f AS (SELECT bid, tx_id, committed FROM {_FLAGS} t WHERE bid % 2 = 0), x AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS tx_id FROM orders) SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'u' ELSE 't' END || o_orderkey AS hash, CASE WHEN o_orderkey % 10 = 0 THEN 'UNKNOWN' WHEN committed IS NULL THEN 'PENDING' WHEN committed THEN 'COMMITTED' ELSE 'ABORTED' END AS status FROM x LEFT JOIN f USING (tx_id)"


@query("SELECT start, ended, committed, committed / 3600.0 AS per_second FROM (SELECT date_trunc('hour', ts) AS start, count(*) AS ended, count(*) FILTER (WHERE event_type <> 'error') AS committed FROM events GROUP BY 1) t")
def block_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.throughput(table(spark, sf_dir, "events").withColumn("committed", col("event_type") != "error"), "ts", "1 hour")


sql("order_by_using", "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place FROM {customer} WHERE c_nationkey = 5")
sql("fetch_first_ties", "SELECT p_partkey, p_size FROM (SELECT p_partkey, p_size, rank() OVER (ORDER BY p_size DESC) AS r FROM {part}) t WHERE r <= 10")


@query("SELECT event_id, '{\"a\":[1,' || event_id || ',' || json_extract_string(props, '$.k') || ']}' AS a, '{\"k\":' || json_extract_string(props, '$.k') || ',\"n\":1}' AS b, '{' || chr(10) || '    \"k\": ' || json_extract_string(props, '$.k') || chr(10) || '}' AS c FROM (SELECT *, 5 AS x FROM events) t")
def json_insert_pretty(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = J.path(col("props"), "k")
    doc = F.concat(lit('{"a":['), col("event_id"), lit(","), k, lit("]}"))
    rows = table(spark, sf_dir, "events").select("event_id", "props", doc.alias("d"))
    return rows.select("event_id", J.insert_path(col("d"), ["a", 0], 1).alias("a"), J.insert_path(col("props"), ["n"], 1).alias("b"), J.pretty(col("props")).alias("c"))


@query("SELECT c_custkey, strlen(c_name)::INT AS a, 8::INT AS b, 4::INT AS c, true AS r FROM customer")
def value_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = Y.relation_size(spark, f"{sf_dir}/customer.parquet")
    return table(spark, sf_dir, "customer").select("c_custkey", Y.column_size(col("c_name")).alias("a"), Y.column_size(col("c_acctbal")).alias("b"), Y.column_size(col("c_nationkey")).alias("c"), lit(size > 0).alias("r"))


@query("SELECT n_regionkey, count(*) AS old_rows, 2 * count(*) AS new_keys, min(n_nationkey) AS least FROM nation WHERE n_regionkey < 3 GROUP BY n_regionkey")
def transition_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement trigger's OLD and NEW tables: an update's rows before and after it, joined by their key."""
    n = table(spark, sf_dir, "nation")
    new = C.update_where(n, col("n_regionkey") < 3, {"n_name": F.upper("n_name")}).returning
    old = n.join(new.select("n_nationkey"), "n_nationkey", "left_semi")
    both = old.select("n_nationkey", "n_regionkey").join(new.select("n_nationkey", col("n_name").alias("after")), "n_nationkey")
    return both.groupBy("n_regionkey").agg(F.count("*").alias("old_rows"), (F.count("after") * 2).alias("new_keys"), F.min("n_nationkey").alias("least"))


_DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def _foreign(spark: SparkSession, sf_dir: str) -> str:
    """nation and region in another database (Derby, which comes with Spark); its url.

    The database is made by the driver and goes to every executor as a read-only archive on the class path, so that all of them can open it.
    """
    name, folder = f"orrery_{uuid.uuid4().hex}", tempfile.mkdtemp(prefix="orrery-foreign-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    jvm, kinds = spark.sparkContext._jvm, {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR(32672)"}
    connect = lambda options: jvm.org.apache.derby.iapi.jdbc.AutoloadedDriver().connect(f"jdbc:derby:{folder}/{name};{options}", jvm.java.util.Properties())
    link = connect("create=true")
    for t in ("nation", "region"):
        rows = table(spark, sf_dir, t)
        columns = ", ".join(f'"{f.name}" {kinds[f.dataType.simpleString()]}' for f in rows.schema)
        link.createStatement().execute(f"CREATE TABLE {t} ({columns})")
        put = link.prepareStatement(f"INSERT INTO {t} VALUES ({', '.join('?' * len(rows.columns))})")
        for row in rows.toLocalIterator():
            for i, v in enumerate(row):
                put.setObject(i + 1, v)
            put.execute()
    link.close()
    with contextlib.suppress(Py4JJavaError):  # Derby answers a shutdown with an exception
        connect("shutdown=true")
    with zipfile.ZipFile(f"{folder}/{name}.jar", "w", zipfile.ZIP_DEFLATED) as jar:
        for file in sorted(Path(folder, name).rglob("*")):
            jar.write(file, file.relative_to(folder))
    spark.sql(f"ADD JAR '{folder}/{name}.jar'")
    return f"jdbc:derby:classpath:{name}"


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1 AND n_nationkey > 3")
def foreign_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters and columns are pushed to the other database."""
    found = copying.foreign_table(spark, _foreign(spark, sf_dir), "nation", driver=_DERBY)
    return found.select("n_nationkey", "n_name", "n_regionkey").filter("n_regionkey = 1 AND n_nationkey > 3").select("n_nationkey", "n_name")


@query("SELECT r_name, count(*)::INT AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def foreign_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join and an aggregate that the other database works out, as a query sent to it."""
    statement = 'SELECT "r_name", count(*) AS "n" FROM nation JOIN region ON "n_regionkey" = "r_regionkey" GROUP BY "r_name"'
    return copying.foreign_table(spark, _foreign(spark, sf_dir), query=statement, driver=_DERBY)


@query("SELECT n_nationkey FROM nation")
def foreign_parallel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four reads by ranges of the key."""
    found = copying.foreign_table(spark, _foreign(spark, sf_dir), "nation", partition=("n_nationkey", 0, 25, 4), driver=_DERBY)
    return found.select("n_nationkey")


@query()
def text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = R.spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select(T.to_tsvector(col("text"), "simple").alias("v"))
    return T.ts_stat(v, "v")


ORACLE["text_statistics"] = r"SELECT lex AS word, count(DISTINCT doc_id) AS ndoc, count(*) AS nentry FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS lex FROM documents) t GROUP BY lex"


@query("SELECT c_custkey, CASE WHEN c_custkey >= 100 THEN left(CAST(c_custkey AS VARCHAR), 2) ELSE CAST(c_custkey AS VARCHAR) END AS cut, c_custkey < 100 AS kept, CASE c_mktsegment WHEN 'BUILDING' THEN 3 WHEN 'MACHINERY' THEN 2 END::INT AS n FROM customer")
def text_dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = col("c_custkey").cast("string")
    synonyms = T.dict_xsyn(col("c_mktsegment"), {"building": ["house", "tower"], "machinery": ["engine"]})
    return table(spark, sf_dir, "customer").select("c_custkey", T.dict_int(k, 2)[0].alias("cut"), (F.size(T.dict_int(k, 2, reject=True)) > 0).alias("kept"), F.when(synonyms.isNotNull(), F.size(synonyms)).alias("n"))


@query("SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::INT AS row, n_nationkey::VARCHAR AS k, CASE WHEN n_nationkey % 3 > 0 THEN n_name END AS name FROM nation")
def xml_path_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.concat(lit("<n><k>"), col("n_nationkey"), lit("</k>"), F.when(col("n_nationkey") % 3 > 0, F.concat(lit("<name>"), "n_name", lit("</name>"))).otherwise(""), lit("</n>"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", item.alias("x")))), lambda e: e["x"])
    docs = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.concat(lit("<r>"), F.array_join(rows, ""), lit("</r>")).alias("x"))
    return X.xpath_table(docs, "n_regionkey", "x", "/r/n", k="k", name="name")


@query("SELECT 'sales' AS role, c_custkey FROM customer WHERE (c_nationkey = 7 OR c_nationkey = 8) AND c_acctbal > 0 UNION ALL SELECT 'other', c_custkey FROM customer WHERE c_nationkey = 7 AND c_acctbal > 0 UNION ALL SELECT 'owner', c_custkey FROM customer UNION ALL SELECT 'refused', c_custkey FROM customer WHERE NOT (c_nationkey = 7 AND c_acctbal > 0)")
def row_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    p = Policies("owner").add(Policy("seven", col("c_nationkey") == 7)).add(Policy("eight", col("c_nationkey") == 8, roles=("sales",))).add(Policy("paid", col("c_acctbal") > 0, permissive=False))
    seen = [p.visible(c, role).select(lit(role).alias("role"), "c_custkey") for role in ("sales", "other", "owner")]
    return seen[0].unionByName(seen[1]).unionByName(seen[2]).unionByName(p.violations(c, "other").select(lit("refused").alias("role"), "c_custkey"))


@query("SELECT user_id AS k, value AS v FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE event_id % 7 <> 0 AND user_id % 2 = 0) e WHERE rn = 1")
def publication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletes are not published, and only even keys are; a subscriber applies the rest."""
    op = F.when(col("event_id") % 7 == 0, "delete").otherwise("update")
    rows = table(spark, sf_dir, "events").select(op.alias("op"), col("event_id").alias("seq"), col("user_id").alias("k"), col("value").alias("v"))
    sent = published(rows, ("insert", "update"), where=col("k") % 2 == 0)
    return C.apply_changes(spark.createDataFrame([], "k long, v double"), sent, ["k"])


@query("WITH big AS MATERIALIZED (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT a.o_custkey, a.n, b.most FROM big a, (SELECT max(n) AS most FROM big) b WHERE a.n * 2 > b.most")
def cte_materialized(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = R.materialized(table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")))
    return big.crossJoin(F.broadcast(big.agg(F.max("n").alias("most")))).filter("n * 2 > most")  # one row


@query("SELECT o_orderkey, count(*) AS n, max(l_quantity) AS most FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def partition_wise_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides lie in buckets of the key: neither the join nor the grouping shuffles."""
    o = K.bucketed(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 8)
    line = K.bucketed(table(spark, sf_dir, "lineitem").select(col("l_orderkey").alias("o_orderkey"), "l_quantity"), ["o_orderkey"], 8)
    return o.join(line.hint("merge"), "o_orderkey").groupBy("o_orderkey").agg(F.count("*").alias("n"), F.max("l_quantity").alias("most"))


@query("SELECT l_returnflag, round(exp(avg(ln(l_quantity))), 6) AS result FROM lineitem GROUP BY l_returnflag")
def aggregate_with_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A geometric mean by states of (sum of logarithms, count)."""
    import numpy as np

    found = U.aggregate(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", (0.0, 0), lambda s, v: (s[0] + float(np.log(v).sum()), s[1] + len(v)), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda s: float(np.exp(s[0] / s[1])) if s[1] else None, "double")
    return found.select("l_returnflag", F.round("result", 6).alias("result"))
