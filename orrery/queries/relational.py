"""Queries for plan nodes, joins, aggregates, windows, sorting, sets and subqueries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from orrery.operators import rewrites as R
from orrery.queries.registry import query, sql, table

# Projection, filters and predicates

sql("result_projection", "SELECT n_nationkey, n_nationkey * 2 + 1 AS odd, upper(n_name) AS name FROM {nation} WHERE n_regionkey >= 0")
sql("seq_scan", "SELECT count(*) AS n, count(l_shipdate) AS dated, min(l_quantity) AS least, max(l_quantity) AS most FROM {lineitem}")
sql("filter_and_or", "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE (l_quantity > 45 AND l_discount >= 0.09) OR (l_returnflag = 'R' AND l_linenumber = 7)")
sql("between_in_like", "SELECT p_partkey, p_name FROM {part} WHERE p_size BETWEEN 10 AND 20 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#23') AND p_type NOT LIKE '%XX%'")
sql("index_scan_equality", "SELECT o_orderkey, o_custkey, o_orderstatus FROM {orders} WHERE o_orderkey = 42 OR o_orderkey IN (7, 11)")
sql("min_max_scan", "SELECT min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM {orders}")
sql("is_distinct_from", "SELECT a.n_nationkey, b.n_regionkey AS other FROM {nation} a LEFT JOIN {nation} b ON a.n_nationkey = b.n_nationkey AND b.n_regionkey < 3 WHERE NOT (b.n_regionkey <=> 1)", "SELECT a.n_nationkey, b.n_regionkey AS other FROM nation a LEFT JOIN nation b ON a.n_nationkey = b.n_nationkey AND b.n_regionkey < 3 WHERE b.n_regionkey IS DISTINCT FROM 1")
sql("case_coalesce_nullif", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' ELSE 'high' END AS band, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment, greatest(c_nationkey, 12) AS g, least(c_nationkey, 12) AS l FROM {customer}")
sql("ilike_escape", "SELECT c_custkey FROM {customer} WHERE c_name ILIKE '%R#0000000_5%' OR c_name LIKE '100!%' ESCAPE '!'")
sql("regex_match", "SELECT doc_id, regexp_like(text, '(?i)license') AS has_licence FROM {documents}", "SELECT doc_id, regexp_matches(text, '(?i)license') AS has_licence FROM documents")
sql("quantified_array", "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE exists(array(3, 5, 7), x -> x = l_linenumber) AND forall(array(10.0D, 20.0D), x -> l_quantity > x)", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber = ANY([3, 5, 7]) AND l_quantity > 20")
sql("generated_column", "SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(18, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2))) AS net FROM {lineitem}")
sql("casts", "SELECT o_orderkey, CAST(o_orderkey AS STRING) AS as_text, CAST(o_totalprice AS BIGINT) AS dummy, CAST(o_orderdate AS DATE) AS day FROM {orders} WHERE o_totalprice = floor(o_totalprice)", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS as_text, CAST(o_totalprice AS BIGINT) AS dummy, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_totalprice = floor(o_totalprice)")
sql("try_cast", "SELECT p_partkey, try_cast(substr(p_brand, 7) AS INT) AS brand_number, try_cast(p_name AS INT) AS no_number FROM {part}")
sql("values_scan", "SELECT r.r_name, v.label FROM {region} r JOIN (VALUES (0, 'zero'), (1, 'one'), (2, NULL)) AS v(k, label) ON r.r_regionkey = v.k")
sql("limit_offset", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10")
sql("limit_zero", "SELECT o_orderkey FROM {orders} LIMIT 0")
sql("top_n_nulls", "SELECT doc, v FROM (SELECT doc_id AS doc, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE n_chars END AS v FROM {documents}) t ORDER BY v DESC NULLS FIRST, doc LIMIT 20")
sql("sort_nulls_last", "SELECT k, v FROM (SELECT c_custkey AS k, CASE WHEN c_nationkey = 3 THEN NULL ELSE c_nationkey END AS v FROM {customer}) t ORDER BY v ASC NULLS LAST, k")
sql("row_security", "SELECT c_custkey, c_name FROM (SELECT * FROM {customer} WHERE c_nationkey = 7) visible WHERE c_acctbal > 0")

# Joins

sql("inner_join", "SELECT o_orderkey, c_name FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY'")
sql("left_join", "SELECT c_custkey, count(o_orderkey) AS n FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey GROUP BY c_custkey")
sql("right_join", "SELECT n_name, s_suppkey FROM {supplier} RIGHT JOIN {nation} ON s_nationkey = n_nationkey")
sql("full_join", "SELECT a.k, b.k AS other FROM (SELECT n_nationkey AS k FROM {nation} WHERE n_nationkey < 15) a FULL JOIN (SELECT n_nationkey AS k FROM {nation} WHERE n_nationkey > 10) b ON a.k = b.k")
sql("cross_join_small", "SELECT r_name, n_name FROM {region} CROSS JOIN {nation}")
sql("join_using", "SELECT n_nationkey, a.n_name, b.n_regionkey FROM {nation} a JOIN {nation} b USING (n_nationkey)")
sql("natural_join", "SELECT n_nationkey, n_name, tag FROM {nation} NATURAL JOIN (SELECT n_nationkey, n_nationkey % 2 AS tag FROM {nation}) t")
sql("semi_join", "SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
sql("anti_join", "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
sql("in_subquery", "SELECT p_partkey FROM {part} WHERE p_partkey IN (SELECT l_partkey FROM {lineitem} WHERE l_quantity >= 50)")
sql("not_in_nulls", "SELECT n_nationkey FROM {nation} WHERE n_nationkey NOT IN (SELECT CASE WHEN r_regionkey = 4 THEN NULL ELSE r_regionkey END FROM {region})")
sql("not_in", "SELECT n_nationkey FROM {nation} WHERE n_nationkey NOT IN (SELECT s_nationkey FROM {supplier} WHERE s_acctbal > 5000)")
sql("merge_join", "SELECT /*+ MERGE(o) */ l_orderkey, l_linenumber, o_orderstatus FROM {lineitem} JOIN {orders} o ON l_orderkey = o_orderkey WHERE l_quantity < 3", "SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity < 3")
sql("shuffle_hash_join", "SELECT /*+ SHUFFLE_HASH(o) */ o_orderpriority, count(*) AS n FROM {lineitem} JOIN {orders} o ON l_orderkey = o_orderkey GROUP BY o_orderpriority", "SELECT o_orderpriority, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority")
sql("star_join", "SELECT r_name, p_brand, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS revenue FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey GROUP BY r_name, p_brand")
sql("lateral_join", "SELECT n_nationkey, t.c_custkey, t.c_acctbal FROM {nation}, LATERAL (SELECT c_custkey, c_acctbal FROM {customer} WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2) t")
sql("self_join_inequality", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
sql("skewed_join", "SELECT k.bucket, count(*) AS n FROM (SELECT CASE WHEN l_linenumber < 6 THEN 42 ELSE l_linenumber END AS bucket FROM {lineitem}) k JOIN (SELECT 42 AS bucket UNION ALL SELECT 6 UNION ALL SELECT 7) b ON k.bucket = b.bucket GROUP BY k.bucket")
sql("join_unique_inner", "SELECT DISTINCT c_custkey, c_name FROM {customer} JOIN (SELECT DISTINCT o_custkey FROM {orders} WHERE o_totalprice > 200000) o ON c_custkey = o_custkey")


@query("SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id AND floor(a.value) < floor(b.value) + 3 AND floor(b.value) < floor(a.value) + 3")
def range_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    a = e.select(F.col("event_id").alias("a"), "user_id", F.floor("value").alias("a_low"), (F.floor("value") + 3).alias("a_high"))
    b = e.select(F.col("event_id").alias("b"), "user_id", F.floor("value").alias("b_low"), (F.floor("value") + 3).alias("b_high"))
    return R.overlap_join(a, b, 10, "a_low", "a_high", "b_low", "b_high", ["user_id"]).filter("a < b").select("a", "b")


@query("SELECT c_custkey, s_suppkey FROM (SELECT c_custkey, s_suppkey, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(c_acctbal - s_acctbal), s_suppkey) AS rn FROM customer JOIN supplier ON c_nationkey = s_nationkey) t WHERE rn <= 2")
def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").alias("nation"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", F.col("s_nationkey").alias("nation"))
    return R.nearest_join(c, s, ["nation"], "c_acctbal", "s_acctbal", 2, "c_custkey", "s_suppkey").select("c_custkey", "s_suppkey")


@query("SELECT p_partkey FROM part WHERE p_retailprice > ALL (SELECT p_retailprice FROM part WHERE p_size = 10)")
def greater_than_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return R.greater_than_all(p, "p_retailprice", p.filter("p_size = 10"), "p_retailprice").select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_retailprice > ANY (SELECT p_retailprice FROM part WHERE p_size = 10)")
def greater_than_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return R.greater_than_any(p, "p_retailprice", p.filter("p_size = 10"), "p_retailprice").select("p_partkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 24 OR (l_quantity = 24 AND l_linenumber < 3)")
def row_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    less = R.row_less([F.col("l_quantity"), F.col("l_linenumber")], [F.lit(24.0), F.lit(3)])
    return table(spark, sf_dir, "lineitem").filter(less).select("l_orderkey", "l_linenumber")


def _quantified(sign: str, quantifier: str, name: str) -> None:
    inner = "(SELECT CASE WHEN s_suppkey % 10 < 8 THEN s_nationkey END FROM supplier WHERE s_acctbal > {0})"
    parts = [f"SELECT c_custkey, {k} AS k FROM customer WHERE c_nationkey {sign} {quantifier.upper()} {inner.format(x)}" for k, x in ((1, 9000), (2, 99999))]

    @query(" UNION ALL ".join(parts).replace("% 10 < 8", "% 10 < 10") + f" UNION ALL SELECT c_custkey, 3 FROM customer WHERE c_nationkey {sign} {quantifier.upper()} {inner.format(0)}", f"quantified_{name}_{quantifier}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c, s = (table(spark, sf_dir, t) for t in ("customer", "supplier"))
        some = s.select("s_acctbal", F.when(F.col("s_suppkey") % 10 < 8, F.col("s_nationkey")).alias("v"))
        each = [(1, s.filter("s_acctbal > 9000"), "s_nationkey"), (2, s.filter("s_acctbal > 99999"), "s_nationkey"), (3, some.filter("s_acctbal > 0"), "v")]
        found = [R.quantified(c, "c_nationkey", sign, quantifier, other, column).select("c_custkey", F.lit(k).alias("k")) for k, other, column in each]
        return found[0].unionByName(found[1]).unionByName(found[2])


for _sign, _name in (("=", "equal"), ("<>", "unequal"), ("<", "less"), (">=", "at_least")):
    for _q in ("any", "all"):
        _quantified(_sign, _q, _name)


@query("SELECT l_orderkey, l_linenumber, (l_quantity > 24 OR (l_quantity = 24 AND l_linenumber >= 3)) AS ge, (l_quantity = 24 AND l_linenumber = 3) AS eq, (l_quantity <> 24 OR l_linenumber <> 3) AS ne, (l_quantity < 24 OR (l_quantity = 24 AND l_linenumber <= 3)) AS le FROM lineitem")
def row_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = [F.col("l_quantity"), F.col("l_linenumber")], [F.lit(24.0), F.lit(3)]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(R.row_compare(left, sign, right).alias(n) for sign, n in ((">=", "ge"), ("=", "eq"), ("<>", "ne"), ("<=", "le"))))


# Aggregates

sql("group_aggregate", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS sum_price, min(l_discount) AS min_disc, max(l_tax) AS max_tax, count(DISTINCT l_suppkey) AS suppliers FROM {lineitem} GROUP BY l_returnflag, l_linestatus")
sql("plain_aggregate_empty", "SELECT count(*) AS n, sum(l_linenumber) AS s, max(l_quantity) AS m FROM {lineitem} WHERE l_quantity < 0")
sql("count_distinct_pairs", "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_partkey, l_suppkey) AS pairs FROM {lineitem}", "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT (l_partkey, l_suppkey)) AS pairs FROM lineitem")
sql("aggregate_filter", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_totalprice > 100000) AS big FROM {orders} GROUP BY o_orderpriority")
sql("having", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 15 AND min(o_totalprice) > 1000")
sql("rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping_id(l_returnflag, l_linestatus) AS g FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)", "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping_id(l_returnflag, l_linestatus) AS g FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
sql("cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus) AS gs, grouping(o_orderpriority) AS gp FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus) AS gs, grouping(o_orderpriority) AS gp FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
sql("grouping_sets", "SELECT l_returnflag, l_linenumber, sum(l_linenumber) AS s FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag, l_linenumber), (l_returnflag), ())")
sql("boolean_bit_aggregates", "SELECT p_brand, bool_and(p_size > 1) AS all_big, bool_or(p_size = 50) AS any_50, every(p_retailprice > 0) AS paid, bit_and(p_size) AS ba, bit_or(p_size) AS bo, bit_xor(p_size) AS bx FROM {part} GROUP BY p_brand", "SELECT p_brand, bool_and(p_size > 1) AS all_big, bool_or(p_size = 50) AS any_50, bool_and(p_retailprice > 0) AS paid, bit_and(p_size) AS ba, bit_or(p_size) AS bo, bit_xor(p_size) AS bx FROM part GROUP BY p_brand")
sql("statistics_aggregates", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sdp, round(var_samp(l_quantity), 5) AS vs, round(var_pop(l_quantity), 5) AS vp, round(avg(l_discount), 8) AS a FROM {lineitem} GROUP BY l_returnflag")
sql("regression_aggregates", "SELECT l_linestatus, round(corr(l_extendedprice, l_quantity), 6) AS r, round(covar_pop(l_discount, l_quantity), 6) AS cp, round(covar_samp(l_discount, l_quantity), 6) AS cs, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 1) AS icpt, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, regr_count(l_extendedprice, l_quantity) AS n, round(regr_avgx(l_extendedprice, l_quantity), 6) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 3) AS ay FROM {lineitem} GROUP BY l_linestatus")
sql("regression_sums", "SELECT round(regr_sxx(l_tax, l_quantity) / 1000, 3) AS sxx, round(regr_syy(l_tax, l_quantity), 3) AS syy, round(regr_sxy(l_tax, l_quantity), 2) AS sxy FROM {lineitem}")
sql("ordered_set_aggregates", "SELECT p_brand, CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY p_size) AS INT) AS disc, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY p_retailprice), 6) AS cont FROM {part} GROUP BY p_brand")
sql("mode_aggregate", "SELECT l_returnflag, mode() WITHIN GROUP (ORDER BY l_linenumber) AS m FROM {lineitem} GROUP BY l_returnflag")
sql("string_agg_ordered", "SELECT n_regionkey, listagg(n_name, ', ') WITHIN GROUP (ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
sql("functional_dependency", "SELECT c_custkey, any_value(c_name) AS c_name, count(o_orderkey) AS n FROM {customer} JOIN {orders} ON c_custkey = o_custkey GROUP BY c_custkey")
sql("select_distinct", "SELECT DISTINCT p_brand, p_size FROM {part}")
sql("group_without_aggregates", "SELECT o_orderstatus, o_orderpriority FROM {orders} GROUP BY o_orderstatus, o_orderpriority")
sql("two_level_aggregate", "SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey) t GROUP BY n")


@query("SELECT p_brand, 1 + count(*) FILTER (WHERE p_size < 20) AS r, 1 + count(DISTINCT p_size) FILTER (WHERE p_size < 20) AS dr, round(count(*) FILTER (WHERE p_size < 20) / count(p_size), 9) AS pr, round((1 + count(*) FILTER (WHERE p_size <= 20)) / (1 + count(p_size)), 9) AS cd FROM part GROUP BY p_brand")
def hypothetical_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, at = F.col("p_size"), F.lit(20)
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(R.hypothetical_rank(v, at).alias("r"), R.hypothetical_dense_rank(v, at).alias("dr"), F.round(R.hypothetical_percent_rank(v, at), 9).alias("pr"), F.round(R.hypothetical_cume_dist(v, at), 9).alias("cd"))


@query("SELECT n_regionkey, array_to_string(array_agg(coalesce(CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_name END, '?') ORDER BY n_nationkey), ',') AS names FROM nation GROUP BY n_regionkey")
def array_agg_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("n_nationkey") % 4 != 0, F.col("n_name"))
    lists = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(R.array_agg(name, F.col("n_nationkey")).alias("l"))
    return lists.select("n_regionkey", F.array_join("l", ",", "?").alias("names"))


@query("SELECT DISTINCT ON (c_nationkey) c_nationkey, c_custkey, c_acctbal FROM customer ORDER BY c_nationkey, c_acctbal DESC, c_custkey")
def distinct_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.distinct_on(table(spark, sf_dir, "customer"), ["c_nationkey"], ["-c_acctbal", "c_custkey"]).select("c_nationkey", "c_custkey", "c_acctbal")


@query("SELECT n_nationkey, unnest([n_nationkey, n_regionkey, 7]) AS a, unnest(['x', 'y']) AS b FROM nation")
def lockstep_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return R.lockstep(n, a=F.array("n_nationkey", "n_regionkey", F.lit(7)), b=F.array(F.lit("x"), F.lit("y"))).select("n_nationkey", "a", "b")


@query()
def approximate_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"))


@query("SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY o_custkey")
def pivot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return wide.select("o_custkey", *(F.coalesce(c, F.lit(0)).alias(c.lower()) for c in ("F", "O", "P")))


# Windows

sql("window_ranks", "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS r, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd, ntile(3) OVER w AS nt FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
sql("window_offsets", "SELECT event_id, lag(value) OVER w AS before, lead(value, 2, -1.0D) OVER w AS after, first_value(event_type) OVER w AS f, last_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, nth_value(event_id, 2) OVER w AS second FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)", "SELECT event_id, lag(value) OVER w AS before, lead(value, 2, -1.0) OVER w AS after, first_value(event_type) OVER w AS f, last_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, nth_value(event_id, 2) OVER w AS second FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
sql("window_rows_frame", "SELECT l_orderkey, l_linenumber, sum(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s, count(*) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM {lineitem}", "SELECT l_orderkey, l_linenumber, CAST(sum(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s, count(*) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM lineitem")
sql("window_range_frame", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS near FROM {part}")
sql("window_share", "SELECT s_suppkey, round(s_acctbal / sum(s_acctbal) OVER (PARTITION BY s_nationkey), 6) AS share FROM {supplier} WHERE s_acctbal > 0")


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS near FROM part")
def window_groups_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.groups_frame(table(spark, sf_dir, "part"), ["p_brand"], "p_size", 1, 2, lambda: F.count("*"), "near").select("p_partkey", "near")


def _excluded(kind: str) -> None:
    frame = {"current row": "CURRENT ROW", "group": "GROUP", "ties": "TIES"}[kind]
    part = "PARTITION BY l_orderkey ORDER BY l_returnflag ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
    columns = ", ".join(f"{f}(l_quantity) OVER ({part} EXCLUDE {frame}) AS {n}" for f, n in (("sum", "s"), ("count", "n"), ("min", "least"), ("max", "most")))

    @query(f"SELECT l_orderkey, l_linenumber, {columns}, round(avg(l_quantity) OVER ({part} EXCLUDE {frame}), 6) AS mean FROM lineitem", f"window_exclude_{kind.replace(' ', '_')}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        named = {"s": "sum", "n": "count", "least": "min", "most": "max", "mean": "avg"}
        rows = R.excluded_all(table(spark, sf_dir, "lineitem"), named, "l_quantity", ["l_orderkey"], ["l_returnflag"], Window.unboundedPreceding, Window.unboundedFollowing, kind)
        return rows.select("l_orderkey", "l_linenumber", "s", "n", "least", "most", F.round("mean", 6).alias("mean"))


for _kind in ("current row", "group", "ties"):
    _excluded(_kind)


@query("SELECT event_id, sum(floor(value)) OVER (PARTITION BY user_id ORDER BY event_type ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP) AS s, min(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW) AS m FROM events")
def window_exclude_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("f", F.floor("value").cast("double"))
    one = R.excluded(e, "sum", "f", ["user_id"], ["event_type"], Window.unboundedPreceding, 0, "group", "s")
    return R.excluded(one, "min", "event_id", ["user_id"], ["ts", "event_id"], -3, 2, "current row", "m").select("event_id", "s", "m")


# Sets

sql("union_all", "SELECT n_name AS name FROM {nation} UNION ALL SELECT r_name FROM {region} UNION ALL SELECT n_name FROM {nation} WHERE n_nationkey < 3")
sql("union_distinct", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}")
sql("intersect", "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}")
sql("intersect_all", "SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey FROM {supplier}")
sql("except_distinct", "SELECT o_custkey AS k FROM {orders} EXCEPT SELECT c_custkey FROM {customer} WHERE c_acctbal > 0")
sql("except_all", "SELECT o_custkey AS k FROM {orders} EXCEPT ALL SELECT c_custkey FROM {customer}")
sql("merge_append", "SELECT k, src FROM (SELECT c_custkey AS k, 'c' AS src FROM {customer} UNION ALL SELECT s_suppkey, 's' FROM {supplier}) t ORDER BY k, src")

# Common table expressions and subqueries

sql("cte_used_twice", "WITH big AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS total FROM {orders} GROUP BY o_custkey) SELECT o_custkey FROM big WHERE total > (SELECT avg(total) * 1.5 FROM big)")
sql("recursive_union_all", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t")
sql("scalar_subquery", "SELECT c_custkey FROM {customer} WHERE c_acctbal > (SELECT max(s_acctbal) - 500 FROM {supplier})")
sql("correlated_subquery", "SELECT l_orderkey, l_linenumber FROM {lineitem} l WHERE l_quantity > (SELECT 1.9 * avg(l_quantity) FROM {lineitem} i WHERE i.l_partkey = l.l_partkey)")
sql("correlated_scalar_select", "SELECT n_nationkey, (SELECT count(*) FROM {customer} WHERE c_nationkey = n_nationkey) AS customers FROM {nation}")


@query("WITH RECURSIVE t(n) AS (SELECT 0 UNION SELECT (n * 7 + 3) % 25 FROM t) SELECT n FROM t")
def recursive_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.recursive_union(spark.range(1).select(F.col("id").cast("int").alias("n")), lambda t: t.select(((F.col("n") * 7 + 3) % 25).alias("n")))


@query("WITH RECURSIVE t(k, parent, level, branch) AS (SELECT CAST(0 AS INT), CAST(NULL AS INT), 0, '0' UNION ALL SELECT n.n_nationkey, t.k, level + 1, branch || '~' || n.n_nationkey FROM nation n JOIN t ON n.n_nationkey > 0 AND (n.n_nationkey - 1) // 3 = t.k) SELECT k AS key, level, branch FROM t")
def connect_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.expr("CASE WHEN n_nationkey > 0 THEN (n_nationkey - 1) DIV 3 END").cast("int").alias("parent"))
    return R.connect_by(tree, "k", "parent", 0).select("key", "level", "branch")


@query("SELECT o_orderkey AS key, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS INT) AS level FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders) ORDER BY 1")
def connect_by_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer, each below the one before it."""
    o = table(spark, sf_dir, "orders")
    own = o.join(F.broadcast(o.agg(F.min("o_custkey").alias("o_custkey"))), "o_custkey")  # one row
    chain = own.select(F.col("o_orderkey").alias("k"), F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("parent"))
    return R.connect_by(chain, "k", "parent", chain.filter("parent IS NULL").first()["k"]).select("key", "level")


@query()
def sample_bernoulli(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").sample(False, 0.1, 42).select("l_orderkey", "l_linenumber")


@query()
def sample_system_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.rand(7)).limit(100).select("o_orderkey")


sql("generate_series", "SELECT id AS n FROM range(1, 101, 3)", "SELECT generate_series AS n FROM generate_series(1, 100, 3)")
sql("generate_series_dates", "SELECT explode(sequence(DATE'2024-01-30', DATE'2024-03-02', INTERVAL 1 DAY)) AS d", "SELECT CAST(generate_series AS DATE) AS d FROM generate_series(TIMESTAMP '2024-01-30', TIMESTAMP '2024-03-02', INTERVAL 1 DAY)")
sql("unnest_ordinality", "SELECT vec_id, pos + 1 AS place, round(CAST(x AS DOUBLE), 5) AS x FROM {embeddings} LATERAL VIEW posexplode(embedding) t AS pos, x", "SELECT vec_id, unnest(generate_series(1, len(embedding))) AS place, round(CAST(unnest(embedding) AS DOUBLE), 5) AS x FROM embeddings")
sql("crosstab", "SELECT * FROM (SELECT l_returnflag, l_linenumber, l_quantity FROM {lineitem}) PIVOT (max(l_quantity) FOR l_linenumber IN (1 AS one, 2 AS two, 7 AS seven))", "SELECT l_returnflag, max(l_quantity) FILTER (WHERE l_linenumber = 1) AS one, max(l_quantity) FILTER (WHERE l_linenumber = 2) AS two, max(l_quantity) FILTER (WHERE l_linenumber = 7) AS seven FROM lineitem GROUP BY l_returnflag")
sql("unpivot", "SELECT p_partkey, what, amount FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price FROM {part}) UNPIVOT (amount FOR what IN (size, price))", "SELECT p_partkey, 'size' AS what, CAST(p_size AS DOUBLE) AS amount FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part")
