"""Queries for scalar functions by family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from orrery.functions import arrays as A, datetimes as D, extras as X, fuzzy as Z, geometry as G, jsons as J, maths as M, network as N, ranges as R, search as T, strings as S
from orrery.operators.rewrites import spread
from orrery.queries.registry import ORACLE, query, sql, table

col, lit = F.col, F.lit

# Strings

sql("string_lengths", "SELECT p_partkey, length(p_name) AS l, char_length(p_name) AS cl, octet_length(encode(p_name, 'UTF-8')) AS ol, bit_length(p_name) AS bl FROM {part}", "SELECT p_partkey, length(p_name) AS l, length(p_name) AS cl, strlen(p_name) AS ol, bit_length(p_name) AS bl FROM part")
sql("string_case_pad", "SELECT n_nationkey, upper(n_name) AS u, lower(n_name) AS l, lpad(n_name, 12, '*') AS lp, rpad(n_name, 12, 'ab') AS rp, reverse(n_name) AS r, repeat(n_name, 2) AS rr FROM {nation}")
sql("string_positions", "SELECT n_nationkey, position('A' IN n_name) AS p, instr(n_name, 'TI') AS i, substring(n_name, 2, 3) AS s, replace(n_name, 'A', 'xx') AS r, translate(n_name, 'AEI', '12') AS t, overlay(n_name PLACING 'ZZ' FROM 2 FOR 1) AS o FROM {nation}", "SELECT n_nationkey, position('A' IN n_name) AS p, instr(n_name, 'TI') AS i, substring(n_name, 2, 3) AS s, replace(n_name, 'A', 'xx') AS r, translate(n_name, 'AEI', '12') AS t, substr(n_name, 1, 1) || 'ZZ' || substr(n_name, 3) AS o FROM nation")
sql("string_split_join", "SELECT c_custkey, split_part(c_name, '#', 2) AS part, concat_ws('-', c_mktsegment, CAST(NULL AS STRING), c_name) AS joined, ascii(c_name) AS a, chr(65 + c_nationkey) AS c FROM {customer}", "SELECT c_custkey, split_part(c_name, '#', 2) AS part, concat_ws('-', c_mktsegment, NULL, c_name) AS joined, ascii(c_name) AS a, chr(65 + c_nationkey) AS c FROM customer")
sql("string_digests", "SELECT c_custkey, md5(c_name) AS m, sha2(c_name, 256) AS s, lower(hex(c_name)) AS h, base64(c_name) AS b FROM {customer}", "SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s, lower(hex(c_name)) AS h, base64(c_name::BLOB) AS b FROM customer")
sql("regexp_functions", "SELECT c_custkey, regexp_extract(c_name, '([0-9]+)', 1) AS digits, regexp_replace(c_name, '[aeiou]', '_') AS gaps, size(split(c_mktsegment, 'I')) AS parts FROM {customer}", "SELECT c_custkey, regexp_extract(c_name, '([0-9]+)', 1) AS digits, regexp_replace(c_name, '[aeiou]', '_', 'g') AS gaps, len(string_split(c_mktsegment, 'I')) AS parts FROM customer")
sql("regexp_matches_rows", "SELECT n_nationkey, explode(regexp_extract_all(n_name, '([AEIOU])', 1)) AS vowel FROM {nation}", "SELECT n_nationkey, unnest(regexp_extract_all(n_name, '[AEIOU]')) AS vowel FROM nation")
sql("regexp_split_rows", "SELECT n_nationkey, explode(split(n_name, '[AE]+')) AS piece FROM {nation}", "SELECT n_nationkey, unnest(regexp_split_to_array(n_name, '[AE]+')) AS piece FROM nation")


@query("SELECT n_nationkey, left(n_name, 3) AS l, left(n_name, -2) AS ln, right(n_name, 3) AS r, right(n_name, -2) AS rn, n_name || '' AS c, ltrim(n_name, 'AB') AS lt, rtrim(n_name, 'AN') AS rt, trim(n_name, 'AN') AS bt FROM nation")
def string_left_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = col("n_name")
    return table(spark, sf_dir, "nation").select("n_nationkey", S.left(n, 3).alias("l"), S.left(n, -2).alias("ln"), S.right(n, 3).alias("r"), S.right(n, -2).alias("rn"), S.concat(n, lit(None), lit("")).alias("c"), S.ltrim(n, "AB").alias("lt"), S.rtrim(n, "AN").alias("rt"), S.btrim(n, "AN").alias("bt"))


@query("SELECT n_nationkey, regexp_replace(n_name, '([AEIOU])', '<\\1>') AS first, regexp_replace(n_name, '([AEIOU])', '<\\1>', 'g') AS every, regexp_full_match(n_name, '(A|B).*A|.*[QZ].*') AS s FROM nation")
def regexp_replace_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = col("n_name")
    return table(spark, sf_dir, "nation").select("n_nationkey", S.regexp_replace(n, "([AEIOU])", r"<\1>").alias("first"), S.regexp_replace(n, "([AEIOU])", r"<\1>", "g").alias("every"), n.rlike(S.similar_to("(A|B)%A|%[QZ]%")).alias("s"))


@query("SELECT p_partkey, substr(p_name, 1, 2) AS before, string_split(p_name, 'a') AS parts, printf('%x', p_size) AS hx, 'Part ' || p_brand || ' at ''' || replace(p_name, '''', '''''') || '''' AS shown FROM part")
def string_windows_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", S.substr(n, -1, 4).alias("before"), S.string_to_array(n, "a").alias("parts"), S.to_hex(col("p_size")).alias("hx"), S.format_text("Part %s at %L", col("p_brand"), n).alias("shown"))


# Numbers

sql("math_basic", "SELECT l_orderkey, l_linenumber, abs(l_tax - 0.05D) AS a, ceil(l_quantity / 7) AS c, floor(l_quantity / 7) AS f, sign(l_quantity - 25) AS s, round(sqrt(l_quantity), 9) AS q, mod(CAST(l_quantity AS INT), 7) AS m, CAST(l_quantity AS INT) DIV 7 AS d FROM {lineitem}", "SELECT l_orderkey, l_linenumber, abs(l_tax - 0.05) AS a, ceil(l_quantity / 7) AS c, floor(l_quantity / 7) AS f, sign(l_quantity - 25) AS s, round(sqrt(l_quantity), 9) AS q, CAST(l_quantity AS INT) % 7 AS m, CAST(l_quantity AS INT) // 7 AS d FROM lineitem")
sql("math_powers", "SELECT p_partkey, round(exp(p_size / 50), 8) AS e, round(ln(p_size), 8) AS l, round(log10(p_size), 8) AS lg, round(power(p_size, 1.5D), 6) AS p, round(cbrt(p_size), 8) AS c, round(pi(), 8) AS pi, factorial(CAST(p_size % 15 AS INT)) AS f FROM {part}", "SELECT p_partkey, round(exp(p_size / 50), 8) AS e, round(ln(p_size), 8) AS l, round(log(p_size), 8) AS lg, round(power(p_size, 1.5), 6) AS p, round(cbrt(p_size), 8) AS c, round(pi(), 8) AS pi, CAST(factorial(CAST(p_size % 15 AS INT)) AS BIGINT) AS f FROM part")
sql("math_trigonometry", "SELECT p_partkey, round(sin(p_size), 8) AS s, round(cos(p_size), 8) AS c, round(tan(p_size / 40), 8) AS t, round(atan2(p_size, 7), 8) AS a, round(asin(p_size / 60), 8) AS asn, round(acos(p_size / 60), 8) AS ac, round(radians(p_size), 8) AS r, round(degrees(p_size), 6) AS d, round(sinh(p_size / 20), 6) AS sh, round(cosh(p_size / 20), 6) AS ch, round(tanh(p_size / 20), 8) AS th, round(asinh(p_size), 8) AS ash FROM {part}")


@query("SELECT l_orderkey, l_linenumber, trunc(l_extendedprice / 1000) AS t, round_even(l_quantity / 4, 0) AS r, round(log(l_quantity), 8) AS lg, gcd(CAST(l_quantity AS BIGINT), 36) AS g, lcm(CAST(l_quantity AS BIGINT), 12) AS lc FROM lineitem")
def math_dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = col("l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", M.trunc(col("l_extendedprice") / 1000).alias("t"), M.round_float(q / 4).alias("r"), F.round(M.log(q), 8).alias("lg"), M.gcd(q, lit(36)).alias("g"), M.lcm(q, lit(12)).alias("lc"))


@query()
def math_degrees_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (col("event_id") * 15 % 720).cast("double")
    shown = lambda c, n: (F.round(c, 8) + 0.0).alias(n)
    return table(spark, sf_dir, "events").select("event_id", shown(M.sind(k), "s"), shown(M.cosd(k), "c"), shown(M.atan2d(k - 100, lit(50.0)), "a"), shown(M.asind(k / 720.0), "asn"))


ORACLE["math_degrees_exact"] = "SELECT event_id, round(sin(radians(k)), 8) + 0.0 AS s, round(cos(radians(k)), 8) + 0.0 AS c, round(degrees(atan2(k - 100, 50)), 8) + 0.0 AS a, round(degrees(asin(k / 720.0)), 8) + 0.0 AS asn FROM (SELECT event_id, event_id * 15 % 720 AS k FROM events) t"


sql("width_bucket", "SELECT o_orderkey, width_bucket(o_totalprice, 0, 500000, 10) AS b FROM {orders}", "SELECT o_orderkey, CASE WHEN o_totalprice < 0 THEN 0 WHEN o_totalprice >= 500000 THEN 11 ELSE CAST(floor(o_totalprice / 50000) AS INT) + 1 END AS b FROM orders")

# Dates

sql("date_parts", "SELECT o_orderkey, extract(YEAR FROM o_orderdate) AS y, extract(MONTH FROM o_orderdate) AS m, extract(DAY FROM o_orderdate) AS d, extract(QUARTER FROM o_orderdate) AS q, extract(WEEK FROM o_orderdate) AS w, dayofyear(o_orderdate) AS doy, weekday(o_orderdate) + 1 AS iso FROM {orders}", "SELECT o_orderkey, extract(YEAR FROM o_orderdate) AS y, extract(MONTH FROM o_orderdate) AS m, extract(DAY FROM o_orderdate) AS d, extract(QUARTER FROM o_orderdate) AS q, extract(WEEK FROM o_orderdate) AS w, dayofyear(o_orderdate) AS doy, isodow(o_orderdate) AS iso FROM orders")
sql("date_trunc", "SELECT CAST(date_trunc('MONTH', o_orderdate) AS DATE) AS m, count(*) AS n FROM {orders} GROUP BY 1", "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS m, count(*) AS n FROM orders GROUP BY 1")
sql("date_arithmetic", "SELECT l_orderkey, l_linenumber, datediff(CAST(l_shipdate AS DATE), CAST(o_orderdate AS DATE)) AS days, CAST(add_months(CAST(o_orderdate AS DATE), 3) AS DATE) AS later, last_day(o_orderdate) AS month_end FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey", "SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE) AS days, CAST(CAST(o_orderdate AS DATE) + INTERVAL 3 MONTH AS DATE) AS later, last_day(o_orderdate) AS month_end FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
sql("time_buckets", "SELECT CAST(date_trunc('HOUR', ts) AS STRING) AS hour, event_type, count(*) AS n FROM {events} GROUP BY 1, 2", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d %H:%M:%S') AS shown, isodow(o_orderdate) AS iso, o_orderdate < TIMESTAMP '2030-01-01' AND TIMESTAMP '1996-01-01' < o_orderdate + INTERVAL 30 DAY AS o FROM orders")
def date_formats_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = col("o_orderdate")
    o = D.overlaps(d, d + F.expr("INTERVAL 30 DAY"), lit("1996-01-01").cast("timestamp_ntz"), lit("2030-01-01").cast("timestamp_ntz"))
    return table(spark, sf_dir, "orders").select("o_orderkey", D.to_char(d, "YYYY/MM/DD HH24:MI:SS").alias("shown"), D.isodow(d).alias("iso"), o.alias("o"))


@query("SELECT o_orderkey, datepart('year', a) * 12 + datepart('month', a) AS months, datepart('day', a) AS days FROM (SELECT o_orderkey, age(TIMESTAMP '2026-03-15 00:00:00', date_trunc('day', o_orderdate)) AS a FROM orders) t")
def date_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = D.age(lit("2026-03-15 00:00:00").cast("timestamp_ntz"), F.date_trunc("day", "o_orderdate").cast("timestamp_ntz"))
    return table(spark, sf_dir, "orders").select("o_orderkey", age.alias("a")).select("o_orderkey", "a.months", "a.days")


@query("SELECT event_id, (d // 30)::INT AS months, (d % 30)::INT AS days, h % 86400 * 1000000 AS micros FROM (SELECT event_id, event_id % 70 + event_id * 7000 % 500000 // 86400 AS d, event_id * 7000 % 500000 AS h FROM events) t")
def date_justify(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = col("event_id")
    span = F.struct(lit(0).alias("months"), (k % 70).cast("int").alias("days"), (k * 7000 % 500000 * 1000000).alias("micros"))
    return table(spark, sf_dir, "events").select("event_id", D.justify_interval(span).alias("i")).select("event_id", "i.*")


# Arrays

sql("array_basic", "SELECT vec_id, size(embedding) AS n, round(CAST(element_at(embedding, 1) AS DOUBLE), 5) AS first, round(CAST(array_max(embedding) AS DOUBLE), 5) AS most, size(slice(embedding, 2, 3)) AS some FROM {embeddings}", "SELECT vec_id, len(embedding) AS n, round(CAST(embedding[1] AS DOUBLE), 5) AS first, round(CAST(list_max(embedding) AS DOUBLE), 5) AS most, len(embedding[2:4]) AS some FROM embeddings")


@query("WITH b AS (SELECT o_custkey, list_sort(list(l_linenumber)) AS a FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey) SELECT o_custkey, array_to_string(list_sort(list_distinct(a)), ',') AS u, nullif(coalesce(list_position(a, 4), 0), 0) AS p, list_contains(a, 2) AND (list_contains(a, 5) OR list_contains(a, 6)) AS q, array_to_string(list_transform(a, lambda x: CASE WHEN x = 1 THEN 9 ELSE x END), ',') AS r, len(a[2:3]) AS s FROM b")
def array_dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), col("l_orderkey") == col("o_orderkey"))
    a = col("a")
    shown = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    grouped = lines.groupBy("o_custkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("a"))
    return grouped.select("o_custkey", shown(A.uniq(a)).alias("u"), A.array_position(a, 4).alias("p"), A.query_int(a, "2 & (5 | 6)").alias("q"), shown(A.array_replace(a, lit(1), lit(9))).alias("r"), F.size(A.array_slice(a, 2, 3)).alias("s"))


@query("SELECT k, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS u, array_to_string(list_sort(list_intersect(a, b)), ',') AS i, list_has_all(a, b) AS c, list_has_any(a, b) AS o FROM (SELECT n_nationkey AS k, [n_nationkey % 3, n_nationkey % 4, n_nationkey % 5] AS a, [n_nationkey % 2, n_nationkey % 5] AS b FROM nation) t")
def array_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select(k.alias("k"), F.array(k % 3, k % 4, k % 5).alias("a"), F.array(k % 2, k % 5).alias("b"))
    shown = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return rows.select("k", shown(A.union(col("a"), col("b"))).alias("u"), shown(A.intersect(col("a"), col("b"))).alias("i"), A.contains(col("a"), col("b")).alias("c"), A.overlaps(col("a"), col("b")).alias("o"))


# JSON


@query("SELECT event_id, json_extract_string(props, '$.' || k) AS v, k FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events) t")
def json_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.explode(J.each_text(col("props"))).alias("k", "v"))
    return rows.select("event_id", "k", "v")


@query("SELECT n_nationkey, '[' || n_nationkey || ',' || n_regionkey || ']' AS a, json_object('k', n_nationkey, 'name', n_name)::VARCHAR AS o, n_nationkey % 2 = 0 AS has FROM nation")
def json_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = col("n_nationkey")
    doc = F.when(k % 2 == 0, J.build_object(even=k)).otherwise(J.build_object(odd=k))
    return table(spark, sf_dir, "nation").select("n_nationkey", J.build_array(k, col("n_regionkey")).alias("a"), J.build_object(k=k, name=col("n_name")).alias("o"), J.has_key(doc, "even").alias("has"))


sql("row_to_json", "SELECT n_nationkey, to_json(named_struct('n', n_nationkey, 'r', n_regionkey)) AS j FROM {nation}", "SELECT n_nationkey, json_object('n', n_nationkey, 'r', n_regionkey)::VARCHAR AS j FROM nation")


@query("SELECT event_id, (json_extract_string(props, '$.k')::INT % 3 = 0) AS c, (json_extract_string(props, '$.k')::INT % 4 < 2) AS l FROM events")
def json_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = J.path(col("props"), "k").cast("int")
    doc = F.concat(lit('{"a":1,"b":{"c":['), k % 3, lit(',7]},"k":'), k, lit("}"))
    part = F.concat(lit('{"b":{"c":[7,0]},"k":'), k, lit("}"))
    one = F.concat(lit("["), k % 4, lit("]"))
    return table(spark, sf_dir, "events").select("event_id", J.contains(doc, part).alias("c"), J.contains(lit("[0,1,9]"), one).alias("l"))


@query("SELECT event_id, '{\"b\": ' || (event_id % 5) || ', \"aa\": ' || json_extract_string(props, '$.k') || '}' AS n FROM events")
def json_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.concat(lit('{"aa":1,"b":'), col("event_id") % 5, lit(',"aa":'), J.path(col("props"), "k"), lit("}"))
    return table(spark, sf_dir, "events").select("event_id", J.normal(doc).alias("n"))


# Ranges


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b, al < bh AND bl < ah AS o, ah = bl OR bh = al AS adj, CASE WHEN al < bh AND bl < ah THEN '[' || greatest(al, bl) || ',' || least(ah, bh) || ')' ELSE 'empty' END AS i, '[' || least(al, bl) || ',' || greatest(ah, bh) || ')' AS m, CASE WHEN al <= bh AND bl <= ah THEN '[' || least(al, bl) || ',' || greatest(ah, bh) || ')' END AS u, al <= bl AND bh <= ah AS c, ah <= bl AS l FROM (SELECT n_nationkey, n_nationkey AS al, n_nationkey + 1 + n_regionkey AS ah FROM nation) a, (SELECT n_nationkey, n_nationkey * 2 % 11 AS bl, n_nationkey * 2 % 11 + 3 AS bh FROM nation) b")
def range_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = col("n_nationkey")
    n = table(spark, sf_dir, "nation")
    a = n.select(k.alias("a"), R.int4range(k, k + 1 + col("n_regionkey")).alias("x"))
    b = n.select(k.alias("b"), R.int4range(k * 2 % 11, k * 2 % 11 + 2, "[]").alias("y"))
    x, y = col("x"), col("y")
    return a.crossJoin(b).select("a", "b", R.overlaps(x, y).alias("o"), R.adjacent(x, y).alias("adj"), R.show(R.intersection(x, y)).alias("i"), R.show(R.merge(x, y)).alias("m"), R.show(R.union(x, y)).alias("u"), R.contains(x, y).alias("c"), R.strictly_left(x, y).alias("l"))


@query("SELECT n_nationkey, n_nationkey >= 5 AND n_nationkey < 12 AS inside, n_nationkey >= 3 AS empty, '[5,12)' AS shown FROM nation")
def range_basics(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = col("n_nationkey")
    r = R.int4range(lit(4), lit(11), "(]")
    own = R.numrange(F.least(k, lit(3)), lit(3), "[)")
    return table(spark, sf_dir, "nation").select("n_nationkey", R.contains_value(r, k).alias("inside"), R.isempty(own).alias("empty"), R.show(r).alias("shown"))


# Full text, spelling


@query(r"SELECT doc_id, list_contains(w, 'the') AND NOT list_contains(w, 'der') AS hit FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents) t")
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = T.to_tsquery("the & !der", "simple")
    return table(spark, sf_dir, "documents").select("doc_id", T.matches_text(col("text"), q, "simple").alias("hit"))


def _words(text: str) -> str:
    """SQL over p: the words of all documents and their places."""
    return r"WITH p AS (SELECT doc_id, unnest(w) AS lex, unnest(generate_series(1, len(w))) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents) t) " + text


@query()
def text_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexemes of each document, how many places they have, and where the last one begins."""
    v = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", T.to_tsvector(col("text"), "simple").alias("v"))
    places = F.aggregate("v", lit(0), lambda n, e: n + F.size(e["positions"]))
    return v.filter(F.size("v") > 0).select("doc_id", T.length(col("v")).alias("n"), places.alias("places"), F.element_at("v", -1)["lexeme"].alias("last"), F.element_at("v", -1)["positions"][0]["at"].alias("at"))


ORACLE["text_vectors"] = _words("SELECT doc_id, count(DISTINCT lex)::INT AS n, count(*)::INT AS places, max(lex) AS last, (min(pos) FILTER (WHERE lex = top))::INT AS at FROM (SELECT *, max(lex) OVER (PARTITION BY doc_id) AS top FROM p) q GROUP BY doc_id")


@query()
def text_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`the` weighs A and `der` B; only those places stay, and a query asks for A."""
    v = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", T.setweight(T.setweight(T.to_tsvector(col("text"), "simple"), "A", ["the"]), "B", ["der"]).alias("v"))
    some = v.select("doc_id", T.ts_filter(col("v"), "ab").alias("f"), T.matches(col("v"), T.to_tsquery("the:A | der:C", "simple")).alias("hit"))
    return some.filter(F.size("f") > 0).select("doc_id", F.size("f").alias("n"), F.aggregate("f", lit(0), lambda n, e: n + F.size(e["positions"])).alias("places"), "hit")


ORACLE["text_weights"] = _words("SELECT doc_id, count(DISTINCT lex)::INT AS n, count(*)::INT AS places, bool_or(lex = 'the') AS hit FROM p WHERE lex IN ('the', 'der') GROUP BY doc_id")


@query()
def text_rank_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", T.to_tsvector(col("text"), "simple").alias("v"))
    q = T.to_tsquery("the | and", "simple")
    return v.filter(T.matches(col("v"), q)).select("doc_id", F.round(T.rank(col("v"), q), 6).alias("r"))


ORACLE["text_rank_documents"] = _words("SELECT doc_id, round(sum(w) / 2, 6) AS r FROM (SELECT doc_id, 0.1 / power(row_number() OVER (PARTITION BY doc_id, lex ORDER BY pos), 2) / 1.64493406685 AS w FROM p WHERE lex IN ('the', 'and')) q GROUP BY doc_id")


@query()
def text_vector_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector and its copy put together: each word comes twice, the copy after the whole first."""
    v = table(spark, sf_dir, "part").select("p_partkey", T.to_tsvector(col("p_name"), "simple").alias("v"), T.array_to_tsvector(F.split("p_name", " ")).alias("a"))
    return v.select("p_partkey", F.translate(T.show(T.concat(col("v"), T.setweight(col("v"), "A"))), "'", "").alias("c"), F.translate(T.show(col("a")), "'", "").alias("a"))


ORACLE["text_vector_concat"] = "WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS l FROM part), p AS (SELECT p_partkey, len(l) AS n, unnest(l) AS x, unnest(generate_series(1, len(l))) AS i FROM w), g AS (SELECT p_partkey, x, n, list(i ORDER BY i) AS i FROM p GROUP BY ALL) SELECT p_partkey, string_agg(x || ':' || array_to_string(list_concat([k::VARCHAR for k in i], [(k + n) || 'A' for k in i]), ','), ' ' ORDER BY x) AS c, string_agg(x, ' ' ORDER BY x) AS a FROM g GROUP BY p_partkey"


@query()
def text_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = T.phraseto_tsquery("of the", "simple")
    d = table(spark, sf_dir, "documents").select("doc_id", "text", T.to_tsvector(col("text"), "simple").alias("v"))
    return d.select("doc_id", T.matches(col("v"), q).alias("hit"), T.matches_text(col("text"), T.to_tsquery("of <2> and", "simple"), "simple").alias("near"))


ORACLE["text_phrase"] = _words("SELECT doc_id, bool_or(lex = 'of' AND coalesce(n1, '') = 'the') AS hit, bool_or(lex = 'of' AND coalesce(n2, '') = 'and') AS near FROM (SELECT *, lead(lex) OVER w AS n1, lead(lex, 2) OVER w AS n2 FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) q GROUP BY doc_id UNION ALL SELECT doc_id, CASE WHEN text IS NOT NULL THEN false END, CASE WHEN text IS NOT NULL THEN false END FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM p)")


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN round(sqrt(0.1 * 0.1 / (1.005 + 0.05 * exp((n_nationkey + 1) / 1.5 - 2))), 6) ELSE round(0.1 / 1.64493406685 / 2, 6) END AS r FROM nation")
def text_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`cat` and `dog` with a distance that grows from nation to nation; in one region only, elsewhere `cat` alone."""
    n = table(spark, sf_dir, "nation")
    text = F.concat(lit("cat "), F.repeat(lit("x "), col("n_nationkey")), F.when(col("n_regionkey") == 1, "dog").otherwise("y"))
    return n.select("n_nationkey", T.to_tsvector(text, "simple").alias("v")).select("n_nationkey", F.round(T.rank(col("v"), T.to_tsquery("cat & dog", "simple")), 6).alias("r"))


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b, levenshtein(a.n_name, b.n_name) AS d, least(levenshtein(a.n_name, b.n_name), 4) AS bounded FROM nation a, nation b WHERE a.n_nationkey < b.n_nationkey")
def edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    a, b = n.toDF("a", "x"), n.toDF("b", "y")
    return a.join(b, col("a") < col("b")).select("a", "b", F.levenshtein("x", "y").alias("d"), Z.levenshtein_less_equal(col("x"), col("y"), 3).alias("bounded"))


@query("WITH w AS (SELECT p_partkey, lower(p_brand) AS s FROM part), t AS (SELECT DISTINCT p_partkey, substr('  ' || u || ' ', i, 3) AS g FROM (SELECT p_partkey, unnest(regexp_extract_all(s, '[a-z0-9]+')) AS u FROM w) x, LATERAL (SELECT unnest(generate_series(1, length(u) + 1)) AS i) y) SELECT p_partkey, string_agg(g, '|' ORDER BY g) AS grams FROM t GROUP BY p_partkey")
def trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(Z.show_trgm(col("p_brand")), "|").alias("grams"))


@query("WITH w AS (SELECT p_partkey, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b FROM part), l AS (SELECT DISTINCT x FROM (SELECT a AS x FROM w UNION ALL SELECT b FROM w) u), e AS (SELECT x, [v for v in [translate(substr(x, i, 1), 'aeiouyhwbfpvcgjkqsxzdtlmnr', '00000099111122222222334556') for i in generate_series(1, length(x))] if v <> '9'] AS e FROM l), s AS (SELECT x, upper(substr(x, 1, 1)) || substr(array_to_string([e[i] for i in generate_series(2, len(e)) if e[i] <> e[i - 1] and e[i] <> '0'], '') || '000', 1, 3) AS s FROM e) SELECT p_partkey, p.s AS s, (substr(p.s, 1, 1) = substr(q.s, 1, 1))::INT + (substr(p.s, 2, 1) = substr(q.s, 2, 1))::INT + (substr(p.s, 3, 1) = substr(q.s, 3, 1))::INT + (substr(p.s, 4, 1) = substr(q.s, 4, 1))::INT AS d FROM w JOIN s p ON w.a = p.x JOIN s q ON w.b = q.x")
def soundex_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.split("p_name", " ")
    return table(spark, sf_dir, "part").select("p_partkey", F.soundex(w[0]).alias("s"), Z.difference(w[0], w[1]).alias("d"))


@query("WITH w AS (SELECT p_partkey AS k, p_name AS a, p_type || ' ' || p_name AS b FROM part), t AS (SELECT k, side, list_distinct(flatten([[substr('  ' || u || ' ', i, 3) for i in generate_series(1, length(u) + 1)] for u in regexp_extract_all(lower(x), '[a-z0-9]+')])) AS g FROM (SELECT k, 1 AS side, a AS x FROM w UNION ALL SELECT k, 2, b FROM w) z) SELECT p.k AS k, round(len(list_intersect(p.g, q.g)) / len(list_distinct(list_concat(p.g, q.g))), 5) AS s FROM t p JOIN t q ON p.k = q.k AND p.side = 1 AND q.side = 2")
def trigram_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.concat_ws(" ", "p_type", "p_name")
    return table(spark, sf_dir, "part").select(col("p_partkey").alias("k"), F.round(Z.similarity(col("p_name"), b), 5).alias("s"))


# Networks, geometry, others


@query("WITH a AS (SELECT c_custkey AS k, c_nationkey AS n, '10.' || (c_custkey // 256 % 256) AS two, '.' || (c_custkey % 256) AS three FROM customer) SELECT k, two || three || '.' || n AS h, (16 + n % 3 * 8)::INT AS m, two || CASE n % 3 WHEN 0 THEN '.0.0/16' WHEN 1 THEN three || '.0/24' ELSE three || '.' || n || '/32' END AS n, two || CASE n % 3 WHEN 0 THEN '.255.255/16' WHEN 1 THEN three || '.255/24' ELSE three || '.' || n END AS b, 4::INT AS f FROM a")
def network_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = col("c_custkey"), col("c_nationkey")
    text = F.concat(lit("10."), F.shiftright(k, 8) % 256, lit("."), k % 256, lit("."), n, lit("/"), 16 + n % 3 * 8)
    rows = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey").select(k.alias("k"), text.alias("a"))
    a = col("a")
    return rows.select("k", N.host(a).alias("h"), N.masklen(a).alias("m"), N.network(a).alias("n"), N.broadcast(a).alias("b"), N.family(a).alias("f"))


@query("SELECT k, round(sqrt(power(k - 3, 2) + power(r * 2 - 1, 2)), 8) AS d, (k + 1) * (r + 2) AS area, round(pi() * k * k, 6) AS ca, CASE WHEN k <> 3 THEN round((2.0 * r - 1) / (k - 3), 8) END AS s FROM (SELECT n_nationkey AS k, n_regionkey AS r FROM nation) t")
def geometry_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, r = col("n_nationkey").cast("double"), col("n_regionkey").cast("double")
    p, q = G.point(k, r * 2), G.point(lit(3.0), lit(1.0))
    b = G.box(G.point(lit(0.0), lit(0.0)), G.point(k + 1, r + 2))
    return table(spark, sf_dir, "nation").select(col("n_nationkey").alias("k"), F.round(G.distance(p, q), 8).alias("d"), G.box_area(b).alias("area"), F.round(G.circle_area(G.circle(p, k)), 6).alias("ca"), F.round(G.slope(q, p), 8).alias("s"))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED')")
def enum_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = X.Enum("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    p = e.ordinal(col("o_orderpriority"))
    return table(spark, sf_dir, "orders").filter(p.between(3, 4)).select("o_orderkey", "o_orderpriority")


@query("SELECT n_nationkey, '<name>' || n_name || '</name><region>' || n_regionkey || '</region>' AS x, n_name AS name FROM nation")
def xml_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = X.xmlforest(name=col("n_name"), region=col("n_regionkey"), none=lit(None).cast("string"))
    return table(spark, sf_dir, "nation").select("n_nationkey", x.alias("x"), F.xpath_string(F.concat(lit("<r>"), x, lit("</r>")), lit("r/name")).alias("name"))


@query("SELECT page_id, len(regexp_extract_all(html, '<a href=')) AS links FROM pages")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_count("html", lit("<a href=")).alias("links"))


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 1 ELSE 0 END AS nulls, CASE WHEN n_regionkey = 1 THEN 1 ELSE 2 END AS others, CASE WHEN n_nationkey * 500 < 10240 THEN n_nationkey * 500 || ' bytes' ELSE (n_nationkey * 500 + 512) // 1024 || ' kB' END AS size FROM nation")
def null_counts_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.when(col("n_regionkey") != 1, col("n_regionkey"))
    return table(spark, sf_dir, "nation").select("n_nationkey", X.num_nulls(r, col("n_name")).alias("nulls"), X.num_nonnulls(r, col("n_name")).alias("others"), X.size_pretty(col("n_nationkey").cast("long") * 500).alias("size"))


@query("SELECT p_partkey, p_type LIKE 'S%' AS m, p_brand LIKE 'Brand#1%' AS b, 3::INT AS n FROM part")
def label_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(lit("Top."), col("p_type"), lit("."), F.replace("p_brand", lit("#"), lit("_")))
    rows = table(spark, sf_dir, "part").select("p_partkey", path.alias("k"))
    return rows.select("p_partkey", X.matches_lquery(col("k"), "Top.S*.*").alias("m"), X.matches_lquery(col("k"), "*.Brand_1*").alias("b"), X.nlevel(X.ltree(col("k"))).alias("n"))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS d FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0")
def cube_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector against all others of its label."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    a, b = e.filter("vec_id % 20 = 0").toDF("a", "label", "x"), e.toDF("b", "label", "y")
    return X.cube_distances(a, b).filter("a <> b").select("a", "b", F.round("d", 5).alias("d"))


@query("SELECT k, round(2 * 6378168.0 * asin(sqrt(power(sin(radians(k) / 2), 2))), 3) AS d FROM (SELECT n_nationkey AS k FROM nation) t")
def earth_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = col("n_nationkey").cast("double")
    zero = lit(0.0)
    return table(spark, sf_dir, "nation").select(col("n_nationkey").alias("k"), F.round(X.earth_distance(zero, zero, k, zero), 3).alias("d"))


@query("SELECT c_custkey, sha256(c_name) AS s FROM customer")
def digest_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", X.digest(col("c_name"), "sha256").alias("s"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", J.path(col("props"), "k").alias("k"))
