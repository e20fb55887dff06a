"""The pipeline, stage by stage, on a small corpus with planted cases."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
import plain
from orrery.llm import store, tokens
from orrery.llm.queries import QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(6)
    words = {"en": ["the", "and", "with", "house", "through", "water", "under"], "de": ["der", "und", "mit", "haus", "schön", "wasser", "unter"]}
    rows = [(i, " ".join(rng.choice(words[x]) + str(rng.randrange(90)) for _ in range(60)), x, f"s{i % 4}") for i, x in enumerate(["en", "de"] * 40)]
    rows += [(200 + i, rows[i][1] + " more", None, "s0") for i in range(5)] + [(300, None, "en", "s1"), (301, "123 456", "en", None)]
    item = " ".join(f"bench{i}" for i in range(15))
    rows += [(400, rows[7][1][:200] + " " + item, "en", "s2")]
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
    return str(at)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    ids = {}
    for name, stage in P.STAGES:
        docs = stage(spark, docs, folder).cache()
        ids[name] = [r["doc_id"] for r in docs.collect()]
        assert docs.columns == columns or name == P.STAGES[-1][0]
    first = set(ids["language"])
    assert not {300, 301} & first and len(first) == 86
    assert set(ids["near_copies"]) == first - {200, 201, 202, 203, 204}
    assert set(ids["decontamination"]) == set(ids["near_copies"]) - {400}
    assert set(ids["mixing"]) <= set(ids["decontamination"]) and ids["tokens"] == sorted(ids["mixing"])


def test_run_is_the_stages_together(spark, folder):
    got = P.run(spark, folder).collect()
    assert got and sum(r["n_tokens"] for r in got) == max(r["start"] + r["n_tokens"] for r in got)
    assert [r["doc_id"] for r in P.run(spark, folder).collect()] == [r["doc_id"] for r in got]


def test_repeated_rows_and_no_labels(spark, folder):
    docs = spark.createDataFrame([(1, "a b c d e f g", None, "s", 1), (1, "a b c d e f g", None, "s", 1), (None, "x y z", "en", "s", 1), (2, "a b c d e f g", "en", None, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = P.drop_near_copies(spark, docs, folder).collect()
    assert sorted((r["doc_id"] or 0) for r in kept) == [0, 1]
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert P.identify_language(spark, unlabelled.withColumn("text", F.when(F.col("doc_id") == 2, "12 34").otherwise(F.col("text"))), folder).count() == 3
    assert tokens.tokenize(docs).count() == 4 and plain.white("a b") == ["a", "b"]


def test_filters_of_rows_without_ids_and_of_repeated_ids(spark, folder):
    text = " ".join(f"word{i}" for i in range(60))
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first()["text"]
    rows = [(None, text), (None, text), (None, text + " more"), (None, "bare"), (None, ""), (None, ""), (5, ""), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = P.drop_near_copies(spark, docs, folder)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:5]) for r in kept.collect()) == [(0, ""), (0, ""), (0, "bare"), (0, "word0"), (5, "")]
    assert [r["doc_id"] for r in P.drop_near_copies(spark, docs.limit(0).unionByName(docs.filter("text like 'word0%'")).withColumn("doc_id", F.when(F.col("text").endswith("more"), 9)), folder).collect()] == [9]
    rows = [(None, f"before {item} after"), (None, text), (7, item), (7, text)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], docs.schema)
    kept = P.drop_benchmark_text(spark, docs, folder).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == [(0, text), (7, text)]


def test_keyed(spark, tmp_path):
    spark.range(1000).select(F.lit("x").alias("text")).repartition(3).write.parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    for df, n in ((read, 1000), (read.join(spark.range(2)), 2000), (read.limit(0), 0), (spark.range(7).toDF("text"), 7)):
        rows = store.keyed(df)
        assert rows.columns == [*df.columns, "_row"]
        first = {r["_row"] for r in rows.collect()}
        assert len(first) == n and first == {r["_row"] for r in rows.select("_row").collect()}


def test_mixing_repeated_rows(spark, folder):
    docs = spark.createDataFrame([(None, "a b c", "en", "s", 5)] * 30 + [(1, "d e f", "en", "t", 5)] * 10, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = P.mix_sources(spark, docs, folder)
    assert mixed.columns == docs.columns
    assert sum(len(plain.white(r["text"])) for r in mixed.collect()) == 120


CLASH = ["_row", "_key", "row", "key", "size", "taken", "score", "lang_pred", "lang_score", "words", "portion", "bucket", "_cut", "_size", "_taken", "_file", "_place", "component_id", "contaminated"]


@pytest.mark.parametrize("ids", ["long", "int"])
def test_stages_with_clashing_columns_edges_and_other_ids(spark, folder, ids):
    """Each stage by itself: columns of names that it uses go through as they came, and so do edges."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("doc_id", F.col("doc_id").cast(ids))
    edges = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "", 0), (500, "x " * 20_000, None, "s1", 40_000), (501, "tie", "en", "s1", 3), (501, "tie", "en", "s1", 3)], docs.schema)
    for c in CLASH:
        docs, edges = docs.withColumn(c, F.lit("clash")), edges.withColumn(c, F.lit("clash"))
    both, none = docs.unionByName(edges).repartition(3), docs.limit(0)
    for name, stage in P.STAGES:
        out = stage(spark, both, folder)
        last = name == P.STAGES[-1][0]
        assert last or out.columns == both.columns
        rows = out.collect()
        assert len(rows) and (last or all(r[c] == "clash" for r in rows for c in CLASH))
        assert stage(spark, none, folder).count() == 0


def test_all_operators_are_registered():
    assert {int(q[2:].split("_")[0]) for q in QUERIES} == set(range(1, 11))
