"""The corpus pipeline: documents in, token files out.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from orrery.llm import decontaminate, language, mixing, neighbours, tokens
from orrery.llm.quality import fold
from orrery.llm.store import discard, free, keyed, settled


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; a missing lang is filled in.

    Texts that are null or have no letter go. Languages are learned from the documents that have one;
    where none has, all other texts stay. A long text is judged whole; repeated rows agree.
    """
    model = language.train(docs, fold(F.col("doc_id"), 3) != 1)
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    pred, score = free(docs, "lang_pred"), free(docs, "lang_score")
    named = language.label(docs, model, names=(pred, score))
    return named.filter(F.col(pred) != language.UNKNOWN).withColumn("lang", F.coalesce("lang", pred)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents: that with the least id, or any if none has one.

    Rows are told apart by a key of their own, so repeated and null ids do no harm. Texts
    without a shingle are in no group: of those alike in id and text one stays, and all without an id.
    """
    row = free(docs, "_row")
    rows = keyed(docs, name=row)
    found = settled(neighbours.neighbours(rows, doc_id=row, row=row), "groups-found", release=True)
    grouped = found.select(F.col("doc_id").alias(row), "component_id").join(rows.select(row, F.col("doc_id").alias("_id")), row)
    first = grouped.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", F.col(row).alias("at"))).alias("first")).select(F.col("first.at").alias(row))
    # one join strategy at every size: the keys grow with the documents
    kept = rows.join(first.hint("merge"), row, "left_semi").select(*docs.columns)
    if not found.filter(F.col("n_shingles") == 0).isEmpty():
        unnamed = F.col("doc_id").isNull()
        kept = kept.filter(~unnamed).dropDuplicates(["doc_id", "text"]).unionByName(kept.filter(unnamed))
    return kept


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark window, whether or not they have an id or share one. Null and empty texts stay."""
    row = free(docs, "_row")
    rows = keyed(docs, name=row)
    found = decontaminate.decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), doc_id=row, row=row)
    return rows.join(found.filter("contaminated").select(F.col("doc_id").alias(row)), row, "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, as often as it takes them."""
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left; a row per document in them."""
    return tokens.tokenize(docs)


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_benchmark_text),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]

#: No SQL: string kernels, hash-random order and byte-pair encoding are beyond it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a stage's table goes when the next one's is written.

    Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and further columns of
    any name are handled by each stage as it says.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name, release=True)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
