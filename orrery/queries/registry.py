"""Registry of named queries and of the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """SQL whose {names} are tables of sf_dir."""
    used = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in used})


def _plain(text: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", text)


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """Register a query in Spark SQL; without an oracle the same text serves for both."""
    QUERIES[name] = lambda spark, sf_dir: run_sql(spark, sf_dir, text)
    ORACLE[name] = _plain(oracle if oracle is not None else text)


def query(oracle: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a function as a query."""

    def put(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if oracle is not None:
            ORACLE[key] = _plain(oracle)
        return f

    return put
