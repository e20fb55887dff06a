"""User-defined functions, aggregates and table functions, and what triggers do on write."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf


@F.pandas_udf(T.DoubleType())
def geometric_mean(v: pd.Series) -> float:
    """A user-defined aggregate; use it in groupBy().agg()."""
    known = v.dropna()
    return float(np.exp(np.log(known).mean())) if len(known) else float("nan")


def product(value: Column) -> Column:
    """An aggregate from a step and a final function, in the JVM: the list of a group is folded."""
    return F.aggregate(F.collect_list(value.cast("double")), F.lit(1.0), lambda a, x: a * x)


def aggregate(df: DataFrame, keys: list[str], value: str, zero: object, step: Callable[[Any, pd.Series], Any], combine: Callable[[Any, Any], Any], finish: Callable[[Any], Any], returns: str, most_keys: int = 100_000) -> DataFrame:
    """CREATE AGGREGATE: a state per group that takes values (step), meets other states (combine) and gives the result (finish).

    Each task keeps states of at most `most_keys` groups and hands on one row for each, so that a hot group is summed where its
    rows are before it is shuffled. Nulls of the value are skipped; a group of nulls gives finish(zero).
    """
    kept = df.select(*keys, value)
    fields = [kept.schema[k] for k in keys]
    partial = T.StructType([*fields, T.StructField("_state", T.BinaryType())])

    def begin(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict[tuple, Any] = {}

        def flushed() -> pd.DataFrame:
            return pd.DataFrame([(*k, pickle.dumps(s)) for k, s in states.items()], columns=[*keys, "_state"])

        for part in parts:
            for key, rows in part.groupby(keys, dropna=False):
                key = tuple(None if pd.isna(k) else k for k in key)
                known = rows[value].dropna()
                states[key] = step(states.get(key, zero), known) if len(known) else states.get(key, zero)
            if len(states) >= most_keys:
                yield flushed()
                states.clear()
        if states:
            yield flushed()

    def end(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        state = reduce(combine, map(pickle.loads, rows["_state"]))
        return pd.DataFrame([(*key, finish(state))], columns=[*keys, "result"])

    return kept.mapInPandas(begin, partial).groupBy(*keys).applyInPandas(end, T.StructType([*fields, T.StructField("result", T._parse_datatype_string(returns))]))


@udtf(returnType="word string, place int")
class SplitWords:
    """A set-returning function: words and their places."""

    def eval(self, text: str) -> Iterator[tuple[str, int]]:
        for i, w in enumerate((text or "").split(), 1):
            yield w, i


#: Column types that RecordSet knows.
TYPES = {"int": T.IntegerType(), "bigint": T.LongType(), "long": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType()}


def _columns(ddl: str) -> T.StructType:
    """A schema of plain types; parsed here because no session is at hand where functions are analysed."""
    return T.StructType([T.StructField(n, TYPES[t]) for n, t in (x.split() for x in ddl.split(","))])


@udtf
class RecordSet:
    """A function whose columns are told by its argument: RecordSet('a int, b string', json)."""

    @staticmethod
    def analyze(columns: AnalyzeArgument, data: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(_columns(columns.value))

    def eval(self, columns: str, data: str) -> Iterator[tuple]:
        import json

        names = _columns(columns).names
        for row in json.loads(data):
            yield tuple(row.get(n) for n in names)


def create_sql_function(spark: SparkSession, name: str, arguments: str, returns: str, body: str) -> None:
    """A SQL function of the session; Catalyst inlines its body."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}")


def call(spark: SparkSession, statement: str, **values: object) -> DataFrame:
    """PREPARE and EXECUTE: a statement with :names for values."""
    return spark.sql(statement, args=values)


def on_write(df: DataFrame, defaults: dict[str, Column] | None = None, generated: dict[str, Column] | None = None, modified: str | None = None) -> DataFrame:
    """Defaults for null columns, generated columns, and the time of writing: what row triggers set."""
    out = df
    for c, v in (defaults or {}).items():
        out = out.withColumn(c, F.coalesce(F.col(c), v))
    for c, v in (generated or {}).items():
        out = out.withColumn(c, v)
    return out.withColumn(modified, F.current_timestamp()) if modified else out


def expand_operations(calls: DataFrame, reads: str = "reads", writes: str = "writes") -> DataFrame:
    """Read and write sets of stored-procedure calls with arrays of keys: bid, tx_id, rel, key, mode."""
    one = lambda c, m: calls.select("bid", "tx_id", "rel", F.explode(F.col(c).cast("array<string>")).alias("key"), F.lit(m).alias("mode"))
    return one(reads, "R").unionByName(one(writes, "W")).distinct()


__all__ = ["Row", "RecordSet", "SplitWords", "call", "create_sql_function", "expand_operations", "geometric_mean", "on_write", "product"]
