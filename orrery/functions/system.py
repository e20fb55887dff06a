"""Types, identifiers, settings, sequences, and whole tables as XML."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from orrery.functions.extras import xmlforest
from orrery.operators.changes import identity

#: SQL names of Spark's types: fixed values.
TYPE_NAMES = {"int": "integer", "bigint": "bigint", "smallint": "smallint", "double": "double precision", "float": "real", "string": "text", "boolean": "boolean", "date": "date", "timestamp": "timestamp with time zone", "timestamp_ntz": "timestamp without time zone", "binary": "bytea"}


def pg_typeof(value: Column) -> Column:
    """The SQL name of a value's type; arrays have [] behind their elements' type."""
    kind = F.typeof(value)
    base = F.regexp_replace(kind, r"^array<(.*)>$", "$1")
    names = F.create_map(*(F.lit(x) for pair in TYPE_NAMES.items() for x in pair))
    named = F.when(base.startswith("decimal"), "numeric").otherwise(F.coalesce(F.try_element_at(names, base), base))
    return F.concat(named, F.when(kind.startswith("array<"), "[]").otherwise(""))


def gen_random_uuid() -> Column:
    return F.uuid()


def current_setting(spark: SparkSession, name: str, missing_ok: bool = False) -> str | None:
    """A setting of the session; an unknown one is an error, unless missing_ok."""
    found = spark.conf.get(name, None)
    if found is None and not missing_ok:
        raise ValueError(f"unrecognized configuration parameter {name!r}")
    return found


def set_config(spark: SparkSession, name: str, value: str) -> str:
    spark.conf.set(name, value)
    return value


class Sequence:
    """CREATE SEQUENCE: numbers that are given out once.

    The state is the driver's, as is that of a statement's plan; whole tables are numbered by assign(), which
    deals a run of numbers over ranges of the order and moves the sequence behind it.
    """

    def __init__(self, start: int | None = None, increment: int = 1, least: int | None = None, most: int | None = None, cycle: bool = False) -> None:
        if not increment:
            raise ValueError("INCREMENT must not be zero")
        self.increment, self.cycle = increment, cycle
        self.least = least if least is not None else (1 if increment > 0 else -(1 << 63))
        self.most = most if most is not None else ((1 << 63) - 1 if increment > 0 else -1)
        self.first = start if start is not None else (self.least if increment > 0 else self.most)
        if not self.least <= self.first <= self.most:
            raise ValueError("START value is out of bounds")
        self.next, self.last, self.lock = self.first, None, threading.Lock()

    def nextval(self) -> int:
        with self.lock:
            if not self.least <= self.next <= self.most:
                if not self.cycle:
                    raise ValueError(f"nextval: reached {'maximum' if self.increment > 0 else 'minimum'} value of sequence")
                self.next = self.least if self.increment > 0 else self.most
            self.last, self.next = self.next, self.next + self.increment
            return self.last

    def currval(self) -> int:
        if self.last is None:
            raise ValueError("currval is not yet defined in this session")
        return self.last

    lastval = currval

    def setval(self, value: int, is_called: bool = True) -> int:
        if not self.least <= value <= self.most:
            raise ValueError(f"setval: value {value} is out of bounds")
        with self.lock:
            self.last, self.next = (value, value + self.increment) if is_called else (self.last, value)
        return value

    def assign(self, df: DataFrame, name: str, order: list[str]) -> DataFrame:
        """df with nextval() for each row, in that order."""
        with self.lock:
            n, first = df.count(), self.next
            last = first + (n - 1) * self.increment
            if n and not (self.least <= last <= self.most):
                raise ValueError("nextval: reached the limit of the sequence")
            if n:
                self.last, self.next = last, last + self.increment
        return identity(df, name, order, first, self.increment)


def table_to_xml(df: DataFrame, table: str, nulls: bool = False) -> DataFrame:
    """One row per row of df: its XML element, by the columns' names. A document of all is these between <table> tags."""
    if nulls:
        cells = F.concat_ws("", *(F.when(F.col(c).isNull(), F.lit(f'<{c} xsi:nil="true"/>')).otherwise(xmlforest(**{c: F.col(c)})) for c in df.columns))
    else:
        cells = xmlforest(**{c: F.col(c) for c in df.columns})
    return df.select("*", F.concat(F.lit(f"<{table}>"), cells, F.lit(f"</{table}>")).alias("xml"))


def query_to_xml(spark: SparkSession, statement: str, nulls: bool = False) -> DataFrame:
    """table_to_xml() of a statement's rows."""
    return table_to_xml(spark.sql(statement), "row", nulls)


def column_size(value: Column) -> Column:
    """Bytes of a value: of its text or bytes, else those of its fixed width."""
    widths = F.create_map(*(F.lit(x) for pair in {"int": 4, "bigint": 8, "smallint": 2, "double": 8, "float": 4, "boolean": 1, "date": 4, "timestamp": 8, "timestamp_ntz": 8}.items() for x in pair))
    return F.coalesce(F.try_element_at(widths, F.typeof(value)), F.octet_length(value.cast("string")))


def relation_size(spark: SparkSession, path: str) -> int:
    """Bytes of a stored table's files."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
