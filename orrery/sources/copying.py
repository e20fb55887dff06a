"""COPY: delimited text in and out, foreign files and databases, cursors, row locations, a series source."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def copy_from(spark: SparkSession, path: str, schema: str | T.StructType, kind: str = "text", delimiter: str | None = None, null: str | None = None, header: bool = False, where: Column | None = None) -> DataFrame:
    """Rows of delimited files. text: tabs, \\N for null, backslash escapes; csv: commas, an empty field for null, double quotes."""
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    if kind == "csv":
        df = spark.read.csv(path, schema=wanted, sep=delimiter or ",", header=header, quote='"', escape='"', nullValue=null if null is not None else "", multiLine=True, mode="FAILFAST")
    elif kind == "text":
        sep, none = delimiter or "\t", null if null is not None else "\\N"
        fields = F.split(F.col("value"), rf"(?<!\\){_quoted(sep)}")
        lines = spark.read.text(path).filter(F.col("value") != "\\.")
        parsed = lines.select(*(F.when(fields[i] != none, _unescape(fields[i])).cast(f.dataType).alias(f.name) for i, f in enumerate(wanted)))
        df = parsed
    else:
        raise ValueError(f"COPY format {kind!r} not recognized")
    return df if where is None else df.filter(where)


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def _unescape(c: Column) -> Column:
    out = c
    for a, b in ((r"\\t", "\t"), (r"\\n", "\n"), (r"\\r", "\r")):
        out = F.regexp_replace(out, rf"(?<!\\){a}", b)
    return F.regexp_replace(out, r"\\(.)", "$1")


def copy_to(df: DataFrame, path: str, kind: str = "text", delimiter: str | None = None, null: str | None = None, header: bool = False) -> None:
    """Write rows as copy_from() reads them; one file per partition."""
    if kind == "csv":
        df.write.csv(path, sep=delimiter or ",", header=header, quote='"', escape='"', nullValue=null if null is not None else "", emptyValue='""')
        return
    sep, none = delimiter or "\t", null if null is not None else "\\N"
    shown = []
    for c in df.columns:
        text = F.col(c).cast("string")
        for a, b in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
            text = F.replace(text, F.lit(a), F.lit(b))
        if sep != "\t":
            text = F.replace(text, F.lit(sep), F.lit("\\" + sep))
        shown.append(F.coalesce(text, F.lit(none)))
    df.select(F.concat_ws(sep, *shown).alias("value")).write.text(path)


def foreign_table(spark: SparkSession, url: str, table: str | None = None, query: str | None = None, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A table or query of another database over JDBC, with its filters, columns, aggregates and limits pushed down.

    partition: column, lowest and highest value, number of parallel reads.
    """
    reader = spark.read.format("jdbc").option("url", url).option("pushDownPredicate", "true").option("pushDownAggregate", "true").option("pushDownLimit", "true").options(**options)
    reader = reader.option("query", query) if query else reader.option("dbtable", table)
    if partition:
        column, low, high, n = partition
        reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", n)
    return reader.load()


def with_row_location(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table with the file and the place in it of each row."""
    return spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row_index"))


def sample_blocks(spark: SparkSession, path: str, percent: float, seed: int = 0, rows: int = 8192) -> DataFrame:
    """TABLESAMPLE SYSTEM: whole runs of `rows` neighbouring rows are taken or left. The same seed takes the same ones."""
    df = with_row_location(spark, path)
    place = F.pmod(F.xxhash64(F.lit(seed), "file", F.floor(F.col("row_index") / rows)), F.lit(1_000_000))
    return df.filter(place < int(percent * 10_000)).drop("file", "row_index")


def sample_rows(df: DataFrame, rows: int, seed: int = 0) -> DataFrame:
    """SYSTEM_ROWS: that many random rows, or all. Each task keeps its `rows` least random numbers, so nothing is sorted as a whole."""
    return df.withColumn("_r", F.rand(seed)).orderBy("_r").limit(rows).drop("_r")


def sample_time(df: DataFrame, milliseconds: int, rows_per_second: int, seed: int = 0) -> DataFrame:
    """SYSTEM_TIME: about as many random rows as are read in that time at a stated speed, so that the same call gives the same sample."""
    return sample_rows(df, max(1, milliseconds * rows_per_second // 1000), seed)


class Cursor:
    """FETCH and MOVE over an ordered result; rows come to the driver a piece at a time."""

    def __init__(self, df: DataFrame, *order: str) -> None:
        self.rows: Iterator[Row] = df.orderBy(*order).toLocalIterator()

    def fetch(self, n: int = 1) -> list[Row]:
        out = []
        for _ in range(n):
            row = next(self.rows, None)
            if row is None:
                break
            out.append(row)
        return out

    def move(self, n: int) -> int:
        return len(self.fetch(n))


def page(df: DataFrame, order: list[str], first: int, last: int) -> DataFrame:
    """Rows first to last, from 1, of an order: a scrollable window. Only the needed rows are gathered."""
    top = df.orderBy(*order).limit(last)
    return top.withColumn("_n", F.row_number().over(Window.orderBy(*order))).filter(F.col("_n") >= first).drop("_n")


class SeriesSource(DataSource):
    """generate_series as a data source: options start, stop, step and partitions."""

    @classmethod
    def name(cls) -> str:
        return "series"

    def schema(self) -> str:
        return "n long"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SeriesReader(self.options)


class SeriesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.start, self.stop, self.step = int(options.get("start", 1)), int(options["stop"]), int(options.get("step", 1))
        self.parts = int(options.get("partitions", 4))
        if not self.step:
            raise ValueError("step size cannot equal zero")

    def partitions(self) -> list[InputPartition]:
        total = max(0, (self.stop - self.start) // self.step + 1)
        cuts = [total * i // self.parts for i in range(self.parts + 1)]
        return [InputPartition((a, b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for i in range(*partition.value):
            yield (self.start + i * self.step,)
