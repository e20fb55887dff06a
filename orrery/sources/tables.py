"""CREATE TABLE AS and SELECT INTO, COPY in the binary format, and COPY of changes."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from orrery.operators.changes import Changed
from orrery.sources.storage import exists, new_path

#: Signature of binary COPY files, bytes of one, and the type names that fields of this format can have: fixed values.
SIGNATURE = b"PGCOPY\n\xff\r\n\0"
FILE_BYTES = 16 << 20
FIELDS = {"smallint": ">h", "int": ">i", "bigint": ">q", "float": ">f", "double": ">d", "boolean": ">?"}


class Tables:
    """Tables by name, kept in the shared folder."""

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark, self.folder = spark, folder or new_path(spark, "database")

    def create_as(self, name: str, df: DataFrame, with_data: bool = True, if_not_exists: bool = False) -> DataFrame:
        """CREATE TABLE name AS df [WITH NO DATA]."""
        path = f"{self.folder}/{name}"
        if exists(self.spark, path):
            if not if_not_exists:
                raise ValueError(f"relation {name!r} already exists")
            return self.read(name)
        (df if with_data else df.limit(0)).write.parquet(path)
        return self.read(name)

    #: SELECT ... INTO name.
    select_into = create_as

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")


def copy_changes(changed: Changed, path: str, **options: object) -> None:
    """COPY (INSERT|UPDATE|DELETE ... RETURNING ...) TO: the rows that the statement touched."""
    from orrery.sources.copying import copy_to

    copy_to(changed.returning, path, **options)


def _field(value: object, kind: str) -> bytes:
    if value is None:
        return struct.pack(">i", -1)
    data = value.encode() if kind == "string" else bytes(value) if kind == "binary" else struct.pack(FIELDS[kind], value)
    return struct.pack(">i", len(data)) + data


def copy_binary_to(df: DataFrame) -> DataFrame:
    """COPY TO with FORMAT binary: rows with `file`, each a whole file of some of the rows (FILE_BYTES, about)."""
    kinds = [f.dataType.simpleString() for f in df.schema]
    for k in kinds:
        if k not in FIELDS and k not in ("string", "binary"):
            raise ValueError(f"no binary form for {k}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, out, size = SIGNATURE + struct.pack(">ii", 0, 0), [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out.append(struct.pack(">h", len(row)) + b"".join(_field(v, k) for v, k in zip(row, kinds, strict=True)))
                size += len(out[-1])
                if size >= FILE_BYTES:
                    yield pa.RecordBatch.from_pydict({"file": pa.array([b"".join([head, *out, struct.pack(">h", -1)])], pa.binary())})
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pydict({"file": pa.array([b"".join([head, *out, struct.pack(">h", -1)])], pa.binary())})

    return df.mapInArrow(run, "file binary")


def copy_binary_from(files: DataFrame, schema: str | T.StructType) -> DataFrame:
    """COPY FROM with FORMAT binary: the rows of files in a column `file` (or `content`, as Spark reads binary files)."""
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    kinds = [f.dataType.simpleString() for f in wanted]
    column = "file" if "file" in files.columns else "content"
    arrow = pa.schema([(f.name, {"smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}[k]) for f, k in zip(wanted, kinds, strict=True)])

    def rows(data: bytes) -> Iterator[tuple]:
        if not data.startswith(SIGNATURE):
            raise ValueError("COPY file signature not recognized")
        at = len(SIGNATURE) + 8 + struct.unpack_from(">i", data, len(SIGNATURE) + 4)[0]
        while (n := struct.unpack_from(">h", data, at)[0]) != -1:
            at, row = at + 2, []
            if n != len(kinds):
                raise ValueError(f"row field count is {n}, expected {len(kinds)}")
            for kind in kinds:
                size = struct.unpack_from(">i", data, at)[0]
                part, at = data[at + 4 : at + 4 + max(size, 0)], at + 4 + max(size, 0)
                row.append(None if size < 0 else part.decode() if kind == "string" else part if kind == "binary" else struct.unpack(FIELDS[kind], part)[0])
            yield tuple(row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                found = list(rows(data))
                columns = list(zip(*found, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)

    return files.select(F.col(column).alias("file")).mapInArrow(run, wanted)


def bucketed(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """df written by buckets of its keys, sorted inside: tables of as many buckets are joined and grouped by these keys without a shuffle."""
    path = new_path(df.sparkSession, "bucketed")
    name = path.rpartition("/")[2].replace("-", "_")
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)
