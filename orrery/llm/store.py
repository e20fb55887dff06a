"""Tables and files that all executors see.

Intermediate tables are written below the folder that the cluster names in
`spark.checkpoint.dir`; a lost executor then costs the tasks it ran, never
results that were already finished. Only where the setting is absent (tests,
local mode) a folder of this process is used.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bytes of text that an operator handles at once, about.
PORTION = 8 << 20

_own: list[str] = []
_paths: dict[int, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by the driver and the executors, as a URI or path."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not _own:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        _own.append(tempfile.mkdtemp(prefix="orrery-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/orrery/{name}-{uuid.uuid4().hex}"


def free(df: DataFrame, name: str) -> str:
    """A name like that which no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bernoulli(key: Column, rows: int, sample: int) -> Column:
    """True for about `sample` of so many rows, by a hash of `key`: no sort, no shuffle, the same on any partitioning."""
    share = min(1.0, sample / max(1, rows))
    return F.lit(True) if share >= 1 else F.pmod(key, F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))


def settled(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends here.

    release: let Spark's cleaner delete the shuffle files of what made the table. It does so
    for shuffles that the driver's garbage collector has found unreachable, so this asks for a collection.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    if release:
        df.sparkSession.sparkContext._jvm.System.gc()
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[id(out)] = path
    weakref.finalize(out, _paths.pop, id(out), None)
    return out


def keyed(df: DataFrame, *columns: Column, name: str = "_row") -> DataFrame:
    """Columns of df (by default all), and a long that tells its rows apart and stays the same whenever they are read.

    A plain read of Parquet files has the file's number and the place in the file; any other table is written first.
    """
    chosen = columns or tuple(F.col(f"`{c}`") for c in df.columns)
    if df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        try:
            placed = df.select(*chosen, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__place"))
        except AnalysisException:  # no Parquet files
            placed = None
        if placed is not None:
            paths = sorted(x["__file"] for x in df.select(F.col("_metadata.file_path").alias("__file")).distinct().collect())  # a row per file
            files = df.sparkSession.createDataFrame(pa.table({"__file": pa.array(paths, pa.string()), "__first": pa.array([i << 40 for i in range(len(paths))], pa.int64())}))
            kept = [c for c in placed.columns if c not in ("__file", "__place")]
            return placed.join(F.broadcast(files), "__file").select(*(F.col(f"`{c}`") for c in kept), (F.col("__first") + F.col("__place")).alias(name))
    return settled(df.select(*chosen, F.monotonically_increasing_id().alias(name)), "rows")


def in_portions(rows: DataFrame, size: int, portion: int = PORTION, row: str = "_row") -> DataFrame:
    """rows with `portion`, a number that spreads them evenly; size: bytes of all, portion: bytes of each, about."""
    return rows.withColumn("portion", F.pmod(F.xxhash64(row), F.lit(size // portion + 1)).cast("int"))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 16 MB, where the session leaves Spark's default of 64 MB: Python workers stay small."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name).removesuffix("b") in (str(64 << 20), "64m"):
        spark.conf.set(name, "16m")


def discard(*tables: DataFrame) -> None:
    """Delete what settled() wrote for tables that nothing will read again."""
    for df in tables:
        remove(df.sparkSession, _paths.pop(id(df)))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's file systems."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; runs on executors."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


class AtomicFile:
    """A file that appears under its name only when it is complete.

    Attempts of one task write under names of their own and put the same bytes at
    the same place, so that retries and speculative copies do no harm.
    """

    def __init__(self, folder: str, name: str) -> None:
        self.fs, path = open_fs(folder)
        self.fs.create_dir(path, recursive=True)
        self.final, self.temp = f"{path}/{name}", f"{path}/.{name}.{uuid.uuid4().hex}"
        self.uri, self.size = f"{folder}/{name}", 0
        self.stream = self.fs.open_output_stream(self.temp, compression=None)

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def commit(self) -> None:
        """Give the file its name. Where another attempt of the task was first, its file stays if it is as long."""
        self.stream.close()
        there = self.fs.get_file_info(self.final)
        if there.type == pafs.FileType.File and there.size == self.size:
            self.fs.delete_file(self.temp)
            return
        if there.type == pafs.FileType.File:
            self.fs.delete_file(self.final)
        self.fs.move(self.temp, self.final)
