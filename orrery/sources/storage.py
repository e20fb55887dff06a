"""The folder that the driver and all executors share, and tables kept in it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """What the cluster names in spark.checkpoint.dir; a folder of this process only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="orrery-tables-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def names(spark: SparkSession, folder: str) -> list[str]:
    """What a folder holds; nothing if there is none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class MaterializedView:
    """A stored query result; refresh() replaces it as a whole.

    Every refresh writes a version of its own, so that readers of the one before are not disturbed.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.folder, self.version = spark, new_path(spark, name), 0

    def refresh(self, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.folder}/v{self.version + 1}")
        self.version += 1
        return self.read()

    def read(self) -> DataFrame:
        if not self.version:
            raise ValueError("the view has not been populated")
        return self.spark.read.parquet(f"{self.folder}/v{self.version}")
