"""Streams: ordered blocks, integrity trees kept up to date, change rows applied, event windows.

State is a table in the shared folder: a base, and what each batch since then adds. A batch writes
its own part only, under its number, so one that runs again after a failure counts once; every so
many batches the parts are merged into a new base and the older ones go.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from orrery.operators.changes import apply_changes
from orrery.plans import blocks as B, integrity as I
from orrery.sources.storage import exists, names, new_path, remove

Merge = Callable[[DataFrame, DataFrame], DataFrame]


class State:
    """A table that batches add to.

    schema: of the table; part: of what a batch adds; merge(base, parts): the table after those parts.
    """

    def __init__(self, spark: SparkSession, name: str, schema: T.StructType | str, merge: Merge, part: T.StructType | str | None = None, path: str | None = None, every: int = 16) -> None:
        self.spark, self.schema, self.merge, self.part = spark, schema, merge, part or schema
        self.path, self.every = path or new_path(spark, name), every

    def _finished(self, kind: str) -> list[int]:
        """Numbers of the bases (v) or parts (d) in the folder, ascending; one listing."""
        return sorted(int(n[1:]) for n in names(self.spark, self.path) if n[:1] == kind and n[1:].isdigit())

    def _base(self, before: int) -> int:
        """The last whole base before a batch, or -1."""
        return next((b for b in reversed(self._finished("v")) if b < before and exists(self.spark, f"{self.path}/v{b}/_SUCCESS")), -1)

    def last(self) -> int:
        """The last batch that added something, or -1."""
        return max([-1, *self._finished("d"), *self._finished("v")])

    def read(self, before: int | None = None) -> DataFrame:
        """The table, or the table before a batch."""
        end = self.last() + 1 if before is None else before
        return self._table(self._base(end), end)

    def _table(self, base: int, end: int) -> DataFrame:
        """A base and the parts after it and before `end`."""
        parts = [f"{self.path}/d{b}" for b in self._finished("d") if base < b < end]
        table = self.spark.read.schema(self.schema).parquet(f"{self.path}/v{base}") if base >= 0 else self.spark.createDataFrame([], self.schema)
        return self.merge(table, self.spark.read.schema(self.part).parquet(*parts)) if parts else table

    def add(self, batch: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/d{batch}")
        if batch % self.every == self.every - 1:
            older = self._base(batch)
            self._table(older, batch + 1).write.mode("overwrite").parquet(f"{self.path}/v{batch}")
            # the base before and its parts stay, in case this batch runs again
            for kind in "dv":
                for b in self._finished(kind):
                    if b < older or kind == "d" and b == older:
                        remove(self.spark, f"{self.path}/{kind}{b}")


def files(spark: SparkSession, folder: str, name: str, schema: T.StructType, per_batch: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", per_batch).parquet(folder)


def run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand all that is available to `each`, batch by batch, and wait for it."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


LEAVES = "leaf long, w0 long, w1 long, w2 long, w3 long, w4 long, w5 long, w6 long, w7 long, n long"


def tree_state(spark: SparkSession, name: str = "tree", path: str | None = None, every: int = 16) -> State:
    """Leaves of an integrity tree; parts are leaves too, and hashes add up by XOR."""
    columns = [x.split()[0] for x in LEAVES.split(", ")]
    return State(spark, name, LEAVES, lambda base, parts: I.merged(base.unionByName(parts)).select(*columns), path=path, every=every)


def maintain_tree(stream: DataFrame, tree: I.Tree, state: State, checkpoint: str, **options: object) -> None:
    """Keep the leaves of a growing table: each batch adds its own hashes."""
    run(stream, lambda rows, batch: state.add(batch, I.leaves(rows, tree, **options)), checkpoint)


FLAGS = "bid long, tx_id long, waw boolean, raw boolean, war boolean, committed boolean"


def flag_state(spark: SparkSession, name: str = "flags", path: str | None = None, every: int = 16) -> State:
    """Decisions on transactions, which are never revised."""
    return State(spark, name, FLAGS, lambda base, parts: base.unionByName(parts), path=path, every=every)


def commit_blocks(stream: DataFrame, state: State, checkpoint: str) -> None:
    """Decide the transactions of whole blocks; stream: rows of read and write sets. Blocks do not span batches."""
    columns = [x.split()[0] for x in FLAGS.split(", ")]
    run(stream, lambda rows, batch: state.add(batch, B.conflicts(rows.distinct()).select(*columns)), checkpoint)


def replica_state(spark: SparkSession, schema: T.StructType, changes: T.StructType, keys: list[str], order: str = "seq", op: str = "op", name: str = "replica", path: str | None = None, every: int = 16) -> State:
    """A table kept by change rows; parts are changes, of each key in a batch the last one."""
    return State(spark, name, schema, lambda base, parts: apply_changes(base, parts, keys, order, op), part=changes, path=path, every=every)


def replicate(stream: DataFrame, keys: list[str], state: State, checkpoint: str, order: str = "seq", op: str = "op") -> None:
    """Keep a replica by change rows."""

    def each(rows: DataFrame, batch: int) -> None:
        last = rows.groupBy(*keys, (F.col(op) == "truncate").alias("_cut")).agg(F.max_by(F.struct(*rows.columns), order).alias("_r")).select("_r.*")
        state.add(batch, last)

    run(stream, each, checkpoint)


def tumbling_counts(events: DataFrame, time: str, width: str, *keys: str, lateness: str = "1 hour") -> DataFrame:
    """Counts per window of time, for streams and tables alike."""
    stream = events.withWatermark(time, lateness) if events.isStreaming else events
    w = F.window(time, width)
    return stream.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, time: str, gap: str, *keys: str, lateness: str = "1 hour") -> DataFrame:
    """Sessions that end after a gap."""
    stream = events.withWatermark(time, lateness) if events.isStreaming else events
    w = F.session_window(time, gap)
    return stream.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")
