"""A store of ordered blocks: what clients submit, what was decided, and what they may ask.

Blocks and decisions are tables in the shared folder, a part for each call. Block n is decided when all
blocks before it are; each transaction's fate follows from the read and write sets that the caller gives for it.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from orrery.plans import blocks as B
from orrery.sources.storage import names, new_path, remove

TXS = "bid long, position int, hash string, sql string"
FLAGS = "bid long, tx_id long, waw boolean, raw boolean, war boolean, committed boolean"


class BlockStore:
    """first: number of the first block; period and size pace what submit() takes without a block: a block for each period."""

    def __init__(self, spark: SparkSession, first: int = 1, size: int = B.MAX_TXS) -> None:
        self.spark, self.first, self.size = spark, first, size
        self.reset()

    def reset(self) -> None:
        """Forget all blocks and decisions."""
        if hasattr(self, "path"):
            remove(self.spark, self.path)
        self.path, self.calls = new_path(self.spark, "blocks"), 0

    def _write(self, df: DataFrame, kind: str) -> None:
        df.write.parquet(f"{self.path}/{kind}-{self.calls}")
        self.calls += 1

    def _read(self, kind: str, schema: str) -> DataFrame:
        parts = [f"{self.path}/{n}" for n in names(self.spark, self.path) if n.startswith(f"{kind}-")]
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    def transactions(self) -> DataFrame:
        """bid, position, hash, sql, tx_id: ids go over all blocks without gaps."""
        return B.assign_ids(self._read("txs", TXS))

    def flags(self) -> DataFrame:
        return self._read("flags", FLAGS)

    def submit_blocks(self, raw: DataFrame, column: str = "block") -> DataFrame:
        """Blocks as JSON; the transactions that could not be parsed come back with their errors, and their blocks are not taken."""
        parsed = B.parse_blocks(raw, column)
        bad = parsed.filter("error IS NOT NULL")
        refused = bad.select("bid").distinct()
        good = parsed.filter("error IS NULL").join(refused, "bid", "left_anti").join(self._read("txs", TXS).select("bid").distinct(), "bid", "left_anti")
        self._write(good.select(F.col("bid").cast("long").alias("bid"), F.col("position").cast("int").alias("position"), "hash", "sql"), "txs")
        return bad

    def submit(self, txs: DataFrame, per_second: float | None = None, seconds: float | None = None) -> None:
        """Transactions (seq, hash, sql) without a block: they fill the blocks after the last one."""
        last = self._read("txs", TXS).agg(F.max("bid")).first()[0]
        placed = B.submit(txs, self.first if last is None else last + 1, self.size, seconds, per_second)
        self._write(placed.select("bid", "position", "hash", "sql"), "txs")

    def add(self, bid: int, txs: DataFrame) -> None:
        """Transactions (hash, sql) that join a block that is not decided yet, behind those it has."""
        if not self.flags().filter(F.col("bid") == bid).isEmpty():
            raise ValueError(f"block {bid} is decided")
        have = self._read("txs", TXS).filter(F.col("bid") == bid).agg(F.max("position")).first()[0]
        place = F.row_number().over(Window.orderBy("hash")) + (-1 if have is None else have)  # what one block may hold at most
        self._write(txs.select(F.lit(bid).cast("long").alias("bid"), place.cast("int").alias("position"), "hash", "sql"), "txs")

    def decide(self, sets: Callable[[DataFrame], DataFrame]) -> int:
        """Decide all blocks that have no gap before them; sets(transactions) gives their read and write sets. The last decided block, or the one before the first."""
        txs = self.transactions()
        known = {r["bid"] for r in txs.select("bid").distinct().collect()}  # a row per block
        done = self.flags().agg(F.max("bid")).first()[0]
        last = done if done is not None else self.first - 1
        upto = last
        while upto + 1 in known:
            upto += 1
        if upto > last:
            fresh = txs.filter(F.col("bid").between(last + 1, upto))
            found = B.conflicts(sets(fresh))
            idle = fresh.join(found.select("tx_id"), "tx_id", "left_anti").select("bid", "tx_id", *(F.lit(False).alias(c) for c in ("waw", "raw", "war")), F.lit(True).alias("committed"))
            self._write(found.select("bid", "tx_id", "waw", "raw", "war", "committed").unionByName(idle), "flags")
        return upto

    def block_status(self, bid: int) -> str:
        """DECIDED, PENDING or UNKNOWN."""
        if not self.flags().filter(F.col("bid") == bid).isEmpty():
            return "DECIDED"
        return "UNKNOWN" if self._read("txs", TXS).filter(F.col("bid") == bid).isEmpty() else "PENDING"

    def results(self, hashes: DataFrame) -> DataFrame:
        return B.results(self.transactions(), self.flags(), hashes)

    def committed(self) -> int:
        return self.flags().filter("committed").count()

    def last_committed(self) -> int:
        return B.last_committed(self.flags()).first()[0]

    def wait(self, bid: int, seconds: float, every: float = 0.2) -> bool:
        """Whether a block is decided by then."""
        end = time.monotonic() + seconds
        while self.block_status(bid) != "DECIDED":
            if time.monotonic() >= end:
                return False
            time.sleep(every)
        return True
