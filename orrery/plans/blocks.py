"""Ordered blocks of transactions: parsing, deterministic ids, conflicts and commit sets.

A block is a JSON document {bid, txs: [{hash, sql, create_ts}]}, or several of at most MAX_TXS
transactions each, whose `first` is the position in the block of their first one. Read and write sets are
rows (bid, tx_id, rel, key, mode). Within a block every transaction reads the same
snapshot; each key is reserved for its smallest reader and its smallest writer. A
transaction aborts if a smaller one writes a key that it writes (WAW), or if it both
reads what a smaller one writes (RAW) and writes what a smaller one reads (WAR), in
which case no reordering would help. All is set-at-a-time: reservations are seen beside
the sets (a block and key has as many rows as the block has transactions, at most two
each), so the sets are worked out and shuffled once, and one pass goes back to transactions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK_SCHEMA = "bid INT, first INT, txs ARRAY<STRUCT<hash: STRING, sql: STRING, create_ts: STRING>>"
#: Limits of a block's document and of a transaction.
MAX_TXS, MAX_HASH, MAX_SQL = 5500, 32, 1024


def parse_blocks(raw: DataFrame, column: str = "block") -> DataFrame:
    """bid, position, hash, sql, create_ts of each transaction; malformed blocks give a row with an error."""
    parsed = raw.select(F.from_json(column, BLOCK_SCHEMA).alias("b"), F.col(column).alias("raw"))
    rows = parsed.select(F.col("b.bid").alias("bid"), F.coalesce("b.first", F.lit(0)).alias("first"), F.posexplode_outer("b.txs").alias("position", "tx"), "raw")
    error = (
        F.when(F.col("bid").isNull(), F.lit("no bid"))
        .when(F.col("tx").isNull() | F.col("tx.sql").isNull(), F.lit("no sql"))
        .when(F.length("tx.hash") > MAX_HASH, F.lit("hash too long"))
        .when(F.length("tx.sql") > MAX_SQL, F.lit("sql too long"))
        .when(F.col("position") >= MAX_TXS, F.lit("too many transactions"))
    )
    return rows.select("bid", (F.col("first") + F.col("position")).alias("position"), F.col("tx.hash").alias("hash"), F.col("tx.sql").alias("sql"), F.col("tx.create_ts").alias("create_ts"), error.alias("error"))


def assign_ids(txs: DataFrame) -> DataFrame:
    """tx_id from 0 without gaps in the order of (bid, position).

    Counts per block are summed over blocks (a row per block), so that no task
    has to see all transactions.
    """
    sizes = txs.groupBy("bid").agg(F.count("*").alias("_size"))
    before = Window.orderBy("bid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bid", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    own = F.row_number().over(Window.partitionBy("bid").orderBy("position")) - 1
    return txs.join(offsets, "bid").withColumn("tx_id", F.col("_offset") + own).drop("_offset")


def reservations(sets: DataFrame) -> DataFrame:
    """bid, rel, key, first_write, first_read: the least transaction that writes and reads each key."""
    w, r = F.when(F.col("mode") == "W", F.col("tx_id")), F.when(F.col("mode") == "R", F.col("tx_id"))
    return sets.groupBy("bid", "rel", "key").agg(F.min(w).alias("first_write"), F.min(r).alias("first_read"))


def conflicts(sets: DataFrame) -> DataFrame:
    """bid, tx_id, waw, raw, war, committed of each transaction in the sets."""
    own, tx = Window.partitionBy("bid", "rel", "key"), F.col("tx_id")
    held = sets.withColumns({name: F.min(F.when(F.col("mode") == m, tx)).over(own) for name, m in (("first_write", "W"), ("first_read", "R"))})
    writes, reads = F.col("mode") == "W", F.col("mode") == "R"
    earlier_write, earlier_read = F.coalesce(F.col("first_write") < F.col("tx_id"), F.lit(False)), F.coalesce(F.col("first_read") < F.col("tx_id"), F.lit(False))
    flags = held.groupBy("bid", "tx_id").agg(F.max(writes & earlier_write).alias("waw"), F.max(reads & earlier_write).alias("raw"), F.max(writes & earlier_read).alias("war"))
    return flags.withColumn("committed", committed())


def committed(reorder: bool = True) -> Column:
    lost = (F.col("raw") & F.col("war")) if reorder else F.col("raw")
    return ~(F.col("waw") | lost)


def abort_rates(flags: DataFrame) -> DataFrame:
    """Per block: transactions, committed, aborted and the share of aborted ones."""
    n, good = F.count("*"), F.count_if(F.col("committed"))
    return flags.groupBy("bid").agg(n.alias("txs"), good.alias("committed"), (n - good).alias("aborted"), F.round((n - good) / n, 6).alias("abort_rate"))


def last_committed(flags: DataFrame) -> DataFrame:
    """One row: the largest id of a committed transaction, -1 without any."""
    return flags.agg(F.coalesce(F.max(F.when(F.col("committed"), F.col("tx_id"))), F.lit(-1)).alias("last_committed"))


def block_status(flags: DataFrame) -> DataFrame:
    status = F.when(F.col("committed"), "COMMITTED").otherwise("ABORTED")
    return flags.select("bid", "tx_id", status.alias("status"))


def commit_order(flags: DataFrame) -> DataFrame:
    """An order in which the committed transactions of a block give its result one after another.

    A transaction that reads what a smaller one writes saw the snapshot, so it goes before the
    writers; those without such a read follow in id order.
    """
    w = Window.partitionBy("bid").orderBy((~F.col("raw")).cast("int"), F.when(F.col("raw"), -F.col("tx_id")).otherwise(F.col("tx_id")))
    return flags.filter("committed").withColumn("place", F.row_number().over(w) - 1)


def apply_writes(state: DataFrame, writes: DataFrame, flags: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """State after the deferred writes of the committed transactions; null deletes.

    state: key, value; writes: bid, tx_id, key, value. Blocks apply in order; inside a block a key has one committed writer.
    """
    good = writes.join(flags.filter("committed").select("bid", "tx_id"), ["bid", "tx_id"])
    last = good.groupBy(key).agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct("bid", "tx_id")).alias("_new"))
    joined = state.join(last, key, "full")
    return joined.select(key, F.when(F.col("_new").isNotNull(), F.col("_new.v")).otherwise(F.col(value)).alias(value)).filter(F.col(value).isNotNull())


def latencies(txs: DataFrame, start: str, end: str) -> DataFrame:
    """Percentiles of the seconds from start to end."""
    s = F.unix_micros(F.col(end).cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))
    return txs.select((s / 1e6).alias("s")).agg(F.count("s").alias("n"), F.percentile("s", 0.5).alias("p50"), F.percentile("s", 0.95).alias("p95"), F.max("s").alias("most"))


def submit(pending: DataFrame, next_block: int, size: int = MAX_TXS, seconds: float | None = None, per_second: float | None = None) -> DataFrame:
    """Transactions in order of arrival (seq) put into blocks: bid, position and, if paced, the second at which each is due.

    A block takes `size` of them, or as many as come in `seconds` at `per_second`. seq counts from 0 without gaps.
    """
    per = size if seconds is None or per_second is None else max(1, min(size, int(seconds * per_second)))
    seq = F.col("seq")
    out = pending.withColumn("bid", (F.floor(seq / per) + next_block).cast("long")).withColumn("position", (seq % per).cast("int"))
    return out if per_second is None else out.withColumn("due", seq / per_second)


def attach(txs: DataFrame, bid: int, block: DataFrame) -> DataFrame:
    """Further transactions (hash, sql) behind those of a block: ids go on without gaps by hash."""
    last = block.filter(F.col("bid") == bid).agg(F.coalesce(F.max("position") + 1, F.lit(0)).alias("_from"))
    place = F.row_number().over(Window.orderBy("hash")) - 1  # what one block may hold at most
    return block.unionByName(txs.withColumn("_n", place).crossJoin(F.broadcast(last)).select(F.lit(bid).cast(block.schema["bid"].dataType).alias("bid"), (F.col("_from") + F.col("_n")).cast(block.schema["position"].dataType).alias("position"), "hash", "sql"))


def results(txs: DataFrame, flags: DataFrame, hashes: DataFrame) -> DataFrame:
    """What became of transactions asked for by hash: COMMITTED, ABORTED, PENDING (in no decided block) or UNKNOWN."""
    known = hashes.join(txs.select("hash", "bid", "tx_id"), "hash", "left").join(flags.select("bid", "tx_id", "committed"), ["bid", "tx_id"], "left")
    status = F.when(F.col("tx_id").isNull(), "UNKNOWN").when(F.col("committed").isNull(), "PENDING").when(F.col("committed"), "COMMITTED").otherwise("ABORTED")
    return known.select("hash", "bid", "tx_id", status.alias("status"))


def throughput(txs: DataFrame, ended: str, width: str = "1 second") -> DataFrame:
    """Per window of time: transactions that ended, committed ones, and these by second."""
    w = F.window(F.col(ended).cast("timestamp"), width)
    seconds = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    return txs.groupBy(w.alias("w")).agg(F.count("*").alias("ended"), F.count_if("committed").alias("committed")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "ended", "committed", (F.col("committed") / seconds).alias("per_second"))
