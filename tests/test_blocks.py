"""Hand-worked and random transaction blocks."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from orrery.plans import blocks as B

SETS = "bid long, tx_id long, rel string, key string, mode string"


def flags(spark, *rows):
    df = spark.createDataFrame([(1, t, "r", k, m) for t, m, k in rows], SETS)
    return {r["tx_id"]: r for r in B.conflicts(df).collect()}


def test_lost_update(spark):
    f = flags(spark, (0, "R", "a"), (0, "W", "a"), (1, "R", "a"), (1, "W", "a"))
    assert f[0]["committed"] and not f[1]["committed"] and f[1]["waw"]


def test_write_skew(spark):
    f = flags(spark, (0, "R", "a"), (0, "R", "b"), (0, "W", "a"), (1, "R", "a"), (1, "R", "b"), (1, "W", "b"))
    assert f[0]["committed"] and f[1]["raw"] and f[1]["war"] and not f[1]["committed"]


def test_duplicate_insert_in_one_block_only(spark):
    rows = [(1, 0, "t", "5", "W"), (1, 1, "t", "5", "W"), (2, 2, "t", "5", "W")]
    got = {r["tx_id"]: r["committed"] for r in B.conflicts(spark.createDataFrame(rows, SETS)).collect()}
    assert got == {0: True, 1: False, 2: True}


def test_read_after_write_alone_commits(spark):
    f = flags(spark, (0, "W", "a"), (1, "R", "a"), (1, "W", "b"))
    assert f[1]["raw"] and f[1]["committed"]


def test_commit_order_is_serial(spark):
    """Replaying the committed transactions in the stated order gives what they saw in the snapshot."""
    rng = random.Random(5)
    rows = []
    for bid in range(8):
        for tx in range(12):
            for mode, n in (("R", 2), ("W", 1)):
                rows += [(bid, bid * 12 + tx, "r", str(k), mode) for k in rng.sample(range(10), n)]
    df = spark.createDataFrame(rows, SETS)
    order = B.commit_order(B.conflicts(df)).orderBy("bid", "place").collect()
    for bid, txs in itertools.groupby(order, key=lambda r: r["bid"]):
        written = set()
        for t in txs:
            reads = {k for b, i, _, k, m in rows if i == t["tx_id"] and m == "R"}
            assert not reads & written, (bid, t["tx_id"])
            writes = {k for b, i, _, k, m in rows if i == t["tx_id"] and m == "W"}
            assert not writes & written
            written |= writes


def test_payments_conserve_the_sum(spark):
    rng = random.Random(1)
    state = {str(i): 100 for i in range(50)}
    for bid in range(1, 4):
        moves = [(bid * 100 + i, *map(str, rng.sample(range(50), 2)), rng.randint(1, 20)) for i in range(30)]
        sets = [(bid, t, "bank", k, m) for t, a, b, _ in moves for k in (a, b) for m in "RW"]
        decided = B.conflicts(spark.createDataFrame(sets, SETS))
        writes = [(bid, t, k, v) for t, a, b, x in moves for k, v in ((a, state[a] - x), (b, state[b] + x))]
        new = B.apply_writes(spark.createDataFrame(list(state.items()), "key string, value long"), spark.createDataFrame(writes, "bid long, tx_id long, key string, value long"), decided)
        state = {r["key"]: r["value"] for r in new.collect()}
        assert sum(state.values()) == 5000 and len(state) == 50


def test_parse_blocks(spark):
    raw = spark.createDataFrame([('{"bid": 2, "txs": [{"hash": "a", "sql": "x"}, {"hash": "b"}]}',), ('{"bid": 1, "txs": [{"hash": "c", "sql": "y", "create_ts": "1"}]}',), ("nonsense",), ('{"bid": 3, "txs": []}',)], "block string")
    rows = B.parse_blocks(raw)
    assert {(r["hash"], r["error"]) for r in rows.collect()} == {("a", None), ("b", "no sql"), ("c", None), (None, "no bid"), (None, "no sql")}
    ids = {r["hash"]: r["tx_id"] for r in B.assign_ids(rows.filter(F.col("error").isNull())).collect()}
    assert ids == {"c": 0, "a": 1}


def test_empty_sets(spark):
    none = spark.createDataFrame([], SETS)
    assert B.conflicts(none).count() == 0
    assert B.last_committed(B.conflicts(none)).first()[0] == -1


def test_block_store(spark):
    from orrery.plans.service import BlockStore

    store = BlockStore(spark, first=1, size=2)
    raw = spark.createDataFrame([('{"bid":1,"txs":[{"hash":"a","sql":"w x"},{"hash":"b","sql":"w x"}]}',), ('{"bid":3,"txs":[{"hash":"d","sql":"r x"}]}',), ('{"bid":9,"txs":[{"hash":"z"}]}',)], "block string")
    assert [r["bid"] for r in store.submit_blocks(raw).collect()] == [9]
    key = F.split("sql", " ")

    def sets(txs):
        return txs.select("bid", "tx_id", F.lit("t").alias("rel"), key[1].alias("key"), F.upper(key[0]).alias("mode"))

    assert store.decide(sets) == 1 and [store.block_status(i) for i in (1, 2, 3)] == ["DECIDED", "UNKNOWN", "PENDING"]
    assert not store.wait(3, 0.1) and store.committed() == 1 and store.last_committed() == 0
    store.add(2, spark.createDataFrame([("c", "w y")], "hash string, sql string"))
    assert store.decide(sets) == 3 and store.wait(3, 5)
    with pytest.raises(ValueError):
        store.add(1, raw.select(F.lit("q").alias("hash"), F.lit("w x").alias("sql")))
    store.submit(spark.createDataFrame([(0, "e", "w x"), (1, "f", "w x"), (2, "g", "w x")], "seq long, hash string, sql string"))
    asked = spark.createDataFrame([(x,) for x in "abcdegz"], "hash string")
    assert {r["hash"]: r["status"] for r in store.results(asked).collect()} == {"a": "COMMITTED", "b": "ABORTED", "c": "COMMITTED", "d": "COMMITTED", "e": "PENDING", "g": "PENDING", "z": "UNKNOWN"}
    assert {r["hash"]: r["bid"] for r in store.transactions().collect() if r["bid"] > 3} == {"e": 4, "f": 4, "g": 5}
    store.reset()
    assert store.block_status(1) == "UNKNOWN" and store.committed() == 0


def test_a_block_of_more_than_a_document_holds_is_parsed_whole(spark):
    """Blocks of 5,501 and 2 transactions: none is lost, and places and ids go on over documents."""
    from orrery.queries import load
    from orrery.sources.storage import new_path

    path, n = new_path(spark, "many"), B.MAX_TXS + 3
    nation = F.when(F.col("id") < B.MAX_TXS + 1, 0).otherwise(1).cast("int").alias("c_nationkey")
    spark.range(n).select(F.col("id").alias("c_custkey"), nation).write.parquet(f"{path}/customer.parquet")
    rows = load()[0]["block_parse"](spark, path).collect()
    assert sorted((r.bid, r.position, r["hash"], r.tx_id) for r in rows) == [(int(i > B.MAX_TXS), i if i <= B.MAX_TXS else i - B.MAX_TXS - 1, f"h{i}", i) for i in range(n)]


def test_stream_of_blocks_is_cut_by_the_size_of_its_table(spark, sf_dir, monkeypatch):
    from orrery.operators import rewrites as R
    from orrery.queries import systems as Q
    from orrery.streaming import feeds as S

    seen, files = [], S.files
    monkeypatch.setattr(R, "TASK_BYTES", 16384)
    monkeypatch.setattr(S, "files", lambda spark, folder, name, schema, per_batch=1: seen.append((len(spark.read.parquet(folder).inputFiles()), per_batch)) or files(spark, folder, name, schema, per_batch))
    Q.stream_blocks(spark, sf_dir)
    assert seen[0][0] > 3 and 1 < seen[0][1] < seen[0][0]
