"""Token ids in compact binary files.

Texts are encoded once; ids are then counted over all documents and numbered by
falling frequency, so that common ids are small. A document's numbers are stored
in one to four bytes each, whose lengths stand apart in control bytes (four
lengths a byte), and are decoded by numpy table lookups. Files hold documents in
ascending order of doc_id, and each is written by one task.

File: magic; then per document a header (doc_id, flag of a known doc_id, number of
ids, bytes of data), its control bytes and its data.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from orrery.llm.store import AtomicFile, discard, keyed, new_path, open_fs, settled, small_batches
from orrery.llm.textscan import Hasher, buffers, give_back, slices

MAGIC = b"ORRTOK1\n"
HEADER = "<q?IQ"
END_ID = 0
#: Pieces of text that a worker remembers the ids of; then it starts anew. Speed only.
CACHE = 1_000_000
SLOT_BITS = 21
#: Pieces of a string that the tokenizer gets.
MANY = 4000
#: Bytes of text encoded at once.
SLICE = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x0A, 0x0D, 0x09]] = True
_HIDDEN = np.zeros(256, bool)
_HIDDEN[:0x21] = True
_HIDDEN[0x7F] = True


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cuts(data: np.ndarray) -> np.ndarray:
    """Places where a text may be cut without changing its ids.

    Byte-level pre-tokenisation never joins what precedes a run of white space to
    that run, so cuts stand before white space that follows a visible character.
    White space outside ASCII is never next to a cut.
    """
    if len(data) < 2:
        return np.zeros(0, np.int64)
    ok = _SPACE[data]
    ok[0] = False
    ok[1:] &= ~_HIDDEN[data[:-1]]
    at = np.flatnonzero(ok)
    one = data[at - 1]
    two, three = np.where(at > 1, data[at - 2], 0), np.where(at > 2, data[at - 3], 0)
    wide = ((two == 0xC2) & ((one == 0x85) | (one == 0xA0))) | ((three == 0xE1) & (two == 0x9A)) | ((three == 0xE2) & ((two == 0x80) | (two == 0x81))) | ((three == 0xE3) & (two == 0x80))
    return at[~wide]


def _runs(length: np.ndarray, first: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... length[i] numbers for each i, one after another."""
    ahead = np.cumsum(length) - length
    return np.repeat(first - ahead, length) + np.arange(int(length.sum()))


class Encoder:
    """Ids of many texts at once: each distinct piece between cuts is encoded once.

    Pieces that are not remembered are put together into long strings, which the
    tokenizer encodes whole; ids tell by the lengths of their bytes where a piece ends.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.hasher, self.other = Hasher(77), Hasher(78)
        special = {i: len(x.content.encode()) for i, x in self.tokenizer.get_added_tokens_decoder().items()}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)  # a character stands for each byte
        self.bytes = np.zeros(1 + max([0, *vocabulary.values(), *special]), np.int64)
        self.bytes[list(vocabulary.values())] = [len(x) for x in vocabulary]
        self.bytes[list(special)] = list(special.values())
        self.clear()

    def clear(self) -> None:
        """Remember nothing. slot: of a piece's hash; key, check (a second hash), first, size: of what stands there."""
        self.slot = np.zeros(1 << SLOT_BITS, np.int32)
        self.key, self.check, self.first, self.size = np.zeros(1, np.uint64), np.zeros(1, np.uint64), np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _encoded(self, start: np.ndarray, end: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces one after another, and how many each has."""
        length = end - start
        joined = data[_runs(length, start)]
        edges = np.append(0, np.cumsum(length))
        safe = np.isin(edges[:-1], cuts(joined), assume_unique=True)
        apart = np.flatnonzero(~safe)  # here a new string begins
        limits = np.append(apart, len(length))
        more = [np.arange(a, b, MANY) for a, b in zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True) if b - a > MANY]
        limits = np.unique(np.concatenate([limits, *more]))
        text = joined.tobytes()
        at = edges[limits].tolist()
        found = self.tokenizer.encode_batch_fast([text[a:b].decode() for a, b in zip(at[:-1], at[1:], strict=True)], add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, np.uint32), *(np.array(x.ids, np.uint32) for x in found)])
        past = np.cumsum(self.bytes[ids])
        if len(past) and past[-1] != edges[-1]:
            raise ValueError("the tokenizer is not a byte-level one")
        return ids, np.diff(np.searchsorted(past, edges, "right"))

    def _learn(self, keys: np.ndarray, checks: np.ndarray, start: np.ndarray, end: np.ndarray, data: np.ndarray) -> None:
        ids, size = self._encoded(start, end, data)
        place = np.arange(len(self.key), len(self.key) + len(keys))
        self.slot[keys >> np.uint64(64 - SLOT_BITS)] = place
        self.key, self.check = np.concatenate([self.key, keys]), np.concatenate([self.check, checks])
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        data, offsets = buffers(texts)
        for low, high in slices(offsets, SLICE):
            part = data[offsets[low] : offsets[high]]
            edges = offsets[low : high + 1] - offsets[low]
            begins = np.zeros(len(part) + 1, bool)
            begins[cuts(part)] = begins[edges[:-1]] = True
            start = np.flatnonzero(begins[:-1])
            end = np.append(start[1:], len(part))[: len(start)]
            keys = self.hasher.spans(part, start, end) + (end - start).astype(np.uint64)
            keys[keys == 0] = 1  # 0 stands for nothing
            checks = self.other.spans(part, start, end)  # a piece is known by 128 bits
            if len(self.key) > CACHE:
                self.clear()
            place = self.slot[keys >> np.uint64(64 - SLOT_BITS)]
            unknown = np.flatnonzero((self.key[place] != keys) | (self.check[place] != checks))
            if len(unknown):
                own = keys[unknown]
                second = checks[unknown]
                order = np.lexsort((second, own))
                new = np.ones(len(order), bool)
                new[1:] = (own[order][1:] != own[order][:-1]) | (second[order][1:] != second[order][:-1])
                at, before = unknown[order[new]], len(self.key)
                self._learn(keys[at], checks[at], start[at], end[at], part)
                place[unknown[order]] = before + np.cumsum(new) - 1
            size = self.size[place]
            ids = self.ids[_runs(size, self.first[place])]
            bound = np.append(0, np.cumsum(size))[np.searchsorted(start, edges)].tolist()
            for a, b in zip(bound[:-1], bound[1:], strict=True):
                yield ids[a:b]


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """An encoder that a Python worker keeps from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.int64) + 1


KEPT = np.arange(4) <= np.arange(4)[:, None]


def pack(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    n = numbers.astype("<u4")
    extra = (n >= 1 << 8).astype(np.uint8) + (n >= 1 << 16) + (n >= 1 << 24)
    padded = np.zeros(-(-len(n) // 4) * 4, np.uint8)
    padded[: len(n)] = extra
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    kept = KEPT[extra]
    return control.tobytes(), n.view(np.uint8).reshape(-1, 4)[kept].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    length = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(length) - length
    source = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = source[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(length > k)
        out[more] |= source[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, n_tokens, packed ids and their crc32 of each row, the end id included. A null text has the end id alone."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack_ids = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            encoder = encoder_of(path)
            out: list[bytes] = []
            counts: list[int] = []
            marks: list[int] = []
            for ids in encoder.encode(batch.column(1)):
                ids = np.append(ids, np.uint32(end_id))
                counts.append(len(ids))
                small = ids.max() < 1 << 16
                marks.append(zlib.crc32(ids))
                out.append((b"2" if small else b"4") + pack_ids.compress(ids.astype("<u2" if small else "<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(out, pa.binary()), pa.array(marks, pa.int64())], ["doc_id", "n_tokens", "ids", "mark"])
        give_back()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary, mark long")


def _ids(blob: bytes, unpacker: zstandard.ZstdDecompressor) -> np.ndarray:
    return np.frombuffer(unpacker.decompress(blob[1:]), "<u2" if blob[:1] == b"2" else "<u4").astype(np.uint32)


def frequencies(encoded: DataFrame) -> DataFrame:
    """id and number of occurrences over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker, counts = zstandard.ZstdDecompressor(), np.zeros(0, np.int64)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                more = np.bincount(_ids(blob, unpacker))
                if len(more) > len(counts):
                    counts = np.append(counts, np.zeros(len(more) - len(counts), np.int64))
                counts[: len(more)] += more
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen], pa.int64())], ["id", "n"])

    return encoded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write(docs: DataFrame, **options: Any) -> tuple[DataFrame, np.ndarray]:
    """Write the files; the manifest (a row per file) and the ids by rank.

    The ids by rank are bounded by the vocabulary, and are stored beside the files.
    """
    spark = docs.sparkSession
    small_batches(spark)
    encoded = settled(encode(docs, **options), "encoded")
    counts = frequencies(encoded).orderBy(F.desc("n"), "id").toPandas()  # at most one row per id of the vocabulary
    by_rank = counts["id"].to_numpy(np.uint32)
    rank = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    shared, folder = spark.sparkContext.broadcast(rank), new_path(spark, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker, ranks, out, n, tokens = zstandard.ZstdDecompressor(), shared.value, None, 0, 0
        at = TaskContext.get().partitionId()
        for batch in batches:
            for doc, blob in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if out is None:
                    out = AtomicFile(folder, f"part-{at:06d}.tokens")
                    out.write(MAGIC)
                ids = ranks[_ids(blob, unpacker)]
                control, data = pack(ids)
                out.write(struct.pack(HEADER, doc or 0, doc is not None, len(ids), len(data)) + control + data)
                n, tokens = n + 1, tokens + len(ids)
        if out is not None:
            out.commit()
            yield pa.RecordBatch.from_pydict({"at": [at], "uri": [out.uri], "docs": [n], "tokens": [tokens]})

    # rows without an id or with one id are dealt over ranges too, by what they hold and then by their place
    ordered = keyed(encoded).repartitionByRange("doc_id", "mark", "_row").sortWithinPartitions("doc_id", "mark", "_row")
    manifest = settled(ordered.mapInArrow(run, "at long, uri string, docs long, tokens long"), "token-files")
    discard(encoded)
    table = AtomicFile(folder, "ids-by-rank.u4")
    table.write(by_rank.astype("<u4").tobytes())
    table.commit()
    return manifest, by_rank


def read(manifest: DataFrame, by_rank: np.ndarray, ids: bool = False) -> DataFrame:
    """The documents of the files: doc_id, start, n_tokens, ids_crc32; with ids=True also ids."""
    shared = manifest.sparkSession.sparkContext.broadcast(by_rank)
    before = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    files = manifest.select("uri", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start"))
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, path = open_fs(uri)
                with fs.open_input_stream(path, compression=None, buffer_size=1 << 20) as source:
                    if source.read(len(MAGIC)) != MAGIC:
                        raise ValueError(f"{uri} is not a token file")
                    rows: list[tuple] = []
                    size = 0
                    while head := source.read(struct.calcsize(HEADER)):
                        doc, known, n, length = struct.unpack(HEADER, head)
                        body = source.read(-(-n // 4) + length)
                        if len(body) != -(-n // 4) + length:
                            raise ValueError(f"{uri} ends inside a document")
                        found = table[unpack(body[: -(-n // 4)], body[-(-n // 4) :], n)].astype("<u4")
                        rows.append((doc if known else None, start, n, zlib.crc32(found.tobytes()), *([found] if ids else [])))
                        start, size = start + n, size + n
                        if len(rows) >= 5000 or ids and size > 1 << 20:
                            yield _batch(rows, names)
                            rows, size = [], 0
                    if rows:
                        yield _batch(rows, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if ids else "")
    return files.repartition(max(1, manifest.count())).mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = [pa.int64()] * 4 + [pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), types, strict=False)], names)


def tokenize(docs: DataFrame, **options: Any) -> DataFrame:
    """Encode, write and read back.

    docs needs an id and a text; other columns are ignored. Result: one row per row
    of docs, in files of ascending doc_id: doc_id, start (ids of all documents
    before it), n_tokens (the end id included), ids_crc32. A null or empty text has
    one id; a long one is encoded piece by piece. Rows of one id follow each other, in an order that their ids fix; a null id comes first. Equally
    frequent ids are numbered in ascending order. An empty table gives no rows.
    """
    return read(*write(docs, **options))
