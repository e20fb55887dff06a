"""WARC archives: one gzip member per record, written and read one after another.

Pages with equal payloads are stored once; the others become `revisit` records
that refer to the stored one. Archives are written to the shared folder, each by
one task and under its name only when complete. The reader inflates members piece
by piece, frames records by Content-Length and checks the digests of block and
payload; its memory does not depend on the size of an archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from orrery.llm.store import AtomicFile, discard, new_path, open_fs, settled, small_batches

CHUNK = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "uri string, records long, bytes long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, intact boolean"


class DamagedArchive(ValueError):
    pass


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    digest = base32_sha1(hashlib.sha1(payload).digest())
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        *([] if url is None else ["WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)]),
        *([] if refers_to is None else [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]),
        "Content-Type: application/http; msgtype=response",
        f"WARC-Block-Digest: sha1:{base32_sha1(hashlib.sha1(block).digest())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(pages: DataFrame, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write a record per row of pages; the manifest has one row per archive.

    pages: an id, a url and a text; other columns are ignored. Of rows with equal
    payloads of at least `min_bytes` bytes those with the smallest id are responses
    and the others revisit it; smaller payloads are always responses. A null text
    is an empty payload, a null url gives no WARC-Target-URI, a row without an id is a response;
    rows alike in id and payload are all responses. Urls and texts may have any length. An empty table gives no archive.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    digests = settled(rows.filter(F.octet_length("html") >= min_bytes).select("page_id", F.sha1("html").alias("digest")), "digests")
    # one row per payload that occurs with several ids; of a hot payload only partial sums are shuffled
    first = settled(digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).filter(F.col("refers_to") < F.col("last")).drop("last"), "first")
    # both sides of this join are plain tables, so that a hot payload's rows can be split among tasks
    revisits = digests.join(first, "digest").filter(F.col("page_id") > F.col("refers_to")).distinct()
    keyed = rows.withColumn("digest", F.sha1("html")).join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")
    folder = new_path(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = None, 0
        for batch in batches:
            ids, urls, htmls, refers = batch.columns
            for i in range(batch.num_rows):
                if out is None:
                    out = AtomicFile(folder, f"part-{TaskContext.get().partitionId():06d}.warc.gz")
                out.write(_gzip(_record(ids[i].as_py(), urls[i].as_py(), htmls[i].as_py().encode(), refers[i].as_py(), date)))
                n += 1
        if out is not None:
            out.commit()
            yield pa.RecordBatch.from_pydict({"uri": [out.uri], "records": [n], "bytes": [out.size]})

    small_batches(spark)
    manifest = settled(keyed.mapInArrow(write, MANIFEST), "manifest")
    discard(digests, first)
    return manifest


class _Member:
    """The inflated bytes of one gzip member, as they arrive."""

    def __init__(self, source: Any, held: bytes) -> None:
        self.source, self.held, self.packed, self.inflate = source, b"", held, zlib.decompressobj(31)

    def more(self) -> bool:
        """Inflate another piece; False at the member's end."""
        while not self.inflate.eof:
            data = self.inflate.unconsumed_tail or self.packed or self.source.read(CHUNK)
            if not data:
                raise DamagedArchive("an archive ends inside a record")
            self.packed = b""
            if piece := self.inflate.decompress(data, CHUNK):
                self.held += piece
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        begin = 0
        while (at := self.held.find(mark, begin)) < 0:
            begin = max(0, len(self.held) - len(mark) + 1)
            if not self.more():
                raise DamagedArchive("a record has no header")
        found, self.held = self.held[:at], self.held[at + len(mark) :]
        return found

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self.more():
                raise DamagedArchive("a record is shorter than its Content-Length")
            piece, self.held = self.held[:n], self.held[n:]
            n -= len(piece)
            yield piece


def _fields(lines: list[bytes]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines)}


def _id(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def read_records(source: Any, payloads: bool = False) -> Iterator[dict[str, Any]]:
    """The records of an open archive, in order. intact: both digests agree."""
    held = b""
    while held or (held := source.read(CHUNK)):
        member = _Member(source, held)
        version, *lines = member.until(b"\r\n\r\n").split(b"\r\n")
        if not version.startswith(b"WARC/1."):
            raise DamagedArchive(f"not a WARC record: {version[:40]!r}")
        head, block, payload, http = _fields(lines), hashlib.sha1(), hashlib.sha1(), b""
        length, inside, kept = int(head["content-length"]), False, []
        for piece in member.take(length):
            block.update(piece)
            if not inside:
                http += piece
                before, mark, piece = http.partition(b"\r\n\r\n")
                inside, http = bool(mark), before if mark else http
            if inside:
                payload.update(piece)
                if payloads:
                    kept.append(piece)
        if not inside:
            raise DamagedArchive("a record has no HTTP header")
        while member.more():
            pass
        if member.held != b"\r\n\r\n":
            raise DamagedArchive("a record does not end after its Content-Length")
        revisit, said = head["warc-type"] == "revisit", head["warc-payload-digest"].removeprefix("sha1:")
        intact = head["warc-block-digest"] == f"sha1:{base32_sha1(block.digest())}" and (revisit or said == base32_sha1(payload.digest()))
        row = {"page_id": _id(head["warc-record-id"]), "url": head.get("warc-target-uri"), "record_type": head["warc-type"], "refers_to": _id(head.get("warc-refers-to"))}
        row |= {"payload_bytes": int(_fields(http.split(b"\r\n")[1:])["content-length"]), "payload_digest": said, "intact": intact}
        yield row | ({"payload": None if revisit else b"".join(kept)} if payloads else {})
        held = member.inflate.unused_data


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the archives that `manifest` names, an archive per task.

    Columns: page_id, url, record_type, refers_to, payload_bytes, payload_digest
    (both of the full payload, also of revisits), intact; with payloads=True also
    payload, null for revisits. A damaged archive fails the query.
    """
    schema = RECORDS + (", payload binary" if payloads else "")
    names = [x.split()[0] for x in schema.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    arrow = pa.schema([(n, types[x.split()[1]]) for n, x in zip(names, schema.split(", "), strict=True)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = open_fs(uri)
                rows: list[dict[str, Any]] = []
                size = 0
                with fs.open_input_stream(path, compression=None) as source:
                    for row in read_records(source, payloads):
                        rows.append(row)
                        size += 200 + len(row.get("payload") or b"")
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return manifest.select("uri").repartition(max(1, manifest.count())).mapInArrow(read, schema)


def archive(pages: DataFrame, **options: Any) -> DataFrame:
    """Write pages and read their records back."""
    return read_archives(write_archives(pages, **options))
