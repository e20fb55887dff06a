"""Removal of word windows that an earlier document already has.

Documents are dealt over portions once. First pass: each portion's windows become a
count-min sketch; merged, it says for each portion which of its windows may be repeated. Second pass: only these
are grouped, exactly. What a portion can settle by itself it does: all its documents but
the smallest that hold a window learn there that there is a smaller one. So a window
goes to the shuffle once per portion, however many documents share it. Third pass: documents meet the
hashes of their repeated windows and lose the words these cover.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from orrery.llm import sketch
from orrery.llm.store import PORTION, in_portions, keyed, small_batches
from orrery.llm.textscan import Hasher, Words, give_back, mix, scan, window_starts

#: Words of a window.
WIDTH = 13
#: Windows that are compared in one group.
GROUP = 1_000_000

#: Either windows of a portion to compare (first, second, docs from base), or hashes of its documents (first, docs, counts).
FOUND = pa.schema([("bucket", pa.int32()), ("portion", pa.int32()), ("base", pa.int64()), ("first", pa.binary()), ("second", pa.binary()), ("docs", pa.binary()), ("counts", pa.binary())])
FOUND_DDL = "bucket int, portion int, base long, first binary, second binary, docs binary, counts binary"
MARKS = "portion int, docs binary, counts binary, hashes binary"
_LAST = (1 << 63) - 1


def _hashes(words: Words, a: Hasher, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and document of each window."""
    start, length, doc = window_starts(words.first, width)
    return a.windows(a.spans(words.data, words.start, words.end), start, length), start, doc


def _groups(first: np.ndarray, second: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by window and document; for each place in it whether it holds the window's smallest document."""
    order = np.lexsort((docs, second, first))
    a, b, d = first[order], second[order], docs[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    least = d[np.flatnonzero(new)][np.cumsum(new) - 1] if len(d) else d
    return order, d == least


def _marks(portions: np.ndarray, docs: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """The distinct hashes of each document: portion, documents, how many hashes each has, and these."""
    order = np.lexsort((first, docs, portions))
    at, docs, first = portions[order], docs[order], first[order]
    keep = np.ones(len(docs), bool)
    keep[1:] = (at[1:] != at[:-1]) | (docs[1:] != docs[:-1]) | (first[1:] != first[:-1])
    at, docs, first = at[keep], docs[keep], first[keep]
    edges = np.append(np.flatnonzero(np.append(True, at[1:] != at[:-1])), len(at)) if len(at) else np.zeros(1, np.int64)
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        own = docs[low:high]
        new = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        yield int(at[low]), own[new].tobytes(), np.diff(new, append=len(own)).astype(np.uint32).tobytes(), first[low:high].tobytes()


def _settle(first: np.ndarray, second: np.ndarray, docs: np.ndarray, portion: int, buckets: int) -> pa.Table:
    """What a portion knows of its windows, and the windows that it has to compare with other portions'."""
    order, least = _groups(first, second, docs)
    first, second, docs = first[order], second[order], docs[order]
    rows: list[tuple] = [(portion % buckets, portion, None, hashes, None, own, counts) for _, own, counts, hashes in _marks(np.full(int((~least).sum()), portion), docs[~least], first[~least])]
    once = least.copy()
    once[1:] &= ~((first[1:] == first[:-1]) & (second[1:] == second[:-1]))
    first, second, docs = first[once], second[once], docs[once]
    base = int(docs.min()) if len(docs) else 0
    kind = np.uint32 if len(docs) and int(docs.max()) - base < 1 << 32 else np.uint64
    edges = np.searchsorted(first, np.ceil(np.arange(1, buckets) * (2.0**64 / buckets)).astype(np.uint64))
    for bucket, (a, b, d) in enumerate(zip(np.split(first, edges), np.split(second, edges), np.split(docs, edges), strict=True)):
        if len(a):
            rows.append((bucket, portion, base, a.tobytes(), b.tobytes(), (d - base).astype(kind).tobytes(), None))
    columns = list(zip(*rows, strict=True)) or [()] * len(FOUND)
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(columns, FOUND.types, strict=True)], schema=FOUND)


def _docs(blob: bytes, n: int, base: int) -> np.ndarray:
    return np.frombuffer(blob, np.uint32 if len(blob) == 4 * n else np.uint64).astype(np.int64) + base


def repeats(placed: DataFrame, size: float, width: int = WIDTH, group: int = GROUP) -> DataFrame:
    """Hashes of windows that start in a document with a smaller id.

    placed: doc_id, text (neither null), portion; size: about how many words. A row holds some
    hashes of some documents of one portion; they are 64 bits each and meant to be
    looked up within their document. Windows of different documents are compared by 96 bits
    that come from two independent hashes of each word.
    """
    bits, buckets = sketch.width_bits(size), int(max(1, np.ceil(size / 4 / group)))

    def outline(texts: pa.Table) -> pa.Table:
        a = Hasher(11)
        found = sketch.cells(np.concatenate([np.zeros(0, np.uint64), *(_hashes(words, a, width)[0] for words in scan(texts["text"]))]), texts["portion"][0].as_py(), bits)
        give_back()
        return found

    def find(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows or not answers.num_rows:
            return FOUND.empty_table()
        a, b, ids = Hasher(11), Hasher(12, words=3), texts["doc_id"].to_numpy()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for words in scan(texts["text"]):
            first, start, doc = _hashes(words, a, width)
            second = (b.windows(b.spans(words.data, words.start, words.end), start, width) >> np.uint64(32)).astype(np.uint32)
            held.append((first, second, ids[words.low + doc]))
        first, second, docs = (np.concatenate(x) for x in zip(*held, strict=True))
        kept = sketch.levels(first, answers, bits) > 0
        found = _settle(first[kept], second[kept], docs[kept], texts["portion"][0].as_py(), buckets)
        give_back()
        return found

    def compare(parts: pd.DataFrame) -> pd.DataFrame:
        known = parts["counts"].notna()
        done = parts[known]
        out = list(zip(done["portion"].astype("int64"), done["docs"], done["counts"], done["first"], strict=True))
        rest = parts[~known]
        first = [np.frombuffer(x, np.uint64) for x in rest["first"]]
        docs = [_docs(x, len(f), int(base)) for x, f, base in zip(rest["docs"], first, rest["base"], strict=True)]
        second = [np.frombuffer(x, np.uint32) for x in rest["second"]]
        portion = np.repeat(rest["portion"].to_numpy(np.int64), [len(x) for x in first])
        a, b, d = (np.concatenate([np.zeros(0, t), *x]) for x, t in ((first, np.uint64), (second, np.uint32), (docs, np.int64)))
        order, least = _groups(a, b, d)
        out += _marks(portion[order][~least], d[order][~least], a[order][~least])
        give_back()
        return pd.DataFrame(out, columns=["portion", "docs", "counts", "hashes"])

    answers = sketch.merged(placed.groupBy("portion").applyInArrow(outline, sketch.CELLS_DDL), bits, levels=False)
    found = placed.groupBy("portion").cogroup(answers.groupBy("portion")).applyInArrow(find, FOUND_DDL)
    return found.groupBy("bucket").applyInPandas(compare, MARKS)


def _joined(words: Words, kept: np.ndarray) -> list[str]:
    """The kept words of each document, joined by single spaces."""
    start, length = words.start[kept], (words.end - words.start)[kept]
    step = length + 1
    ahead = np.cumsum(step) - step
    total = int(step.sum())
    out = np.full(total, 0x20, np.uint8)
    place = np.arange(int(length.sum()))
    before = np.repeat(np.cumsum(length) - length, length)
    out[place - before + np.repeat(ahead, length)] = words.data[place - before + np.repeat(start, length)]
    bound = np.append(ahead, total)[np.append(0, np.cumsum(kept))[words.first]]
    data = out.tobytes()
    return [data[a : max(a, b - 1)].decode() for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)]


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, group: int = GROUP, portion: int = PORTION) -> DataFrame:
    """Remove each word that a window covers which starts in a document with a smaller id.

    docs needs an id and a text; other columns are ignored. Result: one row per row
    of docs: doc_id, n_words, n_removed, kept (the words left, joined by single
    spaces), spans (removed runs of words: first, and past the last). Windows are judged on
    the input. A null or short text loses nothing; a long one is handled whole. Rows of one id are one document when windows are judged;
    a null id counts as the largest, and all rows without one as one document. An empty table gives no rows.
    portion: bytes of text that a task handles at once, about; rows are dealt by a key of their own, so equal ids do no harm.
    """
    small_batches(docs.sparkSession)
    known = F.col(doc_id).cast("long")
    rows = keyed(docs, known.alias("known"), F.coalesce(known, F.lit(_LAST)).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    placed = in_portions(rows, size, portion).drop("_row")

    def strip(texts: pa.Table, marks: pa.Table) -> pa.Table:
        a = Hasher(11)
        ids = texts["doc_id"].to_numpy()
        keys = [np.zeros(0, np.uint64)]
        for docs, counts, hashes in zip(*(marks[c].to_pylist() for c in ("docs", "counts", "hashes")), strict=True):
            owner = np.repeat(np.frombuffer(docs, np.int64), np.frombuffer(counts, np.uint32))
            keys.append(np.frombuffer(hashes, np.uint64) ^ mix(owner.astype(np.uint64)))
        marked = np.sort(np.concatenate(keys))
        out = []
        for words in scan(texts["text"]):
            count = len(words.start)
            edges = np.zeros(count + 1, np.int64)
            if len(marked):
                first, start, doc = _hashes(words, a, width)
                own = first ^ mix(ids[words.low : words.high].astype(np.uint64))[doc]
                at = np.minimum(np.searchsorted(marked, own), len(marked) - 1)
                start = start[marked[at] == own]
                np.add.at(edges, start, 1)
                np.add.at(edges, start + width, -1)
            gone = np.cumsum(edges[:-1]) > 0
            turn = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
            low, high = turn[::2], turn[1::2]
            # a run that goes on into the next document is cut there
            inner = words.first[1:-1]
            inner = inner[(inner > 0) & (inner < count)]
            inner = np.unique(inner[gone[inner] & gone[inner - 1]]) if len(inner) else inner
            low, high = np.sort(np.concatenate((low, inner))), np.sort(np.concatenate((high, inner)))
            owner = np.searchsorted(words.first, low, "right") - 1
            base = words.first[owner] if len(low) else low
            spans = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(owner, np.arange(words.docs + 1)), pa.int32()),
                pa.StructArray.from_arrays([pa.array(low - base, pa.int32()), pa.array(high - base, pa.int32())], ["first", "past"]),
            )
            removed = np.append(0, np.cumsum(gone))[words.first]
            known = texts["known"].combine_chunks().slice(words.low, words.docs)
            out.append(pa.RecordBatch.from_arrays([known, pa.array(words.counts, pa.int64()), pa.array(np.diff(removed), pa.int64()), pa.array(_joined(words, ~gone), pa.string()), spans], schema=result))
        return pa.Table.from_batches(out, schema=result)

    result = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())])))])
    marks = repeats(placed, size / 6, width, group)
    return placed.groupBy("portion").cogroup(marks.groupBy("portion")).applyInArrow(strip, "doc_id long, n_words long, n_removed long, kept string, spans array<struct<first:int,past:int>>")
