"""Count-min sketches of hashes that are dealt over portions, without a limit of size.

The hashes of a portion are a partition's sketch: the cells they touch in each row,
as gaps of some bytes, and how often, where more than once. Cells are dealt by ranges (blocks), and
a task merges a block's cells of all portions. No task and not the driver ever holds a
whole sketch, and nothing is broadcast: the merged counts go back to each portion, for
the cells it touched and in their order. A count is never less than that of the hash,
so no repeated hash is lost. The number of cells grows with the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Cells of a row for each hash, at least: one in some 60 to 300 single hashes counts as repeated.
LOAD = 8
#: Blocks of a row, while a block has at most 2**MAX_SPAN cells (a byte each while it is merged).
BLOCKS_BITS, MAX_SPAN = 8, 25
#: Multipliers of the rows.
ROWS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)

#: A portion's cells of a block: how many, their gaps, and where which have counts above one.
CELLS = pa.schema([("row", pa.int32()), ("block", pa.int64()), ("portion", pa.int32()), ("size", pa.int32()), ("cells", pa.binary()), ("places", pa.binary()), ("counts", pa.binary())])
CELLS_DDL = "row int, block long, portion int, size int, cells binary, places binary, counts binary"
#: For a portion's cells of a block, whether their counts are above one, and for these the levels.
ANSWERS = pa.schema([("portion", pa.int32()), ("row", pa.int32()), ("block", pa.int64()), ("flags", pa.binary()), ("levels", pa.binary())])
ANSWERS_DDL = "portion int, row int, block long, flags binary, levels binary"

#: Level of a count: 0 for one, then a step for each doubling.
_LEVEL = np.ceil(np.log2(np.maximum(np.arange(256), 1))).astype(np.uint8)


def width_bits(expected: float) -> int:
    """Bits of a row's width for that many hashes."""
    return int(max(16, np.ceil(np.log2(max(1.0, LOAD * expected)))))


def span_bits(bits: int) -> int:
    """Bits of a block's width."""
    return min(max(16, bits - BLOCKS_BITS), MAX_SPAN, bits)


def _pack(gaps: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Numbers in groups of seven bits, the last with a clear top bit; and the bytes' edges."""
    sizes = np.ones(len(gaps), np.int64)
    for k in range(1, 9):
        more = gaps >= np.uint64(1 << 7 * k)
        if not more.any():
            break
        sizes += more
    edges = np.append(0, np.cumsum(sizes))
    out = np.zeros(int(edges[-1]), np.uint8)
    for k in range(int(sizes.max(initial=0))):
        own = np.flatnonzero(sizes > k)
        part = (gaps[own] >> np.uint64(7 * k)).astype(np.uint8) & 0x7F
        out[edges[own] + k] = part | ((sizes[own] > k + 1).astype(np.uint8) << 7)
    return out.tobytes(), edges


def _unpack(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(steps < 128)
    first = np.append(0, last[:-1] + 1) if len(last) else last
    out = np.zeros(len(last), np.int64)
    for k in range(int((last - first).max(initial=-1)) + 1):
        own = np.flatnonzero(last - first >= k)
        out[own] |= (steps[first[own] + k] & 0x7F).astype(np.int64) << 7 * k
    return out


def pack_gaps(ascending: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """Runs of ascending numbers (which begin at `starts`) as bytes."""
    gaps = np.diff(ascending.astype(np.int64), prepend=0)
    gaps[starts] = ascending[starts]
    data, edges = _pack(gaps.astype(np.uint64))
    bounds = [*edges[starts].tolist(), len(data)]
    return [data[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def unpack_gaps(runs: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """The numbers of all runs, one run after another."""
    gaps = _unpack(b"".join(runs))
    total = np.cumsum(gaps)
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    return total - np.repeat(total[starts] - gaps[starts], sizes[sizes > 0])


def _cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (hashes * np.uint64(ROWS[row])) >> np.uint64(64 - bits)


def _edges(ascending: np.ndarray) -> np.ndarray:
    """Where a new number begins."""
    return np.flatnonzero(np.append(True, ascending[1:] != ascending[:-1])) if len(ascending) else np.zeros(0, np.int64)


def cells(hashes: np.ndarray, portion: int, bits: int) -> pa.Table:
    """The sketch of a portion."""
    span, found = span_bits(bits), []
    for row in range(len(ROWS)):
        at = np.sort(_cells(hashes, row, bits))
        first = _edges(at)
        count = np.minimum(np.diff(first, append=len(at)), 255).astype(np.uint8)
        at = at[first]
        block = (at >> np.uint64(span)).astype(np.int64)
        starts = _edges(block)
        sizes = np.diff(starts, append=len(at))
        inside = (at & np.uint64((1 << span) - 1)).astype(np.int64)
        several = np.flatnonzero(count > 1)
        owner = np.searchsorted(starts, several, "right") - 1
        has = _edges(owner)
        places, counts = [b""] * len(starts), [b""] * len(starts)
        if len(several):
            runs = pack_gaps(several - starts[owner], has)
            for i, a, b, run in zip(owner[has].tolist(), has.tolist(), [*has[1:].tolist(), len(several)], runs, strict=True):
                places[i], counts[i] = run, count[several[a:b]].tobytes()
        packed = pack_gaps(inside, starts) if len(at) else []
        n = len(starts)
        found.append(pa.Table.from_arrays([pa.array(np.full(n, row), pa.int32()), pa.array(block[starts], pa.int64()), pa.array(np.full(n, portion), pa.int32()), pa.array(sizes, pa.int32()), pa.array(packed, pa.binary()), pa.array(places, pa.binary()), pa.array(counts, pa.binary())], schema=CELLS))
    return pa.concat_tables(found)


def merged(sketches: DataFrame, bits: int, levels: bool) -> DataFrame:
    """Answers to all portions; levels: not only which counts are above one, but about how many."""
    span = span_bits(bits)

    def merge(key: tuple, parts: pa.Table) -> pa.Table:
        sizes = parts["size"].to_numpy().astype(np.int64)
        at = unpack_gaps(parts["cells"].to_pylist(), sizes)
        bounds = np.append(0, np.cumsum(sizes))
        counts = np.ones(len(at), np.uint8)
        for low, places, own in zip(bounds[:-1].tolist(), parts["places"].to_pylist(), parts["counts"].to_pylist(), strict=True):
            if own:
                counts[low + np.cumsum(_unpack(places))] = np.frombuffer(own, np.uint8)
        total = np.zeros(1 << span, np.uint8)
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):  # a portion has each cell once
            own = at[low:high]
            total[own] += np.minimum(counts[low:high], 255 - total[own])
        level = _LEVEL[total[at]]
        ahead = np.append(0, np.cumsum(-(-sizes // 8)))
        padded = np.zeros(8 * int(ahead[-1]), bool)
        padded[np.arange(len(at)) + np.repeat(8 * ahead[:-1] - bounds[:-1], sizes)] = level > 0
        bytes_, some = np.packbits(padded, bitorder="little").tobytes(), level[level > 0].tobytes()
        until = np.append(0, np.cumsum(level > 0))[bounds]
        kept = np.flatnonzero(np.diff(until))
        flags = [bytes_[ahead[i] : ahead[i + 1]] for i in kept.tolist()]
        values = [some[until[i] : until[i + 1]] if levels else b"" for i in kept.tolist()]
        n = len(kept)
        return pa.Table.from_arrays([parts["portion"].combine_chunks().take(pa.array(kept)), pa.array(np.full(n, key[0].as_py()), pa.int32()), pa.array(np.full(n, key[1].as_py()), pa.int64()), pa.array(flags, pa.binary()), pa.array(values, pa.binary())], schema=ANSWERS)

    return sketches.groupBy("row", "block").applyInArrow(merge, ANSWERS_DDL)


def _ordered(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The values in ascending order, and where each was."""
    room = max(1, len(values)).bit_length()
    if bits + room > 64:
        order = np.argsort(values)
        return values[order], order
    both = np.sort(values << np.uint64(room) | np.arange(len(values), dtype=np.uint64))
    return both >> np.uint64(room), (both & np.uint64((1 << room) - 1)).astype(np.int64)


def levels(hashes: np.ndarray, answers: pa.Table, bits: int) -> np.ndarray:
    """For each hash of a portion 0 if it occurs once only, else a level that grows with its count.

    answers: those of merged() to the portion. 0 may be a larger number for a hash that occurs once, never the other way round.
    The level depends on the hash alone, not on the portion.
    """
    span, out = span_bits(bits), np.full(len(hashes), 255, np.uint8)
    of = answers["row"].to_numpy()
    for row in range(len(ROWS)):
        at, order = _ordered(_cells(hashes, row, bits), bits)
        first = _edges(at)
        unique, found = at[first], np.zeros(len(first), np.uint8)
        own = answers.filter(pa.array(of == row))
        block = own["block"].to_numpy().astype(np.uint64)
        low, high = (np.searchsorted(unique, edge << np.uint64(span)).tolist() for edge in (block, block + np.uint64(1)))
        for a, b, flags, values in zip(low, high, own["flags"].to_pylist(), own["levels"].to_pylist(), strict=True):
            some = np.unpackbits(np.frombuffer(flags, np.uint8), count=b - a, bitorder="little").astype(bool)
            found[a:b][some] = np.frombuffer(values, np.uint8) if values else 1
        place = np.repeat(np.arange(len(first)), np.diff(first, append=len(at)))
        spread = np.empty(len(hashes), np.uint8)
        spread[order] = found[place]
        out = np.minimum(out, spread)
    return out
