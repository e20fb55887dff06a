"""Quality rules as a short-circuit cascade.

Counts that describe a text are taken from every document. The verdict then runs
rules one after the other and stops at a document's first rejection. A sample
tells what each rule costs and rejects; rules run in order of rejection per cost. The
order changes the work, never the verdict, which is that of all rules together.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from orrery.llm.store import bernoulli, small_batches
from orrery.llm.textscan import Hasher, Words, mix, scan, window_starts

WIDTH = 5
#: Documents on which costs and rejections are estimated.
SAMPLE = 500
#: Longer texts are not among them; all are judged, whole.
SAMPLE_BYTES = 1 << 20

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[*b"#*$%&|<>"]] = 1
_LEAD = (np.arange(256) & 0xC0 != 0x80).astype(np.int64)  # first bytes of code points
_UPPER = np.array([ord("A") <= i <= ord("Z") for i in range(256)], np.int64)
_LETTER = np.array([(i < 128 and chr(i).isalpha()) or i >= 0x80 for i in range(256)])


def _sums(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(values))
    return total[end] - total[start]


def _again(key: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether an earlier equal key of one owner exists, and whether any other does."""
    full = key ^ mix((owner + 1).astype(np.uint64))
    order = np.argsort(full, kind="stable")
    same = full[order][1:] == full[order][:-1]
    earlier, several = np.zeros(len(key), bool), np.zeros(len(key), bool)
    earlier[order[1:][same]] = True
    several[order[1:][same]] = several[order[:-1][same]] = True
    return earlier, several


@dataclass
class Counts:
    """Counts of the documents of a slice."""

    words: Words
    edges: np.ndarray
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_lines: np.ndarray
    n_repeat_words: np.ndarray

    @property
    def base_failed(self) -> np.ndarray:
        return (self.n_words < 10) | (100 * self.n_repeat_words > 20 * self.n_words)


def count(words: Words, edges: np.ndarray, hasher: Hasher) -> Counts:
    """edges: the documents' bytes in the slice."""
    data, n = words.data, words.docs
    doc = words.doc_of_words()
    chars = np.bincount(doc, _sums(_LEAD[data], words.start, words.end), n).astype(np.int64)
    symbols = _sums(_SYMBOL[data], edges[:-1], edges[1:])
    # lines: from one \n or document edge to the next
    breaks = np.flatnonzero(data == 0x0A)
    begins = np.zeros(len(data) + 1, bool)
    begins[breaks + 1] = begins[edges[:-1]] = True
    low = np.flatnonzero(begins[:-1])
    high = np.append(low[1:], len(data))[: len(low)]
    high = high - ((data[high - 1] == 0x0A) if len(high) else 0)
    filled = np.searchsorted(words.start, high) > np.searchsorted(words.start, low)
    low, high = low[filled], high[filled]
    owner = np.searchsorted(edges, low, "right") - 1
    earlier, _ = _again(hasher.spans(data, low, high) + (high - low).astype(np.uint64), owner)
    plain = hasher.spans(data, words.start, words.end)
    start, length, of = window_starts(words.first, WIDTH)
    _, several = _again(hasher.windows(plain, start, length), of)
    cover = np.zeros(len(plain) + 1, np.int64)
    np.add.at(cover, start[several], 1)
    np.add.at(cover, start[several] + WIDTH, -1)
    repeat = np.bincount(doc, np.cumsum(cover[:-1]) > 0, n).astype(np.int64)
    return Counts(words, edges, words.counts, chars, symbols, np.bincount(owner, earlier, n).astype(np.int64), np.bincount(owner, minlength=n), repeat)


def _per(values: np.ndarray, words: np.ndarray) -> np.ndarray:
    return values / np.maximum(words, 1)


def _long_runs(c: Counts) -> np.ndarray:
    """Words found more than a tenth of the text three times in a row."""
    doc = c.words.doc_of_words()
    plain = Hasher(41).spans(c.words.data, c.words.start, c.words.end)
    runs = np.zeros(len(plain), bool)
    runs[2:] = (plain[2:] == plain[1:-1]) & (plain[2:] == plain[:-2]) & (doc[2:] == doc[:-2])
    return _per(np.bincount(doc, runs, c.words.docs), c.n_words) > 0.1


def _no_letters(c: Counts) -> np.ndarray:
    """Fewer than half of the words with a letter."""
    lettered = _sums(_LETTER[c.words.data], c.words.start, c.words.end) > 0
    return _per(np.bincount(c.words.doc_of_words(), lettered, c.words.docs), c.n_words) < 0.5


def _shouting(c: Counts) -> np.ndarray:
    """More than six tenths of the words with two capitals or more and none else but symbols."""
    upper = _sums(_UPPER[c.words.data], c.words.start, c.words.end)
    letters = _sums(_LETTER[c.words.data], c.words.start, c.words.end)
    return _per(np.bincount(c.words.doc_of_words(), (upper >= 2) & (upper == letters), c.words.docs), c.n_words) > 0.6


#: Rejections: the name, and True for each document of a slice that it rejects.
RULES: dict[str, Callable[[Counts], np.ndarray]] = {
    "symbols": lambda c: c.n_symbols > 0.1 * c.n_words,
    "duplicate_lines": lambda c: (c.n_lines > 3) & (c.n_dup_lines > 0.4 * c.n_lines),
    "word_length": lambda c: (_per(c.word_chars, c.n_words) > 20) | (_per(c.word_chars, c.n_words) < 2),
    "runs": _long_runs,
    "letters": _no_letters,
    "shouting": _shouting,
}


def _subset(c: Counts, some: np.ndarray) -> Counts:
    """The counts of some documents; their words and bytes are moved together."""
    pieces = [c.words.data[a:b] for a, b in zip(c.edges[:-1][some].tolist(), c.edges[1:][some].tolist(), strict=True)]
    word = some[c.words.doc_of_words()]
    edges = np.append(0, np.cumsum(np.diff(c.edges)[some]))
    shift = np.repeat(edges[:-1] - c.edges[:-1][some], c.n_words[some])
    words = Words(0, int(some.sum()), np.concatenate(pieces) if pieces else np.zeros(0, np.uint8), c.words.start[word] + shift, c.words.end[word] + shift, np.append(0, np.cumsum(c.n_words[some])))
    return Counts(words, edges, *(getattr(c, k)[some] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")))


def verdict(c: Counts, order: list[str]) -> np.ndarray:
    """True for documents that no rule rejects; each rule sees only those still in."""
    alive = np.flatnonzero(~c.base_failed)
    left = _subset(c, ~c.base_failed) if len(alive) < c.words.docs else c
    for name in order:
        if not len(alive):
            break
        bad = RULES[name](left)
        if bad.any():
            alive, left = alive[~bad], _subset(left, ~bad)
    kept = np.zeros(c.words.docs, bool)
    kept[alive] = True
    return kept


def _slices(texts: pa.Array) -> Iterator[tuple[Words, np.ndarray]]:
    from orrery.llm.textscan import buffers

    _, offsets = buffers(texts)
    for words in scan(texts):
        yield words, offsets[words.low : words.high + 1] - offsets[words.low]


def plan(docs: DataFrame, sample: int = SAMPLE) -> list[str]:
    """Order of the rules, from their costs and rejections on about `sample` documents chosen by a hash of id and text.

    The order is all that the sample decides, so the longest texts (over SAMPLE_BYTES) may be left out of it.
    """
    chosen = docs.filter(F.octet_length("text") <= SAMPLE_BYTES).filter(bernoulli(F.xxhash64("doc_id", F.octet_length("text")), docs.count(), sample))
    rows = chosen.select("text").limit(2 * sample).toArrow()
    cost, bad, seen = dict.fromkeys(RULES, 1e-9), dict.fromkeys(RULES, 0), 0
    hasher = Hasher(43)
    for words, edges in _slices(rows["text"].combine_chunks()):
        c = count(words, edges, hasher)
        c = _subset(c, ~c.base_failed)
        seen += c.words.docs
        for name, rule in RULES.items():
            began = time.perf_counter()
            rejected = rule(c)
            bad[name] += int(rejected.sum())
            _subset(c, ~rejected)  # what a rejection costs belongs to the rule
            cost[name] += time.perf_counter() - began
    return sorted(RULES, key=lambda x: (-(bad[x] + 0.5) / (seen + 1) / cost[x], x))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Counts and verdict of each row.

    docs needs an id and a text; other columns are ignored. Result: doc_id, n_words,
    word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept. A null or empty text
    has counts of 0 and fails; a long one is counted whole. Rows are judged each by itself, so repeated rows agree; an empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    small_batches(docs.sparkSession)
    order = plan(rows, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(43)
        for batch in batches:
            for words, edges in _slices(batch.column(1)):
                c = count(words, edges, hasher)
                columns = [c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(words.low, words.docs), *(pa.array(x, pa.int64()) for x in columns), pa.array(c.base_failed), pa.array(verdict(c, order))], names)

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return rows.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")
