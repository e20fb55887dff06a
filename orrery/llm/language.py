"""Language identification with a string kernel.

A text is the set of its byte n-grams of several lengths (blended spectrum,
presence only), over the n-grams of some landmark texts; the kernel of two texts is
the normalised size of what they share. Nyström landmarks give features of fixed
length, on which one-versus-rest ridge regressions are fitted. Texts are scored in
batches: presence matrix times landmark matrix times regression matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from orrery.llm.quality import fold
from orrery.llm.store import keyed, small_batches
from orrery.llm.textscan import LOWER, buffers, slices

LENGTHS = (2, 3, 4)
#: Texts per language that are learned from, and those of them that are landmarks.
SAMPLE, LANDMARKS = 240, 40
#: Longer texts are not learned from; all are judged, whole.
SAMPLE_BYTES = 1 << 16
RIDGE = 1e-2
UNKNOWN = "und"

_CODE_BITS = 20
_FOLD = LOWER.copy()
_FOLD[[i for i in range(128) if not chr(i).isalpha()]] = 0x20
_LETTER = np.array([i < 128 and chr(i).isalpha() for i in range(256)])


def grams(part: np.ndarray, edges: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of a slice of texts, and the text of each."""
    doc = np.repeat(np.arange(len(edges) - 1, dtype=np.int32), np.diff(edges))
    m = len(part) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.int32)
    code = np.full(m, n, np.uint32)
    for k in range(n):
        code = code * np.uint32(0x01000193) ^ part[k : k + m]
    code = code * np.uint32(0x9E3779B1) >> np.uint32(32 - _CODE_BITS)
    inside = doc[:m] == doc[n - 1 :]
    return code[inside], doc[:m][inside]


def folded(texts: pa.Array, limit: int = 1 << 18, docs: int = 64) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of at most `docs` texts in lower case, everything but letters as blanks."""
    data, offsets = buffers(texts)
    for first, last in slices(offsets, limit):
        for low in range(first, last, docs):
            high = min(low + docs, last)
            yield low, high, _FOLD[data[offsets[low] : offsets[high]]], offsets[low : high + 1] - offsets[low]


@dataclass
class Model:
    """place: index of a code in the landmarks' n-grams, or their number; landmarks, weights: matrices."""

    languages: list[str]
    place: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray
    direction: np.ndarray | None = None

    def presence(self, part: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Which landmark n-grams each text has, each row scaled to length one."""
        width = len(self.landmarks)
        found = np.zeros((len(edges) - 1, width + 1), np.float32)
        for n in LENGTHS:
            code, doc = grams(part, edges, n)
            found[doc, self.place[code]] = 1
        found = found[:, :width]
        return found / np.sqrt(np.maximum(found.sum(axis=1, keepdims=True), 1))

    def decide(self, part: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Kernel with the landmarks times weights; the two constant matrices are multiplied first, once."""
        if self.direction is None:
            self.direction = self.landmarks @ self.weights
        return self.presence(part, edges) @ self.direction


def fit(texts: list[str], languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """texts in random order; the first `landmarks` of each language are landmarks."""
    names = sorted(set(languages))
    chosen = [i for name in names for i in [j for j, x in enumerate(languages) if x == name][:landmarks]]
    codes = np.unique(np.concatenate([np.zeros(0, np.uint32), *(grams(part, edges, n)[0] for _, _, part, edges in folded(pa.array([texts[i] for i in chosen], pa.string())) for n in LENGTHS)]))
    place = np.full(1 << _CODE_BITS, len(codes), np.int32)
    place[codes] = np.arange(len(codes))
    model = Model(names, place, np.zeros((len(codes), 0), np.float32), np.zeros((0, 0), np.float32))
    x = np.concatenate([np.zeros((0, len(codes)), np.float32), *(model.presence(part, edges) for _, _, part, edges in folded(pa.array(texts, pa.string())))])
    model.landmarks = np.ascontiguousarray(x[chosen].T)
    near, among = (x @ model.landmarks).astype(float), (x[chosen] @ model.landmarks).astype(float)
    value, vector = np.linalg.eigh(among)
    keep = value > 1e-6 * max(1.0, value[-1] if len(value) else 1.0)
    root = vector[:, keep] / np.sqrt(value[keep])
    features = near @ root
    target = np.where(np.array(languages)[:, None] == np.array(names)[None], 1.0, -1.0)
    share = (target > 0).mean(axis=0)
    each = (1 / share)[np.array([names.index(x) for x in languages], int)] if names else np.zeros(0)  # rare languages weigh as much as common ones
    weighted = features * each[:, None]
    model.weights = (root @ np.linalg.solve(weighted.T @ features + ridge * len(texts) * np.eye(features.shape[1]), weighted.T @ target)).astype(np.float32)
    return model


def train(docs: DataFrame, where: Column | None = None, sample: int = SAMPLE, landmarks: int = LANDMARKS, most_bytes: int = SAMPLE_BYTES) -> Model | None:
    """Learn from at most `sample` documents per language, chosen by a hash of the id.

    docs: doc_id, text, lang; rows where one is null, those that `where` rules out, and texts of no or more than `most_bytes` bytes are left out.
    None without any. Rows of one id are chosen each by itself. So the driver gets `sample` texts of bounded
    length for each value of lang.
    """
    small_batches(docs.sparkSession)
    rows = keyed(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.col("lang"))
    known = (rows if where is None else rows.filter(where)).dropna().filter(F.octet_length("text").between(1, most_bytes))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "_row"))
    chosen = known.select("_row", "doc_id", "lang").withColumn("_n", first).filter(F.col("_n") <= sample).select("_row", "_n")
    found = sorted((x["_n"], x["doc_id"], x["text"], x["lang"]) for x in known.join(F.broadcast(chosen), "_row").collect())
    return fit([x[2] for x in found], [x[3] for x in found], landmarks) if found else None


def _lettered(text: str) -> bool:
    return any(map(str.isalpha, text))


def _judged(model: Model | None, texts: pa.Array) -> Iterator[tuple[int, int, list[str], np.ndarray]]:
    """Languages and scores, slice by slice."""
    for low, high, part, edges in folded(texts):
        some = np.array([bool(_LETTER[part[a:b]].any()) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)])
        for i in np.flatnonzero(~some).tolist():
            some[i] = edges[i] < edges[i + 1] and _lettered(texts[low + i].as_py())
        if model is None:
            yield low, high, [UNKNOWN] * (high - low), np.zeros(high - low)
            continue
        value = model.decide(part, edges)
        names = [model.languages[i] if ok else UNKNOWN for i, ok in zip(value.argmax(axis=1).tolist(), some.tolist(), strict=True)]
        yield low, high, names, np.where(some, np.clip((value.max(axis=1) + 1) / 2, 0, 1), 0).astype(float)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of each row.

    docs: doc_id and text; nothing else is looked at. A text that is null or has
    no letter is `und` with score 0; so is every text where nothing was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, names, best in _judged(shared.value, batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(names, pa.string()), pa.array(best)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def label(docs: DataFrame, model: Model | None, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the columns lang_pred and score (by those names), as identify(); all its columns go through."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, found, best in _judged(shared.value, batch.column(at)):
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string()), pa.array(best)], [*batch.schema.names, *names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]))


def classify(docs: DataFrame, folds: int = 3, held: int = 1, sample: int = SAMPLE, landmarks: int = LANDMARKS) -> DataFrame:
    """Languages of all documents, learned outside one fold.

    One row per row of docs: doc_id, held_out, lang_pred, score. Extra columns are ignored;
    an empty table gives no rows. A null or letterless text is `und`; a long one is judged whole. Of
    languages that score alike the first by name is taken. Rows of one id are judged each by itself.
    """
    model = train(docs, fold(F.col("doc_id"), folds) != held, sample, landmarks)
    found = identify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return found.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "lang_pred", "score")
