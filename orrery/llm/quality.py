"""Quality classifier: hashed word n-grams and a logistic regression.

The regression learns by follow-the-regularised-leader updates (per-coordinate
rates, L1 and L2) on a bounded sample of labelled documents. Words count as they
are written and by their shape (case, symbols, length, repetition of a word just before),
singly and in pairs. A score is a sparse dot product: the mean weight of a
document's n-grams, through the logistic function.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from orrery.llm.store import bernoulli, small_batches
from orrery.llm.textscan import Hasher, Words, mix, scan

BITS = 18
#: Labelled documents that are learned from, at most.
SAMPLE = 6000
#: Longer texts are not learned from; all are scored, whole.
SAMPLE_BYTES = 1 << 16
EPOCHS = 3
THRESHOLD = 0.3

_CLASS = np.zeros((4, 256), np.int32)  # upper case, lower case or beyond ASCII, digits, symbols
_CLASS[0, ord("A") : ord("Z") + 1] = 1
_CLASS[1, ord("a") : ord("z") + 1] = 1
_CLASS[1, 0x80:] = 1
_CLASS[2, ord("0") : ord("9") + 1] = 1
_CLASS[3, [*b"#*$%&|<>!@^~\\{}[]_=+`"]] = 1
_LENGTHS = np.array([2, 4, 8, 12, 20])


def _shapes(words: Words, plain: np.ndarray) -> np.ndarray:
    """A small number for how each word looks and whether it was just there."""
    counts = [np.minimum(np.add.reduceat(table[words.data], words.start), 2) for table in _CLASS]
    shape = counts[0] + 3 * counts[1] + 9 * counts[2] + 27 * counts[3]
    shape = shape * 6 + np.searchsorted(_LENGTHS, words.end - words.start)
    doc = words.doc_of_words()
    for back in (1, 2, 3):
        again = np.zeros(len(plain), bool)
        again[back:] = (plain[back:] == plain[:-back]) & (doc[back:] == doc[:-back])
        shape = shape * 2 + again
    return shape


def features(words: Words, hasher: Hasher, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets and documents of the n-grams of a slice, kind by kind."""
    if not len(words.start):
        return
    plain, doc = hasher.spans(words.data, words.start, words.end), words.doc_of_words()
    shape = mix(_shapes(words, plain).astype(np.uint64) + np.uint64(1))
    pairs = doc[1:] == doc[:-1]
    down = np.uint64(64 - bits)
    for salt, view in ((1, plain), (2, shape)):
        yield mix(view + np.uint64(salt)) >> down, doc
        yield mix(view[:-1] * np.uint64(0x9E3779B97F4A7C15) + view[1:] + np.uint64(10 + salt))[pairs] >> down, doc[1:][pairs]


@dataclass
class Model:
    """Weights of the buckets, and the bias."""

    weights: np.ndarray
    bias: float
    bits: int

    def scores(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
        hasher = Hasher(31)
        for words in scan(texts):
            total, n = np.zeros(words.docs), np.zeros(words.docs)
            for bucket, doc in features(words, hasher, self.bits):
                total += np.bincount(doc, self.weights[bucket], words.docs)
                n += np.bincount(doc, minlength=words.docs)
            yield words.low, words.high, 1 / (1 + np.exp(-np.clip(self.bias + total / np.maximum(n, 1), -40, 40)))


def fit(examples: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS, alpha: float = 20.0, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-3) -> Model:
    """Follow the regularised leader over (buckets, values, label) in the given order."""
    z, n, bias, bias_n = np.zeros(1 << bits), np.zeros(1 << bits), 0.0, 1.0

    def weights(i: np.ndarray) -> np.ndarray:
        near = z[i]
        return np.where(np.abs(near) <= l1, 0.0, -(near - np.sign(near) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for index, value, label in examples:
            w = weights(index)
            error = 1 / (1 + np.exp(-np.clip(bias + w @ value, -40, 40))) - label
            g = error * value
            step = (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / alpha
            z[index] += g - step * w
            n[index] += g * g
            bias_n += error * error
            bias -= 0.5 * error / np.sqrt(bias_n)
    return Model(weights(np.arange(1 << bits)).astype(np.float32), float(bias), bits)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", bits: int = BITS, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Model:
    """Learn from labelled documents: about `sample` of them, chosen by a hash of the id.

    docs: doc_id, text; labels: doc_id and a label of 0 or 1. Rows without a label
    or an id, and texts of more than `most_bytes` bytes, are left out; of rows (and labels) of one id one counts. Without labels every score is 0.5.
    Documents are learned from in the order of a hash of the id.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).dropna()
    some = known.filter(bernoulli(F.xxhash64("doc_id"), labels.count(), sample)).groupBy("doc_id").agg(F.min("label").alias("label"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).filter(F.octet_length("text") <= most_bytes)
    met = own.join(F.broadcast(some), "doc_id")  # of about `sample` rows
    # a task sends one row of an id at most
    rows = met.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))).filter("_n = 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(31)
        for batch in batches:
            for words in scan(batch.column(1)):
                parts = list(features(words, hasher, bits))
                bucket = np.concatenate([b for b, _ in parts] or [np.zeros(0, np.uint64)])
                doc = np.concatenate([d for _, d in parts] or [np.zeros(0, np.int64)])
                key, count = np.unique(doc.astype(np.uint64) << np.uint64(bits) | bucket, return_counts=True)
                owner = (key >> np.uint64(bits)).astype(np.int64)
                value = count / np.bincount(doc, minlength=words.docs)[owner] if len(key) else count
                bound = pa.array(np.searchsorted(owner, np.arange(words.docs + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(bound, x) for x in (pa.array((key & np.uint64((1 << bits) - 1)).astype(np.int32)), pa.array(value.astype(np.float32)))]
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(words.low, words.docs) for i in (0, 2)] + lists, ["doc_id", "label", "bucket", "value"])

    found = rows.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label int, bucket array<int>, value array<float>").toArrow()
    order = np.lexsort((found["label"].to_numpy(), mix(found["doc_id"].to_numpy().astype(np.uint64))))
    bucket, value, label_of = found["bucket"].combine_chunks(), found["value"].combine_chunks(), found["label"].to_numpy()
    examples = [(bucket[i].values.to_numpy(), value[i].values.to_numpy().astype(float), int(label_of[i])) for i in order.tolist()]
    return fit(examples, bits) if examples else Model(np.zeros(1 << bits, np.float32), 0.0, bits)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text modulo n; of an empty text for null."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 where score >= threshold) of each row.

    docs: doc_id and text; nothing else is looked at. A null or empty text has the score of the
    bias alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, found in shared.value.scores(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(found), pa.array((found >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, sample: int = SAMPLE) -> DataFrame:
    """Scores of all documents, learned from the labels outside one fold.

    One row per row of docs: doc_id, held_out, score, predicted. Extra columns are
    ignored; empty tables give no rows. A null or empty text has the score of the bias; a long one is scored whole.
    Rows of one id are scored each by itself.
    """
    known = labels.filter(fold(F.col("doc_id"), folds) != 0)
    small_batches(docs.sparkSession)
    scored = score(docs, train(docs, known, sample=sample))
    return scored.select("doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), "score", "predicted")
