"""Licence scans, in DataFrame operations only.

A multinomial logistic regression over words and word pairs, kept sparse by an L1
penalty, says of each paragraph which licence family it belongs to or that it
is none (`unknown`); its probabilities are calibrated on templates that the fit did not see. What it
predicts counts only if the paragraph also resembles a template of that family. A paragraph is a line, and
where lines are not enough by themselves, as in wrapped notices, a run of adjacent ones: their n-grams' weights add up. The model is small and
is learned on the driver from the templates and a bounded sample of lines; a
paragraph without any weighted n-gram has the probabilities of the bias, which are those of `unknown`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from orrery.llm.licence_texts import OTHERS, TEMPLATES
from orrery.llm.store import bernoulli, keyed, settled

WORD = r"[A-Za-z0-9]+(?:[.-][0-9A-Za-z]+)*"
UNKNOWN = "unknown"
#: Documents whose lines stand for `unknown` (about), lines taken of them at most, and characters of a line.
SAMPLE_DOCS, SAMPLE_LINES, SAMPLE_CHARS = 400, 1000, 2000
#: Parts that the templates of each family are dealt into for calibration.
FOLDS = 2
#: Least calibrated probability of a licence (of any family), and least share of n-grams in common with a template of the likeliest.
PROBABILITY, RESEMBLANCE = 0.5, 0.6
#: Of a paragraph with fewer n-grams, the share is of so many (or of the template's, if these are fewer): five words.
LEAST_GRAMS = 9
#: Least gain of a line's n-grams, for some family over unknown, with which it may be a part of a wrapped notice.
EVIDENCE = 1.0
PENALTY, STEPS = 1e-3, 150


def _grams(text: str) -> list[str]:
    words = re.findall(WORD, text.lower())
    return sorted({*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))})


def grams(line: Column) -> Column:
    """Distinct words and word pairs of a line, as _grams()."""
    words = F.regexp_extract_all(F.lower(line), F.lit(WORD), F.lit(0))
    return F.transform(F.array(words), lambda w: F.array_distinct(F.concat(w, F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))))[0]


def _variants(text: str) -> list[str]:
    """A text, its sentences, and runs of its words."""
    words = text.split()
    out = [text, *(x for x in re.split(r"(?<=[.;:])\s+", text) if len(x.split()) >= 5)]
    for share in (0.5, 0.7, 0.85):
        n = max(4, int(len(words) * share))
        out += [" ".join(words[i : i + n]) for i in range(0, max(1, len(words) - n + 1), max(1, (len(words) - n) // 3 or 1))]
    return list(dict.fromkeys(out))


@dataclass
class Model:
    """Class 0 is unknown. weights: n-gram to one weight per class; heat divides the logits."""

    families: list[str]
    weights: dict[str, list[float]]
    bias: list[float]
    heat: float


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _alike(y: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Weights of rows: unknown weighs as much as all families together, these alike, and inside a class the texts that its rows come from."""
    weight = 1.0 / np.bincount(source)[source]
    total = np.bincount(y, weight)
    return (np.where(y == 0, (total > 0).sum() - 1, 1) * weight / total[y]).astype(np.float32)


def _descend(x: np.ndarray, y: np.ndarray, source: np.ndarray, classes: int, penalty: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases by proximal gradient steps with momentum."""
    weight = _alike(y, source)
    weight = (weight / weight.sum())[:, None]
    goal = np.eye(classes, dtype=np.float32)[y]
    w, b = np.zeros((x.shape[1], classes), np.float32), np.zeros(classes, np.float32)
    b[0] = 3.0
    ahead, ahead_b, t = w, b, 1.0
    rate = 4.0 / max(1e-9, float((weight * (x * x).sum(axis=1, keepdims=True)).sum()) + 1)
    for _ in range(steps):
        gap = weight * (_softmax(x @ ahead + ahead_b) - goal)
        new = ahead - rate * (x.T @ gap)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        new_b, later = ahead_b - rate * gap.sum(axis=0), (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_b = new + (t - 1) / later * (new - w), new_b + (t - 1) / later * (new_b - b)
        w, b, t = new, new_b, later
    b[0] = max(b[0], b[1:].max() + 1)  # without any weighted n-gram a paragraph is unknown
    return w, b


def fit(others: list[str], templates: list[tuple[str, str]] = TEMPLATES, penalty: float = PENALTY, steps: int = STEPS, folds: int = FOLDS) -> Model:
    """Learn from templates and other lines; of these, what resembles a template or is a part of one is left out.

    The temperature is chosen for models that miss a part of each family's templates, on all variants of that
    part; the model itself has seen all.
    """
    families = [UNKNOWN, *sorted({f for f, _ in templates})]
    known = [set(_grams(t)) for _, t in templates]

    def licence(own: set[str]) -> bool:
        return any(len(t & own) >= 0.8 * min(len(t), max(len(own), 9)) for t in known)

    nth: dict[str, int] = {}
    rows: list[tuple[int, int, int, str]] = []  # class, fold, number of the text it comes from, text
    for i, (f, t) in enumerate(templates):
        rows += [(families.index(f), nth.get(f, 0) % folds, i, v) for v in _variants(t)]
        nth[f] = nth.get(f, 0) + 1
    rows += [(0, i % folds, len(templates) + i, x) for i, x in enumerate(x for x in [*OTHERS * 3, *others] if not licence(set(_grams(x))))]
    features = [_grams(x) for *_, x in rows]
    column = {g: i for i, g in enumerate(sorted({g for (c, *_), own in zip(rows, features, strict=True) if c for g in own}))}
    x, (y, part, source) = np.zeros((len(rows), len(column)), np.float32), (np.array([r[k] for r in rows]) for k in range(3))
    for i, own in enumerate(features):
        x[i, [column[g] for g in own if g in column]] = 1
    logits, truth = [], []
    for k in range(folds):
        w, b = _descend(x[part != k], y[part != k], source[part != k], len(families), penalty, steps)
        logits.append(x[part == k] @ w + b)
        truth.append(np.flatnonzero(part == k))
    held, at = np.concatenate(logits), np.concatenate(truth)
    right, share = y[at], _alike(y[at], source[at])

    def loss(heat: float) -> float:
        return float(-(share * np.log(_softmax(held / heat)[np.arange(len(held)), right] + 1e-9)).sum())

    heat = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=loss)
    w, b = _descend(x, y, source, len(families), penalty, steps)
    found = {g: [float(v) for v in w[i]] for g, i in column.items() if np.abs(w[i]).max() > 1e-3}
    return Model(families, found, [float(v) for v in b], heat)


def train(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES) -> Model:
    """fit() with lines of about `sample_docs` documents, chosen by a hash of id and length, and of each line its beginning.

    No text leaves its task: only lines do, at most `sample_lines` of SAMPLE_CHARS characters from each.
    """
    chosen = docs.filter(bernoulli(F.xxhash64(F.col(doc_id), F.length(F.col(text))), docs.count(), sample_docs))
    lines = chosen.select(F.explode(F.split(F.col(text), "\n")).alias("line")).select(F.substring("line", 1, SAMPLE_CHARS).alias("line")).filter(F.length("line") > 0)
    return fit([x["line"] for x in lines.orderBy(F.xxhash64("line"), "line").limit(sample_lines).collect()])


def hashes(line: Column) -> Column:
    """Distinct hashes of a line's words and word pairs."""
    words = F.regexp_extract_all(F.lower(line), F.lit(WORD), F.lit(0))

    def both(w: Column) -> Column:
        less = F.greatest(F.size(w) - 1, F.lit(0))
        return F.array_distinct(F.concat(F.transform(w, lambda x: F.xxhash64(x)), F.zip_with(F.slice(w, 1, less), F.slice(w, 2, less), lambda x, y: F.xxhash64(x, y))))

    return F.transform(F.array(words), both)[0]


def _constant(values: list, kind: str) -> Column:
    """An array literal: folded once, when the query is planned."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


class Lookup:
    """The model's n-grams by place in a small table of slots, as array literals: no join, so a line's sums stay in its row.

    place: of a slot's n-gram, 0 for none; known: the hash that stands at a place, so that other n-grams of a slot are told apart.
    """

    def __init__(self, spark: SparkSession, model: Model) -> None:
        grams_ = sorted(model.weights)
        rows = [(i, *(g.split(" ") + [None])[:2]) for i, g in enumerate(grams_)]
        own = spark.createDataFrame(rows, "i int, a string, b string").select("i", F.when(F.col("b").isNull(), F.xxhash64("a")).otherwise(F.xxhash64("a", "b")).alias("h"))
        found = [r["h"] for r in own.orderBy("i").collect()]  # of the model's n-grams
        at = np.array(found, np.int64)
        slots = next(n for n in range(64 * len(found) + 1, 1 << 30, 2) if len(np.unique(at % n)) == len(at))
        place = np.zeros(slots, np.int64)
        place[at % slots] = np.arange(1, len(at) + 1)
        weights = np.array([model.weights[g] for g in grams_]).reshape(len(grams_), len(model.families))
        self.slots, self.place, self.known = slots, _constant(place.tolist(), "int"), _constant([0, *found], "bigint")
        self.weights = [_constant([0.0, *weights[:, k].tolist()], "double") for k in range(len(model.families))]
        gain = np.maximum((weights[:, 1:] - weights[:, :1]).max(axis=1, initial=0), 0)
        self.gain = _constant([0.0, *gain.tolist()], "double")
        #: Of a line's gains, the least sum with which it can be as likely a licence as none.
        self.least = float(min(model.bias[0] - b for b in model.bias[1:]) - model.heat * np.log(len(model.bias) - 1))

    def places(self, hashed: Column) -> Column:
        def one(h: Column) -> Column:
            i = F.get(self.place, F.pmod(h, F.lit(self.slots)).cast("int"))
            return F.when(F.get(self.known, i) == h, i)

        return F.filter(F.transform(hashed, one), lambda i: i.isNotNull())

    @staticmethod
    def total(places: Column, of: Column) -> Column:
        return F.aggregate(places, F.lit(0.0), lambda total, i: total + F.get(of, i))


def _judged(summed: DataFrame, model: Model) -> DataFrame:
    """With family (the likeliest that is not unknown) and probability (that it is not unknown), from sums of weights (w0, w1, ...)."""
    logits = [(F.col(f"w{i}") + F.lit(b)) / F.lit(model.heat) for i, b in enumerate(model.bias)]
    best = F.greatest(*(F.struct(x.alias("logit"), F.lit(f).alias("family")) for x, f in zip(logits[1:], model.families[1:], strict=True)))
    known, none = sum((F.exp(x - F.col("best.logit")) for x in logits[1:]), F.lit(0.0)), F.exp(logits[0] - F.col("best.logit"))
    return summed.withColumn("best", best).withColumn("family", F.col("best.family")).withColumn("probability", known / (known + none)).drop("best")


def paragraphs(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """Lines that may be a licence's or a part of one, and each document's first: doc_id, row, line, paragraph, w0, w1, ... (sums of weights), family, probability.

    row tells apart rows of one id; line counts from 0. Other lines' n-grams gain too little for any family, as
    a bound tells that takes each n-gram's largest gain; EVIDENCE is the least for a part.
    """
    look = Lookup(docs.sparkSession, model)
    own = [F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")]
    rows = docs.select(*own, F.col(row).alias("row")) if row else keyed(docs, *own, name="row")
    lines = rows.select("doc_id", "row", F.posexplode_outer(F.split("text", "\n")).alias("line", "paragraph"))
    met = lines.withColumn("_at", look.places(hashes(F.col("paragraph"))))
    gained = met.withColumn("_gain", look.total(F.col("_at"), look.gain))
    kept = gained.filter((F.col("line") == 0) | (F.col("_gain") >= min(look.least, EVIDENCE)))
    return _judged(kept.select("doc_id", "row", "line", "paragraph", *(look.total(F.col("_at"), w).alias(f"w{k}") for k, w in enumerate(look.weights))), model)


def _confirmed(found: DataFrame, resemblance: float) -> DataFrame:
    """doc_id, row, line, family, probability and resemblance of those paragraphs that resemble a template of their family."""
    templates = found.sparkSession.createDataFrame([(f, _grams(t)) for f, t in TEMPLATES], "family string, template array<string>")
    named = found.select("doc_id", "row", "line", "family", "probability", grams(F.col("paragraph")).alias("own"))
    met = named.join(F.broadcast(templates), "family")  # the fixed templates
    most = F.greatest(F.least(F.size("own"), F.size("template")), F.least(F.size("template"), F.lit(LEAST_GRAMS)))
    share = F.size(F.array_intersect("own", "template")) / F.greatest(most, F.lit(1))
    return met.groupBy("doc_id", "row", "line", "family", "probability").agg(F.max(share).alias("resemblance")).filter(F.col("resemblance") >= resemblance)


def scan(docs: DataFrame, model: Model | None = None, doc_id: str = "doc_id", text: str = "text", probability: float = PROBABILITY, resemblance: float = RESEMBLANCE, row: str | None = None) -> DataFrame:
    """Confirmed licence paragraphs, and a bare first line of each row of docs: doc_id, row, line, family, probability, resemblance.

    line: the first of the paragraph's; family and figures are null in the bare ones.
    Lines that are not confirmed by themselves but may be a part of a notice are judged in runs of adjacent ones.
    probability: that the paragraph is a licence's; family: the likeliest. resemblance: of the n-grams of the paragraph or of a template of its family,
    whichever has fewer, the share that the other has too; the largest over the templates.
    """
    model = model or train(docs, text, doc_id)
    sums, keys = [f"w{i}" for i in range(len(model.families))], ["doc_id", "row", "line"]
    found = paragraphs(docs, model, doc_id, text, row)
    part = F.greatest(*(F.col(n) for n in sums[1:])) - F.col("w0") >= EVIDENCE
    # lines that are neither likely nor a possible part go on bare
    some = F.when(part | (F.col("probability") >= probability), F.struct("paragraph", "family", "probability", part.alias("part"), *sums))
    lines = settled(found.select(*keys, some.alias("own")), "licence-lines")
    known = lines.filter(F.col("own").isNotNull()).select(*keys, "own.*")
    sure = settled(_confirmed(known.filter(F.col("probability") >= probability), resemblance), "licences-of-lines")
    left = known.filter("part").join(sure.select(*keys), keys, "left_anti")
    run = F.col("line") - F.row_number().over(Window.partitionBy("doc_id", "row").orderBy("line"))
    runs = left.withColumn("_run", run).groupBy("doc_id", "row", "_run").agg(
        F.min("line").alias("line"), F.count("*").alias("_n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "paragraph"))), lambda x: x["paragraph"]), " ").alias("paragraph"), *(F.sum(n).alias(n) for n in sums)
    )
    judged = settled(_judged(runs.filter("_n > 1").select(*keys, "paragraph", *sums), model), "licence-runs")
    wrapped = _confirmed(judged.filter(F.col("probability") >= probability), resemblance)
    bare = lines.filter("line = 0").select(*keys, F.lit(None).cast("string").alias("family"), *(F.lit(None).cast("double").alias(c) for c in ("probability", "resemblance")))
    return bare.unionByName(sure).unionByName(wrapped)


def licences(docs: DataFrame, **options: object) -> DataFrame:
    """Licence families of each document.

    docs needs an id and a text; other columns are ignored. Result: one row per row
    of docs: doc_id, n_paragraphs (confirmed licence paragraphs), families (distinct, sorted), probability and
    resemblance (the largest, null without any). A null or empty text has none; a long one is read whole. Rows are judged each by itself, so
    repeated rows agree; an empty table gives no rows. Of families that are equally likely the last by name is taken.
    """
    found = scan(docs, **options)
    return found.groupBy("doc_id", "row").agg(F.count("family").alias("n_paragraphs"), F.array_sort(F.collect_set("family")).alias("families"), F.max("probability").alias("probability"), F.max("resemblance").alias("resemblance")).drop("row")
