"""Enums, XML, key-value maps, label paths, cubes, segments, great circles, ISBN and system functions."""

from __future__ import annotations

import hashlib
import hmac as _hmac
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F


class Enum:
    """An ordered list of labels."""

    def __init__(self, *labels: str) -> None:
        self.labels = labels

    def ordinal(self, c: Column) -> Column:
        """The place of a label, for sorting and comparing."""
        return F.nullif(F.array_position(F.array(*map(F.lit, self.labels)), c), F.lit(0))

    def first(self) -> Column:
        return F.lit(self.labels[0])

    def last(self) -> Column:
        return F.lit(self.labels[-1])

    def range(self, low: str | None = None, high: str | None = None) -> Column:
        a = self.labels.index(low) if low is not None else 0
        b = self.labels.index(high) + 1 if high is not None else len(self.labels)
        return F.array(*map(F.lit, self.labels[a:b]))

    def valid(self, c: Column) -> Column:
        return c.isin(*self.labels)


# XML


def xml_escape(s: Column) -> Column:
    out = s
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def xmlelement(name: str, content: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), F.coalesce(xml_escape(content.cast("string")), F.lit("")), F.lit(f"</{name}>"))


def xmlforest(**columns: Column) -> Column:
    """An element per column that isn't null."""
    return F.concat_ws("", *(F.when(c.isNotNull(), xmlelement(n, c)) for n, c in columns.items()))


def xmlconcat(*parts: Column) -> Column:
    return F.concat_ws("", *parts)


def xmlcomment(text: str) -> Column:
    return F.lit(f"<!--{text}-->")


def xml_is_well_formed(s: Column) -> Column:
    @F.pandas_udf("boolean")
    def run(a: pd.Series) -> pd.Series:
        from xml.etree import ElementTree

        def ok(x: str | None) -> bool | None:
            if x is None:
                return None
            try:
                ElementTree.fromstring(f"<r>{x}</r>")
            except ElementTree.ParseError:
                return False
            return True

        return pd.Series([ok(x) for x in a], dtype=object)

    return run(s)


# Key-value maps and label paths


def hstore_delete(m: Column, *keys: str) -> Column:
    return F.map_filter(m, lambda k, _: ~k.isin(*keys))


def hstore_merge(a: Column, b: Column) -> Column:
    """a || b: b's values win."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)


def hstore_contains(a: Column, b: Column) -> Column:
    return F.forall(F.map_entries(b), lambda e: F.array_contains(F.map_keys(a), e["key"]) & F.element_at(a, e["key"]).eqNullSafe(e["value"]))


def ltree(s: Column) -> Column:
    return F.split(s, r"\.")


def nlevel(t: Column) -> Column:
    return F.size(t)


def subpath(t: Column, offset: int, length: int | None = None) -> Column:
    n = F.size(t)
    start = F.lit(offset) if offset >= 0 else n + offset
    count = n - start if length is None else (F.lit(length) if length >= 0 else n - start + length)
    return F.slice(t, start + 1, F.greatest(count, F.lit(0)))


def is_descendant(t: Column, ancestor: Column) -> Column:
    """t <@ ancestor."""
    return F.slice(t, 1, F.greatest(F.size(ancestor), F.lit(1))) == ancestor


def lca(a: Column, b: Column) -> Column:
    """The longest common prefix that is shorter than both."""
    n = F.least(F.size(a), F.size(b)) - 1
    same = F.filter(F.sequence(F.lit(0), n), lambda i: F.slice(a, 1, i) == F.slice(b, 1, i))
    return F.slice(a, 1, F.array_max(same))


def lquery(pattern: str) -> str:
    """Java pattern of an lquery with *, *{n,m}, |, ! and word* over the dotted text."""
    out = []
    for part in pattern.split("."):
        if part.startswith("*"):
            low, _, high = (part[2:-1].partition(",") if part.startswith("*{") else ("0", ",", ""))
            many = f"{{{low}}}" if part.startswith("*{") and "," not in part else f"{{{low or 0},{high}}}"
            out.append(rf"(?:[^.]+\.){many}")
        else:
            negated, body = part.startswith("!"), part.lstrip("!")
            words = "|".join(w[:-1] + "[^.]*" if w.endswith("*") else w for w in body.split("|"))
            out.append((rf"(?!(?:{words})\.)[^.]+\." if negated else rf"(?:{words})\."))
    return "^" + "".join(out) + "$"


def matches_lquery(path: Column, pattern: str) -> Column:
    return F.concat(path, F.lit(".")).rlike(lquery(pattern))


# Cubes, segments, the earth


def cube_distance(a: Column, b: Column) -> Column:
    """Euclidean, of two points as arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def cube_taxicab(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


def cube_chebyshev(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


#: Points of a and of b that are compared at once, about.
BLOCKS = 512, 2048
#: Labels that are broadcast, with their sizes; tasks at most.
FEW_LABELS, MOST_TASKS = 100_000, 20_000


def _points(lists: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: places and coordinates of the points without a null."""
    sizes = pc.fill_null(pc.list_value_length(lists), -1).to_numpy()
    flat = lists.flatten()
    starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    holes = np.concatenate(([0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))))
    whole = (sizes >= 0) & (holes[starts + np.maximum(sizes, 0)] == holes[starts])
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    found = {}
    for n in np.unique(sizes[whole]):
        at = np.flatnonzero(whole & (sizes == n))
        found[int(n)] = at, values[starts[at][:, None] + np.arange(n)]
    return found


def _distances(left: pa.Table, right: pa.Table) -> pa.Table:
    """All pairs of two blocks. Squares are added in the order of the coordinates, as cube_distance() does."""
    a, b = left["a"].combine_chunks(), right["b"].combine_chunks()
    d, known = np.zeros((len(a), len(b))), np.zeros((len(a), len(b)), bool)
    own, others = _points(left["x"].combine_chunks()), _points(right["y"].combine_chunks())
    for n in own.keys() & others.keys():
        (rows, x), (columns, y) = own[n], others[n]
        y = np.ascontiguousarray(y.T)
        for k in range(0, len(rows), 8):  # as many as the processor's cache holds
            some = x[k : k + 8]
            total, step = np.zeros((len(some), len(columns))), np.empty((len(some), len(columns)))
            for i in range(n):
                np.subtract(some[:, i, None], y[i], out=step)
                np.multiply(step, step, out=step)
                np.add(total, step, out=total)
            d[np.ix_(rows[k : k + 8], columns)] = np.sqrt(total)
        known[np.ix_(rows, columns)] = True
    pairs = {"a": a.take(pa.array(np.repeat(np.arange(len(a)), len(b)))), "b": b.take(pa.array(np.tile(np.arange(len(b)), len(a)))), "d": pa.array(d.ravel(), mask=~known.ravel())}
    return pa.table(pairs)


def cube_distances(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b and d of all pairs of a row of a(label, a, x) and one of b(label, b, y) with an equal label: cube_distance(x, y).

    Rows are dealt by their ids over blocks of about BLOCKS rows of a label, and each block of a meets each of b in
    one group: a group's memory does not grow with the table, and a label's pairs go over all cores. Points with a
    null or of unequal dimensions are at a null distance.
    """
    wide, high = BLOCKS
    counts = a.groupBy("label").agg(F.ceil(F.count("*") / wide).alias("m")).join(b.groupBy("label").agg(F.ceil(F.count("*") / high).alias("n")), "label")
    labels, blocks = counts.agg(F.count("*"), F.sum(F.col("m") * F.col("n"))).first()
    sizes = F.broadcast(counts) if labels <= FEW_LABELS else counts
    tasks = max(1, min(blocks or 0, MOST_TASKS))  # by pairs, not by bytes, which say little here
    each = lambda n, name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias(name)
    own = a.join(sizes, "label").select("label", "a", "x", F.pmod(F.xxhash64("a"), "m").alias("i"), each("n", "j"))
    others = b.join(sizes, "label").select("label", "b", "y", F.pmod(F.xxhash64("b"), "n").alias("j"), each("m", "i"))
    kinds = dict(a.dtypes) | dict(b.dtypes)
    keys = ["label", "i", "j"]
    return own.repartition(tasks, *keys).groupBy(keys).cogroup(others.repartition(tasks, *keys).groupBy(keys)).applyInArrow(_distances, f"a {kinds['a']}, b {kinds['b']}, d double")


def seg_overlaps(a: Column, b: Column) -> Column:
    """Segments struct(low, high)."""
    return (a["low"] <= b["high"]) & (b["low"] <= a["high"])


EARTH_RADIUS = 6378168.0


def earth_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres along the great circle."""
    p, q = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def ean13_valid(s: Column) -> Column:
    digits = F.regexp_extract_all(F.regexp_replace(s, "[- ]", ""), F.lit(r"(\d)"))
    total = F.aggregate(F.transform(digits, lambda d, i: d.cast("int") * F.when(i % 2 == 0, 1).otherwise(3)), F.lit(0), lambda a, x: a + x)
    return (F.size(digits) == 13) & (total % 10 == 0)


# System and others


def num_nulls(*columns: Column) -> Column:
    return sum((c.isNull().cast("int") for c in columns), F.lit(0))


def num_nonnulls(*columns: Column) -> Column:
    return sum((c.isNotNull().cast("int") for c in columns), F.lit(0))


def size_pretty(n: Column) -> Column:
    """Bytes with a unit; a unit is used from 10240 of the one below it."""
    out, rest = F.when(F.abs(n) < 10240, F.concat(n.cast("string"), F.lit(" bytes"))), n
    for i, unit in enumerate(("kB", "MB", "GB", "TB")):
        rest = n / (1024.0 ** (i + 1))
        shown = F.concat(F.round(rest).cast("long").cast("string"), F.lit(f" {unit}"))
        out = out.when(F.abs(F.round(rest)) < 10240, shown) if i < 3 else out.otherwise(shown)
    return out


def hmac(data: Column, key: str, kind: str = "sha256") -> Column:
    @F.pandas_udf("string")
    def run(a: pd.Series) -> pd.Series:
        return a.map(lambda x: None if x is None else _hmac.new(key.encode(), x.encode(), getattr(hashlib, kind)).hexdigest())

    return run(data)


def digest(data: Column, kind: str) -> Column:
    """md5, sha1, sha224, sha256, sha384 or sha512, as hexadecimal text."""
    return F.md5(data) if kind == "md5" else F.sha1(data) if kind == "sha1" else F.sha2(data, int(kind[3:]))


def any_of(values: Sequence[object]) -> Column:
    return F.array(*map(F.lit, values))


def xpath_table(df: DataFrame, key: str, xml: str, rows: str, **paths: str) -> DataFrame:
    """xml2's xpath_table(): a row for each element that `rows` (a path from the root) finds, with the texts of paths below it, null where there is none.

    Built-in paths must be constants and lose the place of what they find, so documents are parsed in Arrow batches.
    """
    root, _, below = rows.strip("/").partition("/")
    fields = ",".join(f"`{n}`:string" for n in paths)

    @F.pandas_udf(f"array<struct<`row`:int,{fields}>>")
    def run(texts: pd.Series) -> pd.Series:
        from xml.etree import ElementTree

        def found(text: str | None) -> list[dict] | None:
            if text is None:
                return None
            top = ElementTree.fromstring(text)
            elements = [] if top.tag != root else top.findall(below) if below else [top]
            return [{"row": i, **{n: e.findtext(path) for n, path in paths.items()}} for i, e in enumerate(elements, 1)]

        return texts.map(found)

    return df.select(key, F.explode(run(F.col(xml))).alias("_e")).select(key, "_e.*")
