"""Arrays: the dialect's null rules, positions from 1, and integer sets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def array_length(a: Column, dimension: int = 1) -> Column:
    """Null for an empty array and for dimensions that it has not."""
    return F.when(F.size(a) > 0, F.size(a)) if dimension == 1 else F.when(F.size(a) > 0, array_length(a[0], dimension - 1))


def array_position(a: Column, x: object) -> Column:
    """From 1; null where absent."""
    return F.nullif(F.array_position(a, x), F.lit(0))


def array_positions(a: Column, x: Column) -> Column:
    marked = F.transform(a, lambda v, i: F.when(v.eqNullSafe(x), i + 1))
    return F.filter(marked, lambda i: i.isNotNull())


def array_replace(a: Column, old: Column, new: Column) -> Column:
    return F.transform(a, lambda v: F.when(v.eqNullSafe(old), new).otherwise(v))


def array_remove(a: Column, x: Column) -> Column:
    """Also nulls can be removed."""
    return F.filter(a, lambda v: ~v.eqNullSafe(x))


def array_fill(x: Column, n: Column | int) -> Column:
    return F.array_repeat(x, n)


def array_slice(a: Column, low: int | None = None, high: int | None = None) -> Column:
    """a[low:high], both included; what lies outside is left out."""
    first = max(1, low if low is not None else 1)
    size = F.size(a)
    last = size if high is None else F.least(F.lit(high), size)
    return F.slice(a, first, F.greatest(last - first + 1, F.lit(0)))


def array_dims(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.concat(F.lit("[1:"), F.size(a).cast("string"), F.lit("]")))


def contains(a: Column, b: Column) -> Column:
    """a @> b."""
    return F.forall(b, lambda x: F.array_contains(a, x))


def overlaps(a: Column, b: Column) -> Column:
    """a && b."""
    return F.arrays_overlap(a, b)


def sort(a: Column, descending: bool = False) -> Column:
    return F.sort_array(a, not descending)


def uniq(a: Column) -> Column:
    """Without adjacent repetitions."""
    return F.filter(a, lambda x, i: (i == 0) | ~x.eqNullSafe(F.element_at(a, F.greatest(i, F.lit(1)))))


def index(a: Column, x: Column) -> Column:
    """idx(): from 1; 0 where absent."""
    return F.coalesce(F.array_position(a, x), F.lit(0))


def subarray(a: Column, start: int, length: int | None = None) -> Column:
    """From 1; a negative start counts from the end, a negative length leaves that many off."""
    n = F.size(a)
    first = F.lit(start) if start > 0 else F.greatest(n + start + 1, F.lit(1))
    count = n - first + 1 if length is None else (F.lit(length) if length >= 0 else n - first + 1 + length)
    return F.slice(a, first, F.greatest(count, F.lit(0)))


def union(a: Column, b: Column) -> Column:
    """a | b, sorted."""
    return F.sort_array(F.array_union(a, b))


def intersect(a: Column, b: Column) -> Column:
    """a & b, sorted."""
    return F.sort_array(F.array_intersect(a, b))


def minus(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_except(a, b))


def query_int(a: Column, query: str) -> Column:
    """a @@ query: numbers with & (and), | (or), ! (not) and brackets."""
    import re

    tokens = re.findall(r"\d+|[&|!()]", query)
    if "".join(tokens) != re.sub(r"\s", "", query):
        raise ValueError(f"malformed query: {query}")
    at = 0

    def either() -> Column:
        nonlocal at
        out = both()
        while at < len(tokens) and tokens[at] == "|":
            at += 1
            out = out | both()
        return out

    def both() -> Column:
        nonlocal at
        out = one()
        while at < len(tokens) and tokens[at] == "&":
            at += 1
            out = out & one()
        return out

    def one() -> Column:
        nonlocal at
        if at >= len(tokens):
            raise ValueError(f"malformed query: {query}")
        t = tokens[at]
        at += 1
        if t == "!":
            return ~one()
        if t == "(":
            out = either()
            if at >= len(tokens) or tokens[at] != ")":
                raise ValueError(f"malformed query: {query}")
            at += 1
            return out
        if not t.isdigit():
            raise ValueError(f"malformed query: {query}")
        return F.array_contains(a, int(t))

    out = either()
    if at != len(tokens):
        raise ValueError(f"malformed query: {query}")
    return out


def append(a: Column, x: Column) -> Column:
    """array_append(): a null array counts as empty."""
    return F.concat(F.coalesce(a, F.filter(F.array(x), lambda _: F.lit(False))), F.array(x))


def prepend(x: Column, a: Column) -> Column:
    """array_prepend()."""
    return F.concat(F.array(x), F.coalesce(a, F.filter(F.array(x), lambda _: F.lit(False))))


def cat(a: Column, b: Column) -> Column:
    """array_cat(): a null side is left out; two nulls are null."""
    return F.coalesce(F.concat(a, b), a, b)


def ndims(a: Column, depth: int = 1) -> Column:
    """array_ndims(): null for an empty array; depth: of the nested type."""
    return F.when(F.size(a) > 0, F.lit(depth))


def lower(a: Column) -> Column:
    """array_lower(): 1, or null for an empty array."""
    return F.when(F.size(a) > 0, F.lit(1))


def upper(a: Column) -> Column:
    """array_upper()."""
    return F.when(F.size(a) > 0, F.size(a))
