"""Ranges as struct(lower, upper, lower_inc, upper_inc, empty); a null bound is infinite."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def make(lower: Column, upper: Column, bounds: str = "[)", discrete: bool = False) -> Column:
    """A range; discrete ones (int, date) are brought to the form [lower, upper)."""
    low_inc, high_inc = F.lit(bounds[0] == "[") & lower.isNotNull(), F.lit(bounds[1] == "]") & upper.isNotNull()
    if discrete:
        if bounds[0] == "(":
            lower = lower + 1
        if bounds[1] == "]":
            upper = upper + 1
        low_inc, high_inc = lower.isNotNull(), F.lit(False)
    empty = F.coalesce((lower > upper) | ((lower == upper) & ~(low_inc & high_inc)), F.lit(False))
    return _of(lower, upper, low_inc, high_inc, empty)


def int4range(lower: Column, upper: Column, bounds: str = "[)") -> Column:
    return make(lower.cast("int"), upper.cast("int"), bounds, True)


def int8range(lower: Column, upper: Column, bounds: str = "[)") -> Column:
    return make(lower.cast("long"), upper.cast("long"), bounds, True)


def numrange(lower: Column, upper: Column, bounds: str = "[)") -> Column:
    return make(lower, upper, bounds)


def tsrange(lower: Column, upper: Column, bounds: str = "[)") -> Column:
    return make(lower, upper, bounds)


def daterange(lower: Column, upper: Column, bounds: str = "[)") -> Column:
    low = F.date_add(lower, 1) if bounds[0] == "(" else lower
    high = F.date_add(upper, 1) if bounds[1] == "]" else upper
    return make(low, high)


def _of(lower: Column, upper: Column, low_inc: Column, high_inc: Column, empty: Column) -> Column:
    return F.struct(F.when(~empty, lower).alias("lower"), F.when(~empty, upper).alias("upper"), (low_inc & ~empty).alias("lower_inc"), (high_inc & ~empty).alias("upper_inc"), empty.alias("empty"))


def isempty(r: Column) -> Column:
    return r["empty"]


def lower(r: Column) -> Column:
    return r["lower"]


def upper(r: Column) -> Column:
    return r["upper"]


def lower_inf(r: Column) -> Column:
    return ~r["empty"] & r["lower"].isNull()


def upper_inf(r: Column) -> Column:
    return ~r["empty"] & r["upper"].isNull()


def contains_value(r: Column, x: Column) -> Column:
    low = r["lower"].isNull() | (r["lower"] < x) | ((r["lower"] == x) & r["lower_inc"])
    high = r["upper"].isNull() | (x < r["upper"]) | ((r["upper"] == x) & r["upper_inc"])
    return ~r["empty"] & low & high


def _low_before(a: Column, b: Column) -> Column:
    """The lower bound of a is at or before that of b."""
    return a["lower"].isNull() | (b["lower"].isNotNull() & ((a["lower"] < b["lower"]) | ((a["lower"] == b["lower"]) & (a["lower_inc"] | ~b["lower_inc"]))))


def _high_before(a: Column, b: Column) -> Column:
    """The upper bound of a is at or before that of b."""
    return b["upper"].isNull() | (a["upper"].isNotNull() & ((a["upper"] < b["upper"]) | ((a["upper"] == b["upper"]) & (b["upper_inc"] | ~a["upper_inc"]))))


def contains(a: Column, b: Column) -> Column:
    """a @> b."""
    return F.coalesce(b["empty"] | (~a["empty"] & _low_before(a, b) & _high_before(b, a)), F.lit(False))


def _meets(a: Column, b: Column) -> Column:
    """The lower bound of a does not lie beyond the upper bound of b."""
    return F.coalesce(a["lower"].isNull() | b["upper"].isNull() | (a["lower"] < b["upper"]) | ((a["lower"] == b["upper"]) & a["lower_inc"] & b["upper_inc"]), F.lit(False))


def overlaps(a: Column, b: Column) -> Column:
    """a && b."""
    return ~a["empty"] & ~b["empty"] & _meets(a, b) & _meets(b, a)


def strictly_left(a: Column, b: Column) -> Column:
    """a << b."""
    return ~a["empty"] & ~b["empty"] & ~_meets(b, a)


def adjacent(a: Column, b: Column) -> Column:
    """a -|- b."""
    touch = lambda x, y: F.coalesce((x["upper"] == y["lower"]) & (x["upper_inc"] != y["lower_inc"]), F.lit(False))
    return ~a["empty"] & ~b["empty"] & (touch(a, b) | touch(b, a))


def intersection(a: Column, b: Column) -> Column:
    """a * b."""
    low, high = _low_before(a, b), _high_before(a, b)
    lower, low_inc = F.when(low, b["lower"]).otherwise(a["lower"]), F.when(low, b["lower_inc"]).otherwise(a["lower_inc"])
    upper, high_inc = F.when(high, a["upper"]).otherwise(b["upper"]), F.when(high, a["upper_inc"]).otherwise(b["upper_inc"])
    return _of(lower, upper, low_inc, high_inc, ~overlaps(a, b))


def merge(a: Column, b: Column) -> Column:
    """range_merge(): the least range that holds both."""
    low, high = _low_before(a, b), _high_before(a, b)
    whole = _of(F.when(low, a["lower"]).otherwise(b["lower"]), F.when(high, b["upper"]).otherwise(a["upper"]), F.when(low, a["lower_inc"]).otherwise(b["lower_inc"]), F.when(high, b["upper_inc"]).otherwise(a["upper_inc"]), F.lit(False))
    return F.when(a["empty"], b).when(b["empty"], a).otherwise(whole)


def union(a: Column, b: Column) -> Column:
    """a + b; null where the result would have a hole."""
    return F.when(a["empty"] | b["empty"] | overlaps(a, b) | adjacent(a, b), merge(a, b))


def minus(a: Column, b: Column) -> Column:
    """a - b; null where the result would have a hole."""
    none = _of(a["lower"], a["upper"], a["lower_inc"], a["upper_inc"], F.lit(True))
    left_cut, right_cut = _low_before(b, a), _high_before(a, b)
    keep_left = _of(a["lower"], b["lower"], a["lower_inc"], ~b["lower_inc"], F.lit(False))
    keep_right = _of(b["upper"], a["upper"], ~b["upper_inc"], a["upper_inc"], F.lit(False))
    return F.when(~overlaps(a, b), a).when(left_cut & right_cut, none).when(right_cut, keep_left).when(left_cut, keep_right)


def show(r: Column) -> Column:
    """The text form, as [1,5)."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.when(r["empty"], "empty").when(r.isNotNull(), F.concat(F.when(r["lower_inc"], "[").otherwise("("), text(r["lower"]), F.lit(","), text(r["upper"]), F.when(r["upper_inc"], "]").otherwise(")")))
