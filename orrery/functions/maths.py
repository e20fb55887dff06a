"""Mathematical functions with the dialect's rounding, signs and exact angles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def trunc(x: Column, digits: int = 0) -> Column:
    """Toward zero."""
    scale = 10.0**digits
    return F.signum(x) * F.floor(F.abs(x) * scale) / scale


def round_float(x: Column, digits: int = 0) -> Column:
    """Halves to even, as floats are rounded."""
    return F.bround(x, digits)


def log(x: Column, base: float | None = None) -> Column:
    """Base 10 unless a base is given."""
    return F.log10(x) if base is None else F.ln(x) / F.ln(F.lit(base))


def div(a: Column, b: Column) -> Column:
    """Integer quotient toward zero."""
    return F.try_divide(a - a % b, b).cast("long")


def _exact(x: Column, table: dict[int, float], other: Column) -> Column:
    turn = F.pmod(x, F.lit(360.0))
    out = F.when(turn == -1.0, F.lit(0.0))
    for angle, value in table.items():
        out = out.when(turn == float(angle), F.lit(value))
    return out.otherwise(other)


#: Exact values at multiples of 30 and 90 degrees: fixed values.
SINES = {0: 0.0, 30: 0.5, 90: 1.0, 150: 0.5, 180: 0.0, 210: -0.5, 270: -1.0, 330: -0.5}
COSINES = {0: 1.0, 60: 0.5, 90: 0.0, 120: -0.5, 180: -1.0, 240: -0.5, 270: 0.0, 300: 0.5}
TANGENTS = {0: 0.0, 45: 1.0, 135: -1.0, 180: 0.0, 225: 1.0, 315: -1.0}


def sind(x: Column) -> Column:
    return _exact(x, SINES, F.sin(F.radians(x)))


def cosd(x: Column) -> Column:
    return _exact(x, COSINES, F.cos(F.radians(x)))


def tand(x: Column) -> Column:
    return _exact(x, TANGENTS, F.tan(F.radians(x)))


def cotd(x: Column) -> Column:
    return _exact(x, {45: 1.0, 90: 0.0, 135: -1.0, 225: 1.0, 270: 0.0, 315: -1.0}, F.cot(F.radians(x)))


def asind(x: Column) -> Column:
    return F.when(x == 0.5, F.lit(30.0)).when(x == -0.5, F.lit(-30.0)).otherwise(F.degrees(F.asin(x)))


def acosd(x: Column) -> Column:
    return F.when(x == 0.5, F.lit(60.0)).when(x == -0.5, F.lit(120.0)).otherwise(F.degrees(F.acos(x)))


def atand(x: Column) -> Column:
    return F.when(F.abs(x) == 1.0, F.signum(x) * 45.0).otherwise(F.degrees(F.atan(x)))


def atan2d(y: Column, x: Column) -> Column:
    return F.degrees(F.atan2(y, x))


@F.arrow_udf(T.LongType())
def _gcd(a: pa.Array, b: pa.Array) -> pa.Array:
    known = pc.and_(pc.is_valid(a), pc.is_valid(b))
    found = np.gcd(pc.fill_null(a, 0).to_numpy(zero_copy_only=False), pc.fill_null(b, 0).to_numpy(zero_copy_only=False))
    return pc.if_else(known, pa.array(found, pa.int64()), pa.scalar(None, pa.int64()))


def gcd(a: Column, b: Column) -> Column:
    """The greatest common divisor of 64-bit numbers, worked out for whole batches; null if either is null."""
    return _gcd(F.abs(a.cast("long")), F.abs(b.cast("long")))


def lcm(a: Column, b: Column) -> Column:
    g = gcd(a, b)
    return F.when(g == 0, F.lit(0).cast("long")).otherwise(F.abs(div(a.cast("long"), F.when(g == 0, F.lit(1)).otherwise(g)) * b.cast("long")))


def factorial(n: Column) -> Column:
    """Exact up to 33, which 38 digits hold."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1))), F.lit(1).cast("decimal(38,0)"), lambda a, x: (a * x.cast("decimal(2,0)")).cast("decimal(38,0)"))


def scale(text: Column) -> Column:
    """Digits after the point of a decimal given as text."""
    return F.length(F.regexp_extract(text, r"\.(\d*)", 1))


def min_scale(text: Column) -> Column:
    return F.length(F.regexp_extract(text, r"\.(\d*?)0*$", 1))


def acosh(x: Column) -> Column:
    """NaN below 1."""
    return F.acosh(x)


def atanh(x: Column) -> Column:
    """Infinite at 1 and -1, NaN beyond."""
    return F.when(F.abs(x) == 1, x * F.lit(float("inf"))).otherwise(F.atanh(x))


def asinh(x: Column) -> Column:
    return F.asinh(x)


def normal_rand(spark: SparkSession, rows: int, mean: float, deviation: float, seed: int = 0) -> DataFrame:
    """normal_rand(): rows of normally distributed numbers; a seed gives the same ones."""
    return spark.range(rows).select((F.randn(seed) * deviation + mean).alias("normal_rand"))
