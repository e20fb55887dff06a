"""Plane geometry: point struct(x, y); lseg struct(a, b); box struct(high, low); circle struct(center, radius); line struct(a, b, c); path struct(points, closed); polygon array of points."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def lseg(a: Column, b: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"))


def box(a: Column, b: Column) -> Column:
    return F.struct(point(F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"])).alias("high"), point(F.least(a["x"], b["x"]), F.least(a["y"], b["y"])).alias("low"))


def circle(center: Column, radius: Column) -> Column:
    return F.struct(center.alias("center"), radius.cast("double").alias("radius"))


def path(points: Column, closed: bool) -> Column:
    return F.struct(points.alias("points"), F.lit(closed).alias("closed"))


def line(a: Column, b: Column) -> Column:
    """ax + by + c = 0 through two points."""
    up = a["x"] == b["x"]
    m = slope(a, b)
    return F.struct(F.when(up, F.lit(-1.0)).otherwise(m).alias("a"), F.when(up, F.lit(0.0)).otherwise(F.lit(-1.0)).alias("b"), F.when(up, a["x"]).otherwise(a["y"] - m * a["x"]).alias("c"))


def slope(a: Column, b: Column) -> Column:
    return F.when(a["x"] != b["x"], (b["y"] - a["y"]) / F.when(a["x"] != b["x"], b["x"] - a["x"]))


def distance(a: Column, b: Column) -> Column:
    """Of two points."""
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def distance_to_segment(p: Column, s: Column) -> Column:
    dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
    n = dx * dx + dy * dy
    t = F.when(n == 0, F.lit(0.0)).otherwise(((p["x"] - s["a"]["x"]) * dx + (p["y"] - s["a"]["y"]) * dy) / F.when(n != 0, n))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.hypot(p["x"] - (s["a"]["x"] + t * dx), p["y"] - (s["a"]["y"] + t * dy))


def length(s: Column) -> Column:
    return distance(s["a"], s["b"])


def width(b: Column) -> Column:
    return b["high"]["x"] - b["low"]["x"]


def height(b: Column) -> Column:
    return b["high"]["y"] - b["low"]["y"]


def box_area(b: Column) -> Column:
    return width(b) * height(b)


def box_center(b: Column) -> Column:
    return point((b["high"]["x"] + b["low"]["x"]) / 2, (b["high"]["y"] + b["low"]["y"]) / 2)


def box_overlaps(a: Column, b: Column) -> Column:
    return (a["low"]["x"] <= b["high"]["x"]) & (b["low"]["x"] <= a["high"]["x"]) & (a["low"]["y"] <= b["high"]["y"]) & (b["low"]["y"] <= a["high"]["y"])


def box_contains(b: Column, p: Column) -> Column:
    return p["x"].between(b["low"]["x"], b["high"]["x"]) & p["y"].between(b["low"]["y"], b["high"]["y"])


def bound_box(a: Column, b: Column) -> Column:
    return F.struct(point(F.greatest(a["high"]["x"], b["high"]["x"]), F.greatest(a["high"]["y"], b["high"]["y"])).alias("high"), point(F.least(a["low"]["x"], b["low"]["x"]), F.least(a["low"]["y"], b["low"]["y"])).alias("low"))


def circle_area(c: Column) -> Column:
    return F.pi() * c["radius"] * c["radius"]


def diameter(c: Column) -> Column:
    return c["radius"] * 2


def circle_contains(c: Column, p: Column) -> Column:
    return distance(c["center"], p) <= c["radius"]


def circle_box(c: Column) -> Column:
    """The box inside a circle."""
    d = c["radius"] / F.sqrt(F.lit(2.0))
    return box(point(c["center"]["x"] + d, c["center"]["y"] + d), point(c["center"]["x"] - d, c["center"]["y"] - d))


def npoints(p: Column) -> Column:
    return F.size(p["points"])


def isclosed(p: Column) -> Column:
    return p["closed"]


def isopen(p: Column) -> Column:
    return ~p["closed"]


def pclose(p: Column) -> Column:
    return p.withField("closed", F.lit(True))


def popen(p: Column) -> Column:
    return p.withField("closed", F.lit(False))


def polygon_area(points: Column) -> Column:
    """By the shoelace formula."""
    n = F.size(points)
    cross = F.transform(points, lambda p, i: p["x"] * F.element_at(points, (i + 1) % n + 1)["y"] - F.element_at(points, (i + 1) % n + 1)["x"] * p["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda a, x: a + x)) / 2
