"""Text lines at any angle: the axis of an outline, the direction of a page, and distances along and across a line.

An outline is array<struct<x,y>> of four points, clockwise from the upper left; an axis is struct<x,y> of length 1.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A fixed value: how much longer than wide an outline must be to show a direction.
LEAST_ASPECT = 1.3


def vector(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def axis(outline: Column) -> Column:
    """The unit vector along the long side; null unless four points show one."""
    p = [F.get(outline, F.lit(k)) for k in range(4)]
    side = lambda a, b, c, d: (F.lit(0.5) * (p[b]["x"] - p[a]["x"] + p[d]["x"] - p[c]["x"]), F.lit(0.5) * (p[b]["y"] - p[a]["y"] + p[d]["y"] - p[c]["y"]))
    (ux, uy), (vx, vy) = side(0, 1, 3, 2), side(0, 3, 1, 2)
    lu, lv = F.hypot(ux, uy), F.hypot(vx, vy)
    long, short = F.greatest(lu, lv), F.least(lu, lv)
    found = F.when(lu >= lv, vector(ux / long, uy / long)).otherwise(vector(vx / long, vy / long))
    return F.when((F.size(outline) == 4) & (short >= 1) & (long / short >= LEAST_ASPECT), found)


def page_axis(axes: Column, weight: Column) -> Column:
    """Aggregate: the mean direction of axes that have no front (angles are doubled); null where they cancel out."""
    angle = 2 * F.atan2(axes["y"], axes["x"])
    sx, sy = F.sum(weight * F.cos(angle)), F.sum(weight * F.sin(angle))
    turn = F.atan2(sy, sx) / 2
    return F.when(F.hypot(sx, sy) >= 1e-6, vector(F.cos(turn), F.sin(turn)))


def aligned(own: Column, page: Column) -> Column:
    """The axis, turned to the page's side."""
    away = own["x"] * page["x"] + own["y"] * page["y"] < 0
    return F.when(away, vector(-own["x"], -own["y"])).otherwise(own)


def frame(own: Column, other: Column) -> Column:
    """The span's own axis, else the other's, else the screen's."""
    return F.coalesce(own, other, vector(F.lit(1.0), F.lit(0.0)))


def extent(points: Column, along: Column) -> Column:
    """struct<a0,a1,c0,c1>: how far points reach along an axis and across it (clockwise)."""
    a = F.transform(points, lambda p: p["x"] * along["x"] + p["y"] * along["y"])
    c = F.transform(points, lambda p: p["y"] * along["x"] - p["x"] * along["y"])
    return F.struct(F.array_min(a).alias("a0"), F.array_max(a).alias("a1"), F.array_min(c).alias("c0"), F.array_max(c).alias("c1"))


def apart(a: Column, b: Column) -> Column:
    """The gap between two extents in one frame."""
    gap = lambda lo, hi: F.greatest(F.lit(0.0), b[lo] - a[hi], a[lo] - b[hi])
    return F.hypot(gap("a0", "a1"), gap("c0", "c1"))


def same_line(a: Column, b: Column) -> Column:
    """Middles no further apart across the line than .8 of the thinner one."""
    mid = F.abs((b["c0"] + b["c1"] - a["c0"] - a["c1"]) / 2)
    return mid <= F.least(a["c1"] - a["c0"], b["c1"] - b["c0"]) * 0.8
