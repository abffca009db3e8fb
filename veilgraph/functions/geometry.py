"""Geometry of boxes (struct<x,y,w,h> in pixels) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), w.cast("int").alias("w"), h.cast("int").alias("h"))


def centre(b: Column) -> tuple[Column, Column]:
    return b["x"] + b["w"] / 2, b["y"] + b["h"] / 2


def gap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Empty space between two intervals, 0 where they touch."""
    return F.greatest(F.lit(0), b0 - a1, a0 - b1)


def distance(a: Column, b: Column) -> Column:
    return F.hypot(gap(a["x"], a["x"] + a["w"], b["x"], b["x"] + b["w"]).cast("double"), gap(a["y"], a["y"] + a["h"], b["y"], b["y"] + b["h"]).cast("double"))


def overlap(a: Column, b: Column) -> Column:
    side = lambda at, size: F.greatest(F.lit(0), F.least(a[at] + a[size], b[at] + b[size]) - F.greatest(a[at], b[at]))
    return (side("x", "w") * side("y", "h")).cast("double")


def area(a: Column) -> Column:
    return (a["w"] * a["h"]).cast("double")


def iou(a: Column, b: Column) -> Column:
    both = overlap(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def share_of_smaller(a: Column, b: Column) -> Column:
    least = F.least(area(a), area(b))
    return F.when(least > 0, overlap(a, b) / least).otherwise(0.0)


def contains(a: Column, b: Column) -> Column:
    return (a["x"] <= b["x"]) & (a["y"] <= b["y"]) & (a["x"] + a["w"] >= b["x"] + b["w"]) & (a["y"] + a["h"] >= b["y"] + b["h"])


def holds_centre(a: Column, b: Column) -> Column:
    x, y = centre(b)
    return x.between(a["x"], a["x"] + a["w"]) & y.between(a["y"], a["y"] + a["h"])


def expanded(b: Column, by: int) -> Column:
    return box(b["x"] - by, b["y"] - by, b["w"] + 2 * by, b["h"] + 2 * by)


def padding(b: Column) -> Column:
    """Pixels added around a mask: 18 % of the short side, half to even, three at least."""
    return F.greatest(F.lit(3), F.bround(F.least(b["w"], b["h"]) * 0.18).cast("int"))


def rotated_back(b: Column, angle: Column, width: Column, height: Column) -> Column:
    """A box found in the image turned by 0, 90 or 270 degrees clockwise, in the upright image of width x height."""
    at90 = box(b["y"], height - b["x"] - b["w"], b["h"], b["w"])
    at270 = box(width - b["y"] - b["h"], b["x"], b["h"], b["w"])
    return F.when(angle == 90, at90).when(angle == 270, at270).otherwise(b)


def nms(boxes: Column, limit: float, measure=iou, same_class: bool = False) -> Column:
    """Greedy suppression of array<struct<score,seq,class,box>>: best score first (lower seq on ties), kept unless it
    overlaps a kept one by `limit` or more."""
    order = F.array_sort(boxes, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(a["seq"] - b["seq"]))
    kind = "array<struct<score:double,seq:int,class:string,box:struct<x:int,y:int,w:int,h:int>>>"

    def step(kept, x):
        hit = lambda k: (measure(k["box"], x["box"]) >= limit) & ((k["class"] == x["class"]) if same_class else F.lit(True))
        return F.when(F.exists(kept, hit), kept).otherwise(F.concat(kept, F.array(x).cast(kind)))

    return F.aggregate(order, F.array().cast(kind), step)
