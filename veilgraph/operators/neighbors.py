"""Neighbours of text spans on a page: band joins instead of all pairs.

spans: photo_id, span_index, text, box struct<x,y,w,h>, conf. A span reaches over the bands of BAND pixels that its
search area touches; two spans meet in the first band that both have, so a pair is made once and a page of n lines
costs about n times the neighbours a line has.
"""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgraph.functions import geometry as G
from veilgraph.session import stored

BAND = 256
RADIUS_EM, LINK_EM = 6.0, 2.5


def scene_spans(parts: DataFrame) -> DataFrame:
    """Boxes for text without any: (photo_id, row, part, text) rows become spans, 22 pixels a character, rows 60 apart."""
    width = F.greatest(F.lit(22) * F.length("text"), F.lit(30))
    before = Window.partitionBy("photo_id", "row").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy("photo_id").orderBy("row", "part")
    x = F.lit(40) + F.coalesce(F.sum(width + 40).over(before), F.lit(0))
    return parts.select("photo_id", "text", (F.row_number().over(order) - 1).alias("span_index"), G.box(x, F.lit(40) + F.lit(60) * F.col("row"), width, F.lit(30)).alias("box"), F.lit(0.95).alias("conf"))


def pairs(spans: DataFrame, up: Column, down: Column) -> DataFrame:
    """Ordered pairs (photo_id, i, j, a, b) of spans whose bands meet; `up` and `down` are how far span i (box `a`) looks."""
    narrow = spans.select("photo_id", "span_index", "box")
    band = lambda y: F.floor(y / BAND)
    top, bottom = F.col("a.y") - up, F.col("a.y") + F.col("a.h") + down
    left = narrow.select("photo_id", F.col("span_index").alias("i"), F.col("box").alias("a")).select("*", band(top).alias("lo_a"), F.explode(F.sequence(band(top), band(bottom))).alias("band"))
    right = narrow.select("photo_id", F.col("span_index").alias("j"), F.col("box").alias("b"))
    right = right.select("*", band(F.col("b.y")).alias("lo_b"), F.explode(F.sequence(band(F.col("b.y")), band(F.col("b.y") + F.col("b.h")))).alias("band"))
    met = left.join(right, ["photo_id", "band"])
    return met.where((F.col("i") != F.col("j")) & (F.col("band") == F.greatest("lo_a", "lo_b"))).select("photo_id", "i", "j", "a", "b")


#: What settled() has written, by the spans it has given back.
_SETTLED: WeakKeyDictionary = WeakKeyDictionary()


def settled(spans: DataFrame) -> DataFrame:
    """The spans as a table in the shared folder, with their neighbours as tables beside it: nearby(), left_neighbors()
    and line_above() of what this returns read them, instead of joining the spans anew each time."""
    if spans in _SETTLED:
        return spans
    kept = stored(spans, "spans")
    wide = F.greatest(F.col("a.h"), F.lit(12)) * RADIUS_EM
    met = stored(pairs(kept, wide, wide), "pairs")  # wider than any of the three looks
    _SETTLED[kept] = met
    return kept


def _pairs(spans: DataFrame, up: Column, down: Column) -> DataFrame:
    return _SETTLED[spans] if spans in _SETTLED else pairs(spans, up, down)


def nearby(spans: DataFrame) -> DataFrame:
    """(photo_id, i, j, distance): spans within six line heights of span i."""
    reach = F.greatest(F.col("a.h"), F.lit(12)) * RADIUS_EM
    return _pairs(spans, reach, reach).withColumn("distance", G.distance(F.col("a"), F.col("b"))).where(F.col("distance") <= reach).select("photo_id", "i", "j", "distance")


def left_neighbors(spans: DataFrame) -> DataFrame:
    """(photo_id, i, j, gap, rank): spans before span i on its line, nearest first."""
    mid = F.abs((F.col("b.y") + F.col("b.h") / 2) - (F.col("a.y") + F.col("a.h") / 2))
    gap = F.col("a.x") - (F.col("b.x") + F.col("b.w"))
    same = (mid <= F.least("a.h", "b.h") * 0.8) & (gap >= -4) & (gap <= F.greatest("a.h", "b.h") * 4)
    none = F.lit(0)
    return _pairs(spans, none, none).where(same).withColumn("gap", gap).select("photo_id", "i", "j", "gap", F.row_number().over(Window.partitionBy("photo_id", "i").orderBy("gap", "j")).alias("rank"))


def line_above(spans: DataFrame, reach_em: float = 0.9) -> DataFrame:
    """(photo_id, i, j, gap): the left-aligned span that stands right above span i; smallest gap, then smallest index."""
    h = F.least("a.h", "b.h")
    gap = F.col("a.y") - (F.col("b.y") + F.col("b.h"))
    above = (F.col("b.y") + F.col("b.h") / 2) < (F.col("a.y") + F.col("a.h") / 2) - h * 0.5
    fits = above & (F.abs(F.col("b.x") - F.col("a.x")) <= h * 1.5) & (gap >= h * -0.35) & (gap <= h * reach_em)
    found = _pairs(spans, F.col("a.h") * reach_em + 1, F.lit(0)).where(fits).withColumn("gap", gap)
    return found.groupBy("photo_id", "i").agg(F.min(F.struct("gap", "j")).alias("m")).select("photo_id", "i", "m.j", "m.gap")


def links(spans: DataFrame) -> DataFrame:
    """(photo_id, i, j): spans no further apart than 2.5 times the taller one's height; each link once, from the taller."""
    taller = (F.col("a.h") > F.col("b.h")) | ((F.col("a.h") == F.col("b.h")) & (F.col("i") < F.col("j")))
    limit = F.greatest(F.col("a.h"), F.lit(10)) * LINK_EM
    return pairs(spans, limit, limit).where(taller & (G.distance(F.col("a"), F.col("b")) <= limit)).select("photo_id", "i", "j")
