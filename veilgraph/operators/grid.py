"""Box joins within a photo by grid cells: two boxes meet in the first cell that both have, so a pair is made once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgraph.functions import geometry as G

CELL = 256


def _cell(v: Column) -> Column:
    return F.floor(v / CELL).cast("int")


def _dealt(rows: DataFrame, box: str, tag: str) -> DataFrame:
    """One row a cell that the box touches, with the box's first cell."""
    b = F.col(box)
    x, y = _cell(b["x"]), _cell(b["y"])
    across = F.sequence(x, _cell(b["x"] + b["w"]))
    down = F.sequence(y, _cell(b["y"] + b["h"]))
    each = rows.withColumn(f"_x{tag}", x).withColumn(f"_y{tag}", y).withColumn("_cx", F.explode(across))
    return each.withColumn("_cy", F.explode(down))


def overlapping(left: DataFrame, right: DataFrame, by: str = "photo_id", a: str = "a", b: str = "b") -> DataFrame:
    """Pairs of rows whose boxes (columns a and b) share some area. Other column names must differ."""
    met = _dealt(left, a, "l").join(_dealt(right, b, "r"), [by, "_cx", "_cy"])
    first = (F.col("_cx") == F.greatest("_xl", "_xr")) & (F.col("_cy") == F.greatest("_yl", "_yr"))
    return met.where(first & (G.overlap(F.col(a), F.col(b)) > 0)).drop("_cx", "_cy", "_xl", "_yl", "_xr", "_yr")


def centred(left: DataFrame, right: DataFrame, by: str = "photo_id", a: str = "a", b: str = "b") -> DataFrame:
    """Pairs where the centre of the left box lies in the right one, edges included."""
    x, y = G.centre(F.col(a))
    met = left.withColumn("_cx", _cell(x)).withColumn("_cy", _cell(y)).join(_dealt(right, b, "r"), [by, "_cx", "_cy"])
    return met.where(G.holds_centre(F.col(b), F.col(a))).drop("_cx", "_cy", "_xr", "_yr")
