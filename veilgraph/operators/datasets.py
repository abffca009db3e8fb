"""Dataset keeping: content dedupe, stable splits, label checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgraph.functions import text as T


def content_id(content: Column) -> Column:
    return F.substring(F.sha1(content.cast("binary")), 1, 12)


def first_copies(rows: DataFrame, content: str, order: str) -> DataFrame:
    """(id, first, copies): one row a distinct content, by its whole digest, aggregated before the shuffle."""
    whole = F.sha1(F.col(content).cast("binary"))
    out = rows.groupBy(whole.alias("whole")).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("copies"))
    return out.select(F.substring("whole", 1, 12).alias("id"), "first", "copies")


def assigned(rows: DataFrame, key: str, fraction: float = 0.15) -> DataFrame:
    return rows.withColumn("split", T.split_of(F.col(key), fraction))


def label_problems(labels: DataFrame, n_classes: int) -> DataFrame:
    """labels: path, line_no, line -> (path, line_no, problem): rows that are not `class cx cy w h` within 0..1."""
    parts = F.split(F.trim("line"), r"(?U)\s+")
    cls = F.try_element_at(parts, F.lit(1)).try_cast("int")
    nums = F.transform(F.slice(parts, 2, 1000), lambda v: v.try_cast("double"))
    bad_number = cls.isNull() | F.exists(nums, lambda v: v.isNull())
    outside = F.exists(nums, lambda v: (v < 0) | (v > 1)) | (F.try_element_at(nums, F.lit(3)) <= 0) | (F.try_element_at(nums, F.lit(4)) <= 0)
    problem = F.when(bad_number, "not a number").when(F.size(nums) != 4, "number of values").when(~cls.between(0, n_classes - 1), "unknown class").when(outside, "out of range")
    return labels.where(F.trim("line") != "").select("path", "line_no", problem.alias("problem")).where("problem is not null")


def label_path(image: Column) -> Column:
    """images/.../x.jpg -> labels/.../x.txt"""
    return F.regexp_replace(F.regexp_replace(image, "(^|/)images/", "$1labels/"), r"\.[^./]+$", ".txt")
