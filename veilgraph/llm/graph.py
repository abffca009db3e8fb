"""Connected components over an edge table, without collecting edges or labels anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgraph.llm.common import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable, for every id that has an edge.

    Smallest label of the neighbours, then the label's own label (pointer jumping), until nothing changes; the rounds
    grow with the logarithm of the longest path. Each round is cut off as a table in the shared folder.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    both = written(pairs.union(pairs.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("low"))
        lower = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "low").alias("component"))
        target = labels.select(F.col("id").alias("component"), F.col("component").alias("next"))
        moved = written(lower.join(target, "component", "left").select("id", "was", F.least("component", F.coalesce("next", "component")).alias("component")), "labels")
        changed = moved.where("was <> component").limit(1).count()
        labels = moved.select("id", "component")
        if not changed:
            return labels
