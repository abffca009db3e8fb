"""Places within groups that no single task has to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilgraph.session import stored


def places(rows: DataFrame, by: list[str], order: list[str], out: str) -> DataFrame:
    """Adds `out`: the row's place, from 0, within its group (by; none: all rows) in ascending order.

    Rows are range-partitioned by group and order, so a group of any size is dealt over many tasks. Each partition
    counts its rows of each group; sums over the partitions before it give the places at which its own begin. The
    counts have a row for each group and partition that meet: at most groups + partitions.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = stored(rows.repartitionByRange(parts, *by, *order).withColumn("_part", F.spark_partition_id()), "places")
    counts = laid.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    names = [f"_by{k}" for k in range(len(by))]
    base = counts.select(*(F.col(c).alias(n) for c, n in zip(by, names, strict=True)), F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)) - 1
    same = F.col("_part") == F.col("_p")
    for c, n in zip(by, names, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(n))
    joined = laid.withColumn("_at", within).join(base, same)
    return joined.select(*rows.columns, (F.col("_base") + F.col("_at")).alias(out))
