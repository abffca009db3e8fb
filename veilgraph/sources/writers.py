"""Writers: nested reports as JSON, JSON lines, snapshots, appended history, manifests, split lists."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.functions import vocab as V


def reports(findings: DataFrame) -> DataFrame:
    """(photo_id, report): findings in order of (severity rank, kind), then as they came (seq)."""
    rank = F.create_map(*(F.lit(x) for p in V.SEVERITY_RANK.items() for x in p))[F.col("severity")]
    body = F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "kind", "seq", "severity", "certainty", "evidence_text")))
    shown = F.transform(body, lambda f: F.struct(f["kind"].alias("kind"), f["severity"].alias("severity"), f["certainty"].alias("certainty"), f["evidence_text"].alias("evidence_text")))
    return findings.groupBy("photo_id").agg(F.to_json(F.struct(shown.alias("findings"))).alias("report"))


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def snapshot(df: DataFrame, path: str) -> None:
    """A small table, replaced as a whole."""
    _replaced(df.sparkSession, path, lambda staged: df.coalesce(1).write.json(staged))


def history(df: DataFrame, path: str) -> None:
    """Appends a run's rows; the header is written with the first ones only."""
    folder, files = _path(df.sparkSession, path)
    df.coalesce(1).write.mode("append").option("header", not files.exists(folder)).csv(path)


def read_history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all runs; the one header line is none of them."""
    names = [c.split()[0] for c in schema.split(",")]
    raw = spark.read.csv(path, schema=", ".join(f"{n} string" for n in names))
    first = F.lit(True)
    for n in names:
        first = first & F.col(n).eqNullSafe(F.lit(n))
    kinds = [c.split()[1] for c in schema.split(",")]
    return raw.where(~first).select(*(F.col(n).cast(k).alias(n) for n, k in zip(names, kinds, strict=True)))


def manifest(rows: DataFrame, path: str) -> None:
    """CSV with a header in order of (added_at, id), written aside and then put in the old one's place."""
    _replaced(rows.sparkSession, path, lambda staged: rows.orderBy("added_at", "id").write.option("header", True).csv(staged))


def split_lists(rows: DataFrame, path: str) -> None:
    """One folder of text lines a split."""
    rows.select(F.col("path").alias("value"), "split").write.mode("overwrite").partitionBy("split").text(path)


def _path(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def _replaced(spark: SparkSession, path: str, write) -> None:
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    write(staged)
    folder, files = _path(spark, path)
    files.delete(folder, True)
    files.rename(_path(spark, staged)[0], folder)
