"""Shared plumbing: table reading, byte-bounded Arrow mapping, shared-folder tables, running totals."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that one Python call works on; longer single texts form a call of their own.
BATCH_BYTES = 8 << 20


#: What a Python worker keeps from one task to the next.
HELD: dict = {}


def released() -> None:
    """Gives memory that this worker has freed back to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library that has no such call
        ctypes.CDLL(None).malloc_trim(0)


def bounded(spark: SparkSession) -> None:
    """Bounds what a Python worker is handed at once by bytes, not rows alone: ten thousand long texts are too much."""
    with contextlib.suppress(Exception):  # a session that lets no one set it
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sliced(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows whose `column` holds about `limit` bytes at most (one row at least)."""
    if batch.num_rows == 0:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    total, first = np.cumsum(size), 0
    while first < len(size):
        done = total[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(total, done + limit, side="right")))
        yield batch.slice(first, last - first)
        first = last


def arrow_map(df: DataFrame, work: Callable, schema: str, column: str = "text", limit: int = BATCH_BYTES) -> DataFrame:
    """mapInArrow whose `work(batch)` sees byte-bounded slices and returns one batch, or None.

    `work` may be a factory marked with `per_task = True`: it is then called once in each task for the real function.
    """

    def run(batches):
        if getattr(work, "per_task", False):
            step = work()
        else:
            step = work
            HELD.clear()  # what other tasks of this worker have kept gives way
        for batch in batches:
            for part in sliced(batch, column, limit):
                out = step(part)
                if out is not None:
                    yield out
        released()

    bounded(df.sparkSession)
    return df.mapInArrow(run, schema)


def per_task(factory: Callable) -> Callable:
    factory.per_task = True
    return factory


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts, null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def bytes_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; set here only where the session has none (local runs)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = held.get() if held.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        where = tempfile.mkdtemp(prefix="veilgraph-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def written(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage with a Parquet table in the shared folder; a lost executor costs nothing that is in it."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Deletes a table that written() made, once nothing lazy reads it any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def running_start(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Adds `out`: the sum of `value` over all rows before this one in ascending `order`.

    Rows are range-partitioned, so no task holds them all; the driver sees one sum a partition.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = written(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = laid.groupBy("_part").agg(F.sum(value).alias("n")).collect()
    before, start = {}, 0
    for row in sorted(sums, key=lambda r: r["_part"]):
        before[row["_part"]] = start
        start += row["n"] or 0
    base = spark.createDataFrame(list(before.items()) or [(0, 0)], "_part int, _base long")
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return laid.join(F.broadcast(base), "_part").withColumn(out, F.col("_base") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("_part", "_base")
