"""Operator 6, token counts: Arrow batches balanced by bytes, lengths only, long texts split at safe boundaries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.llm.common import arrow_map, batch_of, per_task, table
from veilgraph.llm.tokens import encoder_for, laid_out

_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def token_counts(docs: DataFrame, vocab: str = "byte_bpe_50k.json", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row, no shuffle.

    A null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated rows give repeated results; an
    empty table gives no rows; other columns are not read. Strings of special tokens inside a text are taken as the
    library takes them by default. Memory is bounded by the batch bytes and the encoder's remembered segments.
    """

    @per_task
    def task():
        encoder = encoder_for(vocab, lengths_only=True)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            text = batch.column("text")
            return batch_of(_OUT, batch.column("doc_id"), np.diff(laid_out(text)[1]), encoder.encode(text)[1])

        return step

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return arrow_map(picked, task, "doc_id long, n_bytes long, n_tokens long")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > 1024)
