"""The corpus pipeline over `documents`: each stage works on all that the one before it kept, written as Parquet between.

language ID -> MinHash near-duplicates -> repeated passages -> benchmark leaks -> packing. All stages but the last
return the columns of `documents`; the last returns packed pieces. Stages without a DuckDB form are held against
brute force in tests/llm.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.llm.common import shared_dir, table
from veilgraph.llm.decontamination import decontaminated
from veilgraph.llm.langid import train_langid, with_language
from veilgraph.llm.near_dedup import near_duplicates
from veilgraph.llm.packing import bm25_packing
from veilgraph.llm.suffix_dedup import suffix_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near-duplicates of this stage: word 5-shingles, Jaccard similarity of at least 0.8.
SIMILARITY_PERCENT = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language (`und`: null text or no letter) and sets lang where it was null.

    Null and repeated ids are kept as they are; an empty table gives no rows; where no row can be learned from, every
    text with a letter stays."""
    return with_language(docs.select(*COLUMNS), train_langid(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each component. Rows without an id have no component and stay. Rows that
    share an id stand or fall together; where they share the text too, one stays (least lang, source and n_chars)."""
    docs = docs.select(*COLUMNS)
    left = near_duplicates(docs, percent=SIMILARITY_PERCENT).where("kept and doc_id is not null").select("doc_id").distinct()
    kept = docs.where("doc_id is not null").join(left, "doc_id", "left_semi")
    often = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    once = kept.join(often, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("m")).select("doc_id", "text", "m.*")
    alone = kept.join(often, "doc_id", "left_anti")
    return docs.where("doc_id is null").unionByName(alone.select(*COLUMNS)).unionByName(once.select(*COLUMNS))


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later copies of 100-byte passages out of the texts; a document of which nothing is left goes.

    Bytes of a character that a cut has split go with it. n_chars is counted anew. Rows without an id stay whole; rows
    that share an id are cut each by what starts earlier under other ids."""
    left = suffix_dedup(docs, carry=("doc_id", "lang", "source")).where(F.trim("text") != "")
    return left.select("row.*", "text").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item within its edit budget, whatever their id; null texts hold none."""
    return decontaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    Null ids and repeated rows are packed as they are; an empty table gives no rows."""
    return bm25_packing(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("passage_dedup", passage_dedup), ("decontaminate", decontaminate), ("pack", pack)]
#: SQL cannot express the stages that learn, edit texts or tokenize.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    where = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{name}")
        docs = spark.read.parquet(f"{where}/{name}")
    return docs
