import pyspark.sql.functions as F
from tests.llm.test_near_dedup import brute as brute_components
from tests.llm.test_suffix_dedup import brute as brute_bytes

import corpus_pipeline as cp


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_each_stage_decides_as_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(90_001, None, None, None, None), (90_002, "12 34 !!", "en", "x", 8), (90_003, "the lone words of this text", None, "x", 27)], docs.schema)
    docs = docs.unionByName(extra)
    seen = {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{tmp_path}/{name}")
        seen[name] = (docs, spark.read.parquet(f"{tmp_path}/{name}"))
        docs = seen[name][1]
        if name != "pack":
            assert docs.columns == cp.COLUMNS
    before, after = seen["language_id"]
    assert {r[0] for r in rows_of(before)} - {r[0] for r in rows_of(after)} == {90_001, 90_002} and after.where("lang is null").count() == 0
    before, after = seen["near_dedup"]
    assert sorted(r[0] for r in rows_of(after)) == sorted(d for d, _, _, kept in brute_components(rows_of(before), 80) if kept)
    before, after = seen["passage_dedup"]
    left = {d: n - gone for d, n, gone, _, _ in brute_bytes(rows_of(before))}
    got = {d: len(t.encode()) for d, t in rows_of(after)}
    assert all(left[d] - 6 <= got[d] <= left[d] for d in got) and all(n < 6 for d, n in left.items() if d not in got)
    before, after = seen["decontaminate"]
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    dropped = {r[0] for r in rows_of(before)} - {r[0] for r in rows_of(after)}
    assert {d for d, t in rows_of(before) if any(x in t for x in items)} <= dropped
    before, after = seen["pack"]
    assert {r.doc_id for r in after.select("doc_id").distinct().collect()} == {r[0] for r in rows_of(before)}
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_stages_take_an_empty_table(spark, sf_dir):
    none = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    assert [stage(spark, none, sf_dir).count() for _, stage in cp.STAGES] == [0] * 5


def test_null_and_repeated_ids_and_clashing_names(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60 and lang is not null")
    leak = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    rows = [(None, "plain words of no id at all", "en", "x", 1), (None, f"before {leak} after", "en", "x", 1), (7_001, "some words that only one row has", "en", "x", 1), (7_001, "some words that only one row has", "en", "a", 1), (7_001, "and another text of the same id", "en", "x", 1)]
    docs = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    for name in ("lang_pred", "row", "kept", "score", "first", "component_id", "h", "size"):
        docs = docs.withColumn(name, F.lit("clash"))
    out = docs
    for name, stage in cp.STAGES[:4]:
        out = stage(spark, out if name == "language_id" else out.withColumn("kept", F.lit(1)), sf_dir)
        assert out.columns == cp.COLUMNS
    found = [r for r in out.collect() if r.doc_id in (None, 7_001)]
    assert sorted((r.doc_id or 0, r.text, r.source) for r in found) == [(0, "plain words of no id at all", "x"), (7_001, "and another text of the same id", "x"), (7_001, "some words that only one row has", "a")]


def test_language_id_without_rows_to_learn_from(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    docs = docs.unionByName(spark.createDataFrame([(90_001, "12 34", None, "x", 5)], docs.schema))
    out = cp.language_id(spark, docs, sf_dir)
    assert out.count() == docs.count() - 1 and out.where("lang is not null or doc_id = 90001").count() == 0
