"""Gold items against predictions: containment joins, roll-ups, snapshots, extra covers, digits read and covered.

gold: scene, gold_id, item, category, text, expect; findings: scene, finding, evidence, span_text, severity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgraph.functions import text as T
from veilgraph.operators import evaluation as E

#: info counts as nothing.
RANK = {"none": 0, "info": 0, "review": 1, "cover": 2}


def eval_key(text: Column) -> Column:
    """Normalized, without white space and hyphens; null as empty."""
    return F.regexp_replace(T.normalized(F.coalesce(text, F.lit(""))), r"(?U)[\s\-]", "")


def _rank(severity: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in RANK.items() for x in pair))[severity], F.lit(0))


def judged_gold(gold: DataFrame, findings: DataFrame) -> DataFrame:
    """Adds `got` and `verdict` to gold: the highest severity among findings whose spans hold the item's text and whose
    evidence is empty, part of the item or holds it."""
    g = gold.withColumn("_g", eval_key(F.col("text")))
    f = findings.select("scene", eval_key(F.col("evidence")).alias("_e"), eval_key(F.col("span_text")).alias("_s"), _rank(F.col("severity")).alias("_r"))
    fits = F.col("_s").contains(F.col("_g")) & ((F.col("_e") == "") | F.col("_g").contains(F.col("_e")) | F.col("_e").contains(F.col("_g")))
    best = g.select("scene", "gold_id", "_g").join(f, "scene").where(fits).groupBy("scene", "gold_id").agg(F.max("_r").alias("_r"))
    got = F.get(F.array(*map(F.lit, ("none", "review", "cover"))), F.coalesce("_r", F.lit(0)))
    out = gold.join(best, ["scene", "gold_id"], "left").withColumn("got", got).drop("_r")
    return out.withColumn("verdict", E.verdict(F.col("expect"), F.col("got")))


def rates(rows: DataFrame) -> DataFrame:
    """One row of totals and percentages over judged gold; 0 of nothing."""
    of = lambda expect, cond: F.sum(F.when((F.col("expect") == expect) & cond, 1).otherwise(0))
    total = lambda expect: F.sum(F.when(F.col("expect") == expect, 1).otherwise(0))
    got, percent = F.col("got"), E.share
    return rows.agg(
        F.count(F.lit(1)).alias("items"), total("cover").alias("cover_total"), total("review").alias("review_total"), total("none").alias("none_total"),
        percent(of("cover", got == "cover"), total("cover")).alias("cover_hit"), percent(of("cover", got == "review"), total("cover")).alias("cover_weak"),
        percent(of("cover", got == "none"), total("cover")).alias("cover_miss"), percent(of("review", got != "none"), total("review")).alias("review_ok"),
        percent(of("none", got == "cover"), total("none")).alias("false_cover"), percent(of("none", got == "review"), total("none")).alias("false_review"),
    )


def item_rollup(rows: DataFrame) -> DataFrame:
    """(item, expect, verdict, n, share): how often each verdict fell on each item."""
    n = rows.groupBy("item", "expect", "verdict").agg(F.count(F.lit(1)).alias("n"))
    all_of = F.sum("n").over(Window.partitionBy("item", "expect"))
    return n.withColumn("share", E.share(F.col("n"), all_of))


def snapshot(rows: DataFrame) -> DataFrame:
    """(key, right_items, items) by `expect|item`: what a baseline keeps."""
    return rows.groupBy(F.concat_ws("|", "expect", "item").alias("key")).agg(F.sum((F.col("verdict") == "hit").cast("int")).cast("long").alias("right_items"), F.count(F.lit(1)).alias("items"))


def failure_examples(rows: DataFrame) -> DataFrame:
    """The first wrong item (by scene, gold_id) of each (item, category, verdict)."""
    wrong = rows.where("verdict <> 'hit'")
    return wrong.groupBy("item", "category", "verdict").agg(F.min(F.struct("scene", "gold_id")).alias("m")).select("item", "category", "verdict", "m.*")


def extra_covers(gold: DataFrame, findings: DataFrame) -> DataFrame:
    """(scene, finding): covered findings that no gold item of the scene explains."""
    g = gold.select("scene", eval_key(F.col("text")).alias("_g")).where("_g <> ''").distinct()
    f = findings.where("severity = 'cover'").select("scene", "finding", eval_key(F.col("evidence")).alias("_e"), eval_key(F.col("span_text")).alias("_s"))
    known = F.col("_s").contains(F.col("_g")) | ((F.col("_e") != "") & (F.col("_g").contains(F.col("_e")) | F.col("_e").contains(F.col("_g"))))
    explained = f.join(g, "scene").where(known).select("scene", "finding").distinct()
    return f.select("scene", "finding").join(explained, ["scene", "finding"], "left_anti")


def digits_missed(truth: DataFrame, covered: DataFrame) -> DataFrame:
    """(scene, truths, missed): true values whose digits no covered value of the scene has exactly."""
    t = truth.select("scene", T.only_digits(F.col("text")).alias("d")).where("d <> ''")
    c = covered.select("scene", T.only_digits(F.col("evidence")).alias("d")).where("d <> ''").distinct().withColumn("hit", F.lit(1))
    return t.join(c, ["scene", "d"], "left").groupBy("scene").agg(F.count(F.lit(1)).alias("truths"), F.sum(F.when(F.col("hit").isNull(), 1).otherwise(0)).cast("long").alias("missed"))


def digits_read(truth: DataFrame, spans: DataFrame) -> DataFrame:
    """(scene, truths, read): true values whose digits stand within some span's digits."""
    t = truth.select("scene", "gold_id", T.only_digits(F.col("text")).alias("d")).where("d <> ''")
    s = spans.select("scene", T.only_digits(F.col("text")).alias("seen")).where("seen <> ''").distinct()
    hit = t.join(s, "scene").where(F.col("seen").contains(F.col("d"))).select("scene", "gold_id").distinct().withColumn("hit", F.lit(1))
    return t.join(hit, ["scene", "gold_id"], "left").groupBy("scene").agg(F.count(F.lit(1)).alias("truths"), F.count("hit").alias("read"))


def history_row(rows: DataFrame, extra: DataFrame) -> DataFrame:
    """One row: what a run's line in the history says."""
    one = lambda cond: F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long")
    e, g = F.col("expect"), F.col("got")
    totals = rows.agg(
        F.countDistinct("scene").alias("photos"), F.count(F.lit(1)).alias("items"), one(F.col("verdict") == "hit").alias("right_items"), one(e == "cover").alias("to_cover"), one((e == "cover") & (g == "cover")).alias("covered"),
        one((e == "cover") & (g == "review")).alias("review_only"), one((e == "cover") & (g == "none")).alias("missed"), one(e == "none").alias("to_leave"), one((e == "none") & (g == "cover")).alias("false_cover"),
    )
    return totals.crossJoin(extra.agg(F.count(F.lit(1)).alias("extra")))  # one row each
