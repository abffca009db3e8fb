"""Scoring: verdicts and roll-ups, one-to-one box matching, threshold sweeps, baseline differences, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgraph.functions import geometry as G
from veilgraph.operators.grid import overlapping


def verdict(expect: Column, got: Column) -> Column:
    """hit, weak or miss of what was to be covered; right or false_* of the rest."""
    return (
        F.when(expect == "cover", F.when(got == "cover", "hit").when(got == "review", "weak").otherwise("miss"))
        .when(expect == "review", F.when(got == "review", "hit").when(got == "cover", "raised").otherwise("miss"))
        .otherwise(F.when(got == "cover", "false_cover").when(got == "review", "false_review").otherwise("hit"))
    )


def share(part: Column, whole: Column, digits: int = 1) -> Column:
    """Percent, 0 of nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part * 100.0 / whole, digits))


def summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows: expect, got. Counts and rates by group."""
    count = lambda cond: F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long")
    v = verdict(F.col("expect"), F.col("got"))
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("items"), count(v == "hit").alias("right_items"), count(v == "miss").alias("missed"), count(v == "false_cover").alias("false_cover"), count(v == "false_review").alias("false_review"))
    return out.withColumn("right_percent", share(F.col("right_items"), F.col("items")))


def baseline_difference(now: DataFrame, before: DataFrame, key: list[str]) -> DataFrame:
    """Full outer join of (key, right_items, items): what is worse, gone or new."""
    a, b = now.select(*key, F.col("right_items").alias("now_right"), F.col("items").alias("now_items")), before.select(*key, F.col("right_items").alias("was_right"), F.col("items").alias("was_items"))
    status = F.when(F.col("now_items").isNull(), "gone").when(F.col("was_items").isNull(), "new").when(F.col("now_right") * F.col("was_items") < F.col("was_right") * F.col("now_items"), "worse").when(F.col("now_items") != F.col("was_items"), "resized").otherwise("same")
    return a.join(b, key, "full_outer").withColumn("status", status)


def matched(gt: DataFrame, pred: DataFrame, least_iou: float = 0.5) -> DataFrame:
    """(image_id, pred_index, score, gt_index, ignored): predictions by falling score, each taking the best free box.

    gt: image_id, gt_index, box, ignore; pred: image_id, pred_index, box, score. Only overlapping candidates are
    joined; the one-to-one choice is a fold within each image.
    """
    truth = gt.select("image_id", "gt_index", F.col("box").alias("g"), "ignore")
    pairs = overlapping(pred, truth, "image_id", "box", "g").withColumn("iou", G.iou(F.col("box"), F.col("g"))).where(F.col("iou") >= least_iou)
    options = pairs.groupBy("image_id", "pred_index").agg(F.collect_list(F.struct((-F.col("iou")).alias("n"), "gt_index", "ignore")).alias("options"))
    per = pred.select("image_id", "pred_index", "score").join(options, ["image_id", "pred_index"], "left")
    rows = per.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("n"), "pred_index", "score", F.array_sort(F.coalesce("options", F.array().cast("array<struct<n:double,gt_index:int,ignore:boolean>>"))).alias("options")))).alias("preds"))
    kind = "struct<used:array<int>,out:array<struct<pred_index:int,score:double,gt_index:int,ignored:boolean>>>"

    def step(s, p):
        best = F.get(F.filter(p["options"], lambda o: o["ignore"] | ~F.array_contains(s["used"], o["gt_index"])), F.lit(0))
        row = F.struct(p["pred_index"].alias("pred_index"), p["score"].alias("score"), best["gt_index"].alias("gt_index"), F.coalesce(best["ignore"], F.lit(False)).alias("ignored"))
        used = F.when(best.isNull(), s["used"]).otherwise(F.concat(s["used"], F.array(best["gt_index"])))
        return F.struct(used.alias("used"), F.concat(s["out"], F.array(row)).alias("out")).cast(kind)

    zero = F.struct(F.array().alias("used"), F.array().alias("out")).cast(kind)
    return rows.select("image_id", F.explode(F.aggregate("preds", zero, step, lambda s: s["out"])).alias("m")).select("image_id", "m.*")


def sweep(gt: DataFrame, pred: DataFrame, thresholds: list[float]) -> DataFrame:
    """(thr, tp, fp, fn, p, r, f1). Cutting a score-ordered greedy match at a threshold gives the match at that
    threshold, so matching runs once and each threshold is a conditional count."""
    m = matched(gt, pred)
    total = gt.agg(F.sum(F.when(F.col("ignore"), 0).otherwise(1)).alias("total"))
    aggs = []
    for k, thr in enumerate(thresholds):
        live = F.col("score") >= thr
        aggs += [F.sum(F.when(live & F.col("gt_index").isNotNull() & ~F.col("ignored"), 1).otherwise(0)).alias(f"tp{k}"), F.sum(F.when(live & F.col("gt_index").isNull(), 1).otherwise(0)).alias(f"fp{k}")]
    one = m.agg(*aggs).crossJoin(F.broadcast(total))  # one row each
    each = F.explode(F.array(*(F.struct(F.lit(float(t)).alias("thr"), F.coalesce(F.col(f"tp{k}"), F.lit(0)).alias("tp"), F.coalesce(F.col(f"fp{k}"), F.lit(0)).alias("fp")) for k, t in enumerate(thresholds)))).alias("s")
    out = one.select(each, F.coalesce("total", F.lit(0)).alias("total")).select("s.*", (F.col("total") - F.col("s.tp")).alias("fn"))
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    return out.withColumn("p", p).withColumn("r", r).withColumn("f1", F.when(F.col("p") + F.col("r") > 0, F.col("p") * F.col("r") * 2 / (F.col("p") + F.col("r"))).otherwise(0.0))


def picked_threshold(swept: DataFrame, least_precision: float = 0.85) -> DataFrame:
    """One row: the highest recall among precise enough thresholds, else the best F1; the lower threshold on ties."""
    good = F.col("p") >= least_precision
    rank = F.struct(good.alias("good"), F.when(good, F.col("r")).otherwise(F.col("f1")).alias("v"), (-F.col("thr")).alias("t"))
    return swept.groupBy().agg(F.max_by(F.struct("thr", "p", "r", "f1"), rank).alias("best")).select("best.*")


def at_index(rows: DataFrame, by: list[str], value: str, index, steps: int = 1024) -> DataFrame:
    """(by, n, value): the value at place index(n), from 0, among a group's n values in ascending order; nulls are none.

    Exact without one task sorting a group: values are counted in `steps` stretches between the group's least and
    greatest, and only those of the stretch that holds the place are ranked.
    """
    some = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    ends = some.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("n"))
    place = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * steps)).otherwise(0)
    dealt = some.join(ends, by).withColumn("_s", place)
    counts = dealt.groupBy(*by, "n", "_s").agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = counts.withColumn("_b", before).withColumn("_i", index(F.col("n")) - F.col("_b")).where((F.col("_i") >= 0) & (F.col("_i") < F.col("_c")))
    # values of one number are all alike: ranking stops there
    few = dealt.join(held.select(*by, "_s", "_i"), [*by, "_s"]).groupBy(*by, "n", "_i", "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    return few.withColumn("_u", upto).where((F.col("_u") > F.col("_i")) & (F.col("_u") - F.col("_c") <= F.col("_i"))).select(*by, "n", F.col("_v").alias("value"))
