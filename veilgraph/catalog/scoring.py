"""Queries on gold items and predictions, made from `events`: a user's events are one scene's items, findings and spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.operators import evaluation as E
from veilgraph.operators import scoring as S
from veilgraph.queries import query
from veilgraph.sources.readers import table

_PICK = "[{}][CAST(({}) % {} AS INTEGER) + 1]"
_SEV, _EXP = ["cover", "review", "info"], ["cover", "review", "none"]
_BASE = f"""g AS (SELECT user_id AS scene, event_id AS gold_id, event_type AS item, {_PICK.format("'card', 'parcel', 'sign', 'screen'", 'event_id // 2', 4)} AS category, '2 ' || (event_id * 7 % 90 + 10) AS text,
  '2' || (event_id * 7 % 90 + 10) AS k, {_PICK.format("'cover', 'review', 'none'", 'event_id // 2', 3)} AS expect FROM events WHERE event_id % 2 = 0),
f AS (SELECT user_id AS scene, event_id AS finding, CASE WHEN event_id % 5 = 0 THEN '' ELSE '2-' || (event_id * 11 % 90 + 10) END AS evidence, CASE WHEN event_id % 5 = 0 THEN '' ELSE '2' || (event_id * 11 % 90 + 10) END AS e,
  'no 12' || (event_id * 11 % 90 + 10) || '7' AS span_text, 'no12' || (event_id * 11 % 90 + 10) || '7' AS s, {_PICK.format("'cover', 'review', 'info'", 'event_id // 3', 3)} AS severity FROM events WHERE event_id % 2 = 1)"""
_JUDGED = f"""WITH {_BASE}, b AS (SELECT g.scene, g.gold_id, max(CASE f.severity WHEN 'cover' THEN 2 WHEN 'review' THEN 1 ELSE 0 END) AS r FROM g JOIN f ON f.scene = g.scene AND contains(f.s, g.k) AND (f.e = '' OR contains(g.k, f.e) OR contains(f.e, g.k)) GROUP BY 1, 2),
j AS (SELECT g.*, CASE coalesce(b.r, 0) WHEN 2 THEN 'cover' WHEN 1 THEN 'review' ELSE 'none' END AS got FROM g LEFT JOIN b ON b.scene = g.scene AND b.gold_id = g.gold_id),
v AS (SELECT *, CASE expect WHEN 'cover' THEN CASE got WHEN 'cover' THEN 'hit' WHEN 'review' THEN 'weak' ELSE 'miss' END WHEN 'review' THEN CASE got WHEN 'review' THEN 'hit' WHEN 'cover' THEN 'raised' ELSE 'miss' END
  ELSE CASE got WHEN 'cover' THEN 'false_cover' WHEN 'review' THEN 'false_review' ELSE 'hit' END END AS verdict FROM j)"""
_EXTRA = "x AS (SELECT scene, finding FROM f WHERE severity = 'cover' AND NOT EXISTS (SELECT 1 FROM g WHERE g.scene = f.scene AND (contains(f.s, g.k) OR (f.e <> '' AND (contains(g.k, f.e) OR contains(f.e, g.k))))))"


def _pick(values: list[str], n):
    return F.get(F.array(*map(F.lit, values)), (n % len(values)).cast("int"))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").where(e % 2 == 0)
    text = F.concat(F.lit("2 "), (e * 7 % 90 + 10).cast("string"))
    return rows.select(F.col("user_id").alias("scene"), e.alias("gold_id"), F.col("event_type").alias("item"), _pick(["card", "parcel", "sign", "screen"], F.floor(e / 2)).alias("category"), text.alias("text"), _pick(_EXP, F.floor(e / 2)).alias("expect"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    n = (e * 11 % 90 + 10).cast("string")
    rows = table(spark, sf_dir, "events").where(e % 2 == 1)
    return rows.select(F.col("user_id").alias("scene"), e.alias("finding"), F.when(e % 5 == 0, "").otherwise(F.concat(F.lit("2-"), n)).alias("evidence"), F.concat(F.lit("no 12"), n, F.lit("7")).alias("span_text"), _pick(_SEV, F.floor(e / 3)).alias("severity"))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.judged_gold(gold(spark, sf_dir), found(spark, sf_dir))


@query(f"{_JUDGED} SELECT scene, gold_id, got, verdict FROM v")
def judged_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select("scene", "gold_id", "got", "verdict")


def _rate(cond: str, of: str) -> str:
    return f"CASE WHEN count(*) FILTER (expect = '{of}') = 0 THEN 0.0::DOUBLE ELSE round(count(*) FILTER (expect = '{of}' AND {cond}) * 100.0::DOUBLE / count(*) FILTER (expect = '{of}'), 1) END"


@query(f"""{_JUDGED} SELECT count(*) AS items, count(*) FILTER (expect = 'cover') AS cover_total, count(*) FILTER (expect = 'review') AS review_total, count(*) FILTER (expect = 'none') AS none_total,
  {_rate("got = 'cover'", 'cover')} AS cover_hit, {_rate("got = 'review'", 'cover')} AS cover_weak, {_rate("got = 'none'", 'cover')} AS cover_miss, {_rate("got <> 'none'", 'review')} AS review_ok,
  {_rate("got = 'cover'", 'none')} AS false_cover, {_rate("got = 'review'", 'none')} AS false_review FROM v""")
def judgement_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rates(_rows(spark, sf_dir))


@query(f"{_JUDGED} SELECT item, expect, verdict, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY item, expect), 1) AS share FROM v GROUP BY item, expect, verdict")
def item_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.item_rollup(_rows(spark, sf_dir))


@query(f"{_JUDGED} SELECT expect || '|' || item AS key, count(*) FILTER (verdict = 'hit') AS right_items, count(*) AS items FROM v GROUP BY 1")
def baseline_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.snapshot(_rows(spark, sf_dir))


@query(f"{_JUDGED} SELECT item, category, verdict, scene, gold_id FROM v WHERE verdict <> 'hit' QUALIFY row_number() OVER (PARTITION BY item, category, verdict ORDER BY scene, gold_id) = 1")
def failure_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.failure_examples(_rows(spark, sf_dir))


@query(f"WITH {_BASE}, {_EXTRA} SELECT scene, finding FROM x")
def extra_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.extra_covers(gold(spark, sf_dir), found(spark, sf_dir))


@query(f"""{_JUDGED}, {_EXTRA} SELECT count(DISTINCT scene) AS photos, count(*) AS items, count(*) FILTER (verdict = 'hit') AS right_items, count(*) FILTER (expect = 'cover') AS to_cover, count(*) FILTER (expect = 'cover' AND got = 'cover') AS covered,
  count(*) FILTER (expect = 'cover' AND got = 'review') AS review_only, count(*) FILTER (expect = 'cover' AND got = 'none') AS missed, count(*) FILTER (expect = 'none') AS to_leave, count(*) FILTER (expect = 'none' AND got = 'cover') AS false_cover,
  (SELECT count(*) FROM x) AS extra FROM v""")
def history_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, f = gold(spark, sf_dir), found(spark, sf_dir)
    return S.history_row(S.judged_gold(g, f), S.extra_covers(g, f))


@query(f"""WITH {_BASE}, c AS (SELECT DISTINCT scene, regexp_replace(evidence, '[^0-9]', '', 'g') AS d FROM f WHERE severity = 'cover' AND evidence <> '')
SELECT g.scene, count(*) AS truths, count(*) FILTER (c.d IS NULL) AS missed FROM g LEFT JOIN c ON c.scene = g.scene AND c.d = g.k GROUP BY g.scene""")
def digits_missed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.digits_missed(gold(spark, sf_dir), found(spark, sf_dir).where("severity = 'cover'"))


@query(f"""WITH {_BASE} SELECT scene, count(*) AS truths, count(*) FILTER (EXISTS (SELECT 1 FROM f WHERE f.scene = g.scene AND contains(regexp_replace(f.s, '[^0-9]', '', 'g'), g.k))) AS read FROM g GROUP BY scene""")
def digits_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.digits_read(gold(spark, sf_dir), found(spark, sf_dir).select("scene", F.col("span_text").alias("text")))


@query("""WITH e AS (SELECT event_type, value, ts, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type AS engine, count(*) AS images, round(avg(value), 2) AS latency_mean, max(CASE WHEN rn = least(n - 1, CAST(floor(0.95::DOUBLE * n) AS BIGINT)) THEN value END) AS latency_p95,
  round(count(*) * 60.0::DOUBLE / greatest(1, date_diff('second', min(ts), max(ts))), 1) AS images_per_min, max(value) AS peak FROM e GROUP BY event_type""")
def worker_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("value is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    p95 = E.at_index(rows, ["event_type"], "value", lambda n: F.least(n - 1, F.floor(n * 0.95))).select("event_type", F.col("value").alias("latency_p95"))
    wall = F.greatest(F.lit(1), F.timestamp_diff("SECOND", F.min("ts"), F.max("ts")))
    one = rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("images"), F.round(F.avg("value"), 2).alias("latency_mean"), F.round(F.count(F.lit(1)) * 60.0 / wall, 1).alias("images_per_min"), F.max("value").alias("peak"))
    return one.join(p95, "event_type").withColumnRenamed("event_type", "engine")


@query("""WITH e AS (SELECT event_type AS judge, value, event_id % 11 = 0 AS failed, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT judge, count(*) AS items, count(*) FILTER (failed) AS errors, max(CASE WHEN rn = n // 2 THEN value END) AS median_latency FROM e GROUP BY judge""")
def judge_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("value is not null")
    mid = E.at_index(rows, ["event_type"], "value", lambda n: F.floor(n / 2)).select("event_type", F.col("value").alias("median_latency"))
    one = rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("items"), F.sum((F.col("event_id") % 11 == 0).cast("int")).cast("long").alias("errors"))
    return one.join(mid, "event_type").withColumnRenamed("event_type", "judge")


@query("""SELECT event_type AS kind, (event_id % 9) * 10 - 40 AS angle, count(*) AS photos, CAST(sum(event_id % 4) AS BIGINT) AS found FROM events GROUP BY 1, 2
UNION ALL SELECT event_type, NULL, count(*), CAST(sum(event_id % 4) AS BIGINT) FROM events GROUP BY 1""")
def rotation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by kind and angle, with each kind's total over all angles."""
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), (e % 9 * 10 - 40).alias("angle"), (e % 4).alias("n"))
    out = rows.rollup("kind", "angle").agg(F.count(F.lit(1)).alias("photos"), F.sum("n").cast("long").alias("found"), F.grouping("kind").alias("_k"))
    return out.where("_k = 0").drop("_k")
