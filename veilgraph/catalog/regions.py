"""Queries on detected regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilgraph.catalog import photos as P
from veilgraph.functions import geometry as G
from veilgraph.operators import regions as R
from veilgraph.operators.grid import centred, overlapping
from veilgraph.queries import query
from veilgraph.sources.readers import table

_DOCS = "(" + ", ".join(repr(n) for n in R.DOCUMENTS) + ")"
_READ = f"""r AS (SELECT d.p, d.i, any_value(d.name) AS name, any_value(d.conf) AS conf, any_value(d.x) AS x, any_value(d.y) AS y, any_value(d.w) AS w, any_value(d.h) AS h, count(s.i) AS inside,
  CAST(coalesce(sum(CASE WHEN s.conf >= 0.75 THEN length(replace(s.text, ' ', '')) END), 0) AS BIGINT) AS chars, median(CASE WHEN s.conf >= 0.75 THEN s.h END) AS height
  FROM d LEFT JOIN s ON s.p = d.p AND {P.sql_centre_in('s', 'd')} WHERE d.name IN {_DOCS} GROUP BY d.p, d.i)"""


@query(f"WITH {P.PHOTO}, {_READ} SELECT p AS photo_id, i AS det_index, inside, chars, height FROM r")
def read_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.read_in_documents(P.spans(spark, sf_dir), P.detections(spark, sf_dir)).select("photo_id", "det_index", F.col("inside").cast("long").alias("inside"), "chars", "height")


@query(f"""WITH {P.PHOTO}, {_READ}, n AS (SELECT * FROM r WHERE chars < 40 OR height IS NULL OR height < 22 QUALIFY row_number() OVER (PARTITION BY p ORDER BY conf DESC, i) <= 4),
e AS (SELECT *, greatest(0, x - (CAST(floor(w * 0.04) AS BIGINT) + 8)) AS x0, greatest(0, y - (CAST(floor(h * 0.04) AS BIGINT) + 8)) AS y0,
  least({P.WIDTH}, x + w + CAST(floor(w * 0.04) AS BIGINT) + 8) AS x1, least({P.HEIGHT}, y + h + CAST(floor(h * 0.04) AS BIGINT) + 8) AS y1 FROM n)
SELECT p AS photo_id, i AS det_index, x0 AS x, y0 AS y, greatest(1, x1 - x0) AS w, greatest(1, y1 - y0) AS h, round(least(3.0::DOUBLE, greatest(1.0::DOUBLE, 1600::DOUBLE / greatest(x1 - x0, y1 - y0))), 6) AS scale FROM e""")
def documents_to_read_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    again = R.to_read_again(P.spans(spark, sf_dir), P.detections(spark, sf_dir), P.WIDTH, P.HEIGHT)
    return again.select("photo_id", "det_index", *(F.col(f"crop.{c}").cast("long").alias(c) for c in "xywh"), F.round("scale", 6).alias("scale"))


@query(f"""WITH {P.PHOTO}, c AS (SELECT p, i, greatest(0, x - 20) AS cx, greatest(0, y - 20) AS cy, 1 + (i % 5) / 2.0::DOUBLE AS scale, x, y, w, h FROM s)
SELECT p AS photo_id, i AS span_index, CAST(floor(x / scale + cx) AS BIGINT) AS x, CAST(floor(y / scale + cy) AS BIGINT) AS y,
  CAST(greatest(1, round_even(w / scale, 0)) AS BIGINT) AS w, CAST(greatest(1, round_even(h / scale, 0)) AS BIGINT) AS h FROM c""")
def crop_boxes_in_photo(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.spans(spark, sf_dir).withColumn("crop", G.box(F.greatest(F.lit(0), F.col("box.x") - 20), F.greatest(F.lit(0), F.col("box.y") - 20), F.lit(1), F.lit(1)))
    back = R.to_original(F.col("box"), F.col("crop"), F.lit(1) + (F.col("span_index") % 5) / 2.0)
    return rows.select("photo_id", "span_index", back.alias("o")).select("photo_id", "span_index", *(F.col(f"o.{c}").cast("long").alias(c) for c in "xywh"))


@query(f"""WITH {P.PHOTO}, {_READ}, r2 AS (SELECT p, i, chars, CAST(floor(chars * 1.5) AS BIGINT) - i % 7 AS second FROM r) SELECT p AS photo_id, i AS det_index, chars AS first, second, second > chars AS again FROM r2""")
def better_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = R.read_in_documents(P.spans(spark, sf_dir), P.detections(spark, sf_dir)).select("photo_id", "det_index", "chars")
    again = read.withColumn("chars", F.floor(F.col("chars") * 1.5).cast("long") - F.col("det_index") % 7)
    return R.better_reading(read, again)


@query(f"""WITH {P.PHOTO} SELECT f.p AS photo_id, f.i AS finding, any_value(d.name) AS document FROM f JOIN d ON d.p = f.p AND d.name IN {_DOCS} AND {P.sql_centre_in('f', 'd')} GROUP BY 1, 2 HAVING count(*) = 1""")
def document_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.document_tags(P.detections(spark, sf_dir), P.findings(spark, sf_dir))


@query(f"""WITH {P.PHOTO} SELECT d.p AS photo_id, d.i AS det_index FROM d WHERE d.name = 'screen' AND NOT EXISTS (
  SELECT 1 FROM f WHERE f.p = d.p AND f.kind = 'plate' AND {P.sql_overlap('f', 'd')} > 0)""")
def unread_plates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of one class stand for plates."""
    plates = P.detections(spark, sf_dir).where("name = 'screen'").select("photo_id", "det_index", "box")
    return R.unread_plates(plates, P.findings(spark, sf_dir)).select("photo_id", "det_index")


@query(f"""WITH {P.PHOTO}, {_READ},
n AS (SELECT d.* FROM d WHERE d.name = 'card_number' AND NOT EXISTS (SELECT 1 FROM f WHERE f.p = d.p AND f.kind = 'card' AND ({P.sql_centre_in('f', 'd')} OR {P.sql_centre_in('d', 'f')}))),
c AS (SELECT d.p, d.i, d.name, coalesce(r.chars, 0) AS chars,
  EXISTS (SELECT 1 FROM n WHERE n.p = d.p AND n.i = d.i) AS unread_line,
  EXISTS (SELECT 1 FROM f WHERE f.p = d.p AND f.kind = 'card' AND {P.sql_centre_in('f', 'd')}) AS card_in,
  EXISTS (SELECT 1 FROM n WHERE n.p = d.p AND {P.sql_centre_in('n', 'd')}) AS line_in,
  EXISTS (SELECT 1 FROM f WHERE f.p = d.p AND f.severity <> 'info' AND f.kind NOT IN ('qr', 'barcode') AND {P.sql_centre_in('f', 'd')}) AS personal,
  EXISTS (SELECT 1 FROM f WHERE f.p = d.p AND f.kind IN ('qr', 'barcode') AND {P.sql_of_smaller('f', 'd')} >= 0.3) AS decoded
  FROM d LEFT JOIN r ON r.p = d.p AND r.i = d.i),
o AS (SELECT p, i, CASE WHEN name = 'card_number' THEN CASE WHEN unread_line THEN ['card', 'region', 'cover', 'card_number_region'] END
  WHEN name IN {_DOCS} AND chars < 6 THEN ['document', 'region', CASE WHEN name IN ('id_card', 'name_tag', 'card') THEN 'cover' ELSE 'review' END, 'unread']
  WHEN name = 'card' THEN CASE WHEN NOT card_in AND NOT line_in THEN ['document', 'partial', 'cover', 'card_number_unread'] END
  WHEN name IN ('waybill', 'id_card', 'name_tag', 'health_item') AND NOT personal THEN ['document', 'partial', 'review', 'unconfirmed']
  WHEN name = 'face_photo' THEN ['face_photo', 'region', 'review', 'face_photo']
  WHEN name = 'barcode' AND NOT decoded THEN ['barcode', 'region', 'review', 'undecoded'] END AS o FROM c)
SELECT p AS photo_id, i AS det_index, o[1] AS kind, o[2] AS certainty, o[3] AS severity, o[4] AS reason FROM o WHERE o IS NOT NULL""")
def region_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.region_findings(P.detections(spark, sf_dir), P.spans(spark, sf_dir), P.findings(spark, sf_dir))


_TILE = "part AS (SELECT event_id, 600 + event_id % 1500 AS w, 500 + event_id * 7 % 1200 AS h, unnest([0, 1]) AS r FROM events), rc AS (SELECT *, unnest([0, 1]) AS c FROM part WHERE greatest(w, h) >= 1280), x AS (SELECT event_id, w, h, r, c, w::DOUBLE / 1.8::DOUBLE AS tw, h::DOUBLE / 1.8::DOUBLE AS th FROM rc), t AS (SELECT *, CAST(round_even(tw * c::DOUBLE * 0.8::DOUBLE, 0) AS BIGINT) AS x0, CAST(round_even(th * r::DOUBLE * 0.8::DOUBLE, 0) AS BIGINT) AS y0 FROM x), u AS (SELECT *, least(w, CAST(round_even(x0 + tw, 0) AS BIGINT)) AS x1, least(h, CAST(round_even(y0 + th, 0) AS BIGINT)) AS y1 FROM t)"


@query(f"WITH {_TILE} SELECT event_id, x0, y0, x1, y1 FROM u")
def image_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(e, F.explode(R.tiles((F.lit(600) + e % 1500).cast("double"), (F.lit(500) + e * 7 % 1200).cast("double"))).alias("t"))
    return rows.select("event_id", *(F.col(f"t.{c}").cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")))


@query(f"""WITH {_TILE}, b AS (SELECT *, event_id * 37 % 900 AS bx, event_id * 53 % 700 AS yy, event_id % 60 + 20 AS bw, event_id % 40 + 15 AS bh FROM u)
SELECT event_id, x0, y0 FROM b WHERE NOT ((x0 > 0 AND bx <= 2) OR (y0 > 0 AND yy <= 2) OR (x1 < w AND bx + bw >= x1 - x0 - 2) OR (y1 < h AND yy + bh >= y1 - y0 - 2))""")
def boxes_within_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    w, h = (F.lit(600) + e % 1500).cast("double"), (F.lit(500) + e * 7 % 1200).cast("double")
    rows = table(spark, sf_dir, "events").select(e, w.alias("w"), h.alias("h"), G.box(e * 37 % 900, e * 53 % 700, e % 60 + 20, e % 40 + 15).alias("b"), F.explode(R.tiles(w, h)).alias("t"))
    return rows.where(~R.cut_by_tile(F.col("b"), F.col("t"), F.col("w"), F.col("h"))).select("event_id", F.col("t.x0").cast("long").alias("x0"), F.col("t.y0").cast("long").alias("y0"))


# ---- detector evaluation

_SERIOUS = "g AS (SELECT * FROM f WHERE severity <> 'info')"
_SIZE = f"CASE WHEN greatest(d.w, d.h)::DOUBLE / {min(P.WIDTH, P.HEIGHT)} < 0.15 THEN 'small' WHEN greatest(d.w, d.h)::DOUBLE / {min(P.WIDTH, P.HEIGHT)} < 0.4 THEN 'mid' ELSE 'large' END"


def size_class(box):
    part = F.greatest(box["w"], box["h"]) / float(min(P.WIDTH, P.HEIGHT))
    return F.when(part < 0.15, "small").when(part < 0.4, "mid").otherwise("large")


@query(f"""WITH {P.PHOTO}, {_SERIOUS}, e AS (SELECT d.p, d.i, {_SIZE} AS size, count(g.i) > 0 AS found, coalesce(bool_or(g.certainty <> 'region'), FALSE) AS read
  FROM d LEFT JOIN g ON g.p = d.p AND {P.sql_centre_in('g', 'd')} WHERE d.name IN {_DOCS} GROUP BY d.p, d.i, {_SIZE})
SELECT size, count(*) AS documents, CAST(sum(found::INT) AS BIGINT) AS found, CAST(sum(read::INT) AS BIGINT) AS read FROM e GROUP BY size""")
def detector_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents alerted, and read, by size of the document in the photo."""
    docs = P.detections(spark, sf_dir).where(R.is_document(F.col("name"))).select("photo_id", "det_index", F.col("box").alias("b"))
    serious = P.findings(spark, sf_dir).where("severity <> 'info'").select("photo_id", "certainty", F.col("box").alias("a"))
    met = centred(serious, docs).groupBy("photo_id", "det_index").agg(F.max((F.col("certainty") != "region").cast("int")).alias("read")).withColumn("found", F.lit(1))
    each = docs.join(met, ["photo_id", "det_index"], "left").fillna(0, ["read", "found"])
    return each.groupBy(size_class(F.col("b")).alias("size")).agg(F.count(F.lit(1)).alias("documents"), F.sum("found").cast("long").alias("found"), F.sum("read").cast("long").alias("read"))


@query(f"""WITH {P.PHOTO}, {_SERIOUS} SELECT p AS photo_id, count(*) AS stray FROM g WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.p = g.p AND d.name IN {_DOCS} AND {P.sql_centre_in('g', 'd')}) GROUP BY p""")
def stray_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = P.detections(spark, sf_dir).where(R.is_document(F.col("name"))).select("photo_id", F.col("box").alias("b"))
    serious = P.findings(spark, sf_dir).where("severity <> 'info'").select("photo_id", "finding", F.col("box").alias("a"))
    return serious.join(centred(serious, docs).select("photo_id", "finding").distinct(), ["photo_id", "finding"], "left_anti").groupBy("photo_id").agg(F.count(F.lit(1)).alias("stray"))


@query(f"""WITH {P.PHOTO}, {_SERIOUS}, t AS (SELECT * FROM d WHERE name IN ('card_number', 'barcode')),
e AS (SELECT t.p, t.i, EXISTS (SELECT 1 FROM s WHERE s.p = t.p AND {P.sql_of_smaller('s', 't')} >= 0.3) AS read,
  EXISTS (SELECT 1 FROM g WHERE g.p = t.p AND {P.sql_of_smaller('g', 't')} >= 0.3) AS alert,
  EXISTS (SELECT 1 FROM g WHERE g.p = t.p AND g.severity = 'cover' AND {P.sql_of_smaller('g', 't')} >= 0.3) AS cover FROM t)
SELECT (SELECT count(*) FROM e) AS truths, (SELECT count(*) FROM e WHERE read) AS read, (SELECT count(*) FROM e WHERE alert) AS alert, (SELECT count(*) FROM e WHERE cover) AS cover,
  (SELECT count(*) FROM g WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.p = g.p AND {P.sql_of_smaller('g', 't')} >= 0.3)) AS outside""")
def truth_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True regions that were read, alerted and covered, and alerts outside all of them."""
    truth = P.detections(spark, sf_dir).where("name in ('card_number', 'barcode')").select("photo_id", "det_index", F.col("box").alias("b"))
    serious = P.findings(spark, sf_dir).where("severity <> 'info'").select("photo_id", "finding", "severity", F.col("box").alias("a"))
    near = lambda rows: overlapping(rows, truth).where(G.share_of_smaller(F.col("a"), F.col("b")) >= 0.3)
    hit = near(serious)
    by = hit.groupBy("photo_id", "det_index").agg(F.lit(1).alias("alert"), F.max((F.col("severity") == "cover").cast("int")).alias("cover"))
    read = near(P.spans(spark, sf_dir).select("photo_id", "span_index", F.col("box").alias("a"))).select("photo_id", "det_index").distinct().withColumn("read", F.lit(1))
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    one = truth.join(by, ["photo_id", "det_index"], "left").join(read, ["photo_id", "det_index"], "left").agg(F.count(F.lit(1)).alias("truths"), count("read"), count("alert"), count("cover"))
    outside = serious.join(hit.select("photo_id", "finding").distinct(), ["photo_id", "finding"], "left_anti").agg(F.count(F.lit(1)).alias("outside"))
    return one.crossJoin(outside)  # one row each


@query(f"""WITH {P.PHOTO}, h AS (SELECT d.p, d.i, d.name, f.kind FROM d JOIN f ON f.p = d.p AND ({P.sql_iou('f', 'd')} >= 0.3 OR {P.sql_centre_in('f', 'd')} OR {P.sql_centre_in('d', 'f')})),
k AS (SELECT name, kind, count(DISTINCT (p, i)) AS n FROM h GROUP BY 1, 2),
t AS (SELECT name, list(kind ORDER BY n DESC, kind)[1:3] AS kinds FROM k GROUP BY name)
SELECT d.name, count(*) AS truths, count(x.i) AS found, round(count(x.i)::DOUBLE / count(*), 3) AS recall, array_to_string(any_value(t.kinds), ',') AS kinds
FROM d LEFT JOIN (SELECT DISTINCT p, i FROM h) x ON x.p = d.p AND x.i = d.i LEFT JOIN t ON t.name = d.name GROUP BY d.name""")
def attribute_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall by attribute, and the three kinds by which it was found most: a hit has an IoU of 0.3 or one centre inside the other."""
    truth = P.detections(spark, sf_dir).select("photo_id", "det_index", "name", F.col("box").alias("b"))
    found = P.findings(spark, sf_dir).select("photo_id", "kind", F.col("box").alias("a"))
    cols = ["photo_id", "det_index", "name", "kind"]
    other = centred(truth, found, a="b", b="a").select(*cols)
    hit = overlapping(found, truth).where(G.iou(F.col("a"), F.col("b")) >= 0.3).select(*cols).union(centred(found, truth).select(*cols)).union(other).distinct()
    kinds = hit.groupBy("name", "kind").agg(F.count(F.lit(1)).alias("n")).withColumn("rn", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("n"), "kind"))).where("rn <= 3")
    top = kinds.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "kind"))), lambda x: x["kind"]), ",").alias("kinds"))
    got = hit.select("photo_id", "det_index").distinct().withColumn("hit", F.lit(1))
    out = truth.join(got, ["photo_id", "det_index"], "left").groupBy("name").agg(F.count(F.lit(1)).alias("truths"), F.count("hit").alias("found"))
    return out.withColumn("recall", F.round(F.col("found") / F.col("truths"), 3)).join(top, "name", "left")


@query(f"""WITH {P.PHOTO}, e AS (SELECT d.p, d.i, CASE WHEN least(d.w, d.h) < 64 THEN '0~64px' WHEN least(d.w, d.h) < 128 THEN '64~128px' ELSE '128~px' END AS size,
  EXISTS (SELECT 1 FROM d q WHERE q.p = d.p AND q.i <> d.i AND q.conf >= 0.5 AND {P.sql_iou('q', 'd')} >= 0.5) AS hit FROM d)
SELECT size, count(*) AS total, round(CAST(sum(hit::INT) AS DOUBLE) / count(*), 4) AS recall FROM e GROUP BY size""")
def recall_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall by the short side of the true box; other detections of the photo stand for predictions."""
    d = P.detections(spark, sf_dir)
    truth = d.select("photo_id", "det_index", F.col("box").alias("b"))
    pred = d.where("conf >= 0.5").select("photo_id", F.col("det_index").alias("pred"), F.col("box").alias("a"))
    hit = overlapping(pred, truth).where((F.col("pred") != F.col("det_index")) & (G.iou(F.col("a"), F.col("b")) >= 0.5)).select("photo_id", "det_index").distinct().withColumn("hit", F.lit(1))
    side = F.least("b.w", "b.h")
    size = F.when(side < 64, "0~64px").when(side < 128, "64~128px").otherwise("128~px")
    return truth.join(hit, ["photo_id", "det_index"], "left").groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("total"), F.round(F.count("hit") / F.count(F.lit(1)), 4).alias("recall"))


@query(f"""WITH {P.PHOTO}, wrong AS (SELECT q.* FROM d q WHERE q.name = 'id_card' AND q.conf >= 0.3 AND NOT EXISTS (SELECT 1 FROM d WHERE d.p = q.p AND d.i <> q.i AND d.name = 'id_card' AND {P.sql_iou('q', 'd')} >= 0.5)),
o AS (SELECT q.p, q.i, d.name, {P.sql_iou('q', 'd')} AS v, d.i AS j FROM wrong q JOIN d ON d.p = q.p AND d.name <> 'id_card'),
b AS (SELECT p, i, name FROM o WHERE v >= 0.3 QUALIFY row_number() OVER (PARTITION BY p, i ORDER BY v DESC, j) = 1)
SELECT coalesce(b.name, 'background') AS on_what, count(*) AS n FROM wrong w LEFT JOIN b ON b.p = w.p AND b.i = w.i GROUP BY 1""")
def false_positive_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What false detections of one class lie on: the other class of best IoU (0.3 at least), else the background."""
    d = P.detections(spark, sf_dir)
    pred = d.where("name = 'id_card' and conf >= 0.3").select("photo_id", F.col("det_index").alias("pred"), F.col("box").alias("a"))
    truth = d.select("photo_id", "det_index", "name", F.col("box").alias("b"))
    met = overlapping(pred, truth).where(F.col("pred") != F.col("det_index")).withColumn("v", G.iou(F.col("a"), F.col("b")))
    right = met.where("name = 'id_card' and v >= 0.5").select("photo_id", "pred").distinct()
    best = met.where("name <> 'id_card' and v >= 0.3").groupBy("photo_id", "pred").agg(F.max_by("name", F.struct("v", -F.col("det_index"))).alias("name"))
    wrong = pred.join(right, ["photo_id", "pred"], "left_anti")
    return wrong.join(best, ["photo_id", "pred"], "left").groupBy(F.coalesce("name", F.lit("background")).alias("on_what")).agg(F.count(F.lit(1)).alias("n"))
