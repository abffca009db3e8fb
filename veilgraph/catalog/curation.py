"""Queries on dataset rules, over `events` and `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.operators import curation as C
from veilgraph.queries import query
from veilgraph.sources.readers import table

_CLASSES = ["id_card", "face_photo", "card"]
_BOXES = "b AS (SELECT user_id AS path, event_id AS box_no, ['id_card', 'face_photo', 'card'][CAST(event_id % 3 AS INTEGER) + 1] AS class, event_id % 7 * 40 AS x0, event_id % 5 * 50 AS y0, event_id % 7 * 40 + event_id % 11 * 30 + 3 AS x1, event_id % 5 * 50 + event_id % 13 * 25 + 3 AS y1, 300 AS width, 280 AS height FROM events)"


@query(f"""WITH {_BOXES}, o AS (SELECT a.path, a.box_no, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS i, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS s
  FROM b a JOIN b ON a.path = b.path AND a.class = b.class AND b.box_no < a.box_no)
SELECT path, box_no, 'problem' AS level, 'too small' AS problem FROM b WHERE x1 - x0 < 6 OR y1 - y0 < 6
UNION ALL SELECT DISTINCT path, box_no, 'problem', 'drawn twice' FROM o WHERE i > 0 AND i::DOUBLE / (s - i) >= 0.9
UNION ALL SELECT path, box_no, 'warning', 'nearly the whole image' FROM b WHERE (x1 - x0) * (y1 - y0) >= width * height * 0.9::DOUBLE
UNION ALL SELECT path, box_no, 'warning', 'photo outside its card' FROM b a WHERE class = 'face_photo' AND NOT EXISTS (SELECT 1 FROM b c WHERE c.path = a.path AND c.class = 'id_card' AND a.x0 + a.x1 BETWEEN 2 * c.x0 AND 2 * c.x1 AND a.y0 + a.y1 BETWEEN 2 * c.y0 AND 2 * c.y1)""")
def box_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), e.alias("box_no"), F.get(F.array(*map(F.lit, _CLASSES)), (e % 3).cast("int")).alias("class"), (e % 7 * 40).alias("x0"), (e % 5 * 50).alias("y0"))
    rows = rows.withColumn("x1", F.col("x0") + F.col("box_no") % 11 * 30 + 3).withColumn("y1", F.col("y0") + F.col("box_no") % 13 * 25 + 3).withColumn("width", F.lit(300)).withColumn("height", F.lit(280))
    return C.box_problems(rows)


@query("""WITH RECURSIVE g AS (SELECT DISTINCT user_id AS grp FROM events), k AS (SELECT grp, CASE grp % 3 WHEN 0 THEN 'val' ELSE 'train' END AS split FROM g WHERE grp % 10 = 0),
n AS (SELECT grp, row_number() OVER (ORDER BY grp) AS rn FROM g WHERE grp % 10 <> 0 AND grp % 4 <> 1),
r AS (SELECT 0::BIGINT AS rn, (SELECT count(*) FROM k WHERE split = 'train') AS a, (SELECT count(*) FROM k WHERE split = 'val') AS b, 0::BIGINT AS c, '' AS split
  UNION ALL SELECT rn + 1, a + (s = 'train')::INT, b + (s = 'val')::INT, c + (s = 'test')::INT, s FROM (SELECT *, CASE WHEN round(0.70::DOUBLE * (a + b + c + 1) - a, 9) >= round(0.15::DOUBLE * (a + b + c + 1) - b, 9) AND round(0.70::DOUBLE * (a + b + c + 1) - a, 9) >= round(0.15::DOUBLE * (a + b + c + 1) - c, 9) THEN 'train'
    WHEN round(0.15::DOUBLE * (a + b + c + 1) - b, 9) >= round(0.15::DOUBLE * (a + b + c + 1) - c, 9) THEN 'val' ELSE 'test' END AS s FROM r WHERE rn < (SELECT count(*) FROM n)))
SELECT grp AS "group", split FROM k UNION ALL SELECT n.grp, r.split FROM n JOIN r ON r.rn = n.rn UNION ALL SELECT grp, 'train' FROM g WHERE grp % 10 <> 0 AND grp % 4 = 1""")
def group_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("group")).distinct()
    known = users.where("group % 10 = 0").select("group", F.when(F.col("group") % 3 == 0, "val").otherwise("train").alias("split"))
    groups = users.where("group % 10 <> 0").select("group", F.when(F.col("group") % 4 == 1, "synth").otherwise("real").alias("source"))
    return C.group_splits(groups, known)


@query("SELECT 'pic' || (event_id % 500) AS original, min('pic' || (event_id % 500) || '.rf.' || md5(CAST(event_id AS VARCHAR))) AS name FROM events GROUP BY 1")
def first_originals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id").cast("string")
    return C.first_originals(table(spark, sf_dir, "events").select(F.concat(F.lit("pic"), (F.col("event_id") % 500).cast("string"), F.lit(".rf."), F.md5(e.cast("binary"))).alias("name")))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events) WHERE n % 5 = 0")
def frame_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.every_nth(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id", 5)


@query("SELECT event_id FROM events WHERE event_id % 4 > 0 OR CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS UBIGINT)::DOUBLE / 4294967295.0 <= 0.1")
def kept_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.kept_empty(table(spark, sf_dir, "events").select("event_id"), "event_id", F.col("event_id") % 4, 0.1)


@query("SELECT doc_id FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 100")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit is the operator's: a sample of 100 in seeded order."""
    return C.seeded_sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 7, 100)


@query("""SELECT user_id, max_by(v, n) AS latest FROM (SELECT user_id, 'v' || (event_id % 113) AS v, event_id % 113 AS n FROM events WHERE event_id % 6 <> 0) GROUP BY user_id""")
def latest_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    name = F.concat(F.when(e % 6 == 0, "old-").otherwise(""), F.lit("v"), (e % 113).cast("string"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(C.latest_version(name).alias("latest"))


@query("SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type || '-' || (event_id % 3))))[1:8], ',') AS models FROM events GROUP BY user_id")
def model_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws("-", "event_type", (F.col("event_id") % 3).cast("string"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(C.model_list(F.collect_set(name), 8), ",").alias("models"))


@query("""WITH f AS (SELECT 'set' || (event_id % 3) || '/Pic' || event_id || CASE WHEN event_id % 2 = 0 THEN '.png' ELSE '.jpg' END AS path FROM events WHERE event_id % 5 <> 0),
w AS (SELECT 'Pic' || event_id || '.jpg' AS name, event_id FROM events)
SELECT w.name, coalesce(max(a.path), min(b.path)) AS path FROM w LEFT JOIN f a ON string_split(a.path, '/')[-1] = w.name LEFT JOIN f b ON lower(regexp_replace(string_split(b.path, '/')[-1], '\\.[^.]*$', '')) = lower(regexp_replace(w.name, '\\.[^.]*$', '')) GROUP BY w.name""")
def located_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, s = F.col("event_id"), F.col("event_id").cast("string")
    rows = table(spark, sf_dir, "events")
    files = rows.where(e % 5 != 0).select(F.concat(F.lit("set"), (e % 3).cast("string"), F.lit("/Pic"), s, F.when(e % 2 == 0, ".png").otherwise(".jpg")).alias("path"))
    return C.located(rows.select(F.concat(F.lit("Pic"), s, F.lit(".jpg")).alias("name")), files)


@query("""WITH a AS (SELECT event_id AS annotation_id, event_id * 7 % (SELECT count(*) FROM documents) AS image_id, event_id % 6 AS category_id FROM events),
k AS (SELECT * FROM (VALUES (0, 'id_card'), (1, 'screen'), (3, 'card')) AS k(category_id, class))
SELECT d.doc_id AS image_id, count(k.class) AS boxes, coalesce(string_agg(k.class, ',' ORDER BY a.annotation_id), '') AS classes FROM documents d LEFT JOIN a ON a.image_id = d.doc_id LEFT JOIN k ON k.category_id = a.category_id GROUP BY d.doc_id""")
def annotated_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, e = table(spark, sf_dir, "documents"), F.col("event_id")
    marks = table(spark, sf_dir, "events").crossJoin(docs.agg(F.count(F.lit(1)).alias("n"))).select(e.alias("annotation_id"), (e * 7 % F.col("n")).alias("image_id"), (e % 6).alias("category_id"))  # one row beside
    classes = spark.createDataFrame([(0, "id_card"), (1, "screen"), (3, "card")], "category_id long, class string")
    out = C.annotated(docs.select(F.col("doc_id").alias("image_id")), marks, classes)
    return out.select("image_id", F.size("boxes").cast("long").alias("boxes"), F.array_join(F.transform("boxes", lambda b: b["class"]), ",").alias("classes"))


@query("SELECT event_id % 6 AS category_id, count(*) AS n FROM events WHERE event_id % 6 NOT IN (0, 1, 3) GROUP BY 1")
def skipped_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "events").select((F.col("event_id") % 6).alias("category_id"))
    return C.skipped_names(marks, spark.createDataFrame([(0, "id_card"), (1, "screen"), (3, "card")], "category_id long, class string"))


@query("""SELECT p_partkey, CASE WHEN regexp_matches(lower(p_type), 'tin|nickel') THEN NULL WHEN regexp_matches(lower(p_type), 'brass$') THEN 'card' WHEN regexp_matches(lower(p_type), 'steel|copper') THEN 'id_card' END AS class FROM part""")
def mapped_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", C.class_of(F.col("p_type"), [("brass$", "card"), ("steel|copper", "id_card")], "tin|nickel").alias("class"))


@query("""WITH m AS (SELECT event_id AS id, user_id AS grp, ['real', 'synth', 'public'][CAST(event_id % 3 AS INTEGER) + 1] AS source, ['train', 'val', 'test'][CAST(event_id // 3 % 3 AS INTEGER) + 1] AS split FROM events WHERE event_id % 4 <> 0)
SELECT split, source, count(*) AS rows, count(DISTINCT grp) AS groups FROM m GROUP BY split, source UNION ALL SELECT split, NULL, count(*), count(DISTINCT grp) FROM m GROUP BY split""")
def dataset_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    pick = lambda names, n: F.get(F.array(*map(F.lit, names)), (n % 3).cast("int"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("group"), pick(["real", "synth", "public"], e).alias("source"), pick(["train", "val", "test"], F.floor(e / 3)).alias("split"), F.when(e % 4 == 0, "review").otherwise("done").alias("status"))
    return C.status_counts(rows)


@query("""SELECT event_id, (event_id % 2 = 0 AND NOT (event_id % 3 = 0 AND event_id % 5 = 0 AND event_id % 7 <> 0)) OR event_id % 11 = 0 AS replaced, (event_id % 3 = 0 AND event_id % 5 = 0 AND event_id % 7 <> 0) AND event_id % 11 <> 0 AS blocked FROM events""")
def model_promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    replaced, blocked = C.promoted(e % 2 == 0, e % 3, e % 5, e % 7 != 0, e % 11 == 0)
    return table(spark, sf_dir, "events").select("event_id", replaced.alias("replaced"), blocked.alias("blocked"))


@query("""SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN '.' ELSE '' END || 'p' || event_id || ['.JPG', '.png', '.txt', '.jpeg', '.webp'][CAST(event_id % 5 AS INTEGER) + 1] AS b FROM events) WHERE b NOT LIKE '.%' AND regexp_matches(lower(b), '\\.(jpe?g|png|webp|bmp)$')""")
def picture_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    ext = F.get(F.array(*map(F.lit, [".JPG", ".png", ".txt", ".jpeg", ".webp"])), (e % 5).cast("int"))
    name = F.concat(F.lit("in/"), F.when(e % 9 == 0, ".").otherwise(""), F.lit("p"), e.cast("string"), ext)
    return table(spark, sf_dir, "events").where(C.picture_file(name)).select("event_id")


@query("""SELECT event_id, round(1 - cy, 6) AS cx, round(cx, 6) AS cy, h AS w, w AS h FROM (SELECT event_id, (event_id % 97)::DOUBLE / 100 AS cx, (event_id % 89)::DOUBLE / 100 AS cy, (event_id % 13)::DOUBLE / 100 AS w, (event_id % 17)::DOUBLE / 100 AS h FROM events)""")
def rotated_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    part = lambda n: (e % n).cast("double") / 100
    box = F.struct(part(97).alias("cx"), part(89).alias("cy"), part(13).alias("w"), part(17).alias("h"))
    out = C.rotated_label(box, 90)
    return table(spark, sf_dir, "events").select("event_id", F.round(out["cx"], 6).alias("cx"), F.round(out["cy"], 6).alias("cy"), out["w"].alias("w"), out["h"].alias("h"))
