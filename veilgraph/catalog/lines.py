"""Queries on slanted text lines and on writers, over `events` and `documents`."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilgraph.functions import frames as L
from veilgraph.queries import query
from veilgraph.session import shared_dir
from veilgraph.sources import writers as O
from veilgraph.sources.readers import manifest, table

_SLANTED = """e AS (SELECT user_id AS p, event_id AS i, event_id * 37 % 500 AS x, event_id * 53 % 400 AS y, event_id % 60 + 20 AS w, event_id % 40 + 15 AS h, event_id % 21 - 10 AS s, event_id % 13 - 6 AS t FROM events),
l AS (SELECT *, sqrt((w * w + s * s)::DOUBLE) AS lu, sqrt((t * t + h * h)::DOUBLE) AS lv FROM e),
a AS (SELECT *, CASE WHEN greatest(lu, lv) / least(lu, lv) >= 1.3::DOUBLE THEN CASE WHEN lu >= lv THEN w / lu ELSE -t / lv END END AS ax, CASE WHEN greatest(lu, lv) / least(lu, lv) >= 1.3::DOUBLE THEN CASE WHEN lu >= lv THEN s / lu ELSE h / lv END END AS ay FROM l),
g AS (SELECT p, atan2(sum((w + h) * sin(2 * atan2(ay, ax))), sum((w + h) * cos(2 * atan2(ay, ax)))) / 2 AS turn FROM a WHERE ax IS NOT NULL GROUP BY p)"""


def slanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(photo_id, span_index, weight, outline, axis): outlines with a slant that the id decides."""
    e = F.col("event_id")
    x, y, w, h, s, t = e * 37 % 500, e * 53 % 400, e % 60 + 20, e % 40 + 15, e % 21 - 10, e % 13 - 6
    outline = F.array(L.vector(x, y), L.vector(x + w, y + s), L.vector(x + w - t, y + h + s), L.vector(x - t, y + h))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("photo_id"), e.alias("span_index"), (w + h).alias("weight"), outline.alias("outline"))
    return rows.withColumn("axis", L.axis(F.col("outline")))


@query(f"WITH {_SLANTED} SELECT p AS photo_id, i AS span_index, round(ax, 6) AS x, round(ay, 6) AS y FROM a")
def line_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slanted(spark, sf_dir).select("photo_id", "span_index", F.round("axis.x", 6).alias("x"), F.round("axis.y", 6).alias("y"))


@query(f"WITH {_SLANTED} SELECT p AS photo_id, round(cos(turn), 5) AS x, round(sin(turn), 5) AS y FROM g")
def page_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = slanted(spark, sf_dir).where("axis is not null").groupBy("photo_id").agg(L.page_axis(F.col("axis"), F.col("weight")).alias("d"))
    return pages.select("photo_id", F.round("d.x", 5).alias("x"), F.round("d.y", 5).alias("y"))


@query(f"""WITH {_SLANTED}, d AS (SELECT a.*, CASE WHEN ax * cos(turn) + ay * sin(turn) < 0 THEN -ax ELSE ax END AS rx, CASE WHEN ax * cos(turn) + ay * sin(turn) < 0 THEN -ay ELSE ay END AS ry FROM a LEFT JOIN g ON g.p = a.p),
n AS (SELECT *, lag(x) OVER o AS bx, lag(y) OVER o AS yy, lag(w) OVER o AS bw, lag(h) OVER o AS bh, lag(s) OVER o AS bs, lag(t) OVER o AS bt, lag(rx) OVER o AS qx, lag(ry) OVER o AS qy FROM d WINDOW o AS (PARTITION BY p ORDER BY i)),
f AS (SELECT *, coalesce(rx, qx, 1.0::DOUBLE) AS fx, CASE WHEN rx IS NOT NULL THEN ry WHEN qx IS NOT NULL THEN qy ELSE 0.0::DOUBLE END AS fy FROM n WHERE bx IS NOT NULL),
c AS (SELECT p, i, fx, fy, [x, x + w, x + w - t, x - t] AS xs, [y, y + s, y + h + s, y + h] AS ys, [bx, bx + bw, bx + bw - bt, bx - bt] AS xb, [yy, yy + bs, yy + bh + bs, yy + bh] AS yb FROM f),
k AS (SELECT p, i, list_transform([1, 2, 3, 4], lambda j: xs[j] * fx + ys[j] * fy) AS al, list_transform([1, 2, 3, 4], lambda j: ys[j] * fx - xs[j] * fy) AS ac, list_transform([1, 2, 3, 4], lambda j: xb[j] * fx + yb[j] * fy) AS bl, list_transform([1, 2, 3, 4], lambda j: yb[j] * fx - xb[j] * fy) AS bc FROM c),
m AS (SELECT p, i, list_min(al) AS a0, list_max(al) AS a1, list_min(ac) AS c0, list_max(ac) AS c1, list_min(bl) AS b0, list_max(bl) AS b1, list_min(bc) AS d0, list_max(bc) AS d1 FROM k)
SELECT p AS photo_id, i AS span_index, round(sqrt(pow(greatest(0.0::DOUBLE, b0 - a1, a0 - b1), 2) + pow(greatest(0.0::DOUBLE, d0 - c1, c0 - d1), 2)), 3) AS distance, abs((d0 + d1 - c0 - c1) / 2) <= least(c1 - c0, d1 - d0) * 0.8::DOUBLE AS same_line FROM m""")
def slanted_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each span and the one before it, in the span's own frame, turned to the page's side."""
    rows = slanted(spark, sf_dir)
    pages = rows.where("axis is not null").groupBy("photo_id").agg(L.page_axis(F.col("axis"), F.col("weight")).alias("page"))
    own = rows.join(pages, "photo_id", "left").withColumn("own", L.aligned(F.col("axis"), F.col("page")))
    order = Window.partitionBy("photo_id").orderBy("span_index")
    both = own.withColumn("b", F.lag("outline").over(order)).withColumn("other", F.lag("own").over(order)).where("b is not null").withColumn("f", L.frame(F.col("own"), F.col("other")))
    ends = both.withColumn("a", L.extent(F.col("outline"), F.col("f"))).withColumn("b", L.extent(F.col("b"), F.col("f")))
    return ends.select("photo_id", "span_index", F.round(L.apart(F.col("a"), F.col("b")), 3).alias("distance"), L.same_line(F.col("a"), F.col("b")).alias("same_line"))


# ---- writers: what is written is read back


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT doc_id, lang, length(text) AS n FROM documents")
def scene_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON object a line."""
    path = _place(spark, "scenes")
    O.json_lines(table(spark, sf_dir, "documents").select("doc_id", "lang", F.length("text").cast("long").alias("n")), path)
    return spark.read.schema("doc_id long, lang string, n long").json(path)


@query("SELECT event_type AS run, count(*) AS items FROM events GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM events")
def history_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs append to one history; its header stands in it once."""
    path = _place(spark, "history")
    events = table(spark, sf_dir, "events")
    O.history(events.groupBy(F.col("event_type").alias("run")).agg(F.count(F.lit(1)).alias("items")), path)
    O.history(events.agg(F.lit("all").alias("run"), F.count(F.lit(1)).alias("items")), path)
    return O.read_history(spark, path, "run string, items long")


@query("""SELECT CAST(event_id AS VARCHAR) AS id, 'g' || user_id AS "group", 'real' AS source, '' AS split, event_type AS status FROM events WHERE event_id % 50 = 0""")
def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "manifest")
    rows = table(spark, sf_dir, "events").where("event_id % 50 = 0").select(F.col("event_id").cast("string").alias("id"), F.concat(F.lit("g"), F.col("user_id").cast("string")).alias("group"), F.lit("real").alias("source"), F.col("event_type").alias("status"), F.col("ts").cast("string").alias("added_at"))
    O.manifest(rows.limit(0), path)
    O.manifest(rows, path)  # replaces the first
    return manifest(spark, path).select("id", "group", "source", "split", "status")


@query("SELECT CASE WHEN doc_id % 7 = 0 THEN 'val' ELSE 'train' END AS split, 'images/' || doc_id || '.jpg' AS path FROM documents")
def split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "splits")
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("images/"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("path"), F.when(F.col("doc_id") % 7 == 0, "val").otherwise("train").alias("split"))
    O.split_lists(rows, path)
    return spark.read.text(path).select("split", F.col("value").alias("path"))
