"""Photos made from `events`: a user is a photo, and its events are spans, detections and findings in turn.

Every relation is an expression of event_id, the same in Spark and in DuckDB (PHOTO).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.functions import geometry as G
from veilgraph.sources.readers import table

NAMES = ["id_card", "name_tag", "card", "waybill", "screen", "face_photo", "barcode", "card_number"]
KINDS = ["mobile", "email", "card", "qr", "plate", "name", "barcode", "face_photo"]
SEVERITIES = ["cover", "review", "info"]
CERTAINTIES = ["read", "partial", "region"]
WIDTH, HEIGHT = 800, 600


def _pick(values: list[str], n: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), (n % len(values)).cast("int"))


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    turn = F.floor(e / 3)
    return table(spark, sf_dir, "events").where("event_id is not null and user_id is not null").select(F.col("user_id").alias("photo_id"), e, (e % 3).alias("role"), turn.alias("turn"), "event_type", e.alias("_e"))


def _box(scale: int) -> Column:
    e = F.col("_e")
    return G.box(e * 37 % 500, e * 53 % 400, (e % 60 + 20) * scale, (e % 40 + 15) * scale)


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _base(spark, sf_dir).where("role = 0")
    return rows.select("photo_id", F.col("event_id").alias("span_index"), F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("text"), _box(1).alias("box"), (F.col("_e") * 7919 % 100 / 100.0).cast("double").alias("conf"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _base(spark, sf_dir).where("role = 1")
    return rows.select("photo_id", F.col("event_id").alias("det_index"), _pick(NAMES, F.col("turn")).alias("name"), _box(4).alias("box"), (F.col("_e") * 31 % 100 / 100.0).cast("double").alias("conf"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _base(spark, sf_dir).where("role = 2")
    return rows.select(
        "photo_id", F.col("event_id").alias("finding"), _pick(KINDS, F.col("turn")).alias("kind"), _pick(SEVERITIES, F.floor(F.col("turn") / 8)).alias("severity"),
        _pick(CERTAINTIES, F.floor(F.col("turn") / 24)).alias("certainty"), _box(1).alias("box"), (F.col("_e") % 193).cast("string").alias("evidence"),
    )


def _sql_pick(values: list[str], n: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][CAST(({n}) % {len(values)} AS INTEGER) + 1]"


_SQL_BOX = "event_id * 37 % 500 AS x, event_id * 53 % 400 AS y, (event_id % 60 + 20) * {0} AS w, (event_id % 40 + 15) * {0} AS h"
#: Common table expressions s (spans), d (detections) and f (findings): p is the photo, i the index.
PHOTO = f"""s AS (SELECT user_id AS p, event_id AS i, event_type || ' ' || event_id AS text, {_SQL_BOX.format(1)}, (event_id * 7919 % 100)::DOUBLE / 100 AS conf FROM events WHERE event_id % 3 = 0 AND user_id IS NOT NULL),
d AS (SELECT user_id AS p, event_id AS i, {_sql_pick(NAMES, 'event_id // 3')} AS name, {_SQL_BOX.format(4)}, (event_id * 31 % 100)::DOUBLE / 100 AS conf FROM events WHERE event_id % 3 = 1 AND user_id IS NOT NULL),
f AS (SELECT user_id AS p, event_id AS i, {_sql_pick(KINDS, 'event_id // 3')} AS kind, {_sql_pick(SEVERITIES, 'event_id // 24')} AS severity, {_sql_pick(CERTAINTIES, 'event_id // 72')} AS certainty,
  {_SQL_BOX.format(1)}, CAST(event_id % 193 AS VARCHAR) AS evidence FROM events WHERE event_id % 3 = 2 AND user_id IS NOT NULL)"""


def sql_centre_in(a: str, b: str) -> str:
    """The centre of box a lies in box b."""
    return f"(2 * {a}.x + {a}.w BETWEEN 2 * {b}.x AND 2 * ({b}.x + {b}.w) AND 2 * {a}.y + {a}.h BETWEEN 2 * {b}.y AND 2 * ({b}.y + {b}.h))"


def sql_overlap(a: str, b: str) -> str:
    return f"(greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * greatest(0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y)))"


def sql_iou(a: str, b: str) -> str:
    both = sql_overlap(a, b)
    return f"({both}::DOUBLE / ({a}.w * {a}.h + {b}.w * {b}.h - {both}))"


def sql_of_smaller(a: str, b: str) -> str:
    return f"({sql_overlap(a, b)}::DOUBLE / least({a}.w * {a}.h, {b}.w * {b}.h))"
