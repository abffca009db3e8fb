"""Every query by name, over whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from importlib import import_module

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilgraph.functions import geometry as G
from veilgraph.functions import text as T
from veilgraph.functions import vocab as V
from veilgraph.operators import clusters as C
from veilgraph.operators import datasets as D
from veilgraph.operators import evaluation as E
from veilgraph.operators import neighbors as N
from veilgraph.operators import values as Va
from veilgraph.operators.judge import judged
from veilgraph.plans import scan as S
from veilgraph.session import shared_dir
from veilgraph.sources.readers import table
from veilgraph.sources.writers import reports
from veilgraph.streaming import queue as Q
from veilgraph.streaming import timing as W

#: Modules of veilgraph.catalog whose queries belong to these.
CATALOG = ["regions", "scoring", "curation", "service", "words", "lines"]
_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _load() -> None:
    for name in CATALOG:
        import_module(f"veilgraph.catalog.{name}")


def queries() -> dict:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def sql_values(rows: list[tuple], names: str) -> str:
    cell = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") AS v({names})"


# ---- pattern scan


@query()
def findings_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: every line of every document scanned for all patterns; findings and documents by kind and severity."""
    hits = S.findings(S.lines(table(spark, sf_dir, "documents")), ["doc_id", "line_no"], "line")
    return hits.groupBy("kind", "severity").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("doc_id").alias("documents"))


@query(r"""SELECT doc_id, CAST(generate_subscripts(h, 1) - 1 AS INTEGER) AS seq, unnest(h) AS hit
FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}') AS h FROM documents)""")
def scan_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = next(p for k, _, p in V.PATTERNS if k == "email")
    docs = table(spark, sf_dir, "documents").where(F.col("text").contains("@"))
    return docs.select("doc_id", F.posexplode(T.offsets(F.col("text"), pattern)).alias("seq", "h")).select("doc_id", "seq", F.col("h.hit").alias("hit"))


_SEP = r"[-\s]?"
_CARD_FORMS = "|".join(_SEP.join(f"⟦[0-9]{{{n}}}⟧" for n in form) for form in ([4, 4, 4, 4], [8, 4, 4], [4, 8, 4], [4, 4, 8], [12, 4], [8, 8], [4, 12], [16]))


@query(rf"""WITH h AS (
  SELECT doc_id, list_transform(regexp_extract_all(regexp_replace(text, '([0-9]+)', '⟦\1⟧', 'g'), '{_CARD_FORMS}'), lambda x: regexp_replace(x, '[⟦⟧]', '', 'g')) AS h FROM documents),
e AS (SELECT doc_id, CAST(generate_subscripts(h, 1) - 1 AS INTEGER) AS seq, unnest(h) AS hit FROM h),
d AS (SELECT *, list_reverse(list_transform(string_split(regexp_replace(hit, '[^0-9]', '', 'g'), ''), lambda c: CAST(c AS INTEGER))) AS d FROM e)
SELECT doc_id, seq, hit, list_sum(list_transform(d, lambda x, i: CASE WHEN i % 2 = 0 THEN (CASE WHEN x * 2 > 9 THEN x * 2 - 9 ELSE x * 2 END) ELSE x END)) % 10 = 0 AS valid FROM d""")
def scan_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = next(p for k, _, p in V.PATTERNS if k == "card")
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike(r"[0-9]{4}"))
    each = docs.select("doc_id", F.posexplode(T.offsets(F.col("text"), pattern)).alias("seq", "h"))
    return each.select("doc_id", "seq", F.col("h.hit").alias("hit"), T.valid_card_number(F.col("h.hit")).alias("valid"))


@query(r"""SELECT doc_id, count(*) AS hits, min(x) AS least FROM (
  SELECT doc_id, unnest(regexp_extract_all(text, '[0-9-]+')) AS x FROM documents)
WHERE regexp_full_match(x, '[0-9](-?[0-9]){9,13}') GROUP BY doc_id""")
def scan_long_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = next(p for k, _, p in V.PATTERNS if k == "long_digits")
    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike("[0-9]"))
    each = docs.select("doc_id", F.explode(T.matches(F.col("text"), pattern)).alias("x"))
    return each.groupBy("doc_id").agg(F.count(F.lit(1)).alias("hits"), F.min("x").alias("least"))


@query()
def scan_offsets_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits whose text differs from what stands at their offsets: counts by kind, all of them 0."""
    lines = S.lines(table(spark, sf_dir, "documents")).where(F.col("line").rlike("[0-9@]"))
    norm = lines.withColumn("n", T.normalized(F.col("line"))).select("n", F.explode(S.greedy(S.raw_hits(F.col("n")))).alias("h"))
    wrong = F.expr("substring(n, h.start + 1, h.stop - h.start) <> h.hit")
    return norm.groupBy(F.col("h.kind").alias("kind")).agg(F.count(F.lit(1)).alias("hits"), F.sum(F.when(wrong, 1).otherwise(0)).alias("wrong"))


@query(r"""SELECT conv_id, turn, hit FROM (
  SELECT conv_id, turn, regexp_extract(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}') AS hit FROM conversations) WHERE hit <> ''
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, hit) = 1""")
def first_email_of_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = next(p for k, _, p in V.PATTERNS if k == "email")
    turns = table(spark, sf_dir, "conversations").where(F.col("text").contains("@"))
    hit = turns.select("conv_id", "turn", F.regexp_extract("text", pattern, 0).alias("hit")).where("hit <> ''")
    return hit.groupBy("conv_id").agg(F.min(F.struct("turn", "hit")).alias("m")).select("conv_id", "m.turn", "m.hit")


# ---- scalar functions


@query(r"""SELECT doc_id, md5(k) AS key_md5, length(k) AS n, length(c) AS n_compact FROM (
  SELECT doc_id, regexp_replace(text, '[\s\-_·•‧''"`~|]', '', 'g') AS k, regexp_replace(text, '\s+', '', 'g') AS c FROM documents)""")
def label_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = T.label_key(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(key.cast("binary")).alias("key_md5"), F.length(key).cast("long").alias("n"), F.length(T.compact(F.col("text"))).cast("long").alias("n_compact"))


_NUMBERS = [("rrn", "900101-1234568"), ("rrn", "900101-1234567"), ("rrn", "901301-1234567"), ("rrn", "9001011234568"), ("rrn", "000000-0000000"), ("brn", "124-81-00998"), ("brn", "220-81-62517"), ("brn", "1248100998"), ("brn", "124-81-00997"), ("brn", "12-3")]


@query(f"""WITH d AS (SELECT kind, text, regexp_replace(text, '[^0-9]', '', 'g') AS d FROM {sql_values(_NUMBERS, 'kind, text')}),
n AS (SELECT *, list_transform(string_split(d, ''), lambda c: CAST(c AS INTEGER)) AS n FROM d),
r AS (SELECT kind, text, CASE
  WHEN kind = 'rrn' THEN len(n) = 13 AND n[3] * 10 + n[4] BETWEEN 1 AND 12 AND n[5] * 10 + n[6] BETWEEN 1 AND 31
    AND (11 - list_sum(list_transform([2,3,4,5,6,7,8,9,2,3,4,5], lambda w, i: w * n[i])) % 11) % 10 = n[13]
  ELSE len(n) = 10 AND (10 - (list_sum(list_transform([1,3,7,1,3,7,1,3,5], lambda w, i: w * n[i])) + (n[9] * 5) // 10) % 10) % 10 = n[10] END AS valid FROM n)
SELECT kind, text, coalesce(valid, FALSE) AS valid FROM r""")
def checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, _NUMBERS, "kind string, text string")
    return rows.select("kind", "text", F.when(F.col("kind") == "rrn", T.valid_resident_number(F.col("text"))).otherwise(T.valid_business_number(F.col("text"))).alias("valid"))


_NAMES = [(x,) for x in ("김민수", "남궁민수", "강남역", "이영희", "주소", "박철", "최신형", "홍길동", "abc", "선우정아", "", "김민")]


@query(f"""SELECT token, length(token) BETWEEN 3 AND 4 AND regexp_full_match(token, '[가-힣]+') AND NOT token IN ({', '.join(f"'{w}'" for w in V.NAME_STOPWORDS)})
  AND NOT regexp_matches(token, '({'|'.join(V.NOT_NAME_SUFFIX)})$')
  AND CASE WHEN length(token) = 4 THEN substr(token, 1, 2) IN ({', '.join(f"'{w}'" for w in V.COMPOUND_SURNAMES)}) ELSE contains('{V.SURNAMES}', substr(token, 1, 1)) END
  AND regexp_full_match(CASE WHEN length(token) = 4 THEN substr(token, 3, 2) ELSE substr(token, 2, 2) END, '[{V.GIVEN_SYLLABLES}]+') AS candidate
FROM {sql_values(_NAMES, 'token')}""")
def name_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values(spark, _NAMES, "token string").select("token", T.name_candidate(F.col("token")).alias("candidate"))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(lower(trim(url)), '^https?://') THEN 'url' ELSE 'text' END AS payload,
  regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages""")
def payload_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.payload_class(F.col("url")).alias("payload"), F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")).alias("host"))


_GPS = [("a", 37.0, 33.0, 59.0, "N", 126.0, 58.0, 41.0, "E"), ("b", 33.0, 51.0, 30.0, "S", 70.0, 40.0, 0.0, "W"), ("c", 97.0, 0.0, 0.0, "N", 10.0, 0.0, 0.0, "E"), ("d", 1.0, None, 3.0, "N", 2.0, 0.0, 0.0, "E")]
_GPS_NAMES = "photo_id, lat_d, lat_m, lat_s, lat_ref, lon_d, lon_m, lon_s, lon_ref"


@query(f"""SELECT photo_id, CASE WHEN abs(lat) <= 90 AND abs(lon) <= 180 THEN round(lat, 6) END AS lat, CASE WHEN abs(lat) <= 90 AND abs(lon) <= 180 THEN round(lon, 6) END AS lon, 'region' AS certainty FROM (
  SELECT photo_id, (CAST(lat_d AS DOUBLE) + CAST(lat_m AS DOUBLE) / 60 + CAST(lat_s AS DOUBLE) / 3600) * CASE WHEN lat_ref = 'S' THEN -1 ELSE 1 END AS lat,
         (CAST(lon_d AS DOUBLE) + CAST(lon_m AS DOUBLE) / 60 + CAST(lon_s AS DOUBLE) / 3600) * CASE WHEN lon_ref = 'W' THEN -1 ELSE 1 END AS lon FROM {sql_values(_GPS, _GPS_NAMES)})""")
def exif_gps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A damaged tag still tells that a place is there: the row stays, without coordinates."""
    rows = values(spark, _GPS, "photo_id string, lat_d double, lat_m double, lat_s double, lat_ref string, lon_d double, lon_m double, lon_s double, lon_ref string")
    part = lambda c, neg: (F.col(f"{c}_d") + F.col(f"{c}_m") / 60 + F.col(f"{c}_s") / 3600) * F.when(F.col(f"{c}_ref") == neg, -1).otherwise(1)
    both = rows.select("photo_id", part("lat", "S").alias("lat"), part("lon", "W").alias("lon"))
    fine = F.abs("lat").between(0, 90) & F.abs("lon").between(0, 180)
    return both.select("photo_id", F.when(fine, F.round("lat", 6)).alias("lat"), F.when(fine, F.round("lon", 6)).alias("lon"), F.lit("region").alias("certainty"))


# ---- spans of documents


def document_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as rows, sentences as parts."""
    lines = S.lines(table(spark, sf_dir, "documents"))
    parts = lines.select(F.col("doc_id").alias("photo_id"), F.col("line_no").alias("row"), F.posexplode(F.split("line", r"\. ", -1)).alias("part", "text"))
    return N.scene_spans(parts.where(F.trim("text") != ""))


_SPANS = r"""l AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS row, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
p AS (SELECT doc_id, row, generate_subscripts(b, 1) - 1 AS part, unnest(b) AS text FROM (SELECT doc_id, row, string_split(line, '. ') AS b FROM l WHERE trim(line) <> '')),
s AS (SELECT doc_id, row, row_number() OVER (PARTITION BY doc_id ORDER BY row, part) - 1 AS i, greatest(22 * length(text), 30) AS w, 40 + 60 * row AS y,
        40 + coalesce(sum(greatest(22 * length(text), 30) + 40) OVER (PARTITION BY doc_id, row ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x
      FROM p WHERE trim(text) <> '')"""


@query(f"WITH {_SPANS} SELECT doc_id AS photo_id, count(*) AS spans, CAST(sum(x) AS BIGINT) AS sum_x, CAST(sum(w) AS BIGINT) AS sum_w, CAST(max(y) AS BIGINT) AS max_y FROM s GROUP BY doc_id")
def spans_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_spans(spark, sf_dir).groupBy("photo_id").agg(F.count(F.lit(1)).alias("spans"), F.sum("box.x").alias("sum_x"), F.sum("box.w").alias("sum_w"), F.max("box.y").cast("long").alias("max_y"))


@query(f"""WITH {_SPANS}, n AS (SELECT a.doc_id, a.i, a.x - (b.x + b.w) AS gap, row_number() OVER (PARTITION BY a.doc_id, a.i ORDER BY a.x - (b.x + b.w), b.i) AS rank
  FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.row = b.row AND a.i <> b.i AND a.x - (b.x + b.w) BETWEEN -4 AND 120)
SELECT doc_id AS photo_id, count(*) AS neighbors, CAST(sum(gap) AS BIGINT) AS gaps, CAST(sum(i * rank) AS BIGINT) AS mix FROM n GROUP BY doc_id""")
def left_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = N.left_neighbors(document_spans(spark, sf_dir))
    return near.groupBy("photo_id").agg(F.count(F.lit(1)).alias("neighbors"), F.sum("gap").cast("long").alias("gaps"), F.sum(F.col("i") * F.col("rank")).cast("long").alias("mix"))


@query(f"""WITH {_SPANS}, n AS (SELECT a.doc_id, a.i, b.i AS j, a.y - (b.y + 30) AS gap FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.row = a.row - 1 AND abs(b.x - a.x) <= 45
  QUALIFY row_number() OVER (PARTITION BY a.doc_id, a.i ORDER BY a.y - (b.y + 30), b.i) = 1)
SELECT doc_id AS photo_id, count(*) AS found, CAST(sum(gap) AS BIGINT) AS gaps, CAST(sum(i - j) AS BIGINT) AS steps FROM n GROUP BY doc_id""")
def label_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = N.line_above(document_spans(spark, sf_dir), reach_em=2.2)
    return near.groupBy("photo_id").agg(F.count(F.lit(1)).alias("found"), F.sum("gap").cast("long").alias("gaps"), F.sum(F.col("i") - F.col("j")).cast("long").alias("steps"))


@query(f"""WITH {_SPANS}, n AS (SELECT a.doc_id, sqrt(pow(greatest(0, b.x - (a.x + a.w), a.x - (b.x + b.w)), 2) + pow(greatest(0, b.y - (a.y + 30), a.y - (b.y + 30)), 2)) AS d
  FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.row BETWEEN a.row - 3 AND a.row + 3 AND a.i <> b.i)
SELECT doc_id AS photo_id, count(*) AS pairs, round(sum(d), 3) AS distances FROM n WHERE d <= 180 GROUP BY doc_id""")
def neighbors_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = N.nearby(document_spans(spark, sf_dir))
    return near.groupBy("photo_id").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.sum("distance"), 3).alias("distances"))


@query(f"""WITH {_SPANS}, n AS (SELECT *, CASE WHEN row - lag(row) OVER (PARTITION BY doc_id ORDER BY i) > 1 THEN 1 ELSE 0 END AS new FROM s),
c AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS cluster FROM n)
SELECT doc_id AS photo_id, CAST(cluster AS BIGINT) AS cluster, count(*) AS spans, CAST(min(x) AS BIGINT) AS x, CAST(min(y) AS BIGINT) AS y, CAST(max(x + w) - min(x) AS BIGINT) AS w, CAST(max(y) + 30 - min(y) AS BIGINT) AS h FROM c GROUP BY doc_id, cluster""")
def cluster_hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = document_spans(spark, sf_dir)
    return C.cluster_summary(spans, C.clusters(spans)).select("photo_id", F.col("cluster").cast("long").alias("cluster"), "spans", *(F.col(c).cast("long").alias(c) for c in "xywh"))


# ---- judgement of spans

_SCENE = [
    ("s1", 0, 0, "받는분"), ("s1", 0, 1, "김민수"), ("s1", 1, 0, "연락처"), ("s1", 1, 1, "010-1234-5678"), ("s1", 2, 0, "문의 고객센터"), ("s1", 2, 1, "02-345-6789"),
    ("s2", 0, 0, "배송지 서울 강남구 테헤란로 12"), ("s2", 1, 0, "130동 1343호"), ("s2", 2, 0, "help@example.com"), ("s2", 3, 0, "1588-1234"),
    ("s3", 0, 0, "9001011234568"), ("s3", 1, 0, "010 9999 8888"), ("s3", 2, 0, "hong@example.com"),
]


def scene(spark: SparkSession) -> DataFrame:
    return N.scene_spans(values(spark, _SCENE, "photo_id string, row int, part int, text string"))


@query()
def context_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(scene(spark))


@query()
def exposed_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = scene(spark)
    found = judged(spans).join(C.clusters(spans), ["photo_id", "span_index"])
    return C.exposed_together(found, ["photo_id", "cluster"])


@query()
def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(judged(scene(spark)))


_PAPERS = [
    ("p1", 0, 0, "현관 비밀번호 9723*"), ("p1", 9, 0, "학생증"), ("p1", 10, 0, "학번 20231234"), ("p1", 30, 0, "운송장번호909266858784"), ("p1", 39, 0, "국민은행"), ("p1", 39, 1, "38159411957851"),
    ("p2", 0, 0, "성명 김민수"), ("p2", 1, 0, "생년월일 1990.01.02"), ("p2", 2, 0, "처방 조제 내역"), ("p2", 3, 0, "010-1234-5678"),
]


def papers(spark: SparkSession) -> DataFrame:
    return N.scene_spans(values(spark, _PAPERS, "photo_id string, row int, part int, text string"))


@query()
def value_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, secrets, ID numbers, accounts, tracking numbers, birth dates, and what a name beside a value changes."""
    return Va.findings(papers(spark))


@query()
def health_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = papers(spark)
    called = Va.names(spans)
    births = Va.birth_dates(spans, called, Va.beside_names(spans, called))
    return Va.health_documents(spans, called.unionByName(births))


# ---- geometry on boxes made from events


def _box(n: Column) -> Column:
    return G.box(n * 37 % 500, n * 53 % 400, n % 60 + 20, n % 40 + 15)


@query("""WITH b AS (SELECT event_id, event_id * 37 % 500 AS x, event_id * 53 % 400 AS y, event_id % 60 + 20 AS w, event_id % 40 + 15 AS h FROM events),
p AS (SELECT a.event_id, a.w * a.h AS aa, b.w * b.h AS bb, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS o
  FROM b a JOIN b b ON b.event_id = a.event_id + 68)
SELECT event_id, round(o / (aa + bb - o), 6) AS iou, round(o / least(aa, bb), 6) AS of_smaller FROM p""")
def box_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = table(spark, sf_dir, "events").select("event_id", _box(F.col("event_id")).alias("a"))
    other = boxes.select((F.col("event_id") - 68).alias("event_id"), F.col("a").alias("b"))
    return boxes.join(other, "event_id").select("event_id", F.round(G.iou(F.col("a"), F.col("b")), 6).alias("iou"), F.round(G.share_of_smaller(F.col("a"), F.col("b")), 6).alias("of_smaller"))


_SQL_BOXES = "event_id * 37 % 500 AS x, event_id * 53 % 400 AS y, event_id % 60 + 20 AS w, event_id % 40 + 15 AS h"


def _sql_iou(a: str, b: str) -> str:
    both = f"(greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * greatest(0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y)))"
    return f"({both}::DOUBLE / ({a}.w * {a}.h + {b}.w * {b}.h - {both}))"


@query(f"""WITH RECURSIVE b AS (SELECT user_id, event_id, round(value, 3) AS score, {_SQL_BOXES}, row_number() OVER (PARTITION BY user_id ORDER BY round(value, 3) DESC NULLS FIRST, event_id) AS rn FROM events),
r AS (SELECT user_id, 0::BIGINT AS rn, CAST([] AS STRUCT(event_id BIGINT, score DOUBLE, x BIGINT, y BIGINT, w BIGINT, h BIGINT)[]) AS kept FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT r.user_id, b.rn, CASE WHEN len(list_filter(r.kept, lambda k: {_sql_iou('k', 'b')} >= 0.4::DOUBLE)) > 0 THEN r.kept
    ELSE list_append(r.kept, struct_pack(event_id := b.event_id, score := b.score, x := b.x, y := b.y, w := b.w, h := b.h)) END FROM r JOIN b ON b.user_id = r.user_id AND b.rn = r.rn + 1)
SELECT user_id, CAST(k.event_id AS INTEGER) AS event_id, k.score AS score FROM (SELECT user_id, unnest(kept) AS k FROM r WHERE rn = (SELECT max(rn) FROM b WHERE b.user_id = r.user_id))""")
def suppressed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy suppression of each user's boxes (a user stands for a photo)."""
    rows = table(spark, sf_dir, "events").select("user_id", F.struct(F.round("value", 3).cast("double").alias("score"), F.col("event_id").cast("int").alias("seq"), F.col("event_type").alias("class"), _box(F.col("event_id")).alias("box")).alias("b"))
    return rows.groupBy("user_id").agg(F.collect_list("b").alias("bs")).select("user_id", F.explode(G.nms(F.col("bs"), 0.4)).alias("k")).select("user_id", F.col("k.seq").alias("event_id"), F.col("k.score").alias("score"))


@query("""SELECT event_id, user_id, value FROM events WHERE value IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 4""")
def top_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return table(spark, sf_dir, "events").where("value is not null").withColumn("rn", F.row_number().over(order)).where("rn <= 4").select("event_id", "user_id", "value")


# ---- evaluation


def _matching(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("image_id"), "event_id", _box(F.col("event_id")).alias("box"))
    shift = G.box(F.col("box.x") + F.col("event_id") % 11 - 5, F.col("box.y") + F.col("event_id") % 7 - 3, F.col("box.w"), F.col("box.h"))
    gt = e.where("event_id % 3 <> 1").select("image_id", F.col("event_id").cast("int").alias("gt_index"), "box", (F.col("event_id") % 10 == 0).alias("ignore"))
    pred = e.where("event_id % 3 <> 2").select("image_id", F.col("event_id").cast("int").alias("pred_index"), shift.alias("box"), ((F.col("event_id") * 7919 % 1000) / 1000.0).alias("score"))
    return gt, pred


_SWEEP = f"""WITH RECURSIVE e AS (SELECT user_id AS img, event_id, {_SQL_BOXES} FROM events),
g AS (SELECT * FROM e WHERE event_id % 3 <> 1),
q AS (SELECT img, event_id, x + event_id % 11 - 5 AS x, y + event_id % 7 - 3 AS y, w, h, (event_id * 7919 % 1000)::DOUBLE / 1000 AS score FROM e WHERE event_id % 3 <> 2),
o AS (SELECT q.img, q.event_id, list({{'gt': g.event_id, 'ignore': g.event_id % 10 = 0}} ORDER BY {_sql_iou('q', 'g')} DESC, g.event_id) AS options FROM q JOIN g ON g.img = q.img AND {_sql_iou('q', 'g')} >= 0.5::DOUBLE GROUP BY 1, 2),
p AS (SELECT q.img, q.score, o.options, row_number() OVER (PARTITION BY q.img ORDER BY q.score DESC, q.event_id) AS rn FROM q LEFT JOIN o ON o.img = q.img AND o.event_id = q.event_id),
r AS (SELECT img, 0::BIGINT AS rn, CAST([] AS BIGINT[]) AS used, NULL::DOUBLE AS score, NULL::STRUCT(gt BIGINT, "ignore" BOOLEAN) AS best FROM (SELECT DISTINCT img FROM q)
  UNION ALL SELECT img, rn, CASE WHEN best IS NULL THEN used ELSE list_append(used, best.gt) END, score, best FROM (
    SELECT r.img, p.rn, r.used, p.score, list_filter(p.options, lambda z: z."ignore" OR NOT list_contains(r.used, z.gt))[1] AS best FROM r JOIN p ON p.img = r.img AND p.rn = r.rn + 1)),
t AS (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9])::DOUBLE AS thr),
c AS (SELECT thr, count(*) FILTER (r.score >= thr AND r.best IS NOT NULL AND NOT r.best."ignore") AS tp, count(*) FILTER (r.score >= thr AND r.best IS NULL) AS fp FROM t, r WHERE r.rn > 0 GROUP BY thr),
f AS (SELECT *, (SELECT count(*) FROM g WHERE event_id % 10 <> 0) - tp AS fn FROM c),
w AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0::DOUBLE END AS p, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0::DOUBLE END AS r FROM f),
z AS (SELECT *, CASE WHEN p + r > 0 THEN p * r * 2 / (p + r) ELSE 0.0::DOUBLE END AS f1 FROM w)"""


@query(f"{_SWEEP} SELECT thr, tp, fp, fn, p, r, f1 FROM z")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sweep(*_matching(spark, sf_dir), [0.1, 0.3, 0.5, 0.7, 0.9])


@query(f"{_SWEEP} SELECT thr, p, r, f1 FROM z ORDER BY p >= 0.85 DESC, CASE WHEN p >= 0.85 THEN r ELSE f1 END DESC, thr LIMIT 1")
def threshold_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.picked_threshold(threshold_sweep(spark, sf_dir))


def _graded(spark: SparkSession, sf_dir: str, strict: bool) -> DataFrame:
    """Labels as what was expected, marks of junk in the text as what was found."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("text").contains("!!").alias("loud"), F.col("text").contains(" | ").alias("cells"))
    found = F.when(F.col("loud") | (F.lit(not strict) & F.col("cells")), "cover").when(F.col("cells"), "review").otherwise("none")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select("lang", F.when(F.col("quality") == 0, "cover").otherwise("none").alias("expect"), found.alias("got"))


def _graded_sql(strict: bool) -> str:
    return f"""SELECT d.lang, CASE WHEN l.quality = 0 THEN 'cover' ELSE 'none' END AS expect,
      CASE WHEN contains(d.text, '!!') OR ({str(not strict)} AND contains(d.text, ' | ')) THEN 'cover' WHEN contains(d.text, ' | ') THEN 'review' ELSE 'none' END AS got
    FROM labels l JOIN documents d USING (doc_id)"""


_SUMMARY = """SELECT lang, count(*) AS items, sum(CASE WHEN (expect = 'cover' AND got = 'cover') OR (expect = 'none' AND got = 'none') THEN 1 ELSE 0 END)::BIGINT AS right_items,
  sum(CASE WHEN expect = 'cover' AND got = 'none' THEN 1 ELSE 0 END)::BIGINT AS missed, sum(CASE WHEN expect = 'none' AND got = 'cover' THEN 1 ELSE 0 END)::BIGINT AS false_cover,
  sum(CASE WHEN expect = 'none' AND got = 'review' THEN 1 ELSE 0 END)::BIGINT AS false_review FROM (%s) GROUP BY lang"""


@query(f"SELECT *, round(right_items * 100.0::DOUBLE / items, 1) AS right_percent FROM ({_SUMMARY % _graded_sql(True)})")
def verdict_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.summary(_graded(spark, sf_dir, True), ["lang"])


@query(f"""SELECT lang, a.right_items AS now_right, a.items AS now_items, b.right_items AS was_right, b.items AS was_items,
  CASE WHEN a.items IS NULL THEN 'gone' WHEN b.items IS NULL THEN 'new' WHEN a.right_items * b.items < b.right_items * a.items THEN 'worse' WHEN a.items <> b.items THEN 'resized' ELSE 'same' END AS status
FROM ({_SUMMARY % _graded_sql(True)}) a FULL JOIN ({_SUMMARY % _graded_sql(False)}) b USING (lang)""")
def baseline_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, was = (E.summary(_graded(spark, sf_dir, s), ["lang"]) for s in (True, False))
    return E.baseline_difference(now, was, ["lang"])


@query("""SELECT event_type, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS percent FROM events GROUP BY event_type""")
def cause_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("all")))).select("event_type", "n", E.share(F.col("n"), F.col("all")).alias("percent"))


@query("""SELECT event_type, l[len(l) // 2 + 1] AS upper_median, l[least(len(l), CAST(floor(len(l) * 0.9::DOUBLE) AS BIGINT) + 1)] AS p90 FROM (
  SELECT event_type, list_sort(list(value) FILTER (value IS NOT NULL)) AS l FROM events GROUP BY event_type)""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    mid = E.at_index(rows, ["event_type"], "value", lambda n: F.floor(n / 2)).select("event_type", F.col("value").alias("upper_median"))
    return mid.join(E.at_index(rows, ["event_type"], "value", lambda n: F.least(n - 1, F.floor(n * 0.9))).select("event_type", F.col("value").alias("p90")), "event_type")


# ---- datasets


@query("SELECT substr(sha1(text), 1, 12) AS id, min(doc_id) AS first, count(*) AS copies FROM documents GROUP BY 1")
def content_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.first_copies(table(spark, sf_dir, "documents"), "text", "doc_id")


@query("""SELECT doc_id, CASE WHEN CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS UBIGINT)::DOUBLE / 4294967295.0 < 0.15 THEN 'val' ELSE 'train' END AS split FROM documents""")
def split_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.assigned(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


_LABEL_LINES = [("a", 1, "0 0.5 0.5 0.2 0.2"), ("a", 2, "x 0.5 0.5 0.2 0.2"), ("a", 3, "1 0.5 0.5 0.2"), ("b", 1, "9 0.5 0.5 0.2 0.2"), ("b", 2, "1 1.5 0.5 0.2 0.2"), ("b", 3, "1 0.5 0.5 0 0.2"), ("b", 4, "  "), ("b", 5, "2 0.1 0.1 0.1 nope")]


@query(f"""WITH p AS (SELECT path, line_no, regexp_split_to_array(trim(line), '\\s+') AS p FROM {sql_values(_LABEL_LINES, 'path, line_no, line')} WHERE trim(line) <> ''),
n AS (SELECT path, line_no, TRY_CAST(p[1] AS INTEGER) AS c, list_transform(p[2:], lambda v: TRY_CAST(v AS DOUBLE)) AS n FROM p),
r AS (SELECT path, line_no, CASE WHEN c IS NULL OR len(list_filter(n, lambda v: v IS NULL)) > 0 THEN 'not a number' WHEN len(n) <> 4 THEN 'number of values'
  WHEN c NOT BETWEEN 0 AND 5 THEN 'unknown class' WHEN len(list_filter(n, lambda v: v < 0 OR v > 1)) > 0 OR n[3] <= 0 OR n[4] <= 0 THEN 'out of range' END AS problem FROM n)
SELECT * FROM r WHERE problem IS NOT NULL""")
def label_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.label_problems(values(spark, _LABEL_LINES, "path string, line_no int, line string"), 6)


# ---- queue and timing


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("""SELECT event_type, count(*) AS records, list_reduce(list(value ORDER BY ts, event_id), lambda a, x: a * 0.7::DOUBLE + x * 0.3::DOUBLE) AS average
FROM events WHERE value IS NOT NULL GROUP BY event_type""")
def ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.ewma_by(_events(spark, sf_dir).withColumn("v", F.col("value").cast("double")), "event_type", ["ts", "event_id"], "value").select("event_type", "records", "average")


def _sql_guess(units: str) -> str:
    slope = "greatest(0.0::DOUBLE, (a.n * a.sxy - a.sx * a.sy) / (a.n * a.sxx - a.sx * a.sx))"
    return f"""CASE WHEN a.seen = 0 OR a.n <= 0 THEN NULL WHEN a.seen >= 3 AND a.n * a.sxx - a.sx * a.sx > greatest(1.0::DOUBLE, a.n * a.sxx) * 1e-9::DOUBLE
      THEN greatest(0.0::DOUBLE, (a.sy - {slope} * a.sx) / a.n) + {slope} * {units} WHEN a.sx / a.n > 0 THEN (a.sy / a.n) * {units} / (a.sx / a.n) ELSE a.sy / a.n END"""


_WEIGHT = f"(CASE WHEN coalesce(({_sql_guess('x.u')}) > 0 AND x.s > ({_sql_guess('x.u')}) * 5.0::DOUBLE, FALSE) THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END)"
_STEP = ", ".join(f"{c} := a.{c} * 0.9::DOUBLE + {_WEIGHT} * {v}" for c, v in (("n", "1.0::DOUBLE"), ("sx", "x.u"), ("sy", "x.s"), ("sxx", "(x.u * x.u)"), ("sxy", "(x.u * x.s)")))


@query(f"""WITH z AS (SELECT event_type, list(struct_pack(n := 0.0::DOUBLE, sx := 0.0::DOUBLE, sy := 0.0::DOUBLE, sxx := 0.0::DOUBLE, sxy := 0.0::DOUBLE, seen := 0::BIGINT, u := (event_id % 7 + 1)::DOUBLE, s := value::DOUBLE) ORDER BY ts, event_id) AS l
  FROM events WHERE value IS NOT NULL AND value >= 0 GROUP BY event_type),
m AS (SELECT event_type, list_reduce(list_prepend(struct_pack(n := 0.0::DOUBLE, sx := 0.0::DOUBLE, sy := 0.0::DOUBLE, sxx := 0.0::DOUBLE, sxy := 0.0::DOUBLE, seen := 0::BIGINT, u := 0.0::DOUBLE, s := 0.0::DOUBLE), l),
  lambda a, x: struct_pack({_STEP}, seen := a.seen + 1, u := 0.0::DOUBLE, s := 0.0::DOUBLE)) AS a FROM z)
SELECT 'judge:' || event_type AS key, CAST(a.seen AS INTEGER) AS records, round({_sql_guess('4.0::DOUBLE')}, 6) AS seconds_for_4 FROM m""")
def duration_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _events(spark, sf_dir).select(F.concat(F.lit("judge:"), F.col("event_type")).alias("key"), "ts", "event_id", (F.col("event_id") % 7 + 1).cast("double").alias("units"), F.col("value").cast("double").alias("seconds"))
    models = W.models(records, ["ts", "event_id"])
    return models.select("key", F.col("state.seen").alias("records"), F.round(W.predicted(F.col("state"), F.lit(4.0)), 6).alias("seconds_for_4"))


@query("SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS ahead FROM events")
def queue_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.places(_events(spark, sf_dir), "event_type", ["ts", "event_id"]).select("event_id", "event_type", "ahead")


@query("""WITH o AS (SELECT user_id, event_type, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 86400 SECOND THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type)),
g AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_type ROWS UNBOUNDED PRECEDING) AS ep FROM o),
f AS (SELECT *, first_value(event_type) OVER (PARTITION BY user_id, ep ORDER BY ts, event_type) AS f FROM g)
SELECT CASE WHEN opens = 1 THEN 'first' WHEN event_type = f THEN 'joined' ELSE 'conflict' END AS outcome, count(*) AS n FROM f GROUP BY 1""")
def request_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _events(spark, sf_dir).select(F.col("user_id").alias("ticket"), F.col("event_type").alias("fingerprint"), "ts")
    return Q.retries(asked, keep_s=86_400).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


_SESSIONS = """SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS events FROM (
  SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (
    SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 24 HOUR THEN 0 ELSE 1 END AS n FROM events)) GROUP BY user_id, s"""


def _started(df: DataFrame) -> DataFrame:
    return df.select("user_id", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), "events")


@query(_SESSIONS)
def peer_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _started(Q.sessions(_events(spark, sf_dir), "user_id", "ts", "24 hours"))


def drained(spark: SparkSession, sf_dir: str, build, mode: str) -> DataFrame:
    """Runs a stream over the events files to their end and gives what its last trigger has written."""
    schema = table(spark, sf_dir, "events").schema
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    out = build(source.withColumn("ts", F.col("ts").cast("timestamp")))
    save = lambda batch, n: batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/out")
    run = out.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(save).start()
    run.awaitTermination()
    return spark.read.parquet(f"{base}/out")


@query(_SESSIONS)
def stream_peer_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sessions from a stream, in complete mode so that open ones count."""
    return _started(drained(spark, sf_dir, lambda s: Q.sessions(s.withWatermark("ts", "1 hour"), "user_id", "ts", "24 hours"), "complete"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is its own request here, so none may be dropped."""
    build = lambda s: Q.deduplicated_stream(s.select(F.col("event_id").alias("ticket"), F.col("event_type").alias("fingerprint"), "ts"))
    return drained(spark, sf_dir, build, "append").groupBy(F.col("fingerprint").alias("event_type")).agg(F.count(F.lit(1)).alias("n"))
