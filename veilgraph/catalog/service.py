"""Queries on judges' answers, queues, engines and requests, over `events` and `pages`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.catalog import photos as P
from veilgraph.functions import text as T
from veilgraph.operators import answers as A
from veilgraph.queries import query
from veilgraph.sources.readers import table
from veilgraph.streaming import queue as Q
from veilgraph.streaming import timing as W


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _pick(values: list[str], n):
    return F.get(F.array(*map(F.lit, values)), (n % len(values)).cast("int"))


def _sql_pick(values: list[str], n: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][CAST(({n}) % {len(values)} AS INTEGER) + 1]"


_ITEMS = f"""it AS (SELECT user_id AS p, event_id AS seq, list_distinct(list_filter([event_id % 9 - 1, event_id % 4, event_id % 50], lambda v: v >= 0 AND v < 40)) AS idx0, [event_id % 9 - 1, event_id % 4, event_id % 50] AS raw,
  {_sql_pick([' mobile', 'email ', 'shoe', 'card'], 'event_id')} AS kind, {_sql_pick(['COVER', ' review', 'loud', 'info'], 'event_id // 3')} AS severity FROM events),
i2 AS (SELECT p, seq, CASE WHEN len(raw) = 0 THEN [] ELSE list_transform(list_filter([struct_pack(k := 1, v := raw[1]), struct_pack(k := 2, v := raw[2]), struct_pack(k := 3, v := raw[3])], lambda z: z.v >= 0 AND z.v < 40 AND (z.k = 1 OR z.v <> raw[1]) AND (z.k < 3 OR z.v <> raw[2])), lambda z: z.v) END AS idx, trim(kind) AS kind, lower(trim(severity)) AS severity FROM it),
ok AS (SELECT * FROM i2 WHERE len(idx) > 0 AND kind IN ('mobile', 'email', 'card') AND severity IN ('cover', 'review', 'info') QUALIFY row_number() OVER (PARTITION BY p, idx, kind ORDER BY seq, severity) = 1)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("photo_id"), e.alias("seq"), F.array(e % 9 - 1, e % 4, e % 50).alias("idx"), _pick([" mobile", "email ", "shoe", "card"], e).alias("kind"), _pick(["COVER", " review", "loud", "info"], F.floor(e / 3)).alias("severity"), F.lit(40).cast("long").alias("spans"))
    return A.accepted(rows, ["mobile", "email", "card"])


@query(f"WITH {_ITEMS} SELECT p AS photo_id, seq, array_to_string(idx, ',') AS idx, kind, severity FROM ok")
def accepted_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).select("photo_id", "seq", F.array_join(F.transform("idx", lambda v: v.cast("string")), ",").alias("idx"), "kind", "severity")


@query(f"""WITH {_ITEMS}, v AS (SELECT p, seq AS s, kind, unnest(idx) AS other FROM ok WHERE severity <> 'info'), a AS (SELECT p, seq, unnest([seq % 4, seq % 7]) AS other FROM ok)
SELECT a.p AS photo_id, a.seq, array_to_string(list_sort(list_distinct(list(v.kind))), ',') AS kinds FROM a JOIN v ON v.p = a.p AND v.other = a.other AND v.s <> a.seq GROUP BY 1, 2""")
def linked_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir).withColumn("others", F.array(F.col("seq") % 4, F.col("seq") % 7))
    return A.linked(items).select("photo_id", "seq", F.array_join("kinds", ",").alias("kinds"))


@query(f"""WITH a AS (SELECT user_id AS p, event_id // 4 AS grp, event_id AS i, {_sql_pick(['none', 'public', 'review', 'cover', 'odd'], 'event_id')} AS choice, (event_id * 13 % 100)::DOUBLE / 100 AS c, (event_id * 29 % 100)::DOUBLE / 100 AS conf, event_id % 7 = 0 AS label_only,
  count(*) OVER (PARTITION BY user_id, event_id // 4) = 1 AS alone FROM events),
r AS (SELECT *, CASE choice WHEN 'public' THEN 1 WHEN 'review' THEN 2 WHEN 'cover' THEN 3 ELSE 0 END AS r FROM a),
k AS (SELECT *, NOT (label_only AND alone) AND r > 0 AND NOT (conf < 0.45 AND NOT (choice = 'cover' AND c >= 0.9)) AND NOT (conf < 0.75 AND c < 0.7) AS ok, min(conf) OVER (PARTITION BY p, grp) AS worst FROM r)
SELECT p AS photo_id, grp AS "group", CASE choice WHEN 'public' THEN 'info' ELSE choice END AS severity, round(c, 3) AS confidence, CASE WHEN worst >= 0.75 THEN 'read' WHEN worst >= 0.45 THEN 'partial' ELSE 'region' END AS certainty
FROM k WHERE ok QUALIFY row_number() OVER (PARTITION BY p, grp ORDER BY r DESC, i) = 1""")
def combined_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = F.col("event_id")
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("photo_id"), F.floor(e / 4).alias("group"), e.alias("span_index"), _pick(["none", "public", "review", "cover", "odd"], e).alias("choice"), ((e * 13 % 100) / 100.0).cast("double").alias("confidence"), ((e * 29 % 100) / 100.0).cast("double").alias("conf"), (e % 7 == 0).alias("label_only"))
    return A.combined(rows.withColumn("alone", F.count(F.lit(1)).over(Window.partitionBy("photo_id", "group")) == 1))


@query(f"""WITH a AS (SELECT event_id, {_sql_pick(['cover', 'review', 'info'], 'event_id')} AS s, {_sql_pick(['cover', 'public', 'none', 'review'], 'event_id // 3')} AS ch, (event_id * 13 % 100)::DOUBLE / 100 AS c FROM events)
SELECT event_id, CASE WHEN s <> 'cover' AND ch = 'cover' AND c >= 0.8 THEN 'cover' WHEN s <> 'cover' AND ch IN ('public', 'none') AND c >= 0.9 THEN 'info' ELSE s END AS severity FROM a""")
def regraded_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return _events(spark, sf_dir).select("event_id", A.regraded(_pick(["cover", "review", "info"], e), _pick(["cover", "public", "none", "review"], F.floor(e / 3)), (e * 13 % 100) / 100.0).alias("severity"))


@query("SELECT doc_id AS photo_id, line // 300 AS batch, min(line) AS first, count(*) AS spans, count(*) * 3 AS questions FROM (SELECT doc_id, unnest(range(0, length(text) // 4)) AS line FROM documents) GROUP BY 1, 2")
def question_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.floor(F.length("text") / 4)
    spans = table(spark, sf_dir, "documents").where(n > 0).select(F.col("doc_id").alias("photo_id"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("span_index"))
    return A.batches(spans)


@query(f"WITH {P.PHOTO} SELECT p AS photo_id, i AS span_index, dense_rank() OVER (PARTITION BY p ORDER BY y) - 1 AS line, row_number() OVER (PARTITION BY p, y ORDER BY x, i) - 1 AS \"order\" FROM s")
def span_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.numbered(P.spans(spark, sf_dir)).select("photo_id", "span_index", F.col("line").cast("long").alias("line"), F.col("order").cast("long").alias("order"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 AND contains(event_type || ' ' || event_id, 'r') THEN 'r' ELSE event_type || ' ' || event_id END AS evidence, CASE WHEN length(replace(event_type || event_id, ' ', '')) <= 12 THEN event_type || ' ' || event_id END AS label FROM events""")
def evidence_and_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = F.concat_ws(" ", "event_type", F.col("event_id").cast("string"))
    claimed = F.when(F.col("event_id") % 3 == 0, " r ").otherwise("made up")
    messy = F.concat(F.lit(" :"), F.col("event_type"), F.lit(" \t\n "), F.col("event_id").cast("string"), F.lit("：- "))
    return _events(spark, sf_dir).select("event_id", A.evidence(claimed, span).alias("evidence"), A.clean_label(messy).alias("label"))


# ---- queues and engines

_POLLS = f"p AS (SELECT user_id AS engine, event_id AS tick, {_sql_pick(['ok', 'slow', 'ok', 'refused', 'slow', 'slow', 'ok'], 'event_id * 5')} AS outcome FROM events)"


@query(f"""WITH {_POLLS}, r AS (SELECT *, sum((outcome = 'ok')::INT) OVER (PARTITION BY engine ORDER BY tick) AS run FROM p)
SELECT engine, tick, sum((outcome = 'refused')::INT) OVER w = 0 AND sum((outcome = 'slow')::INT) OVER w < 2 AS up FROM r WINDOW w AS (PARTITION BY engine, run ORDER BY tick)""")
def engine_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    polls = _events(spark, sf_dir).select(F.col("user_id").alias("engine"), e.alias("at"), _pick(["ok", "slow", "ok", "refused", "slow", "slow", "ok"], e * 5).alias("outcome"))
    return Q.health(polls).select("engine", F.col("at").alias("tick"), "up")


_ENGINES = [("e1", 1, True, True, True, ["gemini"]), ("e2", 2, True, False, False, ["gemini", "claude"]), ("e3", 3, True, False, True, ["gemini"]), ("e4", 4, False, False, True, ["claude"])]


@query("""SELECT event_id AS job, CASE event_id % 4 WHEN 0 THEN 'e3' WHEN 1 THEN 'e3' WHEN 2 THEN 'e2' END AS engine FROM events""")
def job_engines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs need anything, one judge, another, or one that no engine has."""
    engines = spark.createDataFrame(_ENGINES, "engine string, place int, up boolean, busy boolean, ready boolean, judges array<string>")
    e = F.col("event_id") % 4
    body = F.when(e == 0, '{"provider": "gemini", "key": "k"}').when(e == 1, '{"provider": "gemini", "key": " "}').when(e == 2, '{"provider": "claude"}').otherwise('{"provider": "other", "key": ""}')
    return Q.candidates(_events(spark, sf_dir).select(F.col("event_id").alias("job"), Q.needs(body).alias("needs")), engines)


@query("""SELECT event_id, CASE WHEN count(*) FILTER (event_id % 17 = 0) OVER w = 0 THEN round(sum(event_id % 5 * 1.5::DOUBLE) OVER w, 6) END AS wait FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def waiting_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    jobs = _events(spark, sf_dir).select(F.col("user_id").alias("queue"), e.alias("place"), F.when(e % 17 != 0, (e % 5).cast("double") * 1.5).alias("total"))
    return Q.waiting_totals(jobs).select(F.col("place").alias("event_id"), F.round("wait", 6).alias("wait"))


@query("""WITH t AS (SELECT event_id AS ticket, event_id % 100 AS ended, event_id * 37 % 1009 AS added FROM events WHERE event_id % 3 = 0), k AS (SELECT ticket FROM t ORDER BY added DESC, ticket DESC LIMIT 200)
SELECT ticket FROM t WHERE ended < 100 - 60 OR ticket NOT IN (SELECT ticket FROM k)""")
def expired_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = _events(spark, sf_dir).where(e % 3 == 0).select(e.alias("ticket"), (e % 100).cast("double").alias("ended"), (e * 37 % 1009).alias("added"))
    return Q.expired(rows, F.lit(100.0))


@query("""SELECT ticket, tick FROM (SELECT user_id AS ticket, event_id AS tick, event_type AS s, lag(event_type) OVER w AS b, event_id - lag(event_id) OVER w AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE b IS NULL OR b <> s OR d >= 20""")
def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("ticket"), F.col("event_id").alias("at"), F.col("event_type").alias("state"))
    return Q.changes(rows, 20.0).select("ticket", F.col("at").alias("tick"))


@query("""SELECT event_id, CASE WHEN event_id % 5 > 0 THEN ((event_id % 3 + event_id % 11) // (event_id % 5) + 1) * 2.5::DOUBLE END AS eta_s FROM events""")
def gateway_etas(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return _events(spark, sf_dir).select("event_id", Q.gateway_eta(e % 3, e % 11, F.when(e % 5 > 0, e % 5), F.lit(2.5)).alias("eta_s"))


@query("""WITH k AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'judge:llm:' || event_type || ':m' || (event_id % 3) ELSE 'ocr:' || event_type END AS key FROM events)
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'judge:llm' ELSE 'ocr' END AS base, CASE WHEN event_id % 2 = 0 THEN key || '|judge:llm:' || string_split(key, ':')[3] || '|judge:llm' ELSE key || '|ocr' END AS chain FROM k""")
def stage_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    key = F.when(e % 2 == 0, F.concat(F.lit("judge:llm:"), F.col("event_type"), F.lit(":m"), (e % 3).cast("string"))).otherwise(F.concat(F.lit("ocr:"), F.col("event_type")))
    return _events(spark, sf_dir).select("event_id", W.stage_base(key).alias("base"), F.array_join(W.fallback_keys(key), "|").alias("chain"))


@query("""SELECT user_id, CASE WHEN count(*) FILTER (event_id % 13 = 0) > 0 THEN NULL ELSE round(sum(CASE event_id % 3 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN greatest(event_id % 20 - 7.5::DOUBLE, 0.0::DOUBLE) ELSE (event_id % 20)::DOUBLE END), 6) END AS left_s
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) WHERE rn <= 5 GROUP BY user_id""")
def remaining_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job's five stages: done, running since 7.5 s, or waiting; an unknown estimate makes the rest unknown."""
    from pyspark.sql import Window

    e = F.col("event_id")
    rows = _events(spark, sf_dir).withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).where("rn <= 5")
    known = F.when(e % 13 != 0, (e % 20).cast("double"))
    stage = F.struct(F.when((e % 3 == 0) & (e % 13 != 0), 1.0).alias("took"), known.alias("estimate"), F.when(e % 3 == 1, 2.5).alias("started"))
    jobs = rows.groupBy("user_id").agg(F.collect_list(stage).alias("stages"))
    return jobs.select("user_id", F.round(W.remaining(F.col("stages"), F.lit(10.0)), 6).alias("left_s"))


# ---- small scalars

@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'realcard_a_b_c' ELSE event_type END AS source, substr(event_type, 1, 1) || '*' || substr(event_type, 3) AS name, '010-****-' || lpad(CAST(event_id % 10000 AS VARCHAR), 4, '0') AS mobile FROM events""")
def masked_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    stem = F.when(e % 2 == 0, F.concat(F.lit("realcard_a_b_c_"), e.cast("string"))).otherwise(F.concat_ws("_", "event_type", e.cast("string")))
    mobile = F.concat(F.lit("010-"), F.lpad((e * 7 % 10000).cast("string"), 4, "0"), F.lit("-"), F.lpad((e % 10000).cast("string"), 4, "0"))
    return _events(spark, sf_dir).select("event_id", T.source_of(stem).alias("source"), T.masked_name(F.col("event_type")).alias("name"), T.masked_mobile(mobile).alias("mobile"))


@query("""SELECT doc_id, sha256(text || chr(0) || coalesce(lang, '') || chr(0) || coalesce(source, '')) AS fingerprint FROM documents WHERE text IS NOT NULL""")
def request_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.fingerprint(F.col("text"), F.col("lang"), F.col("source")).alias("fingerprint"))


@query(r"""SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS query FROM pages""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of a link is scanned: path and query; host and credentials are not."""
    return table(spark, sf_dir, "pages").select("page_id", T.url_path(F.col("url")).alias("path"), T.url_query(F.col("url")).alias("query"))


@query(r"""WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'http://h.example' WHEN 1 THEN 'tel:' || page_id WHEN 2 THEN 'WIFI:' || page_id WHEN 3 THEN 'plain' ELSE url END AS payload, page_id % 5 AS k FROM pages)
SELECT page_id, CASE k WHEN 1 THEN 'cover' WHEN 2 THEN 'cover' WHEN 0 THEN 'cover' ELSE 'review' END AS severity, CASE k WHEN 0 THEN 'email' ELSE '' END AS contains FROM p""")
def code_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded codes: the grade by what they are, raised by personal values in the path and query; kinds only, no values."""
    from veilgraph.plans import scan as S

    k = F.col("page_id") % 5
    payload = F.when(k == 0, F.concat(F.lit("http://h.example/"), F.col("page_id").cast("string"), F.lit("/a@b.co?x=1"))).when(k == 1, F.concat(F.lit("tel:"), F.col("page_id").cast("string"))).when(k == 2, F.concat(F.lit("WIFI:"), F.col("page_id").cast("string"))).when(k == 3, "plain").otherwise(F.col("url"))
    return S.code_findings(table(spark, sf_dir, "pages").select("page_id", payload.alias("payload")), ["page_id"], "payload").select("page_id", "severity", F.array_join("contains", ",").alias("contains"))
