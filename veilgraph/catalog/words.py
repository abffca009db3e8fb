"""Queries on text functions: values and words made from `events`, over all its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.functions import text as T
from veilgraph.functions import vocab as V
from veilgraph.queries import query
from veilgraph.sources.readers import table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _pick(values, n):
    return F.get(T.lit_array(values), (n % len(values)).cast("int"))


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _sql_pick(values, n: str) -> str:
    return f"{_sql_list(values)}[CAST(({n}) % {len(values)} AS INTEGER) + 1]"


_DIGITS = "lpad(CAST(event_id * 987654321 % 10000000000000 AS VARCHAR), 13, '0')"
_RRN = f"substr({_DIGITS}, 1, 2) || lpad(CAST(event_id % 14 AS VARCHAR), 2, '0') || lpad(CAST(event_id % 33 AS VARCHAR), 2, '0') || CASE WHEN event_id % 3 = 0 THEN '' ELSE '-' END || substr({_DIGITS}, 7, 7)"


@query(f"""WITH t AS (SELECT event_id, {_RRN} AS t FROM events), d AS (SELECT event_id, t, list_transform(string_split(replace(t, '-', ''), ''), lambda c: CAST(c AS INTEGER)) AS n FROM t),
v AS (SELECT event_id, contains(t, '-') AS sep, n[3] * 10 + n[4] BETWEEN 1 AND 12 AND n[5] * 10 + n[6] BETWEEN 1 AND 31 AS form, (11 - (n[1]*2 + n[2]*3 + n[3]*4 + n[4]*5 + n[5]*6 + n[6]*7 + n[7]*8 + n[8]*9 + n[9]*2 + n[10]*3 + n[11]*4 + n[12]*5) % 11) % 10 = n[13] AS sum FROM d)
SELECT event_id, form, form AND sum AS valid, sep AND form AND NOT sum AS unverified FROM v""")
def resident_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    digits = F.lpad((e * 987654321 % 10000000000000).cast("string"), 13, "0")
    two = lambda n: F.lpad((e % n).cast("string"), 2, "0")
    text = F.concat(F.substring(digits, 1, 2), two(14), two(33), F.when(e % 3 == 0, "").otherwise("-"), F.substring(digits, 7, 7))
    return _events(spark, sf_dir).select("event_id", T.resident_number_form(text).alias("form"), T.valid_resident_number(text).alias("valid"), T.unverified_resident_number(text).alias("unverified"))


@query("""WITH d AS (SELECT event_id, list_transform(string_split(lpad(CAST(event_id * 7654321 % 10000000000 AS VARCHAR), 10, '0'), ''), lambda c: CAST(c AS INTEGER)) AS n FROM events)
SELECT event_id, (10 - (n[1] + n[2]*3 + n[3]*7 + n[4] + n[5]*3 + n[6]*7 + n[7] + n[8]*3 + n[9]*5 + n[9]*5 // 10) % 10) % 10 = n[10] AS valid FROM d""")
def business_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.regexp_replace(F.lpad((F.col("event_id") * 7654321 % 10000000000).cast("string"), 10, "0"), r"^(\d{3})(\d{2})(\d{5})$", "$1-$2-$3")
    return _events(spark, sf_dir).select("event_id", T.valid_business_number(text).alias("valid"))


_BOXES = [*V.PUBLIC_MAILBOXES[:6], "hong", "minsu.kim", "a1"]


@query(f"SELECT event_id, NOT event_id % {len(_BOXES)} >= 6 AS public FROM events")
def public_mailboxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    mail = F.concat(F.when(e % 2 == 0, F.upper(_pick(_BOXES, e))).otherwise(_pick(_BOXES, e)), F.lit("@x.co"))
    return _events(spark, sf_dir).select("event_id", T.public_mailbox(mail).alias("public"))


@query("SELECT event_id, CASE WHEN c >= 0.75 THEN 'read' WHEN c >= 0.45 THEN 'partial' ELSE 'region' END AS certainty FROM (SELECT event_id, (event_id * 31 % 100)::DOUBLE / 100 AS c FROM events)")
def certainties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", T.certainty((F.col("event_id") * 31 % 100) / 100.0).alias("certainty"))


@query("""SELECT doc_id, md5(text || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '(x)' END) AS kept FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '\\s*[(（][㐀-䶿一-鿿\\s]*[)）]')""")
def texts_without_hanja(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Han in brackets goes, empty brackets go, other brackets stay."""
    tail = F.when(F.col("doc_id") % 3 == 0, " (金民秀)").otherwise("（ ）(x)")
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull() & ~F.col("text").rlike(r"(?U)\s*[(（][㐀-䶿一-鿿\s]*[)）]"))
    return docs.select("doc_id", F.md5(T.without_hanja(F.concat("text", tail)).cast("binary")).alias("kept"))


@query("SELECT user_id, event_type AS label, min(event_id) AS first FROM events GROUP BY 1, 2")
def first_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that differ only in spaces and marks are one; the first stands for all."""
    e = F.col("event_id")
    messy = F.concat(F.when(e % 2 == 0, " ").otherwise("-"), F.col("event_type"), F.when(e % 3 == 0, "·").otherwise(""))
    return T.first_of_each(_events(spark, sf_dir).select("user_id", e.alias("first"), messy.alias("text")), ["user_id"], "text", "first").select("user_id", F.col("key").alias("label"), "first")


_WORDS_P, _WORDS_Q = list(V.CONTEXT_PERSONAL), list(V.CONTEXT_PUBLIC)
_KEY = "regexp_replace({}, '[\\s\\-_·•‧''\"`~|]', '', 'g')"


@query(f"""WITH t AS (SELECT event_id, {_KEY.format(_sql_pick(_WORDS_P, 'event_id'))} || 'x' || {_KEY.format(_sql_pick(_WORDS_Q, 'event_id // 7'))} AS b FROM events),
q AS (SELECT event_id, b, list_filter({_sql_list(_WORDS_Q)}, lambda w: contains(b, {_KEY.format('w')})) AS q FROM t),
r AS (SELECT event_id, q, list_reduce(list_prepend(b, list_transform(list_sort(list_transform(q, lambda w: struct_pack(n := -length(w), w := w))), lambda z: z.w)), lambda a, w: replace(a, {_KEY.format('w')}, '|')) AS rest FROM q)
SELECT event_id, array_to_string(q, ',') AS public, array_to_string(list_filter({_sql_list(_WORDS_P)}, lambda w: contains(rest, {_KEY.format('w')})), ',') AS personal FROM r""")
def context_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context words of a text; a public word hides the personal ones inside it."""
    e = F.col("event_id")
    text = F.concat(T.label_key(_pick(_WORDS_P, e)), F.lit("x"), T.label_key(_pick(_WORDS_Q, F.floor(e / 7))))
    found = _events(spark, sf_dir).select("event_id", T.words_in(text).alias("w"))
    return found.select("event_id", F.array_join("w.public", ",").alias("public"), F.array_join("w.personal", ",").alias("personal"))


def _sql_edges(test: str) -> str:
    sides = ", ".join(f"struct_pack(n := {len(''.join(w.split()))}, word := '{w}', side := '{side}')" for side, words in (("personal", _WORDS_P), ("public", _WORDS_Q)) for w in words)
    return f"list_sort(list_filter([{sides}], lambda z: {test}), 'DESC')[1]"


@query(f"""WITH t AS (SELECT event_id, {_KEY.format(_sql_pick(_WORDS_P, 'event_id'))} || 'x' || {_KEY.format(_sql_pick(_WORDS_Q, 'event_id // 7'))} AS b FROM events),
e AS (SELECT event_id, {_sql_edges(f"suffix(b, {_KEY.format('z.word')})")} AS hi, {_sql_edges(f"starts_with(b, {_KEY.format('z.word')})")} AS lo FROM t)
SELECT event_id, hi.word AS at_end, hi.side AS end_side, lo.word AS at_start, lo.side AS start_side FROM e""")
def edge_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    text = F.concat(T.label_key(_pick(_WORDS_P, e)), F.lit("x"), T.label_key(_pick(_WORDS_Q, F.floor(e / 7))))
    out = _events(spark, sf_dir).select("event_id", T.edge_context_word(F.concat(text, F.lit(":"))).alias("hi"), T.edge_context_word(text, at_end=False).alias("lo"))
    return out.select("event_id", F.col("hi.word").alias("at_end"), F.col("hi.side").alias("end_side"), F.col("lo.word").alias("at_start"), F.col("lo.side").alias("start_side"))


_DOC_WORDS = [w for words in V.CONTEXT_DOCUMENT.values() for w in words]


def _sql_hint() -> str:
    cells = ", ".join(f"struct_pack(n := len(list_filter({_sql_list(words)}, lambda w: contains(b, w))), f := {-i}, name := '{name}')" for i, (name, words) in enumerate(V.CONTEXT_DOCUMENT.items()))
    return f"list_sort(list_filter([{cells}], lambda z: z.n >= 2), 'DESC')[1]"


@query(f"""WITH t AS (SELECT event_id, {_sql_pick(_DOC_WORDS, 'event_id')} || ' ' || {_sql_pick(_DOC_WORDS, 'event_id // 3')} || ' ' || {_sql_pick(_DOC_WORDS, 'event_id // 11')} AS b FROM events) SELECT event_id, {_sql_hint()}.name AS hint FROM t""")
def document_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    text = F.concat_ws(" ", _pick(_DOC_WORDS, e), _pick(_DOC_WORDS, F.floor(e / 3)), _pick(_DOC_WORDS, F.floor(e / 11)))
    return _events(spark, sf_dir).select("event_id", T.document_hint(text).alias("hint"))


_SYL = [*V.SURNAMES[:5], *V.GIVEN_SYLLABLES[:9].replace("-", ""), "역", "구"]


@query(f"""WITH t AS (SELECT event_id, {_sql_pick(_SYL, 'event_id')} || {_sql_pick(_SYL, 'event_id // 5')} || CASE WHEN event_id % 4 = 0 THEN '' ELSE {_sql_pick(_SYL, 'event_id // 11')} END AS t FROM events)
SELECT event_id, regexp_full_match(t, '[가-힣]{{2,4}}') AND t NOT IN ({', '.join(f"'{w}'" for w in V.NAME_STOPWORDS)}) AND (contains('{V.SURNAMES}', substr(t, 1, 1)) OR substr(t, 1, 2) IN ({', '.join(f"'{w}'" for w in V.COMPOUND_SURNAMES)})) AS name_like FROM t""")
def name_like_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    token = F.concat(_pick(_SYL, e), _pick(_SYL, F.floor(e / 5)), F.when(e % 4 == 0, "").otherwise(_pick(_SYL, F.floor(e / 11))))
    return _events(spark, sf_dir).select("event_id", T.name_like(token).alias("name_like"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 1 THEN FALSE WHEN 2 THEN FALSE ELSE TRUE END AS road FROM events""")
def road_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A road's name holds Hangul and is no particle form."""
    e = F.col("event_id")
    text = F.concat(F.when(e % 4 == 0, "테헤란로 ").when(e % 4 == 1, "앞으로 ").when(e % 4 == 2, "ab로 ").otherwise("솔밭길 "), (e % 90 + 1).cast("string"))
    return _events(spark, sf_dir).select("event_id", T.road_name(text).alias("road"))


