"""Values that only their surroundings tell: labelled names, secrets, ID numbers, accounts, tracking numbers, birth
dates, health papers; and what a covered name beside a value changes. All passes read spans; none updates in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgraph.functions import text as T
from veilgraph.functions import vocab as V
from veilgraph.operators.clusters import clusters
from veilgraph.operators.judge import judged
from veilgraph.operators.neighbors import left_neighbors, line_above, nearby, settled
from veilgraph.session import stored

KEY = ["photo_id", "span_index"]
FOUND = [*KEY, "kind", "evidence_text", "certainty", "severity", "label"]
ABOVE_EM = 2.2

# ---- fixed values
BANK_NAMES = ["국민", "신한", "우리", "하나", "농협", "기업", "카카오뱅크", "카카오", "토스뱅크", "토스", "케이뱅크", "새마을", "새마을금고", "우체국", "수협", "신협", "SC제일", "씨티", "산업", "부산", "대구", "경남", "광주", "전북", "제주", "KB", "NH", "IBK"]
DATE = r"(?<!\d)(?:19|20)\d{2}\s?[.\-/년]\s?\d{1,2}\s?[.\-/월]\s?\d{1,2}(?:\s?[.일])?(?!\d)|(?<!\d)(?:\d{6}|\d{8})(?!\d)"
SECRET = r"[A-Za-z0-9!@#$%^&*()_+=.?~\-]{4,24}"
PERSONAL_VALUES = ["mobile", "landline", "email", "address_road", "address_unit", "rrn", "rrn_unverified", "card", "account", "student_id"]
PROMOTED = ["mobile", "email", "address_road"]


def label_at_end(text: Column, labels: list[str]) -> Column:
    """First listed label that the text ends with, behind marks and a trailing "no"."""
    bare = lambda c: F.regexp_replace(c, "[:：.#]+$", "")
    flat = bare(T.label_key(T.normalized(text)))
    flat = T.let(flat, lambda f: F.when(F.lower(f).endswith("no"), bare(F.substring(f, F.lit(1), F.length(f) - 2))).otherwise(f))
    return T.let(flat, lambda f: F.get(F.filter(T.lit_array(labels), lambda w: F.endswith(f, w)), F.lit(0)))


def first_inside(text: Column, labels: list[str]) -> Column:
    return F.get(F.filter(T.lit_array(labels), lambda w: F.contains(text, w)), F.lit(0))


def secret_value(text: Column) -> Column:
    clean = F.transform(T.matches(text, SECRET), lambda v: F.regexp_replace(v, r"^[.:]+|[.:]+$", ""))
    return F.get(F.filter(clean, lambda v: (F.length(v) >= 4) & v.rlike(r"(?U)\d")), F.lit(0))


def account_word(text: Column) -> Column:
    def found(n):
        bank = F.filter(F.split(F.replace(n, F.lit(":"), F.lit(" ")), r"(?U)\s+"), lambda t: F.upper(F.when(F.endswith(t, F.lit("은행")) & (F.length(t) > 2), F.substring(t, F.lit(1), F.length(t) - 2)).otherwise(t)).isin(BANK_NAMES))
        return F.coalesce(first_inside(T.label_key(n), V.ACCOUNT_WORDS), F.get(bank, F.lit(0)))

    return T.let(T.normalized(text), found)


def _beside(spans: DataFrame, value: Column, name: str, any_left: bool, above: bool) -> DataFrame:
    """(photo_id, span_index, name): `value` of the nearest left span that has one (or of the nearest only), else of the
    line above."""
    of = spans.select("photo_id", F.col("span_index").alias("j"), value.alias("v")).where("v is not null")
    left = left_neighbors(spans)
    left = left if any_left else left.where("rank = 1")
    sides = left.select("photo_id", "i", "j", F.col("rank").cast("long").alias("at"))
    if above:
        sides = sides.unionByName(line_above(spans, ABOVE_EM).select("photo_id", "i", "j", F.lit(1 << 40).cast("long").alias("at")))
    return sides.join(of, ["photo_id", "j"]).groupBy("photo_id", F.col("i").alias("span_index")).agg(F.min_by("v", "at").alias(name))


def _shown(df: DataFrame, kind: str, severity: Column) -> DataFrame:
    """Text that was not read is not told: a region for review."""
    c = T.certainty(F.col("conf"))
    unread = c == "region"
    return df.select(*KEY, F.lit(kind).alias("kind"), F.when(~unread, F.col("value")).alias("evidence_text"), c.alias("certainty"), F.when(unread, "review").otherwise(severity).alias("severity"), F.when(~unread, F.col("label")).alias("label"))


def names(spans: DataFrame) -> DataFrame:
    """A name-like word right behind a name label, or a name-like span with any name label on its left: to cover."""
    inline = "(?:" + "|".join(V.NAME_LABELS) + r")\s?[:：]?\s?([가-힣]{2,4})(?![가-힣])"
    base = spans.withColumn("normal", T.normalized(F.col("text")))
    base = base.withColumn("token", F.regexp_extract("normal", "(?U)" + inline, 1)).withColumn("match", F.regexp_extract("normal", "(?U)" + inline, 0)).withColumn("flat", T.compact(F.col("normal")))
    labels = _beside(spans, label_at_end(F.col("text"), V.NAME_LABELS), "left_label", any_left=True, above=False)
    near = T.name_like(F.col("token"))
    whole = T.name_like(F.col("flat")) & F.col("left_label").isNotNull()
    found = base.join(labels, KEY, "left").select("*", F.when(near, F.col("token")).when(whole, F.col("flat")).alias("value"), F.when(near, first_inside(F.col("match"), V.NAME_LABELS)).otherwise(F.col("left_label")).alias("label"))
    return _shown(found.where("value is not null"), "name", F.lit("cover"))


def secrets(spans: DataFrame) -> DataFrame:
    """The value right behind a secret's label, in the span, to its right, or on the line below: to cover."""
    base = spans.withColumn("normal", T.normalized(F.col("text"))).withColumn("low", F.lower("normal"))

    def of_label(w: str) -> Column:
        at = F.instr("low", F.lit(w.lower()))
        joined = F.lit(w.isascii()) & (at > 1) & F.expr(f"substring(low, instr(low, '{w.lower()}') - 1, 1)").rlike(r"^\p{L}$")
        rest = F.regexp_replace(F.expr(f"substring(normal, instr(low, '{w.lower()}') + {len(w)})"), "^[ :：=]+", "")
        value = secret_value(F.get(F.split(rest, r"(?U)\s+"), F.lit(0)))
        return F.when((at > 0) & ~joined, F.struct(F.lit(w).alias("label"), value.alias("value")))

    inside = F.get(F.filter(F.array(*map(of_label, V.SECRET_LABELS)), lambda x: x["value"].isNotNull()), F.lit(0))
    ends = T.let(F.lower(F.regexp_replace(T.label_key(T.normalized(F.col("text"))), "[:：.#=]+$", "")), lambda f: F.get(F.filter(T.lit_array(V.SECRET_LABELS), lambda w: F.endswith(f, w)), F.lit(0)))
    beside = _beside(spans, ends, "near_label", any_left=False, above=True)
    token = T.compact(F.col("normal"))
    alone = F.when(token.rlike(f"^{SECRET}$") & token.rlike(r"(?U)\d") & F.col("near_label").isNotNull(), F.struct(F.col("near_label").alias("label"), F.regexp_replace(token, r"^[.:]+|[.:]+$", "").alias("value")))
    found = base.withColumn("inside", inside).join(beside, KEY, "left").withColumn("best", F.coalesce("inside", alone)).where("best is not null").withColumn("value", F.col("best.value")).withColumn("label", F.col("best.label"))
    return _shown(found, "password", F.lit("cover"))


def id_numbers(spans: DataFrame) -> DataFrame:
    """Six to ten digits behind an ID label: to cover beside words of such a card, else for review; eight to ten
    unlabelled digits beside such words: for review."""
    words = [w for w in V.CONTEXT_DOCUMENT["student"] + V.CONTEXT_DOCUMENT["badge"] if w not in V.ID_LABELS]
    base = spans.withColumn("normal", T.normalized(F.col("text"))).withColumn("flat", T.compact(T.without_hanja(F.col("normal")))).withColumn("word", first_inside(T.label_key(F.col("normal")), words))
    around = nearby(spans).join(base.where("word is not null").select("photo_id", F.col("span_index").alias("j"), F.col("word").alias("w")), ["photo_id", "j"]).groupBy("photo_id", F.col("i").alias("span_index")).agg(F.min_by("w", "j").alias("near_word"))

    def of_label(w: str) -> Column:
        value = F.regexp_extract("flat", rf"^.*?{w}[:：]*(\d{{6,10}})(?!\d)", 1)
        return F.when(value != "", F.struct(F.lit(w).alias("label"), value.alias("value")))

    inside = F.get(F.filter(F.array(*map(of_label, V.ID_LABELS)), lambda x: x.isNotNull()), F.lit(0))
    beside = _beside(spans, label_at_end(F.col("text"), V.ID_LABELS), "near_label", any_left=False, above=True)
    doc = F.coalesce("word", "near_word")
    alone = F.when(F.col("flat").rlike(r"^\d{6,10}$") & F.col("near_label").isNotNull(), F.struct(F.col("near_label").alias("label"), F.col("flat").alias("value")))
    bare = F.when(F.col("flat").rlike(r"^[1-9]\d{7,9}$") & doc.isNotNull(), F.struct(F.lit(None).cast("string").alias("label"), F.col("flat").alias("value")))
    found = base.withColumn("inside", inside).join(beside, KEY, "left").join(around, KEY, "left").withColumn("best", F.coalesce("inside", alone, bare)).where("best is not null").withColumn("value", F.col("best.value")).withColumn("label", F.col("best.label"))
    return _shown(found, "student_id", F.when(doc.isNotNull() & F.col("label").isNotNull(), "cover").otherwise("review"))


def relabelled(spans: DataFrame, hits: DataFrame) -> DataFrame:
    """Long numbers behind a tracking label become tracking numbers (review); behind account or bank words, accounts (cover)."""
    tracking = _beside(spans, label_at_end(F.col("text"), V.TRACKING_LABELS), "left_tracking", any_left=True, above=False)
    left = left_neighbors(spans).where("rank = 1").select("photo_id", F.col("i").alias("span_index"), "j", F.lit(0).alias("at"))
    up = line_above(spans, ABOVE_EM).select("photo_id", F.col("i").alias("span_index"), "j", F.lit(1).alias("at"))
    busy = hits.select("photo_id", F.col("span_index").alias("j")).distinct().withColumn("busy", F.lit(True))
    words = spans.select("photo_id", F.col("span_index").alias("j"), account_word(F.col("text")).alias("w")).where("w is not null")
    account = left.unionByName(up).join(words, ["photo_id", "j"]).join(busy, ["photo_id", "j"], "left").where("at = 0 or busy is null").groupBy(*KEY).agg(F.min_by("w", "at").alias("near_account"))
    own = spans.select(*KEY, T.normalized(F.col("text")).alias("normal"))
    out = hits.join(own, KEY).join(tracking, KEY, "left").join(account, KEY, "left")
    prefix = F.expr("CASE WHEN instr(normal, evidence_text) > 1 THEN substring(normal, 1, instr(normal, evidence_text) - 1) END")
    long = (F.col("kind") == "long_digits") & (F.col("certainty") != "region")
    t = F.when(long, F.coalesce(label_at_end(prefix, V.TRACKING_LABELS), "left_tracking"))
    a = F.when(long, F.coalesce(account_word(prefix), "near_account"))
    out = out.withColumn("t", t).withColumn("a", a)
    named = lambda x, y, z: F.when(F.col("t").isNotNull(), x).when(F.col("a").isNotNull(), y).otherwise(z)
    return out.withColumn("kind", named(F.lit("tracking"), F.lit("account"), F.col("kind"))).withColumn("severity", named(F.lit("review"), F.lit("cover"), F.col("severity"))).withColumn("label", named(F.col("t"), F.col("a"), F.col("label"))).drop("normal", "left_tracking", "near_account", "t", "a")


def unlabelled_names(spans: DataFrame, called: DataFrame, hits: DataFrame, mode: str = "context") -> DataFrame:
    """Spans that look like a name: to cover near a personal value or a card's words; with an honorific for review;
    without any clue for review in mode `all` only. Nothing in mode `off`, and nothing from text that was not read."""
    words = V.CONTEXT_DOCUMENT["student"] + V.CONTEXT_DOCUMENT["badge"] + ["신분", "주민등록증", "면허", "명함"]
    known = [w.replace(" ", "") for w in [*V.CONTEXT_PERSONAL, *V.CONTEXT_PUBLIC, *V.NAME_LABELS, *V.TRACKING_LABELS, *V.ACCOUNT_WORDS, *V.SECRET_LABELS, *V.ID_LABELS, *(w for ws in V.CONTEXT_DOCUMENT.values() for w in ws)]]
    base = spans.join(called.select(*KEY).distinct(), KEY, "left_anti").withColumn("plain", T.without_hanja(T.normalized(F.col("text")))).withColumn("flat", T.compact(F.col("plain")))
    polite = F.regexp_extract("plain", r"(?<![가-힣])([가-힣]{3,4})(?:님|씨|께서|에게|선생님|고객님)", 1)
    base = base.withColumn("alone", T.name_candidate(F.col("flat")) & ~T.label_key(F.col("flat")).isin(known)).withColumn("polite", F.when(T.name_candidate(polite), polite))
    base = base.where("alone or polite is not null").where(T.certainty(F.col("conf")) != "region")
    near = nearby(spans).select("photo_id", F.col("i").alias("span_index"), "j")
    valued = hits.where(F.col("kind").isin(PERSONAL_VALUES) & (F.col("severity") != "info")).select("photo_id", F.col("span_index").alias("j")).distinct()
    beside_value = near.join(valued, ["photo_id", "j"]).select(*KEY).distinct().withColumn("valued", F.lit(True))
    worded = spans.select("photo_id", F.col("span_index").alias("j"), first_inside(T.label_key(F.col("text")), words).alias("w")).where("w is not null")
    beside_word = near.join(worded, ["photo_id", "j"]).groupBy(*KEY).agg(F.min_by("w", "j").alias("word"))
    out = base.join(beside_value, KEY, "left").join(beside_word, KEY, "left")
    severity = F.when(F.col("alone"), F.when(F.col("valued") | F.col("word").isNotNull(), "cover").when(F.lit(mode == "all"), "review")).otherwise("review")
    clue = F.when(~F.col("alone"), "호칭").when(F.col("valued"), "연락처·주소").otherwise(F.col("word"))
    out = out.withColumn("severity", severity).withColumn("label", clue).withColumn("value", F.when(F.col("alone"), F.col("flat")).otherwise(F.col("polite"))).where(F.col("severity").isNotNull() & F.lit(mode != "off"))
    return out.select(*KEY, F.lit("name").alias("kind"), F.col("value").alias("evidence_text"), T.certainty(F.col("conf")).alias("certainty"), "severity", "label")


def beside_names(spans: DataFrame, found_names: DataFrame) -> DataFrame:
    """(photo_id, span_index): spans within reach of another span's covered name."""
    held = found_names.where("severity = 'cover'").select("photo_id", F.col("span_index").alias("j")).distinct()
    return nearby(spans).join(held, ["photo_id", "j"]).select("photo_id", F.col("i").alias("span_index")).distinct().withColumn("named", F.lit(True))


def promoted(hits: DataFrame, beside: DataFrame) -> DataFrame:
    """Phones, mails and roads left for review without any word around them are covered beside a covered name."""
    quiet = F.col("label").isNull() & F.col("near_personal").isNull() & F.col("near_public").isNull()
    rise = F.col("kind").isin(PROMOTED) & (F.col("severity") == "review") & (F.col("certainty") != "region") & quiet & F.col("named")
    return hits.join(beside, KEY, "left").withColumn("severity", F.when(rise, "cover").otherwise(F.col("severity"))).withColumn("label", F.when(rise, "이름").otherwise(F.col("label"))).drop("named")


def birth_dates(spans: DataFrame, found_names: DataFrame, beside: DataFrame) -> DataFrame:
    base = spans.withColumn("normal", T.normalized(F.col("text"))).withColumn("own", first_inside(F.col("normal"), V.BIRTH_LABELS))
    labels = _beside(spans, label_at_end(F.col("text"), V.BIRTH_LABELS), "left_label", any_left=True, above=False)
    after = F.expr("CASE WHEN own IS NOT NULL THEN substring(normal, instr(normal, own) + length(own)) END")
    here, any_date = F.regexp_extract(after, "(?U)" + DATE, 0), F.regexp_extract("normal", "(?U)" + DATE, 0)
    itself = found_names.where("severity = 'cover'").select(*KEY).distinct().withColumn("is_name", F.lit(True))
    found = base.join(labels, KEY, "left").join(beside, KEY, "left").join(itself, KEY, "left")
    found = found.withColumn("value", F.trim(F.when(here != "", here).when((any_date != "") & F.col("left_label").isNotNull(), any_date))).withColumn("label", F.when(here != "", F.col("own")).otherwise(F.col("left_label"))).where("value is not null")
    return _shown(found, "birth_date", F.when(F.col("named") | F.col("is_name"), "cover").otherwise("review"))


def health_documents(spans: DataFrame, persons: DataFrame) -> DataFrame:
    """(photo_id, cluster, words): clusters with two health words or more and a covered name or birth date."""
    owned = clusters(spans)
    words = spans.select(*KEY, F.explode(F.filter(T.lit_array(V.HEALTH_WORDS), lambda w: F.contains(T.compact(F.col("text")), w))).alias("word"))
    several = words.join(owned, KEY).groupBy("photo_id", "cluster").agg(F.sort_array(F.collect_set("word")).alias("words")).where(F.size("words") >= 2)
    held = persons.where("severity = 'cover'").join(owned, KEY).select("photo_id", "cluster").distinct()
    return several.join(held, ["photo_id", "cluster"], "left_semi")


def findings(spans: DataFrame, unlabelled: str = "context") -> DataFrame:
    """All text passes in their order: hits, labelled names, secrets, ID numbers, unlabelled names, promotion, birth dates."""
    # what several passes read is written once: each plan stays small, and a lost executor costs little
    spans = settled(spans)
    called, numbers = stored(names(spans), "names"), stored(id_numbers(spans), "numbers")
    first = stored(relabelled(spans, stored(judged(spans), "judged")), "hits")
    seen = first.select(*KEY, "kind", "severity").unionByName(numbers.select(*KEY, "kind", "severity"))
    guessed = stored(unlabelled_names(spans, called, seen, unlabelled), "guessed")
    every_name = called.unionByName(guessed)
    beside = stored(beside_names(spans, every_name), "beside")
    passes = [promoted(first, beside), called, secrets(spans), numbers, guessed, birth_dates(spans, every_name, beside)]
    out = passes[0].select(*FOUND).withColumn("pass_no", F.lit(0))
    for n, p in enumerate(passes[1:], 1):
        out = out.unionByName(p.select(*FOUND).withColumn("pass_no", F.lit(n)))
    return out
