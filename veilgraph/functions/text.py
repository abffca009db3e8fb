"""Text functions as Column expressions: everything stays in the JVM.

Python's \\d and \\s are Unicode; Java's are so only behind (?U), which every pattern here carries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilgraph.functions import vocab as V

HANGUL = "가-힣"


def lit_array(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(0))


def between(text: Column, pattern: str) -> Column:
    return F.split(text, "(?U)" + pattern, -1)


def offsets(text: Column, pattern: str) -> Column:
    """array<struct<hit,start,stop>> of all matches: what stands between matches gives each one's exact place."""
    both = let(text, lambda t: F.zip_with(between(t, pattern), matches(t, pattern), lambda p, m: F.struct(p.alias("p"), m.alias("m"))))
    kind = "struct<at:int,hits:array<struct<hit:string,start:int,stop:int>>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().alias("hits")).cast(kind)

    def step(state, x):
        start = state["at"] + F.length(x["p"])
        stop = start + F.length(x["m"])
        hit = F.array(F.struct(x["m"].alias("hit"), start.alias("start"), stop.alias("stop")))
        return F.when(x["m"].isNull(), state).otherwise(F.struct(stop.alias("at"), F.concat(state["hits"], hit).alias("hits")).cast(kind))

    return F.aggregate(both, zero, step, lambda s: s["hits"])


def replaced(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """regexp_replace whose replacement is an expression of the match."""
    def joined(t):
        parts = F.zip_with(between(t, pattern), F.transform(matches(t, pattern), lambda m: change(m)), lambda p, m: F.concat(p, F.coalesce(m, F.lit(""))))
        return F.when(t.rlike("(?U)" + pattern), F.array_join(parts, "")).otherwise(t)

    return let(text, joined)


def normalized(text: Column) -> Column:
    """Undoes what optical reading does to text: scattered Hangul syllables are joined, marks between Hangul removed,
    and letters read in digit runs turned back into digits."""
    one = lambda t: t.rlike(f"^[{HANGUL}]$")
    short = lambda t: t.rlike(f"^[{HANGUL}]{{1,2}}$")
    kind = "struct<done:array<string>,open:string>"
    make = lambda done, held: F.struct(done.alias("done"), held.alias("open")).cast(kind)

    def step(s, t):
        done, held = s["done"], s["open"]
        return (
            F.when(one(t), make(done, F.concat(held, t)))
            .when((held != "") & short(t), make(F.concat(done, F.array(F.concat(held, t))), F.lit("")))
            .when(held != "", make(F.concat(done, F.array(held, t)), F.lit("")))
            .otherwise(make(F.concat(done, F.array(t)), held))
        )

    tokens = F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")
    last = lambda s: F.array_join(F.when(s["open"] != "", F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]), " ")
    glued = F.aggregate(tokens, F.struct(F.array().alias("done"), F.lit("").alias("open")).cast(kind), step, last)
    glued = F.when(text.rlike(f"[{HANGUL}]"), glued).otherwise(F.array_join(tokens, " "))
    glued = F.regexp_replace(glued, rf"(?<=[{HANGUL}])[-_·•‧'\"`~|](?=[{HANGUL}])", "")
    digits = lambda m: F.translate(m, "OolI|", "00111")
    inner = replaced(glued, r"\d[\dOolI|\-\s]{4,}\d", digits)
    lead = r"(?<![A-Za-z])[Oo](?=[\dOolI|][\dOolI|\-\s]{4,}\d)[\dOolI|\-\s]*\d"
    return replaced(inner, lead, lambda m: F.when(F.length(only_digits(m)) >= 6, digits(m)).otherwise(m))


def only_digits(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\D", "")


def label_key(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)[\s\-_·•‧'\"`~|]", "")


def compact(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def without_hanja(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s*[(（][㐀-䶿一-鿿\s]*[)）]", "")


def _weighted(digits: Column, weights: list[int]) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights):
        total = total + F.substring(digits, i + 1, 1).cast("int") * w
    return total


def _digit(digits: Column, i: int) -> Column:
    return F.substring(digits, i + 1, 1).cast("int")


def resident_number_form(text: Column) -> Column:
    d = only_digits(text)
    month, day = F.substring(d, 3, 2).cast("int"), F.substring(d, 5, 2).cast("int")
    return F.when(F.length(d) == 13, month.between(1, 12) & day.between(1, 31)).otherwise(False)


def valid_resident_number(text: Column) -> Column:
    d = only_digits(text)
    check = (F.lit(11) - _weighted(d, [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5]) % 11) % 10
    return F.when(resident_number_form(text), check == _digit(d, 12)).otherwise(False)


def unverified_resident_number(text: Column) -> Column:
    return text.rlike(r"(?U)\d{6}[-\s]\d") & resident_number_form(text) & ~valid_resident_number(text)


def valid_business_number(text: Column) -> Column:
    d = only_digits(text)
    total = _weighted(d, [1, 3, 7, 1, 3, 7, 1, 3, 5]) + F.floor(_digit(d, 8) * 5 / 10)
    return F.when(F.length(d) == 10, (F.lit(10) - total % 10) % 10 == _digit(d, 9)).otherwise(False)


def valid_card_number(text: Column) -> Column:
    """Luhn, on twelve digits or more."""
    d = only_digits(text)
    return F.when(F.length(d) >= 12, F.call_function("luhn_check", d)).otherwise(False)


def road_name(text: Column) -> Column:
    name = F.element_at(F.split(text, r"(?U)(?:대?로|길)\s?\d", 2), 1)
    return ~name.endswith("으") & name.rlike(f"[{HANGUL}]")


VALIDATORS: dict[str, Callable[[Column], Column]] = {"rrn": valid_resident_number, "rrn_unverified": unverified_resident_number, "card": valid_card_number, "brn": valid_business_number, "address_road": road_name}


def name_like(token: Column) -> Column:
    first, two = F.substring(token, 1, 1), F.substring(token, 1, 2)
    surname = F.lit(V.SURNAMES).contains(first) | two.isin(V.COMPOUND_SURNAMES)
    return F.coalesce(token.rlike(f"^[{HANGUL}]{{2,4}}$") & ~token.isin(V.NAME_STOPWORDS) & surname, F.lit(False))


def name_candidate(token: Column) -> Column:
    """A three-syllable name (four with a compound surname) made of common given-name syllables."""
    four = F.length(token) == 4
    surname = F.when(four, F.substring(token, 1, 2).isin(V.COMPOUND_SURNAMES)).otherwise(F.lit(V.SURNAMES).contains(F.substring(token, 1, 1)))
    given = F.when(four, F.substring(token, 3, 2)).otherwise(F.substring(token, 2, 2))
    place = token.rlike("(?:" + "|".join(V.NOT_NAME_SUFFIX) + ")$")
    return F.coalesce(token.rlike(f"^[{HANGUL}]{{3,4}}$") & ~token.isin(V.NAME_STOPWORDS) & ~place & surname & given.rlike(f"^[{V.GIVEN_SYLLABLES}]{{2}}$"), F.lit(False))


def document_hint(text: Column) -> Column:
    """The document type with most of its words in the text, at least two; the first listed on ties."""

    def best(t):
        count = lambda words: F.size(F.filter(lit_array(words), lambda w: t.contains(w)))
        scores = F.array(*(F.struct(count(words).alias("n"), F.lit(-i).alias("first"), F.lit(name).alias("name")) for i, (name, words) in enumerate(V.CONTEXT_DOCUMENT.items())))
        return F.array_max(F.filter(scores, lambda s: s["n"] >= 2))["name"]

    return let(text, best)


def words_in(text: Column) -> Column:
    """struct<personal,public>: context words of a piece of text; a public word hides the personal ones inside it."""
    key = lambda w: label_key(w)

    def found(blob):
        public = F.filter(lit_array(V.CONTEXT_PUBLIC), lambda w: blob.contains(key(w)))
        return let(public, lambda q: F.struct(personal(blob, q).alias("personal"), q.alias("public")))

    def personal(blob, public):
        longest = F.transform(F.array_sort(F.transform(public, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda x: x["w"])
        rest = F.aggregate(longest, blob, lambda s, w: F.replace(s, key(w), F.lit("|")))
        return let(rest, lambda r: F.filter(lit_array(V.CONTEXT_PERSONAL), lambda w: r.contains(key(w))))

    return let(label_key(normalized(text)), found)


def edge_context_word(text: Column, at_end: bool = True) -> Column:
    """struct<n,word,side> of the longest context word at the text's end (or start); greatest (word, side) on ties."""
    words = F.array(*(F.struct(F.lit(len("".join(w.split()))).alias("n"), F.lit(w).alias("word"), F.lit(side).alias("side")) for side, all_words in (("personal", V.CONTEXT_PERSONAL), ("public", V.CONTEXT_PUBLIC)) for w in all_words))

    def best(flat):
        hit = (lambda x: F.endswith(flat, label_key(x["word"]))) if at_end else (lambda x: F.startswith(flat, label_key(x["word"])))
        return F.array_max(F.filter(words, hit))

    flat = label_key(normalized(text))
    return let(F.regexp_replace(flat, "[:：.#]+$", "") if at_end else flat, best)


def certainty(conf: Column) -> Column:
    return F.when(conf >= 0.75, "read").when(conf >= 0.45, "partial").otherwise("region")


def payload_class(payload: Column) -> Column:
    low = F.lower(F.trim(payload))
    return F.when(low.rlike("^https?://"), "url").when(low.startswith("begin:vcard") | low.startswith("mecard:"), "vcard").when(low.startswith("wifi:"), "wifi").when(low.startswith("tel:") | low.startswith("smsto:"), "tel").otherwise("text")


def public_mailbox(email: Column) -> Column:
    return F.lower(F.substring_index(email, "@", 1)).isin(V.PUBLIC_MAILBOXES)


def split_of(key: Column, fraction: float) -> Column:
    """`val` for the keys whose md5 prefix lies below the fraction, else `train`: stable under any order or subset."""
    return F.when(F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("double") / 4294967295.0 < fraction, "val").otherwise("train")


def with_object_particle(word: Column) -> Column:
    code = F.ascii(F.substring(word, -1, 1)) - 44032
    return F.concat(word, F.when(code.between(0, 11171) & (code % 28 > 0), "을").otherwise("를"))


def source_of(stem: Column) -> Column:
    """The data set that a file's name begins with: four parts where the first is `realcard`, else one."""
    parts = F.split(stem, "_")
    return F.when(parts[0] == "realcard", F.array_join(F.slice(parts, 1, 4), "_")).otherwise(parts[0])


def masked_name(name: Column) -> Column:
    """The second letter hidden; of two letters, all but the first."""
    return F.when(F.length(name) >= 3, F.concat(F.substring(name, 1, 1), F.lit("*"), F.substr(name, F.lit(3)))).otherwise(F.concat(F.substring(name, 1, 1), F.lit("*")))


def masked_mobile(number: Column) -> Column:
    return F.regexp_replace(number, r"^([^-]+)-[^-]+-([^-]+)$", "$1-****-$2")


def fingerprint(content: Column, *fields: Column) -> Column:
    """SHA-256 of a request's content and fields, apart by zero bytes; null fields count as empty."""
    zero = F.lit("\x00")
    whole = [content]
    for f in fields:
        whole += [zero, F.coalesce(f, F.lit(""))]
    return F.sha2(F.concat(*whole).cast("binary"), 256)


def url_path(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(F.trim(url), F.lit("PATH")), F.lit(""))


def url_query(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(F.trim(url), F.lit("QUERY")), F.lit(""))


def first_of_each(rows, by: list[str], text: str, order: str):
    """(by, key, order): of rows whose text has the same label key, the least `order`."""
    return rows.groupBy(*by, label_key(F.col(text)).alias("key")).agg(F.min(order).alias(order))
