"""The pattern scan: text -> non-overlapping hits, as one expression (no shuffle, no Python)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgraph.functions import text as T
from veilgraph.functions import vocab as V

HIT = "struct<kind:string,hit:string,start:int,stop:int,base:double>"


def _hits_of(normal: Column, order: int, kind: str, base: float, pattern: str) -> Column:
    hits = T.offsets(normal, pattern)
    if kind in T.VALIDATORS:
        hits = F.filter(hits, lambda h: T.VALIDATORS[kind](h["hit"]))
    return F.transform(hits, lambda h: F.struct(F.lit(-base).alias("rank"), h["start"].alias("start"), F.lit(order).alias("spec"), h["stop"].alias("stop"), F.lit(kind).alias("kind"), h["hit"].alias("hit")))


def raw_hits(normal: Column, kinds: list[str] | None = None) -> Column:
    """All validated matches, each with (-base, start, spec order) in front for the greedy order."""
    chosen = [(order, spec) for order, spec in enumerate(V.PATTERNS) if kinds is None or spec[0] in kinds]
    return T.let(normal, lambda n: F.flatten(F.array(*(_hits_of(n, order, *spec) for order, spec in chosen))))


def greedy(hits: Column) -> Column:
    """Highest base first, earlier start first: a hit stays unless it overlaps one that stayed. In order of start."""
    kind = f"array<{HIT}>"

    def step(kept, h):
        clash = F.exists(kept, lambda k: (h["stop"] > k["start"]) & (h["start"] < k["stop"]))
        mine = F.array(F.struct(h["kind"].alias("kind"), h["hit"].alias("hit"), h["start"].alias("start"), h["stop"].alias("stop"), (-h["rank"]).alias("base"))).cast(kind)
        return F.when(clash, kept).otherwise(F.concat(kept, mine))

    kept = F.aggregate(F.array_sort(hits), F.array().cast(kind), step)
    return F.array_sort(kept, lambda a, b: a["start"] - b["start"])


def scan(text: Column, kinds: list[str] | None = None) -> Column:
    return greedy(raw_hits(T.normalized(text), kinds))


def lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line_no, line): the text's non-blank lines; numbers count all lines from 0."""
    each = F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line")
    return docs.select(F.col(doc_id).alias("doc_id"), each).where(F.trim("line") != "")


def findings(pieces: DataFrame, keys: list[str], text: str, kinds: list[str] | None = None) -> DataFrame:
    """One row a hit with the context-free severity. Every pattern holds a digit or an @, and reading letters as digits
    takes a digit beside them, so other pieces stay out of the scan."""
    likely = pieces.where(F.col(text).rlike(r"[\p{Nd}@]"))
    each = likely.select(*keys, F.explode(scan(F.col(text), kinds)).alias("h")).select(*keys, "h.*")
    default = F.create_map(*(F.lit(x) for pair in V.DEFAULT_SEVERITY.items() for x in pair))
    public = (F.col("kind") == "email") & T.public_mailbox(F.col("hit"))
    return each.withColumn("severity", F.when(public, "info").otherwise(F.coalesce(default[F.col("kind")], F.lit("review"))))


#: Kinds that raise a decoded code to `cover` when its text holds them.
SENSITIVE_IN_CODES = ["rrn", "card", "mobile", "email", "landline", "address_road", "address_unit"]


def code_findings(codes: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """(keys, payload_kind, severity, contains): contact, network and telephone codes are covered, links and plain text
    reviewed; personal values inside (of a link: in its path and query only) raise it and are told by kind."""
    kind = T.payload_class(F.col(payload))
    inner = F.when(kind == "url", F.concat_ws(" ", T.url_path(F.col(payload)), T.url_query(F.col(payload)))).otherwise(F.col(payload))
    found = F.when(inner.rlike(r"[\p{Nd}@]"), F.transform(scan(inner), lambda h: h["kind"])).otherwise(F.array().cast("array<string>"))
    held = F.sort_array(F.array_distinct(F.array_intersect(found, T.lit_array(SENSITIVE_IN_CODES))))
    base = F.when(kind.isin("vcard", "wifi", "tel"), "cover").otherwise("review")
    out = codes.select(*keys, kind.alias("payload_kind"), base.alias("_base"), held.alias("contains"))
    return out.select(*keys, "payload_kind", F.when(F.size("contains") > 0, "cover").otherwise(F.col("_base")).alias("severity"), "contains")
