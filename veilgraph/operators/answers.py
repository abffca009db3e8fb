"""Answers of outside judges: what of them is accepted, how grades combine, how spans are numbered and sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgraph.functions import geometry as G

# ---- fixed values: spans and parts a call may name, letters of a label, gates of confidence
MOST_SPANS, MOST_PARTS, LABEL_MAX, BATCH, QUESTIONS = 400, 8, 12, 300, 3
SEVERITIES = ["cover", "review", "info"]
RANK = {"none": 0, "public": 1, "review": 2, "cover": 3}
UNREAD, PARTIAL, UNREAD_CONF, PARTIAL_CONF = 0.45, 0.75, 0.9, 0.7


def evidence(claimed: Column, span_text: Column) -> Column:
    """The claimed value where the span holds it, else the span's text: nothing made up is let through."""
    trimmed = F.trim(claimed)
    return F.when((trimmed != "") & span_text.contains(trimmed), trimmed).otherwise(span_text)


def clean_label(text: Column) -> Column:
    """One space for any white space, no colons or hyphens around; null if nothing or too much is left."""
    flat = F.regexp_replace(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), "^[:：-]+|[:：-]+$", "")
    flat = F.trim(flat)
    return F.when((flat != "") & (F.length(F.replace(flat, F.lit(" "), F.lit(""))) <= LABEL_MAX), flat)


def indices(raw: Column, limit: Column) -> Column:
    """Distinct indices in range, in order, among the first MOST_PARTS."""
    return F.array_distinct(F.filter(F.slice(raw, 1, MOST_PARTS), lambda v: (v >= 0) & (v < limit)))


def accepted(items: DataFrame, kinds: list[str]) -> DataFrame:
    """Items (photo_id, seq, idx array, kind, severity, spans: the photo's number of them) that name spans there are, a
    known kind and a known severity; the first of each (indices, kind)."""
    limit = F.least(F.col("spans"), F.lit(MOST_SPANS))
    fine = items.withColumn("idx", indices(F.col("idx"), limit)).withColumn("severity", F.lower(F.trim("severity"))).withColumn("kind", F.trim("kind"))
    fine = fine.where((F.size("idx") > 0) & F.col("kind").isin(kinds) & F.col("severity").isin(SEVERITIES))
    first = fine.groupBy("photo_id", "idx", "kind").agg(F.min(F.struct("seq", "severity")).alias("m"))
    return first.select("photo_id", "m.seq", "idx", "kind", "m.severity")


def combined(answers: DataFrame) -> DataFrame:
    """(photo_id, group, severity, confidence, certainty): a group's highest grade among the answers that pass.

    answers: photo_id, group, span_index, choice, confidence, conf (of the reading), label_only, alone. What was not
    read takes a sure `cover`, what was read in part a fairly sure answer; a label by itself is no finding. The
    confidence is that of the first span with the highest grade; the certainty that of the worst reading.
    """
    rank = F.create_map(*(F.lit(x) for pair in RANK.items() for x in pair))[F.col("choice")]
    unread = (F.col("conf") < UNREAD) & ~((F.col("choice") == "cover") & (F.col("confidence") >= UNREAD_CONF))
    unsure = (F.col("conf") < PARTIAL) & (F.col("confidence") < PARTIAL_CONF)
    passes = ~(F.col("label_only") & F.col("alone")) & (F.coalesce(rank, F.lit(0)) > 0) & ~unread & ~unsure
    best = F.max(F.when(passes, F.struct(rank.alias("r"), (-F.col("span_index")).alias("i"), "choice", "confidence"))).alias("b")
    sure = F.when(F.min("conf") >= PARTIAL, "read").when(F.min("conf") >= UNREAD, "partial").otherwise("region")
    graded = answers.groupBy("photo_id", "group").agg(best, sure.alias("certainty")).where("b is not null")
    severity = F.when(F.col("b.choice") == "public", "info").otherwise(F.col("b.choice"))
    return graded.select("photo_id", "group", severity.alias("severity"), F.round("b.confidence", 3).alias("confidence"), "certainty")


def regraded(severity: Column, choice: Column, confidence: Column) -> Column:
    """A rule's grade after a second opinion: a sure `cover` raises it, a very sure `public` or `none` lowers it."""
    asked = severity.isin("review", "info")
    return F.when(asked & (choice == "cover") & (confidence >= 0.8), "cover").when(asked & choice.isin("public", "none") & (confidence >= 0.9), "info").otherwise(severity)


def batches(spans: DataFrame) -> DataFrame:
    """(photo_id, batch, first, spans, questions): spans in calls of BATCH at most, QUESTIONS asked of each span."""
    each = spans.groupBy("photo_id", F.floor(F.col("span_index") / BATCH).alias("batch"))
    return each.agg(F.min("span_index").alias("first"), F.count(F.lit(1)).alias("spans"), (F.count(F.lit(1)) * QUESTIONS).alias("questions"))


def numbered(spans: DataFrame) -> DataFrame:
    """(photo_id, span_index, line, order): lines from the top, places in a line from the left; a line is what starts at
    one height."""
    line = F.dense_rank().over(Window.partitionBy("photo_id").orderBy("box.y")) - 1
    order = F.row_number().over(Window.partitionBy("photo_id", "box.y").orderBy("box.x", "span_index")) - 1
    return spans.select("photo_id", "span_index", line.alias("line"), order.alias("order"))


def linked(items: DataFrame) -> DataFrame:
    """(photo_id, seq, kinds): the kinds of other accepted values that an item names as its evidence.

    items: photo_id, seq, idx, kind, severity, others (span indices).
    """
    values = items.where("severity <> 'info'").select("photo_id", F.col("seq").alias("_s"), F.col("kind").alias("_k"), F.explode("idx").alias("other"))
    asked = items.select("photo_id", "seq", F.explode("others").alias("other"))
    met = asked.join(values, ["photo_id", "other"]).where("seq <> _s")
    return met.groupBy("photo_id", "seq").agg(F.sort_array(F.collect_set("_k")).alias("kinds"))


def hull(boxes: Column) -> Column:
    """The smallest box around an array of boxes."""
    edge = lambda f, g: f(F.transform(boxes, g))
    x, y = edge(F.array_min, lambda b: b["x"]), edge(F.array_min, lambda b: b["y"])
    return G.box(x, y, edge(F.array_max, lambda b: b["x"] + b["w"]) - x, edge(F.array_max, lambda b: b["y"] + b["h"]) - y)
