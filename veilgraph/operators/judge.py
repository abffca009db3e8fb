"""Severity of pattern hits by what stands around them: the label on the line, an inherited label, nearby words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgraph.functions import text as T
from veilgraph.functions import vocab as V
from veilgraph.operators.neighbors import left_neighbors, line_above, nearby, settled
from veilgraph.plans.scan import scan
from veilgraph.session import stored

CLEARLY_CLOSER = 0.5
KEY = ["photo_id", "span_index"]


def judged(spans: DataFrame) -> DataFrame:
    """(photo_id, span_index, seq, kind, evidence_text, certainty, severity, label, near_personal, near_public).

    A label right before the value decides; else one inherited from up to three aligned lines above; else the words
    within reach: one side alone decides, the clearly closer of two does, otherwise the hit is for review. Text that
    was not read well enough gives a region without its text, for review.
    """
    spans = settled(spans)
    # the scan and the words of each span are used several times: written once
    found = spans.withColumn("normal", T.normalized(F.col("text"))).withColumn("hits", scan(F.col("text")))
    found = found.withColumn("words", T.words_in(F.col("text"))).withColumn("ends", T.edge_context_word(F.col("text"))).withColumn("starts", T.edge_context_word(F.col("text"), at_end=False))
    base = stored(found.select(*KEY, "conf", "normal", "hits", "words", "ends", "starts"), "scanned")
    hits = base.select(*KEY, "conf", "normal", F.posexplode("hits").alias("seq", "h")).select(*KEY, "conf", "normal", "seq", "h.kind", "h.hit")
    default = F.create_map(*(F.lit(x) for pair in V.DEFAULT_SEVERITY.items() for x in pair))
    hits = hits.withColumn("certainty", T.certainty(F.col("conf"))).withColumn("fallback", F.coalesce(default[F.col("kind")], F.lit("review")))

    # labels of spans: at their end, at their start, and of the nearest span on the left
    ends = base.select(*KEY, "ends", "starts")
    left = left_neighbors(spans).where("rank = 1").select("photo_id", F.col("i").alias("span_index"), "j")
    of_left = left.join(ends.select("photo_id", F.col("span_index").alias("j"), F.col("ends").alias("left_ends")), ["photo_id", "j"]).drop("j")
    above = line_above(spans).select("photo_id", F.col("i").alias("span_index"), "j")
    given = ends.join(of_left, KEY, "left").select(*KEY, "left_ends", F.coalesce("starts", "left_ends").alias("given"))
    chain = given.select(*KEY, "left_ends").join(above.withColumnRenamed("j", "a0"), KEY, "left")
    up = above.select("photo_id", F.col("span_index").alias("from"), F.col("j").alias("to"))
    for k in (0, 1, 2):
        chain = chain.join(given.select("photo_id", F.col("span_index").alias(f"a{k}"), F.col("given").alias(f"g{k}")), ["photo_id", f"a{k}"], "left")
        chain = chain.join(up.select("photo_id", F.col("from").alias(f"a{k}"), F.col("to").alias(f"a{k + 1}")), ["photo_id", f"a{k}"], "left")
    labels = chain.select(*KEY, "left_ends", F.coalesce("g0", "g1", "g2").alias("inherited"))

    at = F.instr("normal", F.col("hit"))
    prefix = F.when(at > 1, T.edge_context_word(F.expr("substring(normal, 1, instr(normal, hit) - 1)")))
    hits = hits.withColumn("prefix_label", prefix).join(labels, KEY, "left").withColumn("label", F.coalesce("prefix_label", "left_ends", "inherited")).drop("prefix_label", "left_ends", "inherited")

    # words within reach, with their least distance
    words = base.select(*KEY, "hits", F.col("words").alias("w"))
    words = words.select(*KEY, F.col("w.personal").alias("personal"), F.when(F.size("hits") > 0, F.array().cast("array<string>")).otherwise(F.col("w.public")).alias("public"))
    around = nearby(spans).select("photo_id", F.col("i").alias("span_index"), "j", "distance").join(words.select("photo_id", F.col("span_index").alias("j"), "personal", "public"), ["photo_id", "j"])
    own_text = F.expr("concat(substring(normal, 1, instr(normal, hit) - 1), ' ', substring(normal, instr(normal, hit) + length(hit)))")
    own = hits.select(*KEY, "seq", T.words_in(own_text).alias("w")).select(*KEY, "seq", F.lit(0.0).alias("distance"), "w.personal", "w.public")
    met = own.unionByName(hits.select(*KEY, "seq").join(around, KEY).select(*KEY, "seq", "distance", "personal", "public"))
    nearest = lambda words: F.min(F.when(F.size(words) > 0, F.struct(F.col("distance").alias("d"), F.expr(f"array_min(transform({words}, w -> named_struct('n', -length(w), 'w', w)))").alias("w"))))
    near = met.groupBy(*KEY, "seq").agg(nearest("personal").alias("p"), nearest("public").alias("q"))

    p, q = F.col("p.d"), F.col("q.d")
    by_words = (
        F.when(p.isNull() & q.isNull(), F.col("fallback"))
        .when(p.isNull(), "info")
        .when(q.isNull(), "cover")
        .when((p < q) & (p <= CLEARLY_CLOSER * q), "cover")
        .when((q < p) & (q <= CLEARLY_CLOSER * p), "info")
        .otherwise("review")
    )
    by_label = F.when(F.col("label.side") == "personal", "cover").when(F.col("label.side") == "public", "info")
    mailbox = (F.col("kind") == "email") & T.public_mailbox(F.col("hit"))
    severity = F.when(F.col("certainty") == "region", "review").when(F.col("kind").isin(V.CONTEXT_IMMUNE), F.col("fallback")).when(mailbox, "info").otherwise(F.coalesce(by_label, by_words))
    return hits.join(near, [*KEY, "seq"], "left").select(*KEY, "seq", "kind", F.when(F.col("certainty") != "region", F.col("hit")).alias("evidence_text"), "certainty", severity.alias("severity"), F.col("label.word").alias("label"), F.col("p.w.w").alias("near_personal"), F.col("q.w.w").alias("near_public"))
