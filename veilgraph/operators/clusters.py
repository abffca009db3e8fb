"""Connected spans, their hulls and texts, and what is exposed together in them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from veilgraph.functions import text as T
from veilgraph.functions import vocab as V
from veilgraph.operators.neighbors import links


def _joined(i: list[int], j: list[int]) -> dict[int, int]:
    """The smallest member of each one's group, by union-find."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up.setdefault(y, y)
        return x

    for x, y in zip(i, j, strict=True):
        a, b = top(x), top(y)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: top(x) for x in list(up)}


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(photo_id, span_index, head): the smallest index reachable over edges (photo_id, i, j).

    Components never leave a page, so one shuffle by page settles them all; a task holds one page's links at a time.
    """
    kinds = nodes.select("photo_id", "span_index").schema
    kind = StructType([kinds["photo_id"], kinds["span_index"], StructField("head", kinds["span_index"].dataType)])

    def one(page: pa.Table) -> pa.Table:
        heads = _joined(page.column("i").to_pylist(), page.column("j").to_pylist())
        who = page.column("photo_id")
        return pa.table([pa.array([who[0].as_py()] * len(heads), type=who.type), pa.array(list(heads), type=page.column("i").type), pa.array(list(heads.values()), type=page.column("i").type)], names=["photo_id", "span_index", "head"])

    linked = edges.select("photo_id", "i", "j").groupBy("photo_id").applyInArrow(one, kind)
    return nodes.select("photo_id", "span_index").join(linked, ["photo_id", "span_index"], "left").select("photo_id", "span_index", F.coalesce("head", "span_index").alias("head"))


def clusters(spans: DataFrame) -> DataFrame:
    """(photo_id, span_index, cluster): clusters number from 0 by their first member."""
    heads = components(links(spans), spans)
    return heads.select("photo_id", "span_index", (F.dense_rank().over(Window.partitionBy("photo_id").orderBy("head")) - 1).alias("cluster"))


def cluster_summary(spans: DataFrame, owned: DataFrame) -> DataFrame:
    """(photo_id, cluster, spans, box, document_hint) with the hull and the text's document type."""
    each = spans.join(owned, ["photo_id", "span_index"])
    x1, y1 = F.col("box.x") + F.col("box.w"), F.col("box.y") + F.col("box.h")
    words = F.array_sort(F.collect_list(F.struct("span_index", "text")))
    out = each.groupBy("photo_id", "cluster").agg(F.count(F.lit(1)).alias("spans"), F.min("box.x").alias("x"), F.min("box.y").alias("y"), F.max(x1).alias("x1"), F.max(y1).alias("y1"), F.array_join(F.transform(words, lambda s: s["text"]), " ").alias("blob"))
    hint = T.document_hint(T.label_key(T.normalized(F.col("blob"))))
    return out.select("photo_id", "cluster", "spans", "x", "y", (F.col("x1") - F.col("x")).alias("w"), (F.col("y1") - F.col("y")).alias("h"), hint.alias("document_hint"))


def exposed_together(findings: DataFrame, group: list[str]) -> DataFrame:
    """Groups whose findings (kind, severity) hold a combination: its kinds, in the fixed order."""
    kinds = findings.where("severity <> 'info'").groupBy(*group).agg(F.collect_set("kind").alias("kinds"))
    combos = F.array(*(T.lit_array(c) for c in V.COMBINATIONS))
    met = F.flatten(F.filter(combos, lambda c: F.size(F.array_except(c, F.col("kinds"))) == 0))
    ordered = F.filter(T.lit_array(V.COMBINATION_ORDER), lambda k: F.array_contains(met, k))
    return kinds.select(*group, ordered.alias("kinds")).where(F.size("kinds") > 0)


def merged_lines(spans: DataFrame) -> DataFrame:
    """Word spans joined to lines: on one height (centres within .6 of the lower height) and no further apart than 1.2
    heights. (photo_id, line, text, conf, x, y, w, h); no space around a lone - or . ."""
    from veilgraph.functions import geometry as G
    from veilgraph.operators.neighbors import pairs

    mid = F.abs((F.col("a.y") + F.col("a.h") / 2) - (F.col("b.y") + F.col("b.h") / 2))
    side = G.gap(F.col("a.x"), F.col("a.x") + F.col("a.w"), F.col("b.x"), F.col("b.x") + F.col("b.w"))
    none = F.lit(0)
    joined = pairs(spans, none, none).where((F.col("i") < F.col("j")) & (mid <= F.least("a.h", "b.h") * 0.6) & (side <= F.greatest("a.h", "b.h", F.lit(10)) * 1.2)).select("photo_id", "i", "j")
    heads = components(joined, spans)
    x1, y1 = F.col("box.x") + F.col("box.w"), F.col("box.y") + F.col("box.h")
    words = F.transform(F.array_sort(F.collect_list(F.struct(F.col("box.x").alias("x"), "span_index", "text"))), lambda s: s["text"])
    text = F.regexp_replace(F.array_join(words, " "), r" ?(?<=^| )([-.])(?= |$) ?", "$1")
    out = spans.join(heads, ["photo_id", "span_index"]).groupBy("photo_id", "head").agg(text.alias("text"), F.avg("conf").alias("conf"), F.min("box.x").alias("x"), F.min("box.y").alias("y"), F.max(x1).alias("x1"), F.max(y1).alias("y1"), F.min(F.col("box.y") + F.col("box.h") / 2).alias("mid"))
    line = F.row_number().over(Window.partitionBy("photo_id").orderBy("mid", "head")) - 1
    return out.select("photo_id", line.alias("line"), "text", "conf", "x", "y", (F.col("x1") - F.col("x")).alias("w"), (F.col("y1") - F.col("y")).alias("h"))
