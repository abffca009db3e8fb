"""Operator 1, sharding: vector bin packing that balances bytes, tokens and rows jointly.

Groups of equal texts are the items. Heavy groups are items of their own (a group beyond an eighth of a shard in any
dimension is cut into small pieces by its rows' ids, so that shards stay even); the many light groups are hashed into a fixed number
of bundles. So the driver packs a bounded number of vectors whatever the input's size, and each goes to the shard
where its dot product with the residual capacity is highest.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilgraph.llm.common import table, written

#: Light groups share this many bundles a shard; heavier groups than a bundle's fair share stand alone.
BUNDLES_PER_SHARD = 256
#: A group larger than a shard's capacity over WHOLE is cut, into pieces of a shard's capacity over PIECES.
WHOLE, PIECES = 8, 64


def place(vectors: np.ndarray, n_shards: int) -> np.ndarray:
    """The shard of each vector (rows: items, columns: dimensions), largest first, by highest dot product with what is free."""
    total = np.maximum(vectors.sum(0), 1)
    share = vectors / total
    free, shard = np.full((n_shards, vectors.shape[1]), 1.0 / n_shards), np.zeros(len(vectors), dtype=np.int32)
    for item in np.lexsort((np.arange(len(vectors)), -share.max(1))):
        v = share[item]
        gain = free @ v
        fits = (free >= v - 1e-12).all(1)
        best = int(np.argmax(np.where(fits, gain, -np.inf))) if fits.any() else int(np.argmax((free - v).min(1)))
        shard[item] = best
        free[best] -= v
    return shard


def pack_shards(docs: DataFrame, n_shards: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, tokens, text_crc32, shard, slot): every row gets a shard and a place in it, gapless from 0.

    size is the UTF-8 bytes plus 1; tokens are counted as words between spaces. A null text counts as empty, a null
    id keeps its row; repeated rows each get a slot; an empty table gives no rows; other columns are not read.
    Slots follow (bundle, doc_id), so no task numbers a whole shard.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        (F.length(body) - F.length(F.replace(body, F.lit(" "), F.lit(""))) + 1).cast("long").alias("tokens"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("_group"),
    )
    rows = written(rows, "shard-rows")
    sums = (F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    total = rows.agg(*sums).first()
    light = n_shards * BUNDLES_PER_SHARD
    # share: of the whole, in the dimension where the group is largest; at most 3 * light groups can be over 1 / light
    share = F.greatest(*(F.col(c) / F.lit(float(total[c] or 1)) for c in ("size", "tokens", "rows")))
    groups = rows.groupBy("_group").agg(*sums).withColumn("share", share)
    heavy, first, listed = groups.where(F.col("share") > 1 / light).orderBy("_group").collect(), light, []
    for g in heavy:
        pieces = max(1, min(g["rows"], math.ceil(g["share"] * n_shards * PIECES))) if g["share"] * n_shards * WHOLE > 1 else 1
        listed.append((g["_group"], first, pieces))
        first += pieces
    spark = docs.sparkSession
    named = F.broadcast(spark.createDataFrame(listed, "_group long, _first long, _pieces long"))
    piece = F.col("_first") + F.pmod(F.xxhash64("doc_id", "size"), F.col("_pieces"))
    bundled = rows.join(named, "_group", "left").withColumn("_bundle", F.coalesce(piece, F.pmod(F.col("_group"), F.lit(light)))).drop("_group", "_first", "_pieces")
    items = bundled.groupBy("_bundle").agg(*sums).orderBy("_bundle").collect()
    shard = place(np.array([[s["size"], s["tokens"], s["rows"]] for s in items], dtype=float).reshape(-1, 3), n_shards)
    used, placed = [0] * n_shards, []
    for s, k in zip(items, shard.tolist(), strict=True):
        placed.append((s["_bundle"], k, used[k]))
        used[k] += s["rows"]
    spots = F.broadcast(spark.createDataFrame(placed, "_bundle long, shard int, _base long"))
    order = Window.partitionBy("_bundle").orderBy("doc_id", "size", "text_crc32")
    ranked = bundled.withColumn("_at", F.row_number().over(order) - 1)
    return ranked.join(spots, "_bundle").select("doc_id", "size", "tokens", "text_crc32", "shard", (F.col("_base") + F.col("_at")).alias("slot"))


def op1_shard_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_shards(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")
