"""Operator 2, exact top-k search: Voronoi kNN join under the integer inner product.

A vector x gets one more component, sqrt(M^2 - |x|^2) with M the largest norm, and a query gets 0 there: then
|q - x|^2 = |q|^2 + M^2 - 2 q.x, so the largest inner product is the smallest distance and the triangle inequality
holds. Queries and data are grouped by their nearest pivot; from each group's summary (radius, smallest distances)
follows a bound on its queries' k-th distance, and only data that can lie within it are sent to that group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilgraph.llm.common import batch_of, table, written

#: Pivots: the root of the number of rows, between these; groups of queries before they are joined, at most.
PIVOTS, REDUCERS = (32, 512), 16
#: Rows and queries that meet in one task, at most; queries whose scores it holds at once.
DATA_BLOCK, QUERY_BLOCK, TILE = 8192, 16_384, 512
#: Steps in which a cell's distances are counted. Groups are joined if the joint one needs at most WIDER times the rows of the larger.
STEPS, WIDER = 64, 1.25
#: Rows of which one stands for all until it is picked.
RUN = 64
_DEALT = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int64())), ("cell", pa.int32()), ("dist", pa.float64())])
_HIT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantized(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component. Rows whose id or vector is null, or that hold a null or non-finite component, take no part."""
    finite = ~F.isnan(F.array_max("x")) & (F.array_max("x") < float("inf")) & (F.array_min("x") > float("-inf"))
    kept = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("x")).where("vec_id is not null and x is not null")
    kept = kept.where(~F.exists("x", F.isnull) & F.coalesce(finite, F.lit(True)))  # an empty vector has no largest component
    return kept.select("vec_id", F.transform("x", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists as rows of int64; shorter ones are filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    if n == 0:
        return np.zeros((0, dim), dtype=np.int64)
    offsets, flat = np.asarray(column.offsets), np.asarray(column.flatten())
    sizes = np.diff(offsets)
    if (sizes == dim).all():
        return flat.reshape(n, dim)
    out = np.zeros((n, dim), dtype=np.int64)
    out[np.repeat(np.arange(n), sizes), np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = flat
    return out


def exact_kind(q: np.ndarray, x: np.ndarray) -> type:
    """The narrowest kind in which every inner product is exact: no partial sum exceeds the product of the norms."""
    norm = lambda v: float(np.sqrt(np.square(v.astype(float)).sum(1).max(initial=0)))
    top = norm(q) * norm(x) * (1 + 1e-9)
    return np.float32 if top < 2**24 else np.float64 if top < 2**53 else np.int64


def nearest(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int):
    """(query index, data index, score) of each query's k best by (score desc, id asc); rows with the query's own id are left out.

    x stands in ascending order of x_ids. Scores are not sorted: of each run of RUN rows only the best is compared,
    and k times the first run that holds the best score gives its first row, which has the smallest id.
    """
    n, runs, asks = len(x), -(-len(x) // RUN), np.arange(len(q))
    score = np.empty((runs * RUN, len(q)), dtype=q.dtype)
    np.matmul(x, q.T, out=score[:n])
    low = -np.inf if score.dtype.kind == "f" else -np.iinfo(np.int64).max
    score[n:] = low
    first, last = np.searchsorted(x_ids, q_ids, "left"), np.searchsorted(x_ids, q_ids, "right")
    own = np.repeat(asks, last - first)
    score[np.arange(len(own)) - np.repeat(np.cumsum(last - first) - last, last - first), own] = low
    score = score.reshape(runs, RUN, len(q))
    top, cols, got = score.max(1), [], []
    for _ in range(min(k, n)):
        run = top.argmax(0)
        some = score[run, :, asks]
        at = some.argmax(1)
        got.append(some[asks, at])
        cols.append(run * RUN + at)
        score[run, at, asks] = some[asks, at] = low
        top[run, asks] = some.max(1)
    cols, got, rows = np.array(cols).T.ravel(), np.array(got).T.ravel(), np.repeat(asks, min(k, n))
    keep = got > low
    return rows[keep], cols[keep], got[keep].astype(np.int64)


def joined_groups(need: np.ndarray, group: np.ndarray, counts: np.ndarray, step: float) -> np.ndarray:
    """The group of each query cell, after groups that need nearly the same rows have been joined.

    need[i, j] is the (lowest, highest) distance from pivot j at which a row of cell j can matter to query cell i;
    counts[j, s] are the rows of cell j at distances in step s. A row is sent once to each group that needs it.
    """
    group = group.copy()

    def rows(cells: np.ndarray) -> int:
        low, high = need[cells, :, 0].min(0), need[cells, :, 1].max(0)
        at = np.arange(counts.shape[1])
        return int(counts[((at + 1) * step >= low[:, None]) & (at * step <= high[:, None])].sum())

    size = {g: rows(np.flatnonzero(group == g)) for g in set(group.tolist()) if g >= 0}
    while len(size) > 1:
        tried = []
        for a in size:
            for b in size:
                if a < b:
                    n = rows(np.flatnonzero((group == a) | (group == b)))
                    if n <= WIDER * max(size[a], size[b]):
                        tried.append((n - size[a] - size[b], a, b, n))
        if not tried:
            break
        _, a, b, n = min(tried)
        group[group == b] = a
        size[a] = n
        del size[b]
    return group


def voronoi_knn(data: DataFrame, queries: DataFrame, k: int = 5, pivots: int | None = None, reducers: int = REDUCERS, block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k data rows of highest inner product, ties to the smaller id.

    Both frames are (vec_id, v array<long>); vectors of unequal length are compared as if filled with zeros; rows
    that carry the query's own id are not candidates, whatever they hold; an id that stands in several rows can take
    several ranks; other columns are not read. Fewer candidates than k: all of them; no rows in, no rows out. Scores
    are exact while they stay within 64 bits. Hot cells are cut into blocks of `block` rows and `query_block` queries,
    so no task holds a whole cell; groups of queries whose bounds exclude little share their rows.
    """
    spark = data.sparkSession
    # rows of the driver as an Arrow table: no Python worker has to unpickle them
    small = lambda rows, **kinds: spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds)))
    sizes = data.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("top")).first()
    dim = max(sizes["dim"] or 0, queries.agg(F.max(F.size("v"))).first()[0] or 0, 1)
    top = sizes["top"] or 0.0
    pivots = pivots or min(PIVOTS[1], max(PIVOTS[0], int((sizes["n"] or 0) ** 0.5)))
    chosen = data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
    if not chosen:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    p = np.zeros((len(chosen), dim))
    for i, r in enumerate(chosen):
        p[i, : len(r["v"])] = r["v"]
    lift = np.sqrt(np.maximum(top - (p * p).sum(1), 0))

    def dealt(lifted: bool):
        def run(batches):
            for b in batches:
                v = matrix(b.column("v"), dim).astype(float)
                norm = (v * v).sum(1)
                up = np.sqrt(np.maximum(top - norm, 0)) if lifted else np.zeros(len(v))
                near = v @ p.T + np.outer(up, lift)
                cell = near.argmax(1) if len(v) else np.zeros(0, dtype=int)
                dist = np.sqrt(np.maximum(norm + up**2 + top - 2 * near[np.arange(len(v)), cell], 0))
                yield batch_of(_DEALT, b.column("vec_id"), b.column("v"), cell.astype(np.int32), dist)

        return run

    kind = "vec_id long, v array<long>, cell int, dist double"
    x, q = written(data.select("vec_id", "v").mapInArrow(dealt(True), kind), "knn-data"), written(queries.select("vec_id", "v").mapInArrow(dealt(False), kind), "knn-queries")

    # summaries: bounded by pivots * (k + 1) rows, as each cell gives the smallest distances of k + 1 ids
    # (distinct ones: rows of the query's own id are no candidates, however many there are)
    close = x.groupBy("cell", "vec_id").agg(F.min("dist").alias("dist")).select("cell", "vec_id", "dist", F.row_number().over(Window.partitionBy("cell").orderBy("dist")).alias("rn")).where(F.col("rn") <= k + 1)
    least = [(r["cell"], r["vec_id"], r["dist"]) for r in close.collect()]
    radius = {r["cell"]: (r["u"], r["n"]) for r in q.groupBy("cell").agg(F.max("dist").alias("u"), F.count(F.lit(1)).alias("n")).collect()}
    apart = np.sqrt(np.maximum(2 * top - 2 * (p @ p.T + np.outer(lift, lift)), 0))
    slack = 1e-6 * (1 + np.sqrt(top)) + 1e-5 * np.sqrt(top)  # the distances are rounded; a wider bound is still right
    group = apart[:, : max(1, min(reducers, len(p)))].argmin(1)
    if not radius:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    near, far = np.full((len(p), len(p)), np.inf), np.full((len(p), len(p)), -np.inf)
    for i, (u, _) in radius.items():
        nearer: dict[int, float] = {}
        for j, v, d in least:
            nearer[v] = min(nearer.get(v, np.inf), u + apart[i, j] + d)
        bounds = sorted(nearer.values())
        theta = bounds[k] if len(bounds) > k else np.inf
        near[i], far[i] = apart[i] - u - theta - slack, apart[i] + u + theta + slack
    group = np.where(np.isin(np.arange(len(p)), list(radius)), group, -1)
    step = float(x.agg(F.max("dist")).first()[0]) / STEPS or 1.0
    counts = np.zeros((len(p), STEPS + 1), dtype=np.int64)
    for r in x.groupBy("cell", F.floor(F.col("dist") / step).cast("int").alias("s")).count().collect():
        counts[r["cell"], min(r["s"], STEPS)] = r["count"]
    group = joined_groups(np.stack((near, far), axis=-1), group, counts, step)
    asked = {g: sum(radius[i][1] for i in radius if group[i] == g) for g in set(group.tolist()) if g >= 0}
    need = {(j, g): (float(near[group == g, j].min()), float(far[group == g, j].max())) for g in asked for j in range(len(p))}
    # bounded by pivots * groups rows
    wanted = F.broadcast(small([(j, g, lo, hi) for (j, g), (lo, hi) in need.items()], cell=pa.int32(), g=pa.int32(), lo=pa.float64(), hi=pa.float64()))
    sent = x.join(wanted, "cell").where("dist >= lo and dist <= hi")
    filled = {r["g"]: r["count"] for r in sent.groupBy("g").count().collect()}
    cuts = F.broadcast(small([(g, -(-filled.get(g, 1) // block), -(-n // query_block)) for g, n in asked.items()], g=pa.int32(), nb=pa.int64(), nq=pa.int64()))
    homes = F.broadcast(small([(j, int(g)) for j, g in enumerate(group) if g >= 0], cell=pa.int32(), g=pa.int32()))
    left = sent.join(cuts, "g").select("vec_id", "v", "g", F.pmod(F.xxhash64("vec_id"), F.col("nb")).alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nq") - 1)).alias("qb"))
    right = q.join(homes, "cell").join(cuts, "g").select("vec_id", "v", "g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("b"), F.pmod(F.xxhash64("vec_id", F.lit(7)), F.col("nq")).alias("qb"))

    def solve(some: pa.Table, asks: pa.Table) -> pa.Table:
        ids, qids = np.asarray(some.column("vec_id")), np.asarray(asks.column("vec_id"))
        if len(ids) == 0 or len(qids) == 0:
            return _HIT.empty_table()
        order = np.argsort(ids, kind="stable")
        x, q, ids, out = matrix(some.column("v"), dim)[order], matrix(asks.column("v"), dim), ids[order], []
        kind = exact_kind(q, x)
        x, q = x.astype(kind), q.astype(kind)
        for at in range(0, len(q), TILE):
            r, c, s = nearest(q[at : at + TILE], qids[at : at + TILE], x, ids, k)
            out.append((qids[r + at], ids[c], s))
        return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], schema=_HIT)

    hits = left.groupBy("g", "b", "qb").cogroup(right.groupBy("g", "b", "qb")).applyInArrow(solve, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = written(quantized(table(spark, sf_dir, "embeddings")), "knn-vectors")
    return voronoi_knn(data, data.where("vec_id % 50 = 0"))


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, x.vec_id,
         CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(x.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
