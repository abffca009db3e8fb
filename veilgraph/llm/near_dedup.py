"""Operator 4, near-duplicates: SetSketch registers, banded, estimated jointly by likelihood, verified on full sets.

Exact copies (equal word sequences) become one node first. Each node's sketch has M registers, the exponentially
spaced truncated minima of exponential variables over its shingles. Nodes that agree in a band of registers meet in a
bucket. Links are found in two steps, neither of which emits a bucket's pairs:
  1. every node is held against one bucket minimum (the one it shares most bands with); verified links are joined to
     components, which settles the buckets of ordinary and of very large groups of copies;
  2. buckets that still hold several components are dealt into tiles of bounded size; a tile compares its nodes by
     the joint likelihood estimate, verifies what is likely on full sets, and returns links between components.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.llm.common import arrow_map, batch_of, bytes_of, table, written
from veilgraph.llm.graph import components

WORDS, M, ROWS, BASE, RATE = 5, 128, 4, 1.01, 20.0
BANDS = M // ROWS
#: Nodes on either side of a tile; five standard errors of the estimate are allowed below the threshold.
TILE, ERRORS = 512, 5.0
_MIX1, _MIX2, _GOLD, _PRIME = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15, 0x100000001B3))
_SKETCH = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("seq", pa.binary()), ("regs", pa.binary())])
_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_ACTIVE = pa.schema([("tile", pa.string()), ("node", pa.int64())])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def words_of(data: bytes) -> list[bytes]:
    """A-Z lower-cased; what stands between spaces and the characters 9 to 13."""
    return data.lower().split()


def shingles(words: list[bytes], k: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words: the whole sequence as one; none: empty."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = mixed(np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words)))
    span = min(k, len(h))
    out = np.zeros(len(h) - span + 1, dtype=np.uint64)
    for i in range(span):
        out = (out + h[i : len(h) - span + 1 + i]) * _PRIME
        out ^= out >> np.uint64(29)
    return np.unique(mixed(out + np.uint64(span)))


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Registers (len(sets), M) of non-empty sets. An element's values ascend, each in a register of its own (a random
    permutation); it stops when it can no longer lower any register of its set."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    e = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    low = np.full(len(sets) * M, np.inf)
    x = np.zeros(len(e))
    seed = mixed(e ^ _GOLD)
    at, step = (seed & np.uint64(M - 1)).astype(np.int64), ((seed >> np.uint64(20)) & np.uint64(M - 1)).astype(np.int64) | 1
    for j in range(M):
        u = ((mixed(e + np.uint64((j + 1) * int(_GOLD) & (2**64 - 1))) >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53
        x -= np.log(u) / (M - j)
        np.minimum.at(low, owner * M + ((at + j * step) & (M - 1)), x)
        go = x < low.reshape(-1, M).max(1)[owner]
        if not go.any():
            break
        if not go.all():
            e, x, owner, at, step = e[go], x[go], owner[go], at[go], step[go]
    return np.clip(np.floor(1 - np.log(low / RATE) / np.log(BASE)), 0, 65535).astype("<u2").reshape(-1, M)


def likely_jaccard(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard of register rows a[i] and b[i], given both set sizes, over a grid of 1/200."""
    more, less = (a > b).sum(-1), (a < b).sum(-1)
    same = M - more - less
    u = n_a / (n_a + n_b)
    v = 1 - u
    grid = np.arange(201) / 200.0
    j = np.minimum(grid[None, :], np.minimum(u / v, v / u)[:, None])
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u[:, None] - v[:, None] * j), p(v[:, None] - u[:, None] * j)
    tiny = 1e-12
    like = more[:, None] * np.log(up + tiny) + less[:, None] * np.log(down + tiny) + same[:, None] * np.log(np.maximum(1 - up - down, tiny))
    return j[np.arange(len(j)), like.argmax(1)]


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on full sets."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _regs(column) -> np.ndarray:
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), dtype="<u2").reshape(len(data), M).astype(np.int32)


def near_duplicates(docs: DataFrame, percent: int = 85, k: int = WORDS, tile: int = TILE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row: components of the links 100 * |A & B| >= percent * |A | B|.

    A null or blank text has an empty set and no link. A row without an id gets a null component and is kept; rows
    that share an id are one node. Ties do not arise: a component is named by its smallest id. An empty table gives
    no rows. The chance to miss a link at the threshold is below 1e-9 at 85 (all bands differ) plus 3e-7 (estimate).
    """

    def sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [words_of(x) for x in bytes_of(batch.column("text"))]
        sets = [shingles(w, k) for w in words]
        some = [i for i, s in enumerate(sets) if len(s)]
        regs: list = [None] * len(sets)
        for i, row in zip(some, sketches([sets[i] for i in some]) if some else [], strict=True):
            regs[i] = row.tobytes()
        seq = [hashlib.blake2b(b" ".join(w), digest_size=16).digest() if w else None for w in words]
        return batch_of(_SKETCH, batch.column("doc_id"), [len(s) for s in sets], seq, regs)

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = written(arrow_map(picked, sketch, "doc_id long, n long, seq binary, regs binary"), "sketches")
    named = rows.where("doc_id is not null and seq is not null")
    nodes = written(named.groupBy("seq").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("regs").alias("regs")), "nodes")

    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("regs", i * 2 * ROWS + 1, F.lit(2 * ROWS)))))
    bands = nodes.select("node", band.alias("bucket"))
    buckets = bands.groupBy("bucket").agg(F.min("node").alias("pivot"), F.max("node").alias("top")).where("pivot < top")
    hits = written(bands.join(buckets, "bucket").select("bucket", "node", "pivot"), "buckets")
    full = picked.join(hits.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
    bodies = written(full.select(F.col("doc_id").alias("node"), "text"), "bodies")
    light = nodes.select("node", "n", "regs")

    # 1. one bucket minimum for each node
    votes = hits.where("node <> pivot").groupBy("node", "pivot").count()
    star = votes.groupBy("node").agg(F.max(F.struct("count", (-F.col("pivot")).alias("p"))).alias("best")).select("node", (-F.col("best.p")).alias("pivot"))
    left = star.join(bodies, "node")
    ends = left.join(bodies.select(F.col("node").alias("pivot"), F.col("text").alias("other")), "pivot").select("node", "pivot", "text", "other")

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        held: dict[int, np.ndarray] = {}
        out = []
        for node, pivot, mine, other in zip(batch.column("node").to_pylist(), batch.column("pivot").to_pylist(), bytes_of(batch.column("text")), bytes_of(batch.column("other")), strict=True):
            if pivot not in held:
                held = {pivot: shingles(words_of(other), k)}
            if linked(shingles(words_of(mine), k), held[pivot], percent):
                out.append((node, pivot))
        return batch_of(_LINK, [x[0] for x in out], [x[1] for x in out])

    links = written(arrow_map(ends, verify, "a long, b long", limit=2 << 20), "links")
    first = components(links)

    # 2. buckets that hold several components
    known = hits.join(first.withColumnRenamed("id", "node"), "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    split = known.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo < hi").select("bucket", F.ceil(F.col("size") / tile).cast("int").alias("cuts"))
    mine = F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))
    dealt = known.join(split, "bucket").withColumn("mine", mine).withColumn("other", other)
    name = F.concat_ws(":", "bucket", F.least("mine", "other"), F.greatest("mine", "other"))
    tiles = dealt.select(name.alias("tile"), "node", "component").join(light, "node")

    def likely(part: pa.Table):
        """Indexes of the pairs between components that may be linked, each only in the first bucket that it shares."""
        part = part.combine_chunks()
        node, comp, n = (np.asarray(part.column(c)) for c in ("node", "component", "n"))
        regs = _regs(part.column("regs"))
        keys = regs.reshape(len(node), BANDS, ROWS)
        here = int(part.column("tile")[0].as_py().split(":")[0])
        for i in range(len(node) - 1):
            j = np.arange(i + 1, len(node))
            j = j[(comp[j] != comp[i]) & (100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i]))]
            if not len(j):
                continue
            agree = (keys[j] == keys[i]).all(2)
            j, agree = j[agree.any(1)], agree[agree.any(1)]
            shared = agree.argmax(1)
            mine = np.array([_bucket(int(b), regs[i]) == here for b in range(BANDS)])
            j = j[mine[shared]]
            if len(j):
                j = j[likely_jaccard(regs[j], np.broadcast_to(regs[i], (len(j), M)), n[j].astype(float), np.full(len(j), float(n[i]))) >= floor]
                yield from ((i, int(x)) for x in j)

    floor = percent / 100 - ERRORS * float(np.sqrt(percent / 100 * (1 - percent / 100) / M))

    def active(part: pa.Table) -> pa.Table:
        found = sorted({x for pair in likely(part) for x in pair})
        node, tile_name = part.column("node").to_pylist(), part.column("tile").to_pylist()
        return pa.table([[tile_name[i] for i in found], [node[i] for i in found]], schema=_ACTIVE)

    def settle(part: pa.Table) -> pa.Table:
        node, comp = part.column("node").to_pylist(), part.column("component").to_pylist()
        sets: dict[int, np.ndarray] = {}
        texts = part.column("text")
        root = {c: c for c in comp}

        def top(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        def full_set(i):
            if i not in sets:
                sets[i] = shingles(words_of((texts[i].as_py() or "").encode()), k)
            return sets[i]

        out = []
        for i, j in likely(part):
            if top(comp[i]) != top(comp[j]) and linked(full_set(i), full_set(j), percent):
                root[top(comp[i])] = top(comp[j])
                out.append((node[i], node[j]))
        return pa.table([[x[0] for x in out], [x[1] for x in out]], schema=_LINK)

    tiles = written(tiles, "tiles")
    kept = written(tiles.groupBy("tile").applyInArrow(active, "tile string, node long"), "active")
    more = tiles.join(kept, ["tile", "node"]).join(bodies, "node").groupBy("tile").applyInArrow(settle, "a long, b long")
    more = written(more, "links")
    final = components(links.union(more)) if more.limit(1).count() else first

    by_seq = nodes.select("seq", "node").join(final.withColumnRenamed("id", "node"), "node", "left").select("seq", F.coalesce("component", "node").alias("component"))
    out = rows.select("doc_id", "n", "seq").join(by_seq, "seq", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _bucket(band: int, regs: np.ndarray) -> int:
    """Spark's xxhash64(band, bytes of the band's registers), as the bucket column has it."""
    seed = xxhash.xxh64_intdigest(band.to_bytes(4, "little"), 42)
    value = xxhash.xxh64_intdigest(regs[band * ROWS : (band + 1) * ROWS].astype("<u2").tobytes(), seed)
    return value - (1 << 64) if value >> 63 else value


def op4_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS doc_id, least(a, min(b)) AS component_id FROM r GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.component_id, w.doc_id) AS component_id,
       coalesce(m.component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.doc_id = w.doc_id
"""
