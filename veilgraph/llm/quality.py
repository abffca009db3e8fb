"""Operator 9, quality classifier: naive Bayes support vectors.

Indicators of hashed byte n-grams (2 to 4, over the whole text) are scaled by their class log-count ratios; a linear
hinge-loss model on these is fitted by dual coordinate descent; its weights are mixed with their mean magnitude.
"""

from __future__ import annotations

from functools import reduce
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.llm.common import arrow_map, batch_of, bytes_of, table
from veilgraph.llm.langid import held_out

#: Hashed indicators; labelled documents of each class that are fitted; hinge cost; passes; mix of weights and mean.
BITS, SAMPLE, COST, EPOCHS, MIX = 15, 2000, 1.0, 12, 0.25
_TWICE = np.array([1, 3, 10, 30])
SIZE = (1 << BITS) + len(_TWICE)
_OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def indicators(text: bytes) -> np.ndarray:
    """Sorted distinct hashed n-grams of the whole text; an empty text has the one n-gram of its edges."""
    c = np.frombuffer(b"\x02" + text + b"\x03", dtype=np.uint8).astype(np.uint32)
    seen = np.zeros(SIZE, dtype=bool)
    h = c
    for size in (2, 3, 4):
        if len(c) < size:
            break
        h = h[:-1] * np.uint32(0x01000193) + c[size - 1 :]
        seen[(h * np.uint32(2654435761) ^ np.uint32(size * 0x9E3779B1 & 0xFFFFFFFF)) >> np.uint32(32 - BITS)] = True
    # word bigrams of one word twice share indicators, by how many there are
    words = text.split()
    twice = sum(map(eq, words, words[1:]))
    seen[(1 << BITS) + np.flatnonzero(twice >= _TWICE)] = True
    return np.flatnonzero(seen).astype(np.int32)


class Nbsvm:
    """score(x) = sigmoid(a * (w . x / sqrt(number of indicators) + bias) + b)."""

    def __init__(self, weights: np.ndarray, bias: float, a: float, b: float):
        self.weights, self.bias, self.a, self.b = weights, bias, a, b

    def margin(self, x: np.ndarray) -> float:
        return float(self.weights[x].sum() / np.sqrt(max(1, len(x))) + self.bias)

    def score(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.a * self.margin(x) + self.b, -30, 30))))


def _hinge(xs: list[np.ndarray], y: np.ndarray, cost: float, epochs: int, mix: float, seed: int) -> Nbsvm:
    """Margins only; both classes count alike: each one's hinge cost is divided by its share."""
    count = {s: np.ones(SIZE) for s in (1.0, -1.0)}
    for x, s in zip(xs, y, strict=True):
        count[s][x] += 1
    ratio = np.log(count[1.0] / count[1.0].sum()) - np.log(count[-1.0] / count[-1.0].sum())
    scale = [ratio[x] / np.sqrt(max(1, len(x))) for x in xs]
    norm = np.array([float(v @ v) + 1 for v in scale])
    upper = cost * len(y) / (2 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))
    w, bias, alpha, rng = np.zeros(SIZE), 0.0, np.zeros(len(y)), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            x, v = xs[i], scale[i]
            gap = y[i] * (float(w[x] @ v) + bias) - 1
            new = min(max(alpha[i] - gap / norm[i], 0.0), upper[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[x] += step * v
                bias += step
                alpha[i] = new
    # interpolation: every weight is drawn towards the mean magnitude, so indicators with little say keep their ratio's sign
    w = (1 - mix) * np.abs(w).mean() * np.sign(w) + mix * w
    return Nbsvm(w * ratio, bias, 1.0, 0.0)


def fit(xs: list[np.ndarray], ys: list[int], cost: float = COST, epochs: int = EPOCHS, mix: float = MIX, seed: int = 5) -> Nbsvm:
    """The slope and offset of the score are fitted (logistic, classes weighted alike) to margins from two half models,
    each on the half that it has not seen."""
    y = np.where(np.array(ys) > 0, 1.0, -1.0)
    if len(xs) == 0 or (y > 0).all() or (y < 0).all():
        return Nbsvm(np.zeros(SIZE), 0.0, 0.0, 3.0 if len(xs) and y[0] > 0 else -3.0 if len(xs) else 0.0)
    model = _hinge(xs, y, cost, epochs, mix, seed)
    half = np.zeros(len(y), dtype=int)
    for s in (1.0, -1.0):
        half[np.flatnonzero(y == s)] = np.arange((y == s).sum()) % 2
    margin = np.array([model.margin(x) for x in xs])
    if min((y > 0).sum(), (y < 0).sum()) >= 20:
        for side in (0, 1):
            part = np.flatnonzero(half != side)
            other = _hinge([xs[i] for i in part], y[part], cost, epochs, mix, seed)
            for i in np.flatnonzero(half == side):
                margin[i] = other.margin(xs[i])
    target = y > 0
    weight = np.where(target, 0.5 / target.sum(), 0.5 / (~target).sum())
    centre, spread = float(margin.mean()), float(margin.std()) or 1.0
    z = (margin - centre) / spread
    t = np.array([1.0, 0.0])
    for _ in range(60):  # Newton steps with a little ridge
        p = 1 / (1 + np.exp(-np.clip(t[0] * z + t[1], -30, 30)))
        d, r = weight * (p - target), weight * p * (1 - p) + 1e-9
        g = np.array([d @ z + 1e-4 * t[0], d.sum() + 1e-6 * t[1]])
        h = np.array([[r @ (z * z) + 1e-4, r @ z], [r @ z, r.sum() + 1e-6]])
        t = t - np.clip(np.linalg.solve(h, g), -2, 2)
    model.a, model.b = float(t[0] / spread), float(t[1] - t[0] * centre / spread)
    return model


def train_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, max_chars: int = 200_000) -> Nbsvm:
    """Fits on at most `sample` labelled documents a class (smallest hash of the id, not held out), of at most
    `max_chars` characters each: the bound of what the driver holds. Labels that are null or whose document is missing
    are not used; other columns are not read."""
    usable = labels.select("doc_id", "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # each class's smallest hashes by a top-k of every partition's top k: no task sees a whole class
    picked = reduce(DataFrame.unionByName, (usable.where(side).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for side in ("quality > 0", "quality <= 0")))
    few = F.broadcast(picked.select("doc_id", "quality"))
    short = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") <= max_chars)
    kind = pa.schema([("doc_id", pa.int64()), ("quality", pa.int64()), ("x", pa.list_(pa.int32()))])

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch_of(kind, batch.column("doc_id"), batch.column("quality"), [indicators(x) for x in bytes_of(batch.column("text"))])

    rows = arrow_map(short.join(few, "doc_id").select("doc_id", F.col("quality").cast("long").alias("quality"), "text"), step, "doc_id long, quality long, x array<int>").toArrow()
    ids, ys = rows.column("doc_id").to_pylist(), rows.column("quality").to_pylist()
    xs = [np.asarray(x.values) for c in rows.column("x").chunks for x in c]
    order = sorted(range(len(ids)), key=lambda i: (ids[i], len(xs[i])))
    return fit([xs[i] for i in order], [ys[i] for i in order])


def quality(docs: DataFrame, model: Nbsvm, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) for every row, no shuffle; only the text is read. score: 0 to 1, higher where label 1 is
    likelier. A null text is empty and is scored as such; repeated rows repeat; an empty table gives no rows."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch_of(_OUT, batch.column("doc_id"), [sent.value.score(indicators(x)) for x in bytes_of(batch.column("text"))])

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return arrow_map(picked, step, "doc_id long, score double")


def op9_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality(docs, train_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
