"""Operator 8, language ID: a linear-chain conditional random field labels every word of a text.

A word's features are its identity (lexicon), its affixes (n-grams that touch the word's edge) and its inner n-grams,
all hashed over UTF-8 bytes into one table of weights by language; learned transitions join neighbouring words, so
code-switched text is labelled word by word. A document's label is the language with the largest sum of the words'
forward-backward marginals.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.llm.common import arrow_map, batch_of, table

#: Hashed weights; sampled documents a language; words of a training sequence's stretch; passes over the sample.
BITS, SAMPLE, STRETCH, EPOCHS = 16, 120, 24, 6
#: Words of a block whose transfer matrix is formed.
BLOCK = 128
_OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("n_words", pa.int64())])
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KNUTH = np.uint32(2654435761)


def features(parts: list[bytes]):
    """Words of all parts (runs of letters; bytes from 128 on count as such): the part of each word, and the hashed
    features as two flat arrays (word, feature)."""
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    raw = np.frombuffer(b" ".join([b"", *parts, b""]), dtype=np.uint8)
    buf = _LOWER[raw]
    letter = _LETTER[raw]
    edge = np.diff(letter.astype(np.int8))
    start, stop = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1  # [start, stop) in buf
    part = np.searchsorted(np.cumsum(sizes + 1) + 1, start, side="right")
    n = len(start)
    # the word with its edges marked: zero bytes stand for them, so n-grams at an edge are affixes
    long = stop - start + 2
    base = np.cumsum(long) - long
    word = np.repeat(np.arange(n, dtype=np.int32), long)
    inner = np.arange(int(long.sum()), dtype=np.int32) - np.repeat(base.astype(np.int32), long)
    at = np.repeat(start.astype(np.int32), long) + inner - 1
    c = np.where((inner == 0) | (inner == np.repeat(long, long) - 1), 0, buf[np.clip(at, 0, len(buf) - 1)]).astype(np.uint32)
    owners, hashed = [], []
    h = c.copy()
    for size in (2, 3, 4):
        if len(c) < size:
            break
        h = (h[:-1] if size > 2 else c[:-1]) * np.uint32(0x01000193) ^ (c[size - 1 :] + np.uint32(size))
        inside = word[: len(h)] == word[size - 1 :]
        owners.append(word[: len(h)][inside])
        hashed.append((h[inside] + np.uint32(size)) * _KNUTH)
    powers = np.cumprod(np.full(int(long.max()) if n else 1, 0x01000193, dtype=np.uint32), dtype=np.uint32)
    owners.append(np.arange(n, dtype=np.int32))
    hashed.append(np.add.reduceat((c + np.uint32(1)) * powers[inner], base, dtype=np.uint32) * _KNUTH ^ np.uint32(0x5BD1E995) if n else np.zeros(0, np.uint32))
    return part, np.concatenate(owners), (np.concatenate(hashed) >> np.uint32(32 - BITS)).astype(np.int32)


def emissions(weights: np.ndarray, n_words: int, owner: np.ndarray, feature: np.ndarray) -> np.ndarray:
    """Sum of the features' weights, divided by the root of their number so that long words don't outweigh the chain."""
    count = np.maximum(np.bincount(owner, minlength=n_words), 1)
    return np.stack([np.bincount(owner, weights=w[feature], minlength=n_words) for w in weights], axis=1) / np.sqrt(count)[:, None]


def marginals(emit: np.ndarray, lengths: np.ndarray, trans: np.ndarray, first: np.ndarray, pairs: bool = False):
    """Forward-backward over chains laid end to end: P(label | chain) of each word; with `pairs` also the expected
    transitions and the log-likelihood's normalizer. All chains advance together, longest first."""
    order = np.argsort(-lengths, kind="stable")
    begin = (np.cumsum(lengths) - lengths)[order]
    size = lengths[order]
    k = emit.shape[1]
    e = np.exp(emit - emit.max(1, keepdims=True))
    t = np.exp(trans)
    alpha, beta = np.zeros_like(e), np.zeros_like(e)
    live = np.searchsorted(-size, -np.arange(1, int(size.max(initial=0)) + 1), side="right")
    a = None
    for step, n in enumerate(live.tolist()):
        at = begin[:n] + step
        a = e[at] * (np.exp(first) if step == 0 else a[:n] @ t)
        a /= a.sum(1, keepdims=True)
        alpha[at] = a
    b = np.zeros((0, k))
    expected = np.zeros((k, k))
    for step in range(len(live) - 1, -1, -1):
        n = int(live[step])
        new = np.ones((n, k))
        if len(b):
            nxt = begin[: len(b)] + step + 1
            into = e[nxt] * b
            new[: len(b)] = into @ t.T
            if pairs:
                both = alpha[begin[: len(b)] + step][:, :, None] * t[None] * into[:, None, :]
                expected += (both / both.sum((1, 2), keepdims=True)).sum(0)
        b = new / new.sum(1, keepdims=True)
        beta[begin[:n] + step] = b
    p = alpha * beta
    p /= np.maximum(p.sum(1, keepdims=True), 1e-300)
    return (p, expected) if pairs else p


def long_marginals(emit: np.ndarray, lengths: np.ndarray, trans: np.ndarray, first: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """marginals() for chains of any length, exactly: blocks of words are reduced to transfer matrices side by side,
    messages pass from block to block, and all blocks are then finished side by side."""
    if int(lengths.max(initial=0)) <= block:
        return marginals(emit, lengths, trans, first)
    k, t = emit.shape[1], np.exp(trans)
    e = np.exp(emit - emit.max(1, keepdims=True))
    count = -(-lengths // block)
    chain = np.repeat(np.arange(len(lengths)), count)
    index = np.arange(len(chain)) - np.repeat(np.cumsum(count) - count, count)
    begin = np.repeat(np.cumsum(lengths) - lengths, count) + index * block
    size = np.minimum(block, lengths[chain] - index * block)
    order = np.argsort(-size, kind="stable")
    chain, index, begin, size = chain[order], index[order], begin[order], size[order]
    live = np.searchsorted(-size, -np.arange(1, block + 1), side="right").tolist()
    through = np.broadcast_to(np.eye(k), (len(size), k, k)).copy()
    for step, n in enumerate(live):
        a = (through[:n] @ t if step else through[:n]) * e[begin[:n] + step][:, None, :]
        through[:n] = a / a.sum((1, 2), keepdims=True)
    # messages into each block, from the left and from the right; blocks of all chains move together
    left, right = np.tile(np.exp(first), (len(size), 1)), np.ones((len(size), k))
    at = {(c, i): b for b, (c, i) in enumerate(zip(chain.tolist(), index.tolist(), strict=True))}
    rounds = [[(at[c, i], at[c, i + 1]) for c in np.flatnonzero(count > i + 1).tolist()] for i in range(int(count.max()) - 1)]
    for pairs in rounds:
        x, y = np.array(pairs).T
        u = (left[x][:, None, :] @ through[x] @ t)[:, 0]
        left[y] = u / u.sum(1, keepdims=True)
    for pairs in reversed(rounds):
        x, y = np.array(pairs).T
        r = (t @ through[y] @ right[y][:, :, None])[:, :, 0]
        right[x] = r / r.sum(1, keepdims=True)
    alpha, p = np.zeros_like(e), np.zeros_like(e)
    u = left
    for step, n in enumerate(live):
        a = u[:n] * e[begin[:n] + step]
        a /= a.sum(1, keepdims=True)
        alpha[begin[:n] + step] = a
        u = a @ t
    b = right.copy()
    for step in range(block - 1, -1, -1):
        n = live[step]
        here = begin[:n] + step
        p[here] = alpha[here] * b[:n]
        r = (e[here] * b[:n]) @ t.T
        b[:n] = r / r.sum(1, keepdims=True)
    return p / np.maximum(p.sum(1, keepdims=True), 1e-300)


class Model:
    """labels, weights (label, feature), trans (label, label), first (label)."""

    def __init__(self, labels, weights, trans, first):
        self.labels, self.weights, self.trans, self.first = labels, weights, trans, first

    def predict(self, texts: list[bytes | None]):
        """(label, score, words) of each text. `und` with score 0 where a text is null or has no letter, or nothing was learned."""
        if not self.labels:
            return [("und", 0.0, 0) for _ in texts]
        part, owner, feature = features([t or b"" for t in texts])
        lengths = np.bincount(part, minlength=len(texts))
        p = long_marginals(emissions(self.weights, len(part), owner, feature), lengths, self.trans, self.first) if len(part) else np.zeros((0, len(self.labels)))
        total = np.stack([np.bincount(part, weights=p[:, i], minlength=len(texts)) for i in range(len(self.labels))], axis=1)
        out = []
        for text, n, row in zip(texts, lengths.tolist(), total, strict=True):
            if n == 0 or not _has_letter(text):
                out.append(("und", 0.0, 0))
            else:
                best = int(row.argmax())
                out.append((self.labels[best], min(1.0, float(row[best] / n)), n))
        return out


def _has_letter(text: bytes) -> bool:
    return any(65 <= c <= 90 or 97 <= c <= 122 for c in text[:64]) or any(map(str.isalpha, text.decode("utf-8", "replace")))


def fit(rows: list[tuple[bytes, str]], epochs: int = EPOCHS, stretch: int = STRETCH, seed: int = 11) -> Model:
    """Trains on (text, language). Sequences join stretches of several documents, so transitions between languages
    are seen; likelihood gradients by forward-backward, AdaGrad steps. No rows give a model without labels."""
    if not rows:
        return Model([], np.zeros((0, 1 << BITS)), np.zeros((0, 0)), np.zeros(0))
    labels = sorted({lang for _, lang in rows})
    k, rng = len(labels), np.random.default_rng(seed)
    part, owner, feature = features([t for t, _ in rows])
    by_word = np.argsort(owner, kind="stable")
    owner, feature = owner[by_word], feature[by_word]
    at = np.searchsorted(owner, np.arange(len(part) + 1))
    index = {lang: i for i, lang in enumerate(labels)}
    truth = np.array([index[lang] for _, lang in rows])[part] if len(part) else np.zeros(0, dtype=int)
    cuts = [(x, min(x + stretch, int(b))) for a, b in zip(*(np.searchsorted(part, np.arange(len(rows)), side=s) for s in ("left", "right")), strict=True) for x in range(int(a), int(b), stretch)]
    weights, trans, first = np.zeros((k, 1 << BITS)), np.zeros((k, k)), np.zeros(k)
    g_w, g_t, g_f = np.full_like(weights, 1e-3), np.full_like(trans, 1.0), np.full_like(first, 1.0)
    for _ in range(epochs if k > 1 else 0):
        rng.shuffle(cuts)
        for x in range(0, len(cuts), 192):
            some = cuts[x : x + 192]
            words = np.concatenate([np.arange(a, b) for a, b in some])
            size = np.array([b - a for a, b in some])
            # a chain is one to three stretches
            chain = np.cumsum(rng.random(len(some)) < 0.5)
            lengths = np.bincount(chain - chain[0], weights=size).astype(int)
            span = at[words + 1] - at[words]
            flat = np.repeat(at[words], span) + np.arange(int(span.sum())) - np.repeat(np.cumsum(span) - span, span)
            f, o = feature[flat], np.repeat(np.arange(len(words)), span)
            p, expected = marginals(emissions(weights, len(words), o, f), lengths, trans, first, pairs=True)
            y = truth[words]
            gap = -p
            gap[np.arange(len(y)), y] += 1
            gap /= np.sqrt(np.maximum(span, 1))[:, None]
            used, back = np.unique(f, return_inverse=True)
            starts = np.cumsum(lengths) - lengths
            inner = np.ones(len(y), dtype=bool)
            inner[starts] = False
            seen = np.zeros((k, k))
            np.add.at(seen, (y[:-1][inner[1:]], y[1:][inner[1:]]), 1)
            for i in range(k):
                g = np.bincount(back, weights=gap[o, i], minlength=len(used)) - 1e-3 * weights[i, used]
                g_w[i, used] += g * g
                weights[i, used] += 0.3 * g / np.sqrt(g_w[i, used])
            for value, total, g in ((trans, g_t, seen - expected - 1e-2 * trans), (first, g_f, np.bincount(y[starts], minlength=k) - p[starts].sum(0))):
                total += g * g
                value += 0.3 * g / np.sqrt(total)
    return Model(labels, weights, trans, first)


def held_out(doc_id: str = "doc_id"):
    """Rows whose crc32 of the id as text leaves remainder 1 by 3 are never learned from; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train_langid(docs: DataFrame, sample: int = SAMPLE, max_chars: int = 200_000) -> Model:
    """Fits on at most `sample` documents a language (smallest hash of the id), of at most `max_chars` characters
    each: the bound of what the driver holds. Every other use of the model covers all rows."""
    from pyspark.sql import Window

    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out() & (F.length("text") <= max_chars))
    ids = usable.select("doc_id", "lang").withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))).where(F.col("rn") <= sample)
    few = F.broadcast(ids.select("doc_id", "lang"))
    rows = usable.join(few, ["doc_id", "lang"]).select("text", "lang", "doc_id").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"]))
    return fit([(r["text"].encode(), r["lang"]) for r in rows])


def langid(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, n_words) for every row, no shuffle; only the text is read.

    score: the mean marginal of the language over the text's words, 0 to 1. A null text or one without a letter gives
    `und`, 0; so does every text where no row could be learned from; ties go to the first label in alphabetical order;
    an empty table gives no rows. The model (a fixed number of weights) is broadcast.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch_of(_OUT, batch.column("doc_id"), *zip(*sent.value.predict(_encoded(batch.column("text"))), strict=True))

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return arrow_map(picked, step, "doc_id long, lang_pred string, score double, n_words long", limit=1 << 20)


def with_language(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of docs, with all their columns, that have a language; `lang` is set where it was null. Where no row
    could be learned from, the rows whose text has a letter, as they are.

    A filter over the rows themselves: null and repeated ids and clashing column names make no difference.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = _encoded(batch.column(text))
        if not sent.value.labels:
            return batch.filter(pa.array([x is not None and _has_letter(x) for x in texts], pa.bool_()))
        named = [x[0] for x in sent.value.predict(texts)]
        at = batch.schema.get_field_index(lang)
        filled = pc.coalesce(batch.column(at), pa.array(named, batch.schema.field(at).type))
        return batch.set_column(at, batch.schema.field(at), filled).filter(pa.array([x != "und" for x in named], pa.bool_()))

    return arrow_map(docs, step, docs.schema, column=text, limit=1 << 20)


def _encoded(column: pa.Array) -> list[bytes | None]:
    return [x.encode() if x is not None else None for x in column.to_pylist()]


def op8_crf_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid(docs, train_langid(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
