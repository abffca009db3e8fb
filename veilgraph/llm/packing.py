"""Operator 7, packing: a sharded BM25 index hands each seed document its unused neighbours, which fill its window.

1. Statistics of all documents: how many there are, their mean length, and in how many each (hashed) term occurs.
2. Routing: a document's key is a common term and any term drawn from its own by weight (rare terms that other documents
   share weigh most), with the same draws for all documents, so documents with much in common meet. All documents are
   laid out by (key, hash of id and text) and cut into ranges and shards of about BLOCK_BYTES of text. A key of any size
   is cut the same way, so no shard grows with it.
3. A task indexes its shard under the statistics of all documents. The first unused document is a seed; its BM25
   score with every document of the shard, over all its terms, gives the unused neighbours that fill the window. What
   is left of the last one opens the next window and is its seed.
No choice depends on file layout or partitioning. The work grows in proportion to the input: a seed sees its own shard
only, so a neighbour under another key is not found; README.md gives the measured share of best neighbours found.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilgraph.llm.common import HELD, arrow_map, batch_of, per_task, released, running_start, sliced, table, written
from veilgraph.llm.tokens import Split, encoder_for, laid_out, scrambled

WINDOW_TOKENS, BLOCK_BYTES, K1, B = 4096, 12 << 20, 1.2, 0.75
#: Bytes of text that one round of array operations works on.
SLICE_BYTES = 1 << 20
#: Terms are hashed to so many bits; what goes to all tasks is one number for each, whatever the input's size.
TERM_BITS, PART_BITS = 22, 16
#: A document's first draw is among the terms that more than this share of all documents have.
COMMON = 1 / 16
#: The places at which ranges begin are found on every LAYOUT-th document by hash; every document is then laid out.
LAYOUT = 16
#: Ranges of the layout, at most: their first places go to all tasks. A range holds one or several shards.
RANGES = 1 << 16
_COUNT = pa.schema([("part", pa.int32()), ("counts", pa.binary()), ("docs", pa.int64()), ("words", pa.int64())])
_PLACE = pa.schema([("key", pa.int64()), ("h", pa.int64()), ("doc_id", pa.int64()), ("size", pa.int64())])
_DEALT = pa.schema([("range", pa.int32()), ("key", pa.int64()), ("h", pa.int64()), ("doc_id", pa.int64()), ("size", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("terms", pa.binary()), ("tf", pa.binary())])
_OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def terms_of(texts: Split) -> tuple[np.ndarray, ...]:
    """(document, term, frequency) of each distinct term of each text, in order, and the words of each text.

    A word is a stretch without white space, less a last mark after a letter, with A-Z (and their Latin-1 kin)
    lower-cased; a term is its hash, over its first bytes and its length.
    """
    length = np.diff(texts.cut)
    _, h = texts.words()
    both = np.sort(np.repeat(np.arange(len(length)) << TERM_BITS, length) | (h >> np.uint64(64 - TERM_BITS)).astype(np.int64))
    first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1]))) if len(both) else np.zeros(0, np.int64)
    tf = np.diff(np.concatenate((first, [len(both)])))
    return both[first] >> TERM_BITS, both[first] & ((1 << TERM_BITS) - 1), tf, length


def split_of(column: pa.Array) -> Split:
    return Split(*laid_out(column), lower=True)


def idf_of(df: np.ndarray, total: int) -> np.ndarray:
    """0 for terms of one document only."""
    return np.where(df > 1, np.log1p((total - df + 0.5) / (df + 0.5)), 0.0)


def _sparse(counts: np.ndarray) -> bytes:
    """Places and values of what is not zero, of up to 2 ** PART_BITS counts."""
    at = np.flatnonzero(counts)
    return at.astype("<u2").tobytes() + counts[at].astype("<u8").tobytes()


def _dense(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw) // 10
    return np.frombuffer(raw, dtype="<u2", count=n).astype(np.int64), np.frombuffer(raw, dtype="<u8", offset=2 * n).astype(np.int64)


def statistics(texts: DataFrame) -> tuple[np.ndarray, int, float]:
    """(documents with each term, documents, mean words) over all rows of (text)."""

    def run(batches):
        HELD.clear()
        counts, docs, total = np.zeros(1 << TERM_BITS, dtype=np.uint32), 0, 0
        for batch in batches:
            for part in sliced(batch, "text", SLICE_BYTES):
                _, term, _, length = terms_of(split_of(part.column("text")))
                np.add.at(counts, term, np.uint32(1))
                docs, total = docs + len(length), total + int(length.sum())
        if docs:
            for k, part in enumerate(np.split(counts, len(counts) >> PART_BITS)):
                yield batch_of(_COUNT, [k], [_sparse(part)], [docs if k == 0 else 0], [total if k == 0 else 0])
        released()

    def summed(part: pa.Table) -> pa.Table:
        out = np.zeros(1 << PART_BITS, dtype=np.int64)
        for raw in part.column("counts"):
            at, n = _dense(raw.as_py())
            out[at] += n
        return pa.table([part.column("part")[:1], [_sparse(out)], [sum(part.column("docs").to_pylist())], [sum(part.column("words").to_pylist())]], schema=_COUNT)

    kind = "part int, counts binary, docs long, words long"
    # a part's counts meet in two steps, some tasks' at a time
    some = texts.mapInArrow(run, kind).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64))).groupBy("part", "salt").applyInArrow(lambda t: summed(t.drop(["salt"])), kind)
    df = np.zeros(1 << TERM_BITS, dtype=np.float64)
    docs = total = 0
    for r in some.groupBy("part").applyInArrow(summed, kind).collect():
        at, n = _dense(r["counts"])
        df[(r["part"] << PART_BITS) + at] = n
        docs, total = docs + r["docs"], total + r["words"]
    return df, docs, total / max(1, docs)


def keys_of(doc: np.ndarray, term: np.ndarray, idf: np.ndarray, total: int, n: int) -> np.ndarray:
    """Each document's key: a draw from its terms that a COMMON share of all documents has, then a draw from all of them.

    Chances are in proportion to idf and the draws are the same for all documents, so the chance that two documents
    draw the same term is their idf-weighted Jaccard similarity over the terms in question.
    """
    key = np.zeros(n, dtype=np.int64)
    weight = idf[term]
    common = float(idf_of(np.array([total * COMMON]), total)[0])
    for salt, some in ((1, (weight > 0) & (weight < common)), (2, weight > 0)):
        won = np.zeros(n, dtype=np.int64)
        d, t = doc[some], term[some]
        if len(d):
            first = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
            size = np.diff(np.concatenate((first, [len(d)])))
            bits = scrambled((t.astype(np.uint64) + np.uint64(salt << 40)) * np.uint64(0x9E3779B97F4A7C15))
            race = -np.log(((bits >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / weight[some]
            low = np.repeat(np.minimum.reduceat(race, first), size)
            at = np.flatnonzero(race == low)
            won[d[at[::-1]]] = t[at[::-1]] + 1
        key = key << 31 | won
    return key


class Shard:
    """Postings of some documents, weighted under the statistics of all."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, length: np.ndarray, idf: np.ndarray, mean: float):
        self.n = n = len(length)
        self.cut = np.searchsorted(doc, np.arange(n + 1))  # a document's terms
        # by term, then document: one plain sort of numbers that end in the place
        order = np.sort(term.astype(np.int64) << 32 | np.arange(len(term))) & 0xFFFFFFFF
        first = np.flatnonzero(np.concatenate(([True], np.diff(term[order].astype(np.int64)) != 0))) if len(term) else np.zeros(0, np.int64)
        df = np.diff(np.concatenate((first, [len(term)])))
        names = term[order[first]]
        useful = (df > 1) & (idf[names] > 0)  # others score with the seed alone
        self.at = np.empty(len(term), dtype=np.int64)
        self.at[order] = np.repeat(np.where(useful, np.arange(len(names)), -1), df)
        weight = idf[term] * tf * (K1 + 1) / (tf + (K1 * (1 - B + B * length / max(1.0, mean))).astype(np.float32)[doc])
        self.doc, self.weight = doc[order], weight[order].astype(float)
        self.first = np.concatenate((first, [len(term)]))
        # terms of many documents as dense rows, the others posting by posting
        wide = np.flatnonzero(useful & (df * 16 > n))
        self.row = np.full(len(names), -1)
        self.row[wide] = np.arange(len(wide))
        self.dense = np.zeros((len(wide), n), dtype=np.float32)
        for k, t in enumerate(wide.tolist()):
            span = slice(self.first[t], self.first[t + 1])
            self.dense[k, self.doc[span]] = self.weight[span]

    def narrow(self, keep: np.ndarray) -> np.ndarray:
        """Leaves the postings of the documents that `keep` marks; returns which of those in view they were. All can still be seeds."""
        some = keep[self.doc]
        place = np.cumsum(keep) - 1
        self.first = np.concatenate(([0], np.cumsum(some)))[self.first]
        self.doc, self.weight = place[self.doc[some]], self.weight[some]
        self.dense, self.n = np.ascontiguousarray(self.dense[:, keep]), int(keep.sum())
        return np.flatnonzero(keep)

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of the seed's terms, all of them, with each document in view."""
        at = self.at[self.cut[seed] : self.cut[seed + 1]]
        at = at[at >= 0]
        row = self.row[at]
        out = self.dense[row[row >= 0]].sum(0) if (row >= 0).any() else np.zeros(self.n, dtype=np.float32)
        at = at[row < 0]
        if len(at):
            size = self.first[at + 1] - self.first[at]
            place = np.repeat(self.first[at] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            out = out + np.bincount(self.doc[place], self.weight[place], minlength=self.n)
        return out


def neighbours(score: np.ndarray) -> Iterator[int]:
    """Indexes of positive scores, best first, ties in order."""
    found = np.flatnonzero(score > 0)
    value, keep, given = score[found], 16, 0
    while given < len(found):
        if keep < len(found):
            bar = np.partition(value, len(found) - keep)[len(found) - keep]
            some = np.flatnonzero(value >= bar)
        else:
            some = np.arange(len(found))
        some = some[np.lexsort((some, -value[some]))]
        yield from found[some[given:]].tolist()
        given, keep = len(some), keep * 8


def reading_order(shard: Shard, tokens: np.ndarray, window: int = WINDOW_TOKENS, filled: int = 0) -> Iterator[int]:
    """The shard's documents in the order in which they fill windows. `filled`: tokens that the first one holds already.

    The shard is used up: documents that have been given go out of view once they are a quarter of those in view.
    """
    n = shard.n
    unused, view, given = np.ones(n, dtype=bool), np.arange(n), 0
    room, seed, first = window - filled, -1, 0
    while True:
        if seed < 0:
            while first < n and not unused[first]:
                first += 1
            if first == n:
                return
            seed = first
            unused[seed], given = False, given + 1
            yield seed
            room -= int(tokens[seed])
            if room <= 0:
                room = window - (-room) % window
        if 4 * given >= len(view):
            view, given = view[shard.narrow(unused[view])], 0
        last = -1
        for k in neighbours(np.where(unused[view], shard.scores(seed), 0)):
            d = int(view[k])
            unused[d], given = False, given + 1
            yield d
            room -= int(tokens[d])
            if room <= 0:  # the window is full; what is left of d opens the next one and is its seed
                room, last = window - (-room) % window, d
                break
        seed = last


class Packer:
    """Cuts a stream of documents into sequences."""

    def __init__(self, window: int, first: int = 0):
        self.window, self.number, self.open, self.fill = window, first, [], 0

    def _close(self) -> list[tuple]:
        out, offset = [], 0
        for doc, start, length in self.open:
            out.append((doc, start, length, self.number, offset))
            offset += length
        self.open, self.fill, self.number = [], 0, self.number + 1
        return out

    def add(self, doc: int, start: int, end: int) -> list[tuple]:
        out = []
        while start < end:
            take = min(end - start, self.window - self.fill)
            self.open.append((doc, start, take))
            self.fill, start = self.fill + take, start + take
            if self.fill == self.window:
                out += self._close()
        return out

    def finish(self) -> list[tuple]:
        """What is left (less than a window) goes into sequences of powers of two: no padding."""
        left, size, out = self.open, self.fill, []
        self.open, self.fill = [], 0
        while size:
            part = need = 1 << (size.bit_length() - 1)
            while need:
                doc, start, length = left.pop(0)
                take = min(need, length)
                self.open.append((doc, start, take))
                if take < length:
                    left.insert(0, (doc, start + take, length - take))
                need -= take
            out += self._close()
            size -= part
        return out


def layout(places: DataFrame, block: int) -> list[tuple[int, int]]:
    """(key, h) at which each range begins, in order, of rows (key, h, doc_id, size).

    A range takes `block` bytes, or several times that in a table of over RANGES blocks. Range-partitioned running sums, so no key is too large; at most RANGES ranges.
    """
    total = places.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-total // (block * RANGES)))
    placed = running_start(places, ["key", "h", "doc_id"], "size", "before").select("key", "h", F.expr(f"before div {block * shards}").alias("range"))
    firsts = placed.groupBy("range").agg(F.min(F.struct("key", "h")).alias("first")).orderBy("range").collect()
    return [(r["first"]["key"], r["first"]["h"]) for r in firsts]


def range_of(firsts: np.ndarray, key: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The last range that begins at or before each (key, h). `firsts` is a sorted array of (key, h) pairs."""
    asked = np.empty(len(key), dtype=firsts.dtype)
    asked["key"], asked["h"] = key, h
    return np.maximum(np.searchsorted(firsts, asked, side="right") - 1, 0)


def bm25_packing(docs: DataFrame, vocab: str = "word_bpe_49k.json", end_id: int = 2, window: int = WINDOW_TOKENS, block: int = BLOCK_BYTES, doc_id: str = "doc_id", text: str = "text", width: str = "<u2") -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset); each id of each row lies in exactly one.

    A null text counts as empty (its one id is the end id); null ids and repeated rows are packed as they are; an
    empty table gives no rows; texts longer than a window are cut; a text without words has no neighbours. What a
    shard leaves at its end goes into sequences of powers of two. The documents are read three times and shuffled once
    (their ids and terms, by range). A range of over twice `block` bytes makes several shards. `width` is the type in which ids are shuffled, '<u2' for vocabularies up to 65,536.
    """
    spark = docs.sparkSession
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(doc_id).cast("long"), F.col(text)).alias("h"))
    df, total, mean = statistics(docs.select(F.col(text).alias("text")))
    if not total:
        return spark.createDataFrame([], PACKED)
    sent = spark.sparkContext.broadcast(idf_of(df, total).astype(np.float32))

    def placed(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = split_of(batch.column("text"))
        doc, term, _, _ = terms_of(texts)
        size = (np.diff(texts.offsets) + 1) * LAYOUT
        return batch_of(_PLACE, keys_of(doc, term, sent.value, total, batch.num_rows), batch.column("h"), batch.column("doc_id"), size)

    places = written(arrow_map(picked.where(F.pmod("h", F.lit(LAYOUT)) == 0), placed, "key long, h long, doc_id long, size long", limit=SLICE_BYTES), "packing-places")
    begins = layout(places, block) or [(0, 0)]
    firsts = spark.sparkContext.broadcast(np.array(begins, dtype=[("key", np.int64), ("h", np.int64)]))

    @per_task
    def task():
        encoder = encoder_for(vocab)
        small = np.dtype(width)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = split_of(batch.column("text"))
            doc, term, tf, length = terms_of(texts)
            key, h = keys_of(doc, term, sent.value, total, batch.num_rows), np.asarray(batch.column("h"))
            ids, sizes = encoder.encode(batch.column("text"), texts)
            raw, at = ids.astype(small).tobytes(), np.concatenate(([0], np.cumsum(sizes))).tolist()
            wide = small.itemsize
            cut = np.searchsorted(doc, np.arange(batch.num_rows + 1)).tolist()
            names, counts = term.astype("<u4").tobytes(), np.minimum(tf, 65535).astype("<u2").tobytes()
            pairs = list(zip(cut, cut[1:], strict=False))
            return batch_of(
                _DEALT,
                range_of(firsts.value, key, h).astype(np.int32),
                key,
                h,
                batch.column("doc_id"),
                np.diff(texts.offsets) + 1,
                length,
                [raw[a * wide : b * wide] for a, b in zip(at, at[1:], strict=False)],
                [names[4 * a : 4 * b] for a, b in pairs],
                [counts[2 * a : 2 * b] for a, b in pairs],
            )

        return step

    def solve(rows: dict[str, list], first: int) -> tuple[list[tuple], int]:
        """Pieces of one shard: (row, start, length, sequence, offset)."""
        cut = [len(x) // 4 for x in rows["terms"]]
        term, tf = np.frombuffer(b"".join(rows["terms"]), dtype="<u4"), np.frombuffer(b"".join(rows["tf"]), dtype="<u2")
        tokens = np.array([len(x) // np.dtype(width).itemsize + 1 for x in rows["ids"]])
        shard = Shard(np.repeat(np.arange(len(cut)), cut), term, tf, np.array(rows["length"]), sent.value, mean)
        packer, out = Packer(window, first), []
        for d in reading_order(shard, tokens, window):
            out += packer.add(d, 0, int(tokens[d]))
        out += packer.finish()
        return out, packer.number

    def pack(batches):
        small, names = np.dtype(width), ("doc_id", "length", "ids", "terms", "tf")
        now, number, size, rows = None, 0, 0, {c: [] for c in names}

        def flush():
            nonlocal number, rows, size
            out, number = solve(rows, number)
            ids = {}
            done: list[tuple] = []
            for d, start, length, sequence, offset in out:
                if d not in ids:
                    ids[d] = np.append(np.frombuffer(rows["ids"][d], dtype=small), end_id).astype("<u4").tobytes()
                raw = ids[d]
                done.append((rows["doc_id"][d], start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), len(raw) // 4, sequence, offset))
                if 4 * (start + length) == len(raw):
                    del ids[d]
            rows, size = {c: [] for c in names}, 0
            return batch_of(_OUT, *zip(*done, strict=True))

        HELD.clear()
        for batch in batches:
            where = batch.column("range").to_pylist()
            sizes = batch.column("size").to_pylist()
            columns = {c: batch.column(c).to_pylist() for c in names}
            for k, r in enumerate(where):
                if rows["ids"] and (r != now or size >= 2 * block):
                    yield flush()
                if r != now:
                    now, number = r, r << 32
                for c, x in columns.items():
                    rows[c].append(x[k])
                size += sizes[k]
        if rows["ids"]:
            yield flush()
        released()

    dealt = arrow_map(picked, task, "range int, key long, h long, doc_id long, size long, length long, ids binary, terms binary, tf binary", limit=2 * SLICE_BYTES)
    return dealt.repartitionById(len(begins), "range").sortWithinPartitions("key", "h", "doc_id").mapInArrow(pack, PACKED)


def shard_of(texts: list[str]) -> Shard:
    """A shard of its own: these texts are all documents."""
    doc, term, tf, length = terms_of(split_of(pa.array(texts, pa.large_string())))
    df = np.bincount(term, minlength=1 << TERM_BITS)
    return Shard(doc, term, tf, length, idf_of(df, len(texts)), float(length.mean()) if len(texts) else 1.0)


def packing_padding(pieces: DataFrame, window: int = WINDOW_TOKENS) -> DataFrame:
    """(sequences, tokens, padding): padding counts what sequences lack to `window`, none at a power of two."""
    size = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    lack = F.when(F.pow(F.lit(2.0), F.round(F.log2("n"))) == F.col("n"), 0).otherwise(window - F.col("n"))
    return size.agg(F.count(F.lit(1)).alias("sequences"), F.sum("n").alias("tokens"), F.sum(lack).alias("padding"))


def op7_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_packing(table(spark, sf_dir, "documents"))
