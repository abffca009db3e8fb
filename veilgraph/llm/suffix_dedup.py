"""Operator 3, suffix-array dedup: every byte covered by a string of LENGTH bytes that also starts earlier goes.

Each window of LENGTH bytes belongs to its minimizer, the smallest hashed K-gram in it (leftmost on ties). Equal
windows have equal minimizers, so windows can be settled group by group of minimizers: a minimizer met once owns only
unique windows and drops out by its hash alone; the text around the others (a segment: its run of windows) is dealt
into buckets by minimizer. In a bucket, suffixes are ordered by prefix doubling; the previous and next smaller
positions in that order give each window's longest previous factor, and a window whose factor reaches LENGTH is covered.
Whole copies of texts, and within a bucket of segments, are folded first: the earliest stands for all of them.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilgraph.llm.common import arrow_map, batch_of, bytes_of, sliced, table, written
from veilgraph.llm.near_dedup import mixed

LENGTH, K = 100, 24
#: Segments a bucket is meant to hold; a minimizer with more than HOT is settled in parts first; met more often than OFTEN in a batch, it is known to repeat.
BUCKET, HOT, OFTEN = 12_000, 100_000, 8
#: Bytes of text whose anchors are computed at once: some ten arrays of eight bytes each.
CHUNK = 1 << 20
_POS = np.uint64((1 << 30) - 1)
_ANCHOR = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("run", pa.int64())])
_SEGMENT = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("a", pa.int64()), ("seg", pa.binary())])
_RUN = pa.schema([("doc_id", pa.int64()), ("s", pa.int64()), ("e", pa.int64())])
_PARTLY = pa.schema([("doc_id", pa.int64()), ("s", pa.int64()), ("e", pa.int64()), ("h", pa.int64()), ("seg", pa.binary())])
_KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.binary())])
_SEGMENTS = "h long, doc_id long, a long, seg binary"


def anchors(parts: list[bytes], length: int = LENGTH, k: int = K):
    """(part, first window, last window, hash) of each minimizer's run of windows in the parts, in order."""
    size = np.array([len(p) for p in parts], dtype=np.int64)
    buf = np.frombuffer(b"".join(parts) + bytes(8), dtype=np.uint8)
    n, w = len(buf) - 8, length - k + 1
    none = np.zeros(0, dtype=np.int64)
    if n < length:
        return none, none, none, none
    eight = np.ndarray(shape=(n,), dtype="<u8", buffer=buf, strides=(1,))
    grams = n - k + 1
    h = np.zeros(grams, dtype=np.uint64)
    for i, at in enumerate([*range(0, k - 7, 8), k - 8]):
        h = (h ^ eight[at : at + grams]) * np.uint64((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)[i % 4])
        h ^= h >> np.uint64(29)
    h = mixed(h)
    value = (h & ~_POS) | np.arange(grams, dtype=np.uint64)
    # sliding minimum over w values: minima up to each place from its block's start, and from its block's end
    blocks = -(-grams // w)
    pad = np.full(blocks * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    pad[:grams] = value
    pad = pad.reshape(blocks, w)
    ahead = np.minimum.accumulate(pad, axis=1).ravel()
    behind = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - length + 1
    owner = (np.minimum(behind[:starts], ahead[w - 1 : w - 1 + starts]) & _POS).astype(np.int64)
    ends = np.cumsum(size)
    doc = np.repeat(np.arange(len(parts)), size)
    good = doc[:starts] == doc[length - 1 :]
    change = np.flatnonzero((owner[1:] != owner[:-1]) | (doc[1:starts] != doc[: starts - 1]) | (good[1:] != good[:-1])) + 1
    first = np.concatenate(([0], change))
    last = np.concatenate((change, [starts])) - 1
    first, last = first[good[first]], last[good[first]]
    part = doc[first]
    base = (ends - size)[part]
    return part, first - base, last - base, h[owner[first]].view(np.int64)


def chunks(data: list[bytes], length: int = LENGTH, size: int = CHUNK):
    """(part, offset, bytes): long texts cut into pieces that overlap so that each window lies in exactly one."""
    for i, d in enumerate(data):
        for at in range(0, max(1, len(d) - length + 1), size):
            yield i, at, d[at : at + size + length - 1]


def anchors_of(data: list[bytes], length: int = LENGTH, k: int = K):
    """anchors() of whole texts in bounded memory; a run that a piece's edge cuts counts as two."""
    out, held, size = [], [], 0

    def solve():
        if not held:
            return
        part, a, b, h = anchors([x[2] for x in held], length, k)
        index, base = (np.array([x[j] for x in held], dtype=np.int64) for j in (0, 1))
        out.append((index[part], a + base[part], b + base[part], h))
        held.clear()

    for piece in chunks(data, length):
        held.append(piece)
        size += len(piece[2])
        if size >= CHUNK:
            solve()
            size = 0
    solve()
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else anchors([], length, k)


def suffix_order(buf: np.ndarray, at: np.ndarray, position: np.ndarray, length: int) -> np.ndarray:
    """Order of the suffixes of buf that start at `at`, by their first `length` bytes (prefix doubling), then by position."""
    n = len(buf) - 8
    rank = np.unique(np.ndarray(shape=(n,), dtype="<u8", buffer=buf, strides=(1,)).byteswap(), return_inverse=True)[1]
    have = 8
    while have < length:
        step = min(have, length - have)
        key = rank[: len(rank) - step] * np.int64(len(rank) + 1) + rank[step:]
        rank = np.unique(key, return_inverse=True)[1]
        have += step
    return np.lexsort((position, rank[at]))


def common_prefix(buf: np.ndarray, x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Equal bytes at the places x[i] and y[i] of buf, at most `most`."""
    eight = np.ndarray(shape=(len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))
    out, live = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
    for k in range(0, most, 8):
        apart = eight[x[live] + k] ^ eight[y[live] + k]
        low = apart & (~apart + np.uint64(1))  # its lowest bit tells the first byte that differs
        out[live] = np.where(apart == 0, k + 8, k + np.log2(np.maximum(low, 1).astype(float)).astype(np.int64) // 8)
        live = live[apart == 0]
        if not len(live):
            break
    return np.minimum(out, most)


def nearest_smaller(position: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each suffix, in suffix order, its common prefix with the nearest one before it of smaller position (0: none).

    lcp[i] is the common prefix of suffixes i - 1 and i. All pointers jump together over what is not smaller: what
    lies between a suffix and the one it points to is never smaller, so the rounds grow with the logarithm.
    """
    to, least = np.arange(len(position)) - 1, lcp.copy()
    live = np.flatnonzero(to >= 0)
    while len(live):
        live = live[position[to[live]] >= position[live]]
        over = to[live]
        least[live] = np.minimum(least[live], least[over])
        to[live] = to[over]
        live = live[to[live] >= 0]
    least[to < 0] = 0
    return least


def longest_previous(segments: list[bytes], windows: np.ndarray, position: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """LPF, up to `length`, of all windows, segment by segment: the longest prefix of a window that another one of
    smaller position has too. windows[i] of segment i start at positions position[i], position[i] + 1, ...

    The nearest smaller positions before and after a window in suffix order hold its longest earlier matches.
    """
    total = int(windows.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    size = np.array([len(s) for s in segments], dtype=np.int64)
    buf = np.frombuffer(b"".join(segments) + bytes(length + 16), dtype=np.uint8)
    offset = np.arange(total) - np.repeat(np.cumsum(windows) - windows, windows)
    at, p = np.repeat(np.cumsum(size) - size, windows) + offset, np.repeat(position, windows) + offset
    order = suffix_order(buf, at, p, length)
    start, place = at[order], p[order]
    lcp = np.concatenate(([0], common_prefix(buf, start[:-1], start[1:], length)))
    before = nearest_smaller(place, lcp)
    after = nearest_smaller(place[::-1], np.concatenate(([0], lcp[:0:-1])))[::-1]
    out = np.empty(total, dtype=np.int64)
    out[order] = np.maximum(before, after)
    return out


def earlier(segments: list[bytes], windows: np.ndarray, position: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each segment, the offsets of its windows whose longest previous factor reaches `length`."""
    found = longest_previous(segments, windows, position, length) >= length
    return [np.flatnonzero(x) for x in np.split(found, np.cumsum(windows)[:-1])]


def _runs(offsets: np.ndarray):
    """(first, last) of each run of consecutive numbers."""
    if not len(offsets):
        return []
    cut = np.flatnonzero(np.diff(offsets) > 1) + 1
    return [(int(x[0]), int(x[-1])) for x in np.split(offsets, cut)]


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else schema.empty_table()


def suffix_dedup(docs: DataFrame, length: int = LENGTH, k: int = K, bucket: int = BUCKET, hot: int = HOT, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): the removed byte runs [start, stop) and the bytes that are left, for every row.

    A null text is empty. Rows that share an id stand at one place: neither is earlier than the other. A row without
    an id takes no part and keeps its bytes. Texts shorter than `length` keep theirs. An empty table gives no rows.
    A later exact copy of a whole text is removed whole (each of its windows starts earlier in the first copy). With
    `carry`, these columns of each row are given back too, as a struct `row`, and what is left as `text`: bytes of a
    character that a cut has split go with it.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *([F.struct(*carry).alias("row")] if carry else []))
    copies = picked.where((F.octet_length("text") >= length) & F.col("doc_id").isNotNull()).groupBy(F.sha2("text", 256).alias("key")).agg(F.min("doc_id").alias("first"))
    firsts = written(copies.select(F.col("first").alias("doc_id")).distinct(), "firsts").withColumn("first", F.lit(True))
    # the texts, bucketed by id once: both later joins then move only their small side
    name = f"suffix_texts_{uuid.uuid4().hex}"
    # (a merge join at every size: `firsts` grows with the input, so it is never broadcast)
    picked.join(firsts.hint("merge"), "doc_id", "left").write.bucketBy(parts, "doc_id").saveAsTable(name)
    texts = spark.table(name)

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        part, a, b, h = anchors_of(bytes_of(batch.column("text")), length, k)
        doc = np.asarray(batch.column("doc_id"))[part]
        _, back, count = np.unique(h, return_inverse=True, return_counts=True)
        known = count[back] > OFTEN
        key = np.where(known, mixed(h.view(np.uint64) ^ mixed(doc.view(np.uint64) * np.uint64(31) + a.view(np.uint64))).view(np.int64), h)
        run = a * 128 + (b - a)
        extra = np.flatnonzero(known)[np.unique(back[known], return_index=True)[1]]  # one witness a hash, under its own key
        return batch_of(_ANCHOR, np.concatenate((key, h[extra])), np.concatenate((doc, doc[extra])), np.concatenate((np.where(known, -run - 1, run), -run[extra] - 1)))

    found = arrow_map(texts.where("first"), find, "key long, doc_id long, run long")
    again = found.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("run < 0 or n > 1")
    runs = again.groupBy("doc_id").agg(F.collect_set(F.when(F.col("run") < 0, -F.col("run") - 1).otherwise(F.col("run"))).alias("runs"))

    def cut(batches):
        for batch in batches:
            for piece in sliced(batch, "text", 4 << 20):
                data, ids = bytes_of(piece.column("text")), np.asarray(piece.column("doc_id"))
                part, a, b, h = anchors_of(data, length, k)
                wanted = piece.column("runs")
                listed = np.asarray(wanted.flatten())
                owner = np.repeat(np.arange(len(data)), np.diff(np.asarray(wanted.offsets)))
                # runs of a part as one number each: part in the high bits
                mine = np.isin(part << 40 | a, owner << 40 | listed >> 7)
                part, a, b, h = part[mine], a[mine], b[mine], h[mine]
                segs = [data[p][x : y + length] for p, x, y in zip(part.tolist(), a.tolist(), b.tolist(), strict=True)]
                yield batch_of(_SEGMENT, h, ids[part], a, segs)

    def single(batches):
        for batch in batches:
            for piece in sliced(batch, "seg", 1 << 18):
                doc, a, seg = (piece.column(c).to_pylist() for c in ("doc_id", "a", "seg"))
                rows = [(xxhash.xxh3_64_intdigest(s[o : o + length]) - (1 << 63), d, x + o, s[o : o + length]) for d, x, s in zip(doc, a, seg, strict=True) for o in range(len(s) - length + 1)]
                yield batch_of(_SEGMENT, *zip(*rows, strict=True))

    def settle(part: pa.Table) -> tuple[list[tuple], list[tuple]]:
        """(removed runs (doc_id, first, last), runs of windows that are left: (h, doc_id, first, bytes)) of some segments.

        Identical segments first: the earliest stands for all, the others are removed whole.
        """
        doc, a, seg = np.asarray(part.column("doc_id")), np.asarray(part.column("a")), part.column("seg").to_pylist()
        order = np.lexsort((a, doc)).tolist()
        head: dict[bytes, int] = {}
        out: list[tuple] = []
        for i in order:
            j = head.setdefault(seg[i], i)
            if j != i and (doc[j], a[j]) != (doc[i], a[i]):
                out.append((int(doc[i]), int(a[i]), int(a[i]) + len(seg[i]) - length))
        rest = list(head.values())
        # positions as one number that keeps the order of (doc_id, start)
        ids = np.unique(doc[rest], return_inverse=True)[1].astype(np.int64)
        flat = ids * (int(a.max()) + 1000) + a[rest]
        windows = np.array([len(seg[i]) - length + 1 for i in rest], dtype=np.int64)
        h, left = part.column("h").to_pylist(), []
        for i, n, offsets in zip(rest, windows.tolist(), earlier([seg[i] for i in rest], windows, flat, length), strict=True):
            out += [(int(doc[i]), int(a[i]) + x, int(a[i]) + y) for x, y in _runs(offsets)]
            left += [(h[i], int(doc[i]), int(a[i]) + x, seg[i][x : y + length]) for x, y in _runs(np.setdiff1d(np.arange(n), offsets))]
        return out, left

    def final(part: pa.Table) -> pa.Table:
        return _table(_RUN, settle(part)[0])

    def partly(part: pa.Table) -> pa.Table:
        out, left = settle(part)
        return _table(_PARTLY, [(*r, None, None) for r in out] + [(d, a, None, h, seg) for h, d, a, seg in left])

    segments = written(texts.where("first").join(runs.hint("merge"), "doc_id").select("doc_id", "text", "runs").mapInArrow(cut, _SEGMENTS), "segments")
    removed, fine = None, False
    while True:
        buckets = max(1, -(-segments.count() // bucket))
        counts = segments.groupBy("h").count().where(F.col("count") > hot)
        many = written(counts.select("h", F.ceil(F.col("count") / bucket).alias("cuts")), "hot")
        some = many.count()
        calm = segments.join(many, "h", "left_anti") if some else segments
        done = calm.withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets))).groupBy("bucket").applyInArrow(final, "doc_id long, s long, e long")
        removed = done if removed is None else removed.union(done)
        if not some:
            break
        # hot minimizers in parts: a window that a part removes has an equal earlier one among those that the part leaves,
        # so only what is left meets in the next round
        hotter = written(segments.join(F.broadcast(many) if some < 10_000 else many, "h").select("h", "doc_id", "a", "seg", F.pmod(F.xxhash64("doc_id", "a"), F.col("cuts")).alias("cut")), "hot-segments")
        parts_done = written(hotter.groupBy("h", "cut").applyInArrow(partly, "doc_id long, s long, e long, h long, seg binary"), "hot-parts")
        removed = removed.union(parts_done.where("seg is null").select("doc_id", "s", "e"))
        left = parts_done.where("seg is not null").select("h", "doc_id", F.col("s").alias("a"), "seg")
        if not fine and 2 * left.count() > hotter.count():  # they differ: from now on windows are dealt by all their bytes
            fine = True
            left = left.select("doc_id", "a", "seg").mapInArrow(single, _SEGMENTS)
        segments = written(left, "segments")
    by_doc = removed.groupBy("doc_id").agg(F.collect_list(F.struct("s", "e")).alias("runs"))

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for doc, data, first, runs in zip(batch.column("doc_id").to_pylist(), bytes_of(batch.column("text")), batch.column("first").to_pylist(), batch.column("runs").to_pylist(), strict=True):
            spans: list[list[int]] = [[0, len(data)]] if not first and doc is not None and len(data) >= length else []
            for s, e in sorted((r["s"], r["e"] + length) for r in runs or ()):
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], e)
                else:
                    spans.append([s, e])
            kept, at = [], 0
            for s, e in spans:
                kept.append(data[at:s])
                at = e
            out.append((doc, len(data), [{"start": s, "stop": e} for s, e in spans], b"".join(kept) + data[at:]))
        done = batch_of(_KEPT, *zip(*out, strict=True))
        if not carry:
            return done
        texts = pa.array([x.decode("utf-8", "ignore") for x in done.column("kept").to_pylist()], pa.string())
        return done.append_column("row", batch.column("row")).append_column("text", texts)

    kind = "doc_id long, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary"
    both = texts.join(by_doc.hint("merge"), "doc_id", "left").select("doc_id", "text", "first", "runs", *(["row"] if carry else []))
    return arrow_map(both, finish, f"{kind}, row {both.schema['row'].dataType.simpleString()}, text string" if carry else kind)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    length = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    return out.select("doc_id", "n_bytes", length.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
