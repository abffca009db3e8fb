"""Operator 10, token-id output: a content-addressed store.

Layout under one folder, all Parquet (readable by any Spark reader):
  pieces/kind=0   (key: 16-byte BLAKE2b of the payload, n: ids, payload: little-endian ids) - each unique chunk once
  recipes         (doc_id, start, n_tokens, digests: 16 bytes a chunk, chunks: their lengths, then their CRCs, root)
                  in ascending doc_id order
  manifest        (part, n_docs, n_tokens, root): a Merkle root over the documents that start in each stretch of ids
A rolling hash over the ids cuts the streams, so equal passages give equal chunks wherever they stand.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.llm.common import arrow_map, batch_of, per_task, running_start, shared_dir, table
from veilgraph.llm.tokens import encoder_for

WINDOW, LEAST, MEAN_BITS, MOST = 8, 128, 9, 4096
_FACTORS = (np.uint64(0x9E3779B97F4A7C15) ** np.arange(1, WINDOW + 1, dtype=np.uint64)).astype(np.uint64)
#: Ids whose documents' roots make one entry of the manifest.
PART = 1 << 22
_PIECE = pa.schema([("kind", pa.int32()), ("key", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int64()), ("payload", pa.binary()), ("root", pa.binary()), ("chunks", pa.binary())])
_KIND = "kind int, key binary, doc_id long, n long, payload binary, root binary, chunks binary"
_MANIFEST = pa.schema([("part", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("root", pa.binary())])
_GROUP = pa.schema([("g", pa.int64()), ("root", pa.binary())])
_IDS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
_CHECKED = pa.schema([("key", pa.binary()), ("n", pa.int64()), ("crc", pa.int64())])
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def digest(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Pairwise root; an odd last node moves up as it is; no leaves give the digest of nothing."""
    if not leaves:
        return digest(b"")
    while len(leaves) > 1:
        leaves = [digest(leaves[i] + leaves[i + 1]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0]


def marks(ids: np.ndarray) -> np.ndarray:
    """Ends where a chunk may end: the hash of the last WINDOW ids has MEAN_BITS zero bits at its top."""
    n = len(ids)
    if n < WINDOW:
        return np.zeros(0, dtype=np.int64)
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    h = np.zeros(n - WINDOW + 1, dtype=np.uint64)
    for k, f in enumerate(_FACTORS):
        h += x[k : n - WINDOW + 1 + k] * f
    return np.flatnonzero((h >> np.uint64(64 - MEAN_BITS)) == 0) + WINDOW


def cuts(n: int, may: list[int]) -> list[int]:
    """Ends of the chunks of a stream of n ids: at marks, within LEAST and MOST ids (the last chunk may be shorter)."""
    ends, last = [], 0
    for end in may:
        while end - last > MOST:
            last += MOST
            ends.append(last)
        if end - last >= LEAST:
            ends.append(end)
            last = end
    while n - last > MOST:
        last += MOST
        ends.append(last)
    return ends + [n] if last < n or not ends else ends


_SHIFT: list[np.ndarray] = []


def _shifts(k: int) -> np.ndarray:
    """Four tables of 256 numbers that move a CRC-32 past 2**k zero bytes, a byte of the CRC each."""
    while len(_SHIFT) <= k:
        if _SHIFT:
            column = _moved(_moved(np.uint32(1) << np.arange(32, dtype=np.uint32), len(_SHIFT) - 1), len(_SHIFT) - 1)
        else:
            column = np.uint32(1) << np.arange(32, dtype=np.uint32)
            for _ in range(8):
                column = (column >> np.uint32(1)) ^ np.where(column & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
        tables = np.zeros((4, 256), dtype=np.uint32)
        for bit in range(32):
            tables[bit // 8] ^= np.where(np.arange(256) >> (bit % 8) & 1, column[bit], 0).astype(np.uint32)
        _SHIFT.append(tables)
    return _SHIFT[k]


def _moved(crc: np.ndarray, k: int) -> np.ndarray:
    t = _shifts(k)
    return t[0][crc & 255] ^ t[1][crc >> 8 & 255] ^ t[2][crc >> 16 & 255] ^ t[3][crc >> 24]


def crc_moved(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """CRC-32 values moved past so many zero bytes. That of A + B is that of A moved past B's bytes, xor that of B."""
    crc, k = crc.astype(np.uint32), 0
    while (zeros >> k).any():
        some = np.flatnonzero(zeros >> k & 1)
        crc[some] = _moved(crc[some], k)
        k += 1
    return crc


def write_store(docs: DataFrame, path: str, vocab: str = "byte_bpe_50k.json", end_id: int = 2, doc_id: str = "doc_id", text: str = "text", width: str = "<u2") -> bytes:
    """Encodes every text (null: empty), appends `end_id`, and writes the store; returns the manifest's root.

    One shuffle by chunk digest: each task sends a chunk once, and a chunk that many documents share meets as one row
    a task. Rows with a null id come first; repeated rows share all chunks and have a recipe each; an empty table
    gives an empty store. `width` is the stored id type, '<u2' for vocabularies up to 65,536 ids, else '<u4'.
    """
    spark = docs.sparkSession

    @per_task
    def task():
        encoder = encoder_for(vocab)
        sent: set[bytes] = set()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, size = encoder.encode(batch.column("text"))
            ids = np.insert(ids, np.cumsum(size), end_id).astype("<u4")
            size = size + 1
            # one pass of the rolling hash over all streams; marks whose window starts in another document don't count
            base = np.cumsum(size) - size
            may = marks(ids)
            split = np.searchsorted(may, np.column_stack((base + WINDOW, base + size + 1))).tolist()
            flat, wide, may, four = memoryview(ids.astype(width).tobytes()), np.dtype(width).itemsize, may.tolist(), memoryview(ids.tobytes())
            new_keys, new_sizes, payloads = [], [], []
            names, sizes, crcs, roots, docs = [], [], [], [], batch.column("doc_id")
            for at, n, (lo, hi) in zip(base.tolist(), size.tolist(), split, strict=True):
                first, mine, ends = 0, [], cuts(n, [x - at for x in may[lo:hi]])
                for stop in ends:
                    payload = flat[(at + first) * wide : (at + stop) * wide]
                    name = digest(payload)
                    mine.append(name)
                    crcs.append(zlib.crc32(four[(at + first) * 4 : (at + stop) * 4]))
                    if name not in sent:
                        sent.add(name)
                        new_keys.append(name)
                        new_sizes.append(stop - first)
                        payloads.append(bytes(payload))
                    first = stop
                names.append(b"".join(mine))
                roots.append(merkle(mine))
                sizes.append(np.diff(ends, prepend=0))
            if len(sent) > 200_000:
                sent.clear()
            many = [len(x) // 16 for x in names]
            lens, sums = np.concatenate(sizes).astype("<u4"), np.array(crcs, dtype="<u4")
            stop = np.cumsum(many) * 4
            lens, sums = lens.tobytes(), sums.tobytes()
            extra = [lens[b - 4 * m : b] + sums[b - 4 * m : b] for b, m in zip(stop.tolist(), many, strict=True)]
            k, d = len(new_keys), len(names)
            return batch_of(
                _PIECE,
                np.repeat(np.array([0, 1], dtype=np.int32), [k, d]),
                new_keys + [digest(str(x).encode()) for x in docs.to_pylist()],
                pa.concat_arrays([pa.nulls(k, pa.int64()), docs]),
                np.concatenate((np.array(new_sizes, dtype=np.int64), size)),
                payloads + names,
                [None] * k + roots,
                [None] * k + extra,
            )

        return step

    def once(batches):
        last = None
        for batch in batches:  # sorted: copies of a chunk follow one another
            key, kind = batch.column("key"), np.asarray(batch.column("kind"))
            keep = kind == 1
            if len(keep):
                same = np.asarray(pc.equal(key[1:], key[:-1]).fill_null(False).to_numpy(zero_copy_only=False))
                keep[1:] |= ~same
                keep[0] |= key[0].as_py() != last
                last = key[-1].as_py() if kind[-1] == 0 else None
                yield batch.filter(pa.array(keep))

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = arrow_map(picked, task, _KIND, limit=4 << 20)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces.repartition(parts, "kind", "key").sortWithinPartitions("kind", "key").mapInArrow(once, _KIND).write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/pieces")

    recipes = spark.read.schema(_KIND).parquet(f"{path}/pieces").where("kind = 1").select("doc_id", "n", "payload", "root", "chunks")
    started = running_start(recipes, ["doc_id", "root"], "n", "start")
    started.select("doc_id", "start", F.col("n").alias("n_tokens"), F.col("payload").alias("digests"), "chunks", "root").repartitionByRange(parts, "start").sortWithinPartitions("start").write.parquet(f"{path}/recipes")
    _roots(spark.read.parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")
    return _root(spark.read.parquet(f"{path}/manifest"))


def _roots(recipes: DataFrame) -> DataFrame:
    """(part, n_docs, n_tokens, root): the Merkle root over the documents that start in each stretch of PART ids."""

    def one(some: pa.Table) -> pa.Table:
        some = some.sort_by("start")
        n = sum(some.column("n_tokens").to_pylist())
        return pa.table([[some.column("part")[0].as_py()], [some.num_rows], [n], [merkle(some.column("root").to_pylist())]], schema=_MANIFEST)

    rows = recipes.select(F.expr(f"start div {PART}").alias("part"), "start", "n_tokens", "root")
    return rows.groupBy("part").applyInArrow(one, "part long, n_docs long, n_tokens long, root binary")


def _root(manifest: DataFrame) -> bytes:
    """One root over all parts: those of 4,096 parts each are joined on the executors."""

    def one(some: pa.Table) -> pa.Table:
        some = some.sort_by("part")
        leaves = [digest(b"%d %d %d %s" % r) for r in zip(*(some.column(c).to_pylist() for c in ("part", "n_docs", "n_tokens", "root")), strict=True)]
        return pa.table([[some.column("part")[0].as_py() >> 12], [merkle(leaves)]], schema=_GROUP)

    groups = manifest.withColumn("g", F.expr("part div 4096")).groupBy("g").applyInArrow(lambda t: one(t.drop(["g"])), "g long, root binary")
    return merkle([bytes(r["root"]) for r in sorted(groups.collect(), key=lambda r: r["g"])])


def verify_store(spark: SparkSession, path: str, root: bytes | None = None, width: str = "<u2") -> None:
    """Raises ValueError unless the store is whole: every chunk hashes to its name, every recipe lists chunks that are
    there with the length and CRC that it states, and the recipes give the manifest's roots and (if given) `root`."""

    def checked(batches):
        for batch in batches:
            crcs = []
            for key, n, payload in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "payload")), strict=True):
                ids = np.frombuffer(payload, dtype=width)
                if digest(payload) != key or len(ids) != n:
                    raise ValueError(f"chunk {key.hex()} is damaged")
                crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield batch_of(_CHECKED, batch.column("key"), batch.column("n"), crcs)

    def listed(batch: pa.RecordBatch) -> pa.RecordBatch:
        # each distinct chunk once a batch: one that very many documents share never meets as many rows
        names, sizes, crcs = set(), [], []
        for digests, chunks in zip(batch.column("digests").to_pylist(), batch.column("chunks").to_pylist(), strict=True):
            both = np.frombuffer(chunks, dtype="<u4").reshape(2, -1)
            names.update(zip((digests[i : i + 16] for i in range(0, len(digests), 16)), both[0].tolist(), both[1].tolist(), strict=True))
        names, sizes, crcs = zip(*names, strict=True) if names else ((), (), ())
        return batch_of(_CHECKED, list(names), list(sizes), list(crcs))

    same = ["key", "n", "crc"]
    there = spark.read.schema(_KIND).parquet(f"{path}/pieces").where("kind = 0").select("key", "n", "payload").mapInArrow(checked, "key binary, n long, crc long")
    recipes = spark.read.parquet(f"{path}/recipes")
    named = arrow_map(recipes.select("digests", "chunks"), listed, "key binary, n long, crc long", column="digests").distinct()
    if lost := named.join(there, same, "left_anti").limit(1).collect():
        raise ValueError(f"chunk {bytes(lost[0]['key']).hex()} is missing, or not as a recipe states it")
    kept, found = spark.read.parquet(f"{path}/manifest"), _roots(recipes)
    cells = lambda df, c: df.select("part", F.struct("n_docs", "n_tokens", "root").alias(c))
    other = cells(kept, "a").join(cells(found, "b"), "part", "full").where(~F.col("a").eqNullSafe(F.col("b"))).limit(1).collect()
    if other:
        raise ValueError(f"the recipes of part {other[0]['part']} are not those of the manifest")
    if root is not None and _root(kept) != root:
        raise ValueError("the manifest is not the one that was written")


def read_store(spark: SparkSession, path: str, root: bytes | None = None, width: str = "<u2") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files alone, after verify_store() has found them whole.

    Chunks stay where they are: a document's CRC follows from the lengths and CRCs of its chunks, which have been
    held against the payloads. Every document's own Merkle root and length are compared; a difference raises.
    """
    verify_store(spark, path, root, width)

    def joined(batch: pa.RecordBatch) -> pa.RecordBatch:
        many, sizes, crcs = [], [], []
        for doc, n, digests, own, chunks in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "digests", "root", "chunks")), strict=True):
            both = np.frombuffer(chunks, dtype="<u4").reshape(2, -1)
            if merkle([digests[i : i + 16] for i in range(0, len(digests), 16)]) != own or int(both[0].sum()) != n or len(both[0]) * 16 != len(digests):
                raise ValueError(f"document {doc} cannot be rebuilt")
            many.append(len(both[0]))
            sizes.append(both[0])
            crcs.append(both[1])
        size, crc = np.concatenate(sizes).astype(np.int64) * 4, np.concatenate(crcs)
        first = np.cumsum(many) - many
        done = np.cumsum(size)
        after = np.repeat(done[first + many - 1], many) - done  # bytes of the document behind each chunk
        whole = np.bitwise_xor.reduceat(crc_moved(crc, after), first)
        return batch_of(_READ, batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), whole.astype(np.int64))

    return arrow_map(spark.read.parquet(f"{path}/recipes"), joined, "doc_id long, start long, n_tokens long, ids_crc32 long", column="digests", limit=1 << 20)


def rebuilt(spark: SparkSession, path: str, width: str = "<u2") -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document's ids as little-endian unsigned 32-bit bytes, put together from
    its chunks. A document's chunks meet in one row, as long as the document."""

    def joined(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [b"".join(np.frombuffer(c["payload"], dtype=width).astype("<u4").tobytes() for c in sorted(x, key=lambda c: c["pos"])) for x in batch.column("chunks").to_pylist()]
        return batch_of(_IDS, batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), ids)

    chunks = spark.read.schema(_KIND).parquet(f"{path}/pieces").where("kind = 0").select("key", "payload")
    at = F.posexplode(F.transform(F.sequence(F.lit(0), (F.length("digests") / 16 - 1).cast("int")), lambda k: F.substring("digests", k * 16 + 1, F.lit(16))))
    parts = spark.read.parquet(f"{path}/recipes").select("doc_id", "start", "n_tokens", at.alias("pos", "key"))
    whole = parts.join(chunks, "key").groupBy("doc_id", "start", "n_tokens").agg(F.collect_list(F.struct("pos", "payload")).alias("chunks"))
    return whole.mapInArrow(lambda batches: map(joined, batches), "doc_id long, start long, n_tokens long, ids binary")


def op10_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-store-{uuid.uuid4().hex}"
    root = write_store(table(spark, sf_dir, "documents"), path)
    return read_store(spark, path, root)
