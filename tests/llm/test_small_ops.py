import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import pytest
from tokenizers import Tokenizer

from veilgraph.llm import content_store, knn, packing, sharding
from veilgraph.llm.tokens import vocabulary

DOCS = "doc_id long, text string, shard string"
ODD = [(1, None, "a"), (2, "", "b"), (3, "x" * 50_000, None), (4, "same words here", ""), (4, "same words here", ""), (5, "same words here", "c"), (None, "lone é", "d")]


def plain_ids(name, text, end=2):
    tok = plain_ids.__dict__.setdefault(name, Tokenizer.from_file(vocabulary(name)))
    return np.array(tok.encode(text or "", add_special_tokens=False).ids + [end], dtype="<u4")


# ---- operator 1


def test_shards_hold_every_row_with_gapless_slots(spark, sf_dir):
    out = sharding.op1_shard_packing(spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    assert sorted(out.doc_id) == sorted(docs.doc_id) and set(out.shard) <= set(range(16))
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    crc = {d: zlib.crc32(t.encode()) for d, t in zip(docs.doc_id, docs.text, strict=True)}
    assert all(crc[d] == c for d, c in zip(out.doc_id, out.text_crc32, strict=True))


def test_shards_are_even_with_one_hot_group(spark):
    draw = random.Random(3)
    rows = [(i, "hot copy of one text " * 4 if i % 3 == 0 else "w" * draw.randint(1, 400)) for i in range(20_000)]
    out = sharding.pack_shards(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    by = out.groupby("shard").agg({"size": "sum", "tokens": "sum", "slot": "count"})
    assert len(by) == 16 and len(out) == 20_000
    assert (by["size"].max() / by["size"].mean() < 1.01) and (by["slot"].max() / by["slot"].mean() < 1.1)


def test_shards_odd_rows_and_none(spark):
    out = sharding.pack_shards(spark.createDataFrame(ODD, DOCS)).toPandas()
    assert len(out) == 7 and out["size"].sum() == sum(len((t or "").encode()) + 1 for _, t, _ in ODD)
    assert sharding.pack_shards(spark.createDataFrame([], DOCS)).count() == 0


def test_place_uses_dot_product_and_fits():
    v = np.array([[5, 1, 1], [1, 5, 1], [1, 1, 5]] * 4, dtype=float)
    load = np.zeros((4, 3))
    np.add.at(load, sharding.place(v, 4), v)
    assert (load == 7).all()


# ---- operator 2


def brute(rows, k=5, step=50):
    v = {i: np.floor(256 * np.array(x, dtype=np.float64)).astype(np.int64) for i, x in rows if i is not None and x is not None and not any(c is None or not np.isfinite(c) for c in x)}
    out = []
    for q in sorted(v):
        if q % step == 0:
            best = sorted(((-int(v[q] @ v[i]), i) for i in v if i != q))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


@pytest.mark.parametrize("blocks", [(8192, 1024), (7, 2)])
def test_knn_equals_brute_force_with_ties(spark, blocks):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 8))
    rows = [(i, (base[i % 6] + rng.normal(size=8) * (0 if i % 3 == 0 else 0.05)).astype(float).tolist()) for i in range(300)]
    rows += [(400, None), (450, [1.0, None] + [0.0] * 6), (None, [0.0] * 8), (500, [float("nan")] * 8), (550, [float("inf")] + [0.0] * 7), (600, [0.0] * 8)]
    data = knn.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = knn.voronoi_knn(data, data.where("vec_id % 50 = 0"), pivots=6, reducers=3, block=blocks[0], query_block=blocks[1])
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_knn_prunes_far_cells(spark):
    rows = [(i, [100.0 + i % 7, 0.0] if i < 100 else [0.0, 1.0 + i % 5]) for i in range(200)]
    data = knn.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = knn.voronoi_knn(data, data.where("vec_id % 50 = 0"))
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_knn_with_an_id_in_more_rows_than_k(spark):
    rows = [(0, [100.0, 0.0])] * 7 + [(i, [0.0, 1.0 + i % 5]) for i in range(1, 194)]
    data = knn.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = knn.voronoi_knn(data, data.where("vec_id = 0").limit(1))
    assert sorted(map(tuple, got.collect())) == [(0, r, r, 0) for r in range(1, 6)]


def test_knn_empty_and_few(spark):
    kind = "vec_id long, embedding array<float>"
    none = knn.quantized(spark.createDataFrame([], kind))
    assert knn.voronoi_knn(none, none).count() == 0
    two = knn.quantized(spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5])], kind))
    assert [tuple(r) for r in knn.voronoi_knn(two, two.where("vec_id = 0")).collect()] == [(0, 1, 1, 256 * 128 + 512 * 128)]


def test_knn_with_many_blocks_repeated_ids_and_other_columns(spark):
    rng = np.random.default_rng(6)
    rows = [(int(i % 350), rng.normal(size=6).tolist(), "x") for i in range(700)]
    data = knn.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string"))
    got = sorted(map(tuple, knn.voronoi_knn(data, data.where("vec_id % 50 = 0").dropDuplicates(["vec_id"]), pivots=9, reducers=4, block=40, query_block=3).collect()))
    v = [(i, np.floor(256 * np.array(x)).astype(np.int64)) for i, x, _ in rows]
    asked = {r.vec_id: np.array(r.v) for r in data.where("vec_id % 50 = 0").dropDuplicates(["vec_id"]).collect()}
    want = []
    for q, x in asked.items():
        best = sorted((-int(x @ y), i) for i, y in v if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert [g[:2] + g[3:] for g in got] == sorted((q, n, s) for q, n, _, s in want)


def test_knn_joins_groups_that_need_the_same_rows_only():
    counts = np.full((4, 10), 100)
    everything, own = np.tile([0.0, 10.0], (4, 4, 1)), np.tile([9.0, -1.0], (4, 4, 1))
    own[np.arange(4), np.arange(4)] = [0.0, 10.0]
    first = np.array([0, 1, 2, 2])
    assert set(knn.joined_groups(everything, first, counts, 1.0)) == {0}
    assert knn.joined_groups(own, first, counts, 1.0).tolist() == [0, 1, 2, 2]


@pytest.mark.parametrize("top", [3, 1000, 10**5, 10**9])
def test_knn_picks_the_best_without_sorting_scores(monkeypatch, top):
    """Ties and own ids over several runs, in floats, doubles and integers."""
    rng = np.random.default_rng(top)
    x, q = rng.integers(-top, top + 1, (300, 3)), rng.integers(-top, top + 1, (9, 3))
    x[::2] = x[0]
    ids, asked = np.sort(rng.integers(0, 300, 300)), rng.integers(0, 303, 9)
    kind = knn.exact_kind(q, x)
    assert kind == {3: np.float32, 1000: np.float32, 10**5: np.float64, 10**9: np.int64}[top]
    want = []
    for i in range(9):
        best = sorted((-int(x[j] @ q[i]), j) for j in range(300) if ids[j] != asked[i])[:7]
        want += [(i, j, -s) for s, j in best]
    monkeypatch.setattr(np, "argsort", None)
    got = knn.nearest(q.astype(kind), asked, x.astype(kind), ids, 7)
    assert list(zip(*(c.tolist() for c in got), strict=True)) == want


@pytest.mark.parametrize("part", ["float", "double"])
def test_knn_vectors_that_take_part(spark, part):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [0.5, -0.001]), (1, []), (2, None), (3, [None]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [1.0, inf]), (7, [-inf, 1.0]), (8, [nan, None, inf]), (None, [1.0])]
    got = knn.quantized(spark.createDataFrame(rows, f"vec_id long, embedding array<{part}>"))
    assert sorted(map(tuple, got.collect())) == [(0, [128, -1]), (1, [])]


def test_knn_query_equals_its_sql(spark, sf_dir):
    for t in ("embeddings",):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert sorted(map(tuple, knn.op2_voronoi_knn(spark, sf_dir).collect())) == sorted(duckdb.sql(knn.OP2_SQL).fetchall())


# ---- operator 7


def packed_right(rows, pieces, window):
    want = sorted((d is not None, d or 0, zlib.crc32(plain_ids("word_bpe_49k.json", t).tobytes())) for d, t, *_ in rows)
    texts = {}
    for d, t, *_ in rows:
        texts.setdefault(d, []).append(plain_ids("word_bpe_49k.json", t))
    by_sequence, covered = {}, {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
        covered.setdefault(p.doc_id, []).append(p)
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    for d, ids in texts.items():
        assert sum(p.length for p in covered[d]) == sum(map(len, ids))
        if len(ids) == 1:
            at = 0
            for p in sorted(covered[d], key=lambda p: p.start):
                assert p.start == at and p.ids_crc32 == zlib.crc32(ids[0][at : at + p.length].tobytes()) and p.doc_tokens == len(ids[0])
                at += p.length
    assert want
    return padding


def test_packing_covers_every_id_once(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert packed_right(rows, packing.op7_bm25_packing(spark, sf_dir).collect(), 4096) == 0
    few = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    assert packed_right(rows, packing.bm25_packing(few, window=64, block=20_000).collect(), 64) == 0


def test_packing_odd_rows_and_none(spark):
    assert packed_right(ODD, packing.bm25_packing(spark.createDataFrame(ODD, DOCS)).collect(), 4096) == 0
    assert packing.bm25_packing(spark.createDataFrame([], DOCS)).count() == 0


def order_of(texts, window):
    return list(packing.reading_order(packing.shard_of(texts), np.full(len(texts), 3), window))


def test_neighbours_share_rare_words():
    assert order_of(["apple pear plum", "engine wheel brake", "apple plum cherry", "wheel brake oil", "other things"], 100) == [0, 2, 1, 3, 4]


def test_seed_asks_with_all_its_words():
    rare, common = [f"rare{k}" for k in range(10)], [f"word{k}" for k in range(60)]
    texts = [" ".join(rare + common)] + [f"{r} " + " ".join(f"own{k}x{j}" for j in range(40)) for k, r in enumerate(rare)]
    texts += [" ".join(common), " ".join(common + [f"more{j}" for j in range(400)])]
    assert order_of(texts, 1000)[:2] == [0, 11]


def test_scores_are_bm25():
    draw = random.Random(2)
    texts = [" ".join(draw.choices([f"w{j}" for j in range(80)], [1 / (j + 1) for j in range(80)], k=draw.randint(0, 60))) for _ in range(150)]
    shard, lists = packing.shard_of(texts), [x.split() for x in texts]
    mean = sum(map(len, lists)) / len(lists)
    for seed in range(0, 150, 30):
        got = shard.scores(seed)
        for d, have in enumerate(lists):
            want = 0.0
            for t in set(lists[seed]):
                df, tf = sum(t in w for w in lists), have.count(t)
                if df > 1 and tf:
                    want += np.log1p((len(lists) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(have) / mean))
            assert got[d] == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_statistics_cover_all_documents(spark):
    texts = ["One two, two", "two three", None, "", "ÉTÉ été one"] * 30
    df, n, mean = packing.statistics(spark.createDataFrame([(t,) for t in texts], "text string").repartition(7))
    term = lambda w: packing.terms_of(packing.split_of(pa.array([w])))[1][0]
    assert n == 150 and mean == pytest.approx(30 * 8 / 150)
    assert [df[term(w)] for w in ("one", "TWO", "three", "été")] == [60, 60, 30, 30] and df.sum() == 180


def best_by_bm25(texts, seed):
    """Brute force over all documents and all words of the seed."""
    words = [x.split() for x in texts]
    mean = sum(map(len, words)) / len(words)
    score = []
    for d, have in enumerate(words):
        total = 0.0
        for t in set(words[seed]):
            df, tf = sum(t in w for w in words), have.count(t)
            total += np.log1p((len(words) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(have) / mean))
        score.append(-1.0 if d == seed else total)
    return int(np.argmax(score))


def test_packing_does_not_depend_on_the_layout(spark):
    draw = random.Random(8)
    topics = [[f"t{k}w{j}" for j in range(30)] for k in range(12)]
    texts = [" ".join(draw.choices(topics[i % 12], k=20) + draw.choices([f"all{j}" for j in range(50)], k=20)) for i in range(60)]
    rows = list(enumerate(texts))
    for block in (1 << 20, 900):
        got = []
        for parts in (1, 4, 7):
            docs = spark.createDataFrame(spark.sparkContext.parallelize(random.Random(parts).sample(rows, len(rows)), parts), "doc_id long, text string")
            pieces = packing.bm25_packing(docs, window=4096, block=block).collect()
            assert packed_right(rows, pieces, 4096) == 0
            got.append(sorted((p.sequence_id, p.offset, p.doc_id, p.start, p.length, p.ids_crc32) for p in pieces))
        assert got[0] == got[1] == got[2]
        if block == 1 << 20:
            first, second = list(dict.fromkeys(p[2] for p in got[0]))[:2]
            assert second == best_by_bm25(texts, first)


def test_copies_meet_under_one_key(spark):
    draw = random.Random(4)
    prose = lambda: " ".join(f"w{draw.randint(0, 3000)}" for _ in range(120))
    texts = [prose() for _ in range(200)]
    near = [t + " one more word" for t in texts]
    df = np.zeros(1 << packing.TERM_BITS)
    doc, term, _, _ = packing.terms_of(packing.split_of(pa.array(texts + near)))
    df += np.bincount(term, minlength=len(df))
    key = packing.keys_of(doc, term, packing.idf_of(df, 400), 400, 400)
    assert (key[:200] == key[200:]).mean() > 0.9 and len(set(key[:200].tolist())) > 40


# ---- operator 10


def test_crc_joined_and_cuts():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.bytes(int(rng.integers(0, 5000))), rng.bytes(int(rng.integers(0, 5000)))
        moved = content_store.crc_moved(np.array([zlib.crc32(a)]), np.array([len(b)]))
        assert int(moved[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)
    for n in (0, 1, 127, 128, 129, 5000, 60_000):
        for ids in (rng.integers(0, 50_000, n, dtype=np.uint32), np.zeros(n, dtype=np.uint32)):
            ends = content_store.cuts(n, content_store.marks(ids).tolist())
            assert ends[-1] == n and ends == sorted(set(ends)) and max(np.diff([0, *ends])) <= content_store.MOST


def test_store_round_trip(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want, start = [], 0
    for d, t in sorted(rows):
        ids = plain_ids("byte_bpe_50k.json", t)
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, content_store.op10_content_store(spark, sf_dir).collect())) == want


def test_store_keeps_a_chunk_once_and_gives_the_ids_back(spark, tmp_path):
    rows = [(i, "word salad of many parts " * 300 if i % 2 else None, "k") for i in range(40)] + [(None, "x", "y"), (7, "again", "z"), (7, "again", "z")]
    path = f"{tmp_path}/store"
    root = content_store.write_store(spark.createDataFrame(rows, DOCS).repartition(5), path)
    chunks = spark.read.parquet(f"{path}/pieces").where("kind = 0")
    assert chunks.count() == chunks.select("key").distinct().count()
    got = content_store.read_store(spark, path, root).collect()
    assert len(got) == len(rows) and sum(r.n_tokens for r in got) == sum(len(plain_ids("byte_bpe_50k.json", t)) for _, t, _ in rows)
    ids = sorted((r.doc_id or -1, bytes(r.ids)) for r in content_store.rebuilt(spark, path).collect())
    assert ids == sorted((d or -1, plain_ids("byte_bpe_50k.json", t).tobytes()) for d, t, _ in rows)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('kept')}/store"
    rows = [(i, f"text {i} " + "of many parts " * (i * 40), "k") for i in range(12)]
    return path, content_store.write_store(spark.createDataFrame(rows, DOCS).repartition(3), path)


@pytest.mark.parametrize("harm", ["chunk", "lost chunk", "recipe", "lost recipe", "crc", "manifest", "other root"])
def test_store_finds_damage(spark, store, tmp_path, harm):
    path, root = store
    bad = f"{tmp_path}/bad"
    all_parts = ["kind", "key", "doc_id", "n", "payload", "root", "chunks"]
    pieces, recipes, manifest = (spark.read.parquet(f"{path}/{x}") for x in ("pieces", "recipes", "manifest"))
    pieces = pieces.where("kind = 0").select(*all_parts)
    if harm == "chunk":
        pieces = pieces.withColumn("payload", F.expr("concat(payload, X'0000')"))
    elif harm == "lost chunk":
        pieces = pieces.orderBy("key").offset(1)
    elif harm == "recipe":
        recipes = recipes.withColumn("root", F.when(F.col("start") == 0, F.expr("cast('x' as binary)")).otherwise(F.col("root")))
    elif harm == "lost recipe":
        recipes = recipes.where("doc_id <> 5")
    elif harm == "crc":
        recipes = recipes.withColumn("chunks", F.expr("concat(substr(chunks, 1, length(chunks) - 1), X'07')"))
    elif harm == "manifest":
        manifest = manifest.withColumn("n_docs", F.col("n_docs") + 1)
    else:
        root = b"x" * 16
    pieces.write.partitionBy("kind").parquet(f"{bad}/pieces")
    recipes.write.parquet(f"{bad}/recipes")
    manifest.write.parquet(f"{bad}/manifest")
    with pytest.raises(Exception, match="damaged|missing|not those|not the one"):
        content_store.read_store(spark, bad, root).collect()


def test_empty_store(spark, tmp_path):
    content_store.write_store(spark.createDataFrame([], DOCS), f"{tmp_path}/none")
    assert content_store.read_store(spark, f"{tmp_path}/none").count() == 0
