import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from veilgraph.llm import near_dedup as nd
from veilgraph.llm.graph import components


def brute(rows, percent=85):
    def tokens(t):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").translate({i: " " for i in range(9, 14)}).split(" ")

    sets = {}
    for d, t, *_ in rows:
        w = [x for x in tokens(t) if x]
        sets[d] = set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return sorted((d, len(sets[d]), top(d), top(d) == d) for d in ids)


def made(seed, groups=6, copies=25, words=90):
    """Groups of near copies whose edits straddle the threshold, chains of edits, exact copies, short and blank texts."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(4))
    rows, ids = [], list(range(1, 2000))
    draw.shuffle(ids)
    for g in range(groups):
        base = [word() for _ in range(words)]
        text = list(base)
        for c in range(copies):
            text = list(base) if g % 2 else text
            for _ in range(draw.randint(0, 3)):
                text[draw.randrange(words)] = word()
            rows.append((ids.pop(), " ".join(text)))
            if c % 5 == 0:
                rows.append((ids.pop(), "  " + "\t".join(text).upper()))
    rows += [(ids.pop(), x) for x in (None, "", " \n ", "one two", "One  TWO", "one two three", "É a b c d e", "é a b c d e", "a\x1cb c d e f", "a b c d e f")]
    return rows


@pytest.mark.parametrize(("seed", "tile"), [(1, 512), (2, 16)])
def test_components_equal_brute_force(spark, seed, tile):
    rows = made(seed)
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), tile=tile)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, "a b c d e f", 1), (3, "a b c d e f", 2), (3, "a b c d e f", 2), (9, "x " * 40_000, 3), (5, None, None)]
    got = sorted(map(tuple, nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, n long")).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (3, 2, 3, True), (3, 2, 3, True), (9, 1, 9, True), (5, 0, 5, True)], key=str)
    assert nd.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(4)
    pool = np.unique(rng.integers(0, 2**63, 3000, dtype=np.uint64))
    errors = []
    for j in (0.3, 0.6, 0.85, 0.95):
        inter = int(j * 1000)
        side = (1000 - inter) // 2
        a, b = pool[: inter + side], np.concatenate([pool[:inter], pool[inter + side : inter + 2 * side]])
        ra, rb = nd.sketches([a, b]).astype(np.int32)
        assert (np.maximum(ra, rb) == nd.sketches([np.union1d(a, b)])[0]).all()
        errors.append(abs(nd.likely_jaccard(ra[None], rb[None], np.array([len(a) * 1.0]), np.array([len(b) * 1.0]))[0] - inter / (inter + 2 * side)))
    assert max(errors) < 0.2 and sum(errors) < 0.35


def test_bucket_key_is_sparks(spark):
    regs = np.arange(nd.M).astype(np.int32) * 7
    raw = bytearray(regs.astype("<u2").tobytes())
    df = spark.createDataFrame([(raw,)], "regs binary").select(F.xxhash64(F.lit(3), F.substring("regs", 3 * 2 * nd.ROWS + 1, 2 * nd.ROWS)).alias("k"))
    assert df.first()["k"] == nd._bucket(3, regs)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (300, 200)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100, 300: 100}


def test_query_equals_its_sql(spark, sf_dir):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(duckdb.sql(nd.OP4_SQL).fetchall())
    assert sorted(map(tuple, nd.op4_setsketch_dedup(spark, sf_dir).collect())) == want
