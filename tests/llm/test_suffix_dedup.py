import hashlib
import random

import numpy as np
import pytest

from veilgraph.llm import suffix_dedup as sd


def brute(rows, length=100):
    seen: dict[bytes, tuple] = {}
    texts = [(d, (t or "").encode()) for d, t, *_ in rows]
    for d, data in sorted(texts):
        for s in range(len(data) - length + 1):
            seen.setdefault(data[s : s + length], (d, s))
    out = []
    for d, data in sorted(texts):
        gone = np.zeros(len(data), dtype=bool)
        for s in range(len(data) - length + 1):
            if seen[data[s : s + length]] < (d, s):
                gone[s : s + length] = True
        edge = np.diff(np.concatenate(([0], gone.astype(int), [0])))
        kept = bytes(np.frombuffer(data, dtype=np.uint8)[~gone])
        out.append((d, len(data), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def made(seed):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("aeéstñ") for _ in range(draw.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(40) for _ in range(4)] + ["ab" * 80, "z" * 150]
    rows = []
    for i in range(120):
        bits = [prose(draw.randint(0, 30)) for _ in range(draw.randint(1, 4))]
        for _ in range(draw.randint(0, 3)):
            p = draw.choice(shared)
            cut = draw.randint(0, 60)
            bits.insert(draw.randint(0, len(bits)), p[cut : draw.choice([None, cut + 99, cut + 100, cut + 101])])
        rows.append((i * 7 % 120, " ".join(bits)))
    rows += [(200 + i, rows[i][1]) for i in range(8)] + [(300, None), (301, ""), (302, "q" * 5000), (303, "short"), (304, "short")]
    return rows


def digest(out):
    return sorted((r.doc_id, r.n_bytes, sum(x.stop - x.start for x in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in out.collect())


@pytest.mark.parametrize(("seed", "bucket", "hot", "often"), [(1, 12_000, 100_000, 8), (2, 20, 100_000, 1), (3, 50, 3, 2)])
def test_equals_brute_force(spark, monkeypatch, seed, bucket, hot, often):
    monkeypatch.setattr(sd, "OFTEN", often)
    rows = made(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert digest(sd.suffix_dedup(df, bucket=bucket, hot=hot)) == brute(rows)


def test_odd_rows(spark):
    long = "pq" * 200
    rows = [(None, long, 1), (4, long, 2), (4, long, 2), (2, None, 3)]
    got = sorted(sd.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string, first long")).collect(), key=str)
    assert {(r.doc_id, len(r.kept)) for r in got} == {(None, 400), (4, 2), (2, 0)} and len(got) == 4
    assert sd.suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_window_has_one_minimizer():
    rng = np.random.default_rng(2)
    parts = [bytes(rng.integers(97, 103, int(n), dtype=np.uint8)) for n in (0, 99, 100, 101, 5000, 12, 300)]
    part, a, b, _ = sd.anchors(parts)
    for i, p in enumerate(parts):
        covered = [w for x, y in zip(a[part == i], b[part == i], strict=True) for w in range(x, y + 1)]
        assert covered == list(range(max(0, len(p) - 99)))


def test_query_on_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, sd.op3_suffix_dedup(spark, sf_dir).collect())) == brute(rows)


def test_longest_previous_factors_equal_brute_force():
    draw = random.Random(5)
    for length in (8, 20, 100):
        for _ in range(6):
            segments = ["".join(draw.choice("ab") for _ in range(length + draw.randint(0, 30))).encode() for _ in range(8)]
            segments += [segments[0], segments[1][:-1] + b"c" * 5, b"a" * (length + 9)]
            windows = np.array([len(s) - length + 1 for s in segments])
            position = np.array(draw.sample(range(0, 100_000, 500), len(segments)))
            got = sd.longest_previous(segments, windows, position, length)
            every = [(p + o, s[o : o + length]) for s, p, n in zip(segments, position.tolist(), windows.tolist(), strict=True) for o in range(n)]
            common = lambda x, y: next((i for i, (c, d) in enumerate(zip(x, y, strict=True)) if c != d), length)
            assert got.tolist() == [max((common(w, v) for q, v in every if q < p), default=0) for p, w in every]


def test_hot_minimizers_that_differ_are_dealt_by_all_their_bytes(spark):
    draw = random.Random(9)
    rows = [(i, "".join(draw.choice("xyz") for _ in range(40)) + "the same two dozen bytes and more of them" + "".join(draw.choice("uvw") for _ in range(40))) for i in range(60)]
    rows += [(100 + i, rows[i][1][5:]) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert digest(sd.suffix_dedup(df, bucket=4, hot=3)) == brute(rows)
