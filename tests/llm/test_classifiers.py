import itertools

import numpy as np

from veilgraph.llm import langid, quality


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    lengths = np.array([3, 1, 0, 4])
    emit, trans, first = rng.normal(size=(8, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    got, pairs = langid.marginals(emit, lengths, trans, first, pairs=True)
    at, want_pairs = 0, np.zeros((3, 3))
    for n in lengths:
        want, total, p2 = np.zeros((n, 3)), 0.0, np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            weight = np.exp(sum(emit[at + i, y] for i, y in enumerate(path)) + (first[path[0]] if path else 0) + sum(trans[a, b] for a, b in itertools.pairwise(path)))
            total += weight
            for i, y in enumerate(path):
                want[i, y] += weight
            for a, b in itertools.pairwise(path):
                p2[a, b] += weight
        if n:
            assert np.allclose(got[at : at + n], want / total)
            want_pairs += p2 / total
        at += n
    assert np.allclose(pairs, want_pairs)


def test_blocks_give_the_same_marginals():
    rng = np.random.default_rng(8)
    lengths = np.array([1, 40, 0, 7, 8, 9, 17, 300])
    emit, trans, first = 3 * rng.normal(size=(lengths.sum(), 4)), 2 * rng.normal(size=(4, 4)), rng.normal(size=4)
    assert np.allclose(langid.long_marginals(emit, lengths, trans, first, block=8), langid.marginals(emit, lengths, trans, first))


def test_langid_held_out_accuracy(spark):
    out = langid.op8_crf_langid(spark, "/root/testdata/sf0.01").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas()
    both = out.merge(docs, on="doc_id")
    held = both[both.held_out]
    assert len(out) == len(docs) and (held.lang == held.lang_pred).mean() > 0.97 and out.score.between(0, 1).all()


def test_langid_code_switching_and_odd_rows(spark):
    en, de = b"the water of the river and the house with this thing", b"der schnee und die strasse nicht mit einem baum ich"
    model = langid.fit([(en, "en"), (de, "de")] * 30, epochs=8)
    part, owner, feature = langid.features([en + b" " + de])
    p = langid.marginals(langid.emissions(model.weights, len(part), owner, feature), np.array([len(part)]), model.trans, model.first)
    assert p[:11, 1].min() > 0.5 and p[11:, 0].min() > 0.5
    rows = [(1, None, "en"), (2, "", None), (3, "12 !! © 34", None), (None, "the water", "x"), (4, "der " * 30_000, ""), (4, "der " * 30_000, "")]
    got = [(r.doc_id, r.lang_pred) for r in langid.langid(spark.createDataFrame(rows, "doc_id long, text string, lang_pred string"), model).collect()]
    assert sorted(got, key=str) == sorted([(1, "und"), (2, "und"), (3, "und"), (None, "en"), (4, "de"), (4, "de")], key=str)
    assert langid.langid(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_quality_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    out = quality.op9_nbsvm_quality(spark, d).toPandas()
    both = out.merge(spark.read.parquet(f"{d}/labels.parquet").toPandas(), on="doc_id")
    held = both[both.held_out]
    right = held.quality == held.predicted
    assert len(out) == 10_000 and right[held.quality == 1].mean() > 0.9 and right[held.quality == 0].mean() > 0.8


def test_quality_odd_rows(spark):
    xs = [quality.indicators(t) for t in (b"good plain text", b"BAD!! BAD!!")] * 5
    model = quality.fit(xs, [1, 0] * 5)
    rows = [(1, None, 0.0), (2, "", 1.0), (None, "BAD!!", None), (3, "plain text " * 20_000, 0.1)]
    got = {r.doc_id: r.score for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, score double"), model).collect()}
    assert got[1] == got[2] and all(0 <= s <= 1 for s in got.values()) and got[None] < 0.5 < got[3]
    assert quality.quality(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0
    assert quality.fit([], []).score(xs[0]) == 0.5
