import random

from hypothesis import given, settings
from hypothesis import strategies as st

from veilgraph.llm import decontamination as dc


def least(pattern, text):
    """Plain dynamic programming: least edit distance of the pattern to any stretch."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, c in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (p != c))
    return min(row)


@settings(max_examples=300, deadline=None)
@given(st.text("abc ", min_size=1, max_size=70), st.text("abc ", max_size=120))
def test_myers_is_edit_distance(pattern, text):
    distance, end = dc.Myers(pattern).best(text)
    assert distance == least(pattern, text) and (end == 0 or least(pattern, text[:end]) == distance)


def test_matches_equal_brute_force(spark):
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 6)))
    items = [(i, " ".join(word() for _ in range(draw.choice([3, 12, 30])))) for i in range(25)]
    rows = []
    for d in range(150):
        bits = [word() for _ in range(draw.randint(0, 40))]
        if d % 2:
            leak = list(draw.choice(items)[1])
            for _ in range(draw.randint(0, 10)):
                leak[draw.randrange(len(leak))] = draw.choice(["", "x", "yz", leak[0]])
            bits.insert(draw.randint(0, len(bits)), "".join(leak).upper())
        rows.append((d, ", ".join(bits)))
    want = []
    for d, t in rows:
        for i, x in items:
            item = dc.normalized(x)
            if (n := least(item, dc.normalized(t))) <= dc.budget(item):
                want.append((d, i, n))
    got = dc.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), pass_chars=500)
    assert sorted((r.doc_id, r.item_id, r.distance) for r in got.collect()) == sorted(want) and len(want) > 10


def test_odd_rows(spark):
    kind, ikind = "doc_id long, text string, item_id string", "item_id long, text string, doc_id string"
    docs = spark.createDataFrame([(1, None, ""), (2, "", ""), (None, "some Benchmark, item text", ""), (3, "x " * 60_000, ""), (3, "x " * 60_000, "")], kind)
    items = spark.createDataFrame([(7, "benchmark item", ""), (7, "benchmark item", ""), (8, None, ""), (9, "!!", ""), (None, "x x x", "")], ikind)
    got = sorted(((r.doc_id, r.item_id, r.distance) for r in dc.contaminated(docs, items).collect()), key=str)
    assert got == sorted([(None, 7, 0)] * 2 + [(3, None, 0)] * 2, key=str)
    assert dc.contaminated(docs.limit(0), items).count() == 0 and dc.contaminated(docs, items.limit(0)).count() == 0


def test_query_finds_verbatim_leaks(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    want = {(d, i) for d, t in docs for i, x in items if x in t}
    got = {(r.doc_id, r.item_id) for r in dc.op5_edit_decontamination(spark, sf_dir).collect()}
    assert want <= got and want
