import random

from pyspark.sql import functions as F

from veilgraph.functions import geometry as G
from veilgraph.operators import clusters as C
from veilgraph.operators import evaluation as E
from veilgraph.operators import neighbors as N
from veilgraph.operators.judge import judged
from veilgraph.streaming import timing as W

BOX = "struct<x:int,y:int,w:int,h:int>"
SPAN = f"photo_id string, span_index int, text string, box {BOX}, conf double"


def page(seed, n=60):
    draw = random.Random(seed)
    return [("p", i, "x", (draw.randrange(900), draw.randrange(2000), draw.randint(5, 200), draw.choice([8, 20, 30, 90])), 0.9) for i in range(n)]


def gap(a, b):
    g = lambda lo, n, lo2, n2: max(0, lo2 - lo - n, lo - lo2 - n2)
    return (g(a[0], a[2], b[0], b[2]) ** 2 + g(a[1], a[3], b[1], b[3]) ** 2) ** 0.5


def test_nearby_equals_all_pairs(spark):
    rows = page(1)
    want = sorted((i, j) for _, i, _, a, _ in rows for _, j, _, b, _ in rows if i != j and gap(a, b) <= 6 * max(a[3], 12))
    got = N.nearby(spark.createDataFrame(rows, SPAN)).collect()
    assert sorted((r.i, r.j) for r in got) == want


def test_clusters_equal_union_find(spark):
    rows = page(2)
    root = list(range(len(rows)))
    for _, i, _, a, _ in rows:
        for _, j, _, b, _ in rows:
            if gap(a, b) <= 2.5 * max(a[3], b[3], 10):
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    order = sorted(set(root))
    got = {r.span_index: r.cluster for r in C.clusters(spark.createDataFrame(rows, SPAN)).collect()}
    assert got == {i: order.index(r) for i, r in enumerate(root)}


SCENES = {
    "labels": [(0, 0, "연락처"), (0, 1, "010-1234-5678"), (9, 0, "고객센터"), (9, 1, "02-345-6789"), (18, 0, "010-1111-2222")],
    "reach": [(0, 0, "010-1234-5678"), (2, 0, "성명 적는 칸입니다"), (20, 0, "02-345-6789"), (22, 0, "매장 안내입니다")],
    "prefix": [(0, 0, "받는분 010-1234-5678"), (20, 0, "help@a.co"), (40, 0, "고객센터 4111111111111111"), (60, 0, "1588-1234")],
}


def test_labels_words_prefixes_and_fixed_kinds(spark):
    rows = [(p, r, k, t) for p, parts in SCENES.items() for r, k, t in parts]
    spans = N.scene_spans(spark.createDataFrame(rows, "photo_id string, row int, part int, text string"))
    got = {(r.photo_id, r.span_index, r.kind): r.severity for r in judged(spans).collect()}
    assert got == {
        ("labels", 1, "mobile"): "cover", ("labels", 3, "landline"): "info", ("labels", 4, "mobile"): "review",
        ("reach", 0, "mobile"): "cover", ("reach", 2, "landline"): "info",
        ("prefix", 0, "mobile"): "cover", ("prefix", 1, "email"): "info", ("prefix", 2, "card"): "cover", ("prefix", 3, "service_line"): "info",
    }


def test_unread_text_is_not_told(spark):
    row = [("s", 0, "010-1234-5678", (0, 0, 200, 20), 0.3)]
    out = judged(spark.createDataFrame(row, SPAN)).first()
    assert (out.certainty, out.severity, out.evidence_text) == ("region", "review", None)


def test_order_of_rows_does_not_matter(spark):
    spans = spark.createDataFrame(page(6), SPAN)
    shuffled = spans.orderBy(F.rand(3)).repartition(5)
    for f in (N.nearby, N.left_neighbors, N.line_above):
        assert sorted(map(str, f(spans).collect())) == sorted(map(str, f(shuffled).collect()))


def plain_iou(a, b):
    o = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    return o / (a[2] * a[3] + b[2] * b[3] - o)


def test_suppression_and_matching_equal_loops(spark):
    draw = random.Random(4)
    boxes = [(round(draw.random(), 2), i, "c", (draw.randrange(60), draw.randrange(60), 30, 30)) for i in range(40)]
    kept = []
    for b in sorted(boxes, key=lambda b: (-b[0], b[1])):
        if all(plain_iou(b[3], k[3]) < 0.4 for k in kept):
            kept.append(b)
    df = spark.createDataFrame([(boxes,)], f"b array<struct<score:double,seq:int,class:string,box:{BOX}>>")
    assert [k["seq"] for k in df.select(G.nms(F.col("b"), 0.4).alias("k")).first()["k"]] == [k[1] for k in kept]

    gt = [("i", i, (draw.randrange(90), draw.randrange(90), 30, 30), i % 5 == 0) for i in range(25)]
    pred = [("i", i, (draw.randrange(90), draw.randrange(90), 30, 30), round(draw.random(), 3)) for i in range(25)]
    used, want = set(), []
    for _, p, box, score in sorted(pred, key=lambda r: (-r[3], r[1])):
        options = sorted((-plain_iou(box, g[2]), g[1], g[3]) for g in gt if plain_iou(box, g[2]) >= 0.3 and (g[3] or g[1] not in used))
        want.append((p, options[0][1] if options else None))
        used |= {options[0][1]} if options else set()
    g = spark.createDataFrame(gt, f"image_id string, gt_index int, box {BOX}, ignore boolean")
    p = spark.createDataFrame(pred, f"image_id string, pred_index int, box {BOX}, score double")
    assert sorted((r.pred_index, r.gt_index) for r in E.matched(g, p, 0.3).collect()) == sorted(want)
    swept = E.sweep(g, p, [0.2, 0.8]).collect()
    assert len(swept) == 2 and all(r.tp + r.fn == sum(not x[3] for x in gt) for r in swept)


def test_duration_model_equals_loop(spark):
    draw = random.Random(5)
    rows = [(i, float(draw.randint(1, 5)), draw.choice([1.0, 2.0, 60.0]) * draw.random()) for i in range(30)]
    s = [0.0] * 5 + [0]

    def guess(u):
        n, sx, sy, sxx, sxy, c = s
        if c == 0:
            return None
        var = n * sxx - sx * sx
        if c >= 3 and var > 1e-9 * max(1, n * sxx):
            b = max(0, (n * sxy - sx * sy) / var)
            return max(0, (sy - b * sx) / n) + b * u
        return sy / n * u / (sx / n)

    for _, u, t in rows:
        g = guess(u)
        w = 0.3 if g and t > 5 * g else 1.0
        s = [v * 0.9 + w * x for v, x in zip(s[:5], (1, u, t, u * u, u * t), strict=True)] + [s[5] + 1]
    df = spark.createDataFrame([("judge:llm:x", *r) for r in rows] + [("judge:llm:x", 99, -1.0, 2.0), ("", 98, 1.0, 1.0)], "key string, at int, units double, seconds double")
    out = {r.key: r.v for r in W.models(df, ["at"]).select("key", W.predicted(F.col("state"), F.lit(3.0)).alias("v")).collect()}
    assert set(out) == {"judge:llm:x", "judge:llm"} and all(abs(v - guess(3.0)) < 1e-9 for v in out.values())
    asked = spark.createDataFrame([(1, "judge:llm:new", 3.0), (2, "ocr", 1.0)], "id int, key string, units double")
    assert [(r.id, r.seconds is None) for r in W.estimates(asked, W.models(df, ["at"])).orderBy("id").collect()] == [(1, False), (2, True)]
