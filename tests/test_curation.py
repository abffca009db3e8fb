import random

from veilgraph.operators import curation as C

BOX = "path int, box_no int, class string, x0 int, y0 int, x1 int, y1 int, width int, height int"


def many(seed, n=1000):
    draw, rows = random.Random(seed), []
    for i in range(n):
        x, y, w, h = draw.choice([0, 7, 64, 200]), draw.choice([0, 9, 128]), draw.choice([-3, 0, 3, 10, 64, 100, 320]), draw.choice([0, 5, 9, 10, 64, 128])
        if rows and draw.random() < 0.6:  # near an earlier one, the same, or exactly nine tenths of it
            _, _, _, x, y, x1, y1, _, _ = draw.choice(rows)
            w, h = x1 - x, y1 - y
            x, w = draw.choice([(x, w), (x + w // 10, w - w // 10), (x - w // 20, w), (x + 1, w - 1), (x - w // 9, w + w // 9)])
        rows.append((draw.choice([1, 1, 2, None]), draw.choice([i, i, n - i, None]), draw.choice(["id_card", "face_photo", None]), x, y, x + w, y + h, 300, 280))
    return rows


def overlap(a, b):
    both = max(0, min(a[5], b[5]) - max(a[3], b[3])) * max(0, min(a[6], b[6]) - max(a[4], b[4]))
    area = lambda r: (r[5] - r[3]) * (r[6] - r[4])
    return both > 0 and both / (area(a) + area(b) - both) >= 0.9


def test_boxes_drawn_twice_equal_all_pairs(spark):
    rows = many(3)
    known = [r for r in rows if None not in r[:3]]
    want = {a[:2] for a in known for b in known if a[0] == b[0] and a[2] == b[2] and b[1] < a[1] and overlap(a, b)}
    assert sorted(map(tuple, C.drawn_twice(spark.createDataFrame(rows, BOX)).collect())) == sorted(want)
    assert len(want) > 50


def test_boxes_are_not_broadcast(spark, tmp_path):
    """Spark takes a small file for small tables, whatever its rows are spread over."""
    spark.createDataFrame(many(4), BOX).write.parquet(str(tmp_path / "boxes"))
    out = C.box_problems(spark.read.parquet(str(tmp_path / "boxes")))
    out.collect()
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_photos_that_share_a_number_stand_alone(spark):
    rows = [(1, 0, "id_card", 0, 0, 100, 100, 900, 900), (1, 1, "face_photo", 10, 10, 40, 40, 900, 900), (1, 1, "face_photo", 500, 500, 540, 540, 900, 900)]
    assert [tuple(r) for r in C.box_problems(spark.createDataFrame(rows, BOX)).collect()] == [(1, 1, "warning", "photo outside its card")]
