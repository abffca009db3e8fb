from veilgraph.operators import neighbors as N
from veilgraph.operators import values as Va

PAGES = {
    "name": [(0, 0, "받는분: 김민수"), (9, 0, "보내는분"), (9, 1, "박철"), (18, 0, "성명"), (18, 1, "주소")],
    "secret": [(0, 0, "와이파이 비번"), (1, 0, "nuri8402!"), (9, 0, "현관 비밀번호 9723*"), (18, 0, "비밀번호 변경")],
    "id": [(0, 0, "학생증"), (1, 0, "학번 20231234"), (30, 0, "사번"), (30, 1, "123456"), (60, 0, "20231234")],
    "track": [(0, 0, "운송장번호909266858784"), (9, 0, "국민은행"), (9, 1, "38159411957851"), (18, 0, "123456789012")],
    "promo": [(0, 0, "받는분 김민수"), (1, 0, "010-1234-5678")],
    "guess": [(0, 0, "이영희"), (1, 0, "010-9876-5432"), (30, 0, "김민수님 안녕하세요"), (60, 0, "박지훈")],
    "birth": [(0, 0, "생년월일 1990.01.02"), (9, 0, "성명 김민수"), (10, 0, "생년월일 19900102")],
}


def test_value_passes(spark):
    rows = [(p, r, k, t) for p, parts in PAGES.items() for r, k, t in parts]
    spans = N.scene_spans(spark.createDataFrame(rows, "photo_id string, row int, part int, text string"))
    got = sorted((r.photo_id, r.span_index, r.kind, r.evidence_text, r.severity) for r in Va.findings(spans).collect())
    want = [
        ("name", 0, "name", "김민수", "cover"), ("name", 2, "name", "박철", "cover"),
        ("secret", 1, "password", "nuri8402!", "cover"), ("secret", 2, "password", "9723*", "cover"),
        ("id", 1, "student_id", "20231234", "cover"), ("id", 3, "student_id", "123456", "review"),
        ("track", 0, "tracking", "909266858784", "review"), ("track", 2, "account", "38159411957851", "cover"), ("track", 3, "long_digits", "123456789012", "info"),
        ("promo", 0, "name", "김민수", "cover"), ("promo", 1, "mobile", "010-1234-5678", "cover"),
        ("guess", 0, "name", "이영희", "cover"), ("guess", 1, "mobile", "010-9876-5432", "cover"), ("guess", 2, "name", "김민수", "review"),
        ("birth", 0, "birth_date", "1990.01.02", "review"), ("birth", 1, "name", "김민수", "cover"), ("birth", 2, "birth_date", "19900102", "cover"),
    ]
    assert got == sorted(want)
