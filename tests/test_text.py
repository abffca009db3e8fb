import pytest
from pyspark.sql import functions as F

from veilgraph.functions import text as T
from veilgraph.plans.scan import scan


def one(spark, f, *args):
    names = [f"c{i}" for i in range(len(args))]
    return spark.createDataFrame([args], ", ".join(f"{n} string" for n in names)).select(f(*map(F.col, names)).alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("권 선 로 208", "권선로 208"), ("받 는 분 김 민수", "받는분김민수"), ("받-는분", "받는분"), ("O1O-1234-5678", "010-1234-5678"), ("010-I234-5678", "010-1234-5678"), ("Oil 12", "Oil 12"), ("", ""), ("  a   b ", "a b")],
)
def test_normalized(spark, text, want):
    assert one(spark, T.normalized, text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("010-1234-5678", [("mobile", "010-1234-5678")]),
        ("주민번호900101-1234568", [("rrn", "900101-1234568")]),
        ("900101-1234567", [("rrn_unverified", "900101-1234567")]),
        ("9001011234567", [("long_digits", "9001011234567")]),
        ("4111 1111 1111 1111", [("card", "4111 1111 1111 1111")]),
        ("4111 1111 1111 1112", []),
        ("1588-1234", [("service_line", "1588-1234")]),
        ("12가 3456", [("plate", "12가 3456")]),
        ("121동 1655호", [("address_unit", "121동 1655호")]),
        ("테헤란로 12", [("address_road", "테헤란로 12")]),
        ("택배로 3개", []),
        ("앞으로 3", []),
        ("운송장번호6123-4567-8901", [("long_digits", "6123-4567-8901")]),
        ("5301012345678", [("long_digits", "5301012345678")]),
        ("a@b.co 02-345-6789", [("email", "a@b.co"), ("landline", "02-345-6789")]),
    ],
)
def test_scan(spark, text, want):
    assert [(h["kind"], h["hit"]) for h in one(spark, scan, text)] == want


def test_words_hide_inside_public_words(spark):
    row = one(spark, T.words_in, "대표전화")
    assert row["personal"] == [] and row["public"] == ["대표전화", "대표"]


def test_edge_words_take_the_longest(spark):
    assert one(spark, T.edge_context_word, "고객센터 대표전화 :")["word"] == "대표전화"
    assert one(spark, lambda c: T.edge_context_word(c, at_end=False), "배송지 서울")["side"] == "personal"


def test_document_hint_and_certainty(spark):
    assert one(spark, T.document_hint, "운송장 택배 영수증") == "waybill" and one(spark, T.document_hint, "택배") is None
    df = spark.createDataFrame([(0.75,), (0.5,), (0.2,)], "c double")
    assert [r[0] for r in df.select(T.certainty(F.col("c"))).collect()] == ["read", "partial", "region"]
