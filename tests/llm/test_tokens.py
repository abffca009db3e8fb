import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from veilgraph.llm import tokens
from veilgraph.llm.token_counts import op6_token_counts, token_counts
from veilgraph.llm.tokens import SegmentEncoder, safe_parts, vocabulary

SHARED = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
PIECES = ["the", " ", "  ", "\n", "\n ", "'s", "it's", "a.b", "<|endoftext|>", "<|startoftext|>", "é", "ß", "İ", "́", "\xa0", "12", "%%%", "...", "\x1c", "\x85", "日本", "🙂", "Σ", "ΑΣ", " ", "I'LL", ",", "!", "\t"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_segments_equal_whole_texts(name):
    plain, mine, draw = Tokenizer.from_file(vocabulary(name)), SegmentEncoder(name, keep=50), random.Random(7)
    texts = ["", " ", "a" * 3000] + ["".join(draw.choice(PIECES) for _ in range(draw.randint(1, 40))) for _ in range(3000)]
    for at in range(0, len(texts), 500):
        some = texts[at : at + 500]
        ids, sizes = mine.encode(pa.array(some))
        got = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
        assert got == [e.ids for e in plain.encode_batch(some, add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60), st.integers(1, 10))
def test_safe_parts_join_to_the_same_ids(text, limit):
    tok = SHARED
    parts = list(safe_parts(text, limit))
    assert "".join(parts) == text
    assert sum((tok.encode(p, add_special_tokens=False).ids for p in parts), []) == tok.encode(text, add_special_tokens=False).ids


def test_counts_with_nulls_and_extra_columns(spark):
    rows = [(1, None, "x"), (2, "", "y"), (None, "two words", None), (3, "same", "z"), (3, "same", "z"), (4, "é<|endoftext|>", "")]
    got = sorted(map(tuple, token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")).collect()), key=str)
    assert got == sorted([(1, 0, 0), (2, 0, 0), (None, 9, 2), (3, 4, 1), (3, 4, 1), (4, 15, 2)], key=str)


def test_long_texts_go_in_parts(monkeypatch):
    monkeypatch.setattr(tokens, "PART_CHARS", 300)
    draw = random.Random(3)
    texts = ["".join(draw.choice(PIECES) for _ in range(draw.choice([5, 2000]))) for _ in range(40)]
    ids, sizes = SegmentEncoder("byte_bpe_50k.json").encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [e.ids for e in SHARED.encode_batch(texts, add_special_tokens=False)]
    assert SegmentEncoder("byte_bpe_50k.json", lengths_only=True).encode(pa.array(texts))[1].tolist() == sizes.tolist()


def test_query_equals_the_library(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    counts = [len(e.ids) for e in SHARED.encode_batch([r.text or "" for r in rows], add_special_tokens=False)]
    want = sorted((r.doc_id, len((r.text or "").encode()), n, n > 1024) for r, n in zip(rows, counts, strict=True))
    assert sorted(map(tuple, op6_token_counts(spark, sf_dir).collect())) == want
