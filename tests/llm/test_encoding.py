import base64

import pytest

pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

import public_tokenizers as P  # noqa: E402
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402
from leafline.llm import encoding as E  # noqa: E402

CONTENT = open(E.tokenizer_path(), "rb").read()
OURS = E.BytePairEncoder(CONTENT, E.split_pattern())
THEIRS = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, CONTENT.splitlines())}, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_same_ids_as_the_public_library_and_exact_round_trip(text):
    assert OURS.encode(text) == THEIRS.encode_ordinary(text)
    assert OURS.decode(OURS.encode(text)) == text


@pytest.mark.parametrize("text", ["<|endoftext|>", "a" * 5000, "漢字かな交じり" * 300, "  \n\n\t x", "don't  WE'RE 12345"])
def test_hard_texts(text):
    assert OURS.encode(text) == THEIRS.encode_ordinary(text)


def test_every_row_has_ids(spark):
    df = spark.createDataFrame([(1, "one two", [9]), (2, "", None), (3, None, None), (3, "one two", None)], "doc_id long, text string, ids array<int>")
    rows = sorted((r.doc_id, list(r.ids)) for r in E.encode_corpus(df).collect())
    ids = THEIRS.encode_ordinary("one two")
    assert rows == [(1, ids), (2, []), (3, []), (3, ids)]
    assert sorted((r.doc_id, r.n_tokens) for r in E.count_tokens(df).collect()) == [(1, 2), (2, 0), (3, 0), (3, 2)]
    assert E.encode_corpus(df.limit(0)).count() == 0
