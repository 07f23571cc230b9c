import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from leafline.llm import sentences as S
from leafline.llm import splitting as P
from pyspark.sql import functions as F

HOW = S.Segmentation(S.Model({}, {}, {}, {}), S.Languages([("en", "the")]))
SEGMENTER = HOW.segmenter


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="abc 漢字。. \n,้", min_size=1, max_size=120), max_size=12), st.sampled_from([60, 200]))
def test_pieces_are_within_the_limit_and_whole(parts, limit):
    text = "".join(parts)
    cuts = P.Splitter(SEGMENTER, limit, limit // 8).cuts(text)
    assert "".join(text[a:b] for _, a, b in cuts) == text
    assert all(P.size(text[a:c]) <= limit for a, _, c in cuts)
    assert all(0 <= b - a <= max(limit // 8, 0) for a, b, _ in cuts)


def test_a_change_of_topic_is_the_cut():
    first = "The mill grinds the corn and the miller keeps the corn dry. " * 8
    second = "Stars and planets shine over distant galaxies of stars. " * 8
    (_, _, cut), *_ = P.Splitter(SEGMENTER, 700, 50).cuts(first + second)
    assert cut == len(first)
    depths = P.valley_depths(["corn mill"] * 5 + ["star sky"] * 5)
    assert max(range(9), key=depths.__getitem__) == 4


def test_no_natural_boundary_and_marks_stay_with_their_letters():
    cuts = P.Splitter(SEGMENTER, 100, 20).cuts("x" * 350)
    assert len(cuts) >= 4 and "".join("x" * (b - a) for _, a, b in cuts) == "x" * 350
    text = "ก้" * 200
    assert all(text[a] == "ก" for _, a, _ in P.Splitter(SEGMENTER, 101, 20).cuts(text))
    with pytest.raises(ValueError):
        P.Splitter(SEGMENTER, 100, 50)


def test_chunks(spark):
    long_text = "The mill opens. " * 100
    segments = [{"page": 3, "text": long_text.strip()}, {"page": 4, "text": "The end of it."}]
    whole = "\n\n".join(s["text"] for s in segments)
    rows = [(1, whole, segments, "before", 3, "x"), (2, "short", [], None, None, "x"), (3, None, segments, None, None, "x"), (4, "漢" * 551, None, None, None, "x"), (4, "漢" * 551, None, None, None, "x"), (5, "y" * 1100, None, "", 1, "x")]
    df = spark.createDataFrame(rows, "chunk_no long, text string, page_segments array<struct<page:int,text:string>>, overlap_from_previous string, start_page int, piece_no string")
    out = P.split_oversized(df, HOW).orderBy("chunk_no", "piece_no").collect()
    assert {r.chunk_no for r in out} == {1, 4} and sum(r.chunk_no == 4 and r.piece_no == 0 for r in out) == 2
    own = [r for r in out if r.chunk_no == 1]
    assert own[0].overlap_from_previous == "before" and own[-1].source_pages[-1] == 4 and own[0].page_range == "3"
    assert all("\n\n".join(s.text for s in r.page_segments) == r.text and r.size <= 1100 for r in own)
    assert all(r.text.startswith(r.overlap_from_previous) and len(r.overlap_from_previous) <= 120 for r in own[1:])
    assert P.split_oversized(df.limit(0), HOW).count() == 0
    assert [r[0] for r in df.select(P.text_size(F.col("text"))).collect()] == [len(whole), 5, None, 1102, 1102, 1100]


def test_depths_equal_the_climb_from_each_gap(monkeypatch):
    import random

    rng = random.Random(6)

    def climb(values, i, step):
        height, j = values[i], i + step
        while 0 <= j < len(values) and values[j] >= height:
            height, j = values[j], j + step
        return height

    for n in (0, 1, 2, 30, 200):
        values = [rng.randint(0, 4) / 4 for _ in range(max(n - 1, 0))]
        given = iter(values)
        monkeypatch.setattr(P, "_cosine", lambda a, b: next(given))  # noqa: B023
        want = [climb(values, i, -1) + climb(values, i, 1) - 2 * v for i, v in enumerate(values)]
        assert P.valley_depths(["one word"] * n) == pytest.approx(want)
