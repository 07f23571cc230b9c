import unicodedata

import pytest
from leafline.llm import confusables as C


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("Ｔｈｅ　ｍｉｌｌ", "The mill"), ("Τhе mіll", "The mill"), ("The  mill", "The mill"), ("Th​e m­ill﻿", "The mill"), ("café", "café"), ("ﬁnance", "finance"), ("⽔泵", "水泵"),
        ("ｳ゙ｧﾍﾟ", "ヴァペ"), ("non‑breaking", "non-breaking"), ("豈", "豈"), (" x ", "x"),
    ],
)
def test_equal_to_the_eye(a, b):
    assert C.skeleton(a) == C.skeleton(b)
    assert C.wording(a) == C.wording(b)


@pytest.mark.parametrize(("a", "b"), [("The mill", "THE MILL"), ("cafe", "café"), ("x2", "x²"), ("mill", "mill*"), ("mill†", "mill"), ("l1", "ll"), ("a - b", "a – b")])
def test_visible_differences_stay(a, b):
    assert C.skeleton(a) != C.skeleton(b)


def test_skeletons_are_stable():
    for text in ("ﬁ Ａé 漢⽔ ｶﾞ ŧ", "µ Ω K Å", "".join(map(chr, range(0xA0, 0x600)))):
        s = C.skeleton(text)
        assert C.skeleton(s) == s and C.skeleton(unicodedata.normalize("NFC", s)) == s
    assert C.skeleton(None) is None and C.skeleton("") == "" and C.skeleton("​ ") == ""


def test_wordings():
    same = ["Page 7 of 12", "PAGE 123 of 4", "page 1 of ２", "Ｐａｇｅ  9 оf 1"]
    assert len({C.wording(t) for t in same}) == 1
    assert C.wording("НАПЕЧАТАНО 1") == C.wording("Напечатано 22")
    assert C.wording("Page x") != C.wording("Page y") and C.wording(None) is None


def test_lookalikes(spark):
    refs = spark.createDataFrame([(1, "The mill", "en"), (2, "Der Turm", "de"), (3, None, "x"), (4, " ", "x")], "ref_id long, text string, lang string")
    texts = ["The mill", "Thе mill", "The  mill", "THE MILL", None, "", "​", "Der Turm", "Thе mill"]
    rows = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "line_id long, text string, ref_id int")
    got = sorted((r.record_table, r.record_id, r.ref_id) for r in C.lookalikes([("a", rows, "line_id", "text"), ("b", rows.limit(0), "line_id", "text")], refs).collect())
    assert got == [("a", 1, 1), ("a", 2, 1), ("a", 7, 2), ("a", 8, 1)]
    classes = {r.line_id: r.skeleton_id for r in C.groups(rows, "line_id").collect()}
    assert classes[0] == classes[1] == classes[2] != classes[3] and 4 not in classes


def test_forms_cover_lines_and_chunks(spark, tmp_path):
    from leafline.llm import queries

    spark.createDataFrame([(7, "Thе mill"), (8, None)], "line_id long, text string").write.parquet(f"{tmp_path}/extract_page_lines.parquet")
    spark.createDataFrame([(7, "The  mill"), (9, "Der Turm")], "chunk_no long, text string").write.parquet(f"{tmp_path}/chunks.parquet")
    df = queries.p4_forms(spark, str(tmp_path))
    assert df.columns == ["record_table", "record_id", "skeleton_id", "form"]
    got = {(r.record_table, r.record_id): r for r in df.collect()}
    assert sorted(got) == [("chunks", 7), ("chunks", 9), ("extract_page_lines", 7)]
    line, chunk = got["extract_page_lines", 7], got["chunks", 7]
    assert line.form == chunk.form == "The mill" and line.skeleton_id == chunk.skeleton_id != got["chunks", 9].skeleton_id


def test_a_public_table_adds_look_alikes(spark, tmp_path):
    place = str(tmp_path / "c.txt")
    (tmp_path / "c.txt").write_text("\ufeff# a table\n13A0 ;\t0044 ;\tMA # D\nA4D0 ; 0042 ; MA\n0031 ; 006C ; MA\n0661 ; 006C ; MA\n00E9 ; 0065 ; MA\nFF41 ; 0061 ; MA\n\nA7F7 ; 2014 ; MA\n", encoding="utf-8")
    assert C.read_confusables(place) == {"\u13a0": "D", "\ua4d0": "B"}
    table = C.with_more(C.read_confusables(place))
    assert C.skeleton("\ua4d0ook", table) == "Book" != C.skeleton("\ua4d0ook") and C.skeleton("é1", table) != C.skeleton("e1", table)
    refs = spark.createDataFrame([(1, "Book")], "ref_id long, text string")
    rows = [("t", spark.createDataFrame([(5, "\ua4d0ook")], "id long, text string"), "id", "text")]
    assert C.lookalikes(rows, refs).count() == 0 and C.lookalikes(rows, refs, confusables=place).collect()[0].ref_id == 1
    assert C.record_groups(rows, place).collect()[0].form == "Book"
