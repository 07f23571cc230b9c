from datetime import datetime

from leafline.functions import text as T
from leafline.operators import lines
from pyspark.sql import functions as F

LINE = "line_id long, page_id long, file_id long, line_no int, text string, top double, bottom double, page_height double, extracted_at timestamp, source string, key string"
PAGE = "page_id long, file_id long, page_index int, page_number int, width double, height double, extraction_error string, parsed_at timestamp"
NOW, LATER = datetime(2024, 1, 1), datetime(2024, 1, 2)


def make_lines(spark, rows):
    return spark.createDataFrame([(i, *r, NOW, "s", "clash") for i, r in enumerate(rows)], LINE)


def make_pages(spark, n, file_id=1):
    return spark.createDataFrame([(p, file_id, p, p + 1, 600.0, 800.0, None, NOW) for p in range(n)], PAGE)


def test_glyphs_and_blanks(spark):
    rows = [("c",), ("⼿⻚",), ("a (cid:12)  b",), ("a  b",), ("x \r\ny\n\n\n\nz",), (None,), ("",)]
    df = spark.createDataFrame(rows, "t string")
    got = [r[0] for r in df.select(T.normalize_text(T.strip_unmapped_glyphs(F.col("t")))).collect()]
    assert got == ["abc", "手页", "a b", "a  b", "x\ny\n\nz", None, ""]


def test_content_and_numeric_rows(spark):
    df = spark.createDataFrame([("x = y", 10.0), ("ab", 1.0), ("12", 1.0), ("漢", 1.0), ("1 2 3", 10.0), ("1 2 3", 5.0), ("1 2 3", None)], "t string, h double")
    assert [r[0] for r in df.select(T.has_content(F.col("t"), F.col("h"), F.lit(10.0))).collect()] == [False, True, True, True, True, False, False]


def test_repeated_header_needs_three_pages_and_half(spark):
    rows = [(p, 1, 0, f"Page {p + 1} of 4", 10.0, 20.0, 800.0) for p in range(4)] + [(p, 1, 1, "Draft", 30.0, 40.0, 800.0) for p in range(2)] + [(p, 1, 2, "Body", 400.0, 410.0, 800.0) for p in range(4)]
    keys = lines.repeated_keys(lines.latest_lines(make_lines(spark, rows)), lines.latest_pages(make_pages(spark, 4))).collect()
    assert [(r.key, r.n_pages) for r in keys] == [("page # of #", 4)]


def test_clean_pages_gaps_removal_and_empty_pages(spark):
    rows = []
    for p in range(3):
        rows += [(p, 1, 0, "Head", 10.0, 20.0, 800.0), (p, 1, 1, "First line of the text here", 200.0, 210.0, 800.0), (p, 1, 2, "second line", 212.0, 222.0, 800.0), (p, 1, 3, "third", 224.0, 234.0, 800.0), (p, 1, 4, "far below", 300.0, 310.0, 800.0), (p, 1, 5, "x =", 312.0, 322.0, 800.0), (p, 1, 6, None, None, None, 800.0), (p, 1, 7, "no place", None, None, None)]
    out = {r.page_id: r for r in lines.clean_pages(make_lines(spark, rows), make_pages(spark, 4)).collect()}
    assert out[0].text == "First line of the text here\nsecond line\nthird\n\nfar below\nno place"
    assert (out[0].repeated_lines_removed, out[0].low_information_lines_removed, out[0].needs_ocr) == (1, 1, False)
    assert (out[3].text, out[3].has_text, out[3].needs_ocr, out[3].word_count) == ("", False, True, 0)
    total = lines.documents(lines.clean_pages(make_lines(spark, rows), make_pages(spark, 4))).collect()[0]
    assert (total.page_count, total.ocr_pages, total.repeated_lines_removed) == (4, 1, 3)


def test_later_extraction_wins_and_empty_tables(spark):
    df = make_lines(spark, [(0, 1, 0, "old text", 100.0, 110.0, 800.0)]).unionByName(make_lines(spark, [(0, 1, 0, "new text", 100.0, 110.0, 800.0)]).withColumns({"extracted_at": F.lit(LATER), "line_id": F.lit(9).cast("long")}))
    assert [r.text for r in lines.latest_lines(df).collect()] == ["new text"]
    nothing = make_lines(spark, [])
    assert lines.clean_pages(nothing, make_pages(spark, 0)).count() == 0
    assert lines.repeated_report(lines.latest_lines(nothing), make_pages(spark, 0)).count() == 0


def test_one_pass_texts_equal_the_two_pass_ones(spark):
    rows = [(p % 5, p % 2, i, "word " * (i % 4 + 1) if i % 3 else "1 =", 10.0 * i + (40 if i % 7 == 0 else 0), 10.0 * i + 9, 800.0) for p in range(5) for i in range(12)]
    got = lines.latest_lines(make_lines(spark, rows))
    marked = lines.mark_lines(got, lines.latest_pages(make_pages(spark, 5)))
    both = {r.page_id: (r.raw_text, r.text) for r in lines._both_texts(marked).collect()}
    raw = {r.page_id: r.text for r in lines.page_texts(got).collect()}
    kept = {r.page_id: r.text for r in lines.page_texts(marked.where("not is_repeated and not is_low_information")).collect()}
    assert both == {p: (raw[p], kept.get(p, "")) for p in raw}
