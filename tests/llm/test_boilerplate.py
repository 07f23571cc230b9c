from datetime import datetime

import pytest
from leafline.llm import boilerplate as B
from leafline.llm import mojibake as M
from pyspark.sql import functions as F

NOW = datetime(2024, 1, 1)
SCHEMA = "line_id long, page_id long, file_id long, source string, line_no int, text string, top double, bottom double, page_height double, extracted_at timestamp, wording string"


def make(spark):
    rows, n = [], 0

    def add(source, file, text, top, line_no):
        nonlocal n
        rows.append((n, file * 10, file, source, line_no, text, top, None if top is None else top + 10, 800.0, NOW, "clash"))
        n += 1

    for s in range(6):
        for f in range(4):
            file = s * 10 + f
            add(f"s{s}", file, f"© 202{f} Source {chr(65 + s)}x" if f < 3 else f"© 2024  SΟURCE {chr(65 + s)}X", 20.0, 0)
            add(f"s{s}", file, f"body line {s} {f} and more of the text", 400.0, 1)
            add(f"s{s}", file, f"only here {chr(97 + s)}{chr(97 + f)}", 780.0, 2)
            add(f"s{s}", file, str(f), 785.0, 3)
    add("s0", 0, "© 2029 Source Ax", None, 4)
    add("s0", 0, None, 20.0, 5)
    add("s0", 0, "Â© 2029 Source Ax fÃ¼r", 20.0, 6)
    add("s0", 0, "© 2023 Source Ax", 20.0, 0)
    add("two", 90, "Twice", 20.0, 0), add("two", 91, "Twice", 20.0, 0)
    return spark.createDataFrame(rows, SCHEMA), rows


@pytest.fixture(scope="module")
def shared(spark):
    return M.share([spark.createDataFrame([("für die Mühle in der Stadt © 2020",)] * 200, "text string")], with_words=False)


def test_lines_that_cover_half_of_the_files(spark, shared):
    df, rows = make(spark)
    got = {r.line_id for r in B.repeated_lines(df, shared).where("covers").collect()}
    want = {r[0] for r in rows if r[6] is not None and r[5] and (r[5].startswith("© ") or r[5].isdigit()) and r[3] != "two"}
    assert got == want


def test_the_edges_have_an_excess_and_what_stands_everywhere_has_none(spark, shared):
    df, rows = make(spark)
    # A wording that fills page bodies everywhere, and by the way stands at the edges of all files of one source.
    n, more = len(rows), []
    for s in range(6):
        for f in range(4):
            more += [(n + len(more) + k, 0, s * 10 + f, f"s{s}", 10 + k, "and so on", 400.0, 410.0, 800.0, NOW, None) for k in range(40)]
    more += [(n + len(more) + k, k * 10, k, "s0", 60, "AND SO ON", 20.0, 30.0, 800.0, NOW, None) for k in range(4)]
    df = df.unionByName(spark.createDataFrame(more, SCHEMA))
    found = B.repeated_lines(df, shared).join(df.select("line_id", "text"), "line_id").collect()
    assert sum("ource" in r.text for r in found) == 19 and any(r.text.isdigit() for r in found) and not any(r.text.lower() == "and so on" for r in found)
    edges = B.edge_lines(df, shared)
    untested = B.statistics(edges, df).where(B._covering(B.MIN_SHARE, B.MIN_FILES)).join(edges, ["source", "wording"])
    assert untested.count() == B.repeated_lines(df, shared).where("covers").count() + 4  # the test decides, the coverage alone would not
    a, b, c, d = (F.lit(float(x)) for x in (5, 5, 5, 5))
    assert spark.range(1).select(B.log_likelihood_ratio(a, b, c, d)).collect()[0][0] == pytest.approx(0.0, abs=1e-9)


def test_lines_without_a_number_all_stay(spark, shared):
    rows = [(i, 1, 1, "s", None, f"loose {i}", 400.0, 410.0, 800.0, NOW, None) for i in range(5)] + [(9, 1, 1, "s", 0, None, 20.0, 30.0, 800.0, NOW, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    page = B.remove_repeated(df, B.repeated_lines(df, shared)).collect()[0]
    assert page.text == "\n".join(f"loose {i}" for i in range(5)) and (page.n_lines, page.n_removed) == (6, 0)


def test_pages_come_out_without_them(spark, shared):
    df, _ = make(spark)
    pages = {r.page_id: r for r in B.remove_repeated(df, B.repeated_lines(df, shared)).collect()}
    assert pages[10].text == "body line 0 1 and more of the text\nonly here ab" and pages[10].n_removed == 2
    assert pages[900].text == "Twice"
    nothing = df.limit(0)
    assert B.repeated_lines(nothing, shared).count() == 0 and B.remove_repeated(nothing, B.repeated_lines(nothing, shared)).count() == 0


def test_false_discovery_threshold(spark):
    scores = spark.createDataFrame([(x,) for x in [0.1] * 90 + [30.0] * 10], "llr double")
    assert 5 < B.significance_threshold(scores) <= 30
    assert B.significance_threshold(spark.createDataFrame([(0.2,)] * 50, "llr double")) == float("inf")
