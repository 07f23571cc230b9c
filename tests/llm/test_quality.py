import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from leafline.llm import mojibake as M
from leafline.llm import quality as Q

COMMON = frozenset("the of and to in is that it a for with der die das und".split())
PROSE = "The mill of Nova opens the gate of the harbour, and the rest stays as it is. The bridge is closed."
NOT = {
    "numbered": "\n".join(f"{i}. The mill opens the gate of row {i}." for i in range(1, 8)),
    "bullets": "\n".join(f"• The tower of {w}" for w in ("Bako", "Nova", "Zubo", "Rimi", "Tapo")),
    "table": "name | size | cost\nBako | 12 | 4 %\nNova | 3 | n/a\nZubo | 7 | 88 %",
    "tabs": "a\tb\tc\n1\t2\t3\n4\t5\t6",
    "contents": "\n".join(f"The mill of {w}........ {i}" for i, w in enumerate(("Bako", "Nova", "Zubo", "Rimi"))),
    "symbols": "=-=-=-=-=-=-=-\n*~*~*~*~*~*~*~\n________________",
    "base64": "Qk9oT3Zxc2ZUaFJkY2FhYnhzd2U4OTdhc2RmZ2hqa2w\nYXNkZmdoamtsb3dlcnR6dWlvcHl4Y3Zibm0xMjM0NTY",
    "repeats": "\n".join(["The tower of Pedu The tower of Pedu The tower of Pedu"] * 6),
    "words": "garden, map, sensor, ledger,\nvalve, archive, bridge, tower,\nmill, gate, map, pump, cable,",
    "glyphs": "(cid:12)(cid:44)a(cid:9)\n(cid:12)(cid:44)b(cid:9)",
}
IS = {
    "plain": PROSE,
    "wrapped": "The mill of Nova opens the gate\nof the harbour, and the rest\nstays. The bridge is closed.",
    "heading": "The mill\n\n" + PROSE,
    "speech": "– “The mill opens,” says Bako.\n– The gate is closed to the end of the day.\n– “Is that so?”",
    "capitals": PROSE.upper(),
    "thai": "โรงเรียนลงทะเบียนคลังสินค้าด้วยทราย ห้องสมุดย้ายโรงเรียนที่โมฟาซู สัญญาตรวจสอบสายเคเบิล",
    "empty": "",
    "short": "The mill",
}


def judge(text):
    return Q.verdict(Q.measure(text.split("\n"), COMMON).finish())[0]


@pytest.mark.parametrize("kind", list(NOT))
def test_no_prose(kind):
    assert judge(NOT[kind])


@pytest.mark.parametrize("kind", list(IS))
def test_prose(kind):
    assert not judge(IS[kind])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["", "The mill opens. The gate.", "• item of it", "1 | 2 | 3", "– a turn.", "heading", "x" * 40]), max_size=30), st.integers(0, 1000))
def test_merging_blocks_gives_the_same_sums(lines, seed):
    """Any cut into blocks, merged in any tree, equals the whole, lines that repeat across a cut included."""
    whole = Q.measure(lines, COMMON)
    rng = random.Random(seed)
    cuts = sorted({0, len(lines), *(rng.randint(0, len(lines)) for _ in range(3))})
    load = lambda p: Q.Block.load(Q.Block.of([[p, True]], False).dump())
    parts = [load(Q.measure(lines[a:b], COMMON)) for a, b in zip(cuts, cuts[1:])] or [load(Q.Partial())]
    while len(parts) > 1:
        i = rng.randrange(len(parts) - 1)
        parts[i : i + 2] = [parts[i].merge(parts[i + 1])]
    assert parts[0].finish() == whole.finish()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["The mill opens. The gate.", "• item of it", "1 | 2 | 3", "x" * 40]), st.sampled_from([None, 10.0, 50.0, 90.0, 130.0, 400.0, 420.0, 700.0, 790.0])), min_size=1, max_size=25), st.integers(0, 1000))
def test_a_page_in_blocks_equals_the_whole_page(given_lines, seed):
    rows = [{"line_no": i, "text": t, "top": y, "bottom": None if y is None else y + 10, "page_height": 800.0} for i, (t, y) in enumerate(given_lines)]
    step, band = Q.page_facts(rows)
    rng = random.Random(seed)
    cuts = sorted({0, len(rows), *(rng.randint(0, len(rows)) for _ in range(3))})
    parts = []
    for a, b in zip(cuts, cuts[1:]):
        last = next((r["top"] for r in reversed(rows[:a]) if r["top"] is not None), None)
        parts.append(Q.Block.load(Q.page_block(rows[a:b], step, band, last, COMMON).dump()))
    while len(parts) > 1:
        i = rng.randrange(len(parts) - 1)
        parts[i : i + 2] = [parts[i].merge(parts[i + 1])]
    assert parts[0].finish() == Q.page_block(rows, step, band, None, COMMON).finish()


@pytest.fixture(scope="module")
def shared(spark):
    return M.share([spark.createDataFrame([(PROSE,)] * 50, "text string")], with_words=False)


def test_chunks(spark, shared):
    df = spark.createDataFrame([(1, PROSE, 1), (2, NOT["table"], 1), (2, NOT["table"], 1), (3, None, 1), (4, "", 1), (5, "\n".join(f"In {i} the mill {'opens' if i % 2 else 'closes and the bridge opens'} it. The gate is closed." for i in range(3000)), 1)], "chunk_no long, text string, n_lines int")
    rows = sorted(((r.chunk_no, r.not_prose) for r in Q.chunk_statistics(df, COMMON, shared).collect()))
    assert rows == [(1, False), (2, True), (2, True), (4, False), (5, False)]
    long = [r for r in Q.chunk_statistics(df, COMMON, shared).collect() if r.chunk_no == 5][0]
    assert long.n_lines == 3000 and long.n_words == 1500 * (10 + 14)
    assert Q.chunk_statistics(df.limit(0), COMMON, shared).count() == 0


def test_pages(spark, shared):
    def page(p, lines, start=200.0, step=16.0):
        return [(p * 1000 + i, p, i, t, start + step * i, start + step * i + 10, 800.0) for i, t in enumerate(lines)]

    furniture = lambda p: [(p * 1000 + 900, p, 900, "Page 7", 780.0, 790.0, 800.0), (p * 1000 + 901, p, 901, "Draft - not for sale", 20.0, 30.0, 800.0)]
    rows = page(1, IS["wrapped"].split("\n")) + furniture(1) + page(2, NOT["bullets"].split("\n")) + furniture(2) + furniture(3) + page(4, [f"• Item of {i}" for i in range(1400)], 1.0, 0.5) + page(5, [None])
    rows += [(50_000, 1, 1, "of the harbour, and the rest", 216.0, 226.0, 800.0)]
    df = spark.createDataFrame(rows, "line_id long, page_id long, line_no int, text string, top double, bottom double, page_height double")
    got = {r.page_id: (r.not_prose, r.n_lines) for r in Q.page_statistics(df, COMMON, shared).collect()}
    assert got[1] == (False, 3) and got[2] == (True, 5) and got[4][0] and 5 not in got and not got.get(3, (False,))[0]
    assert Q.page_statistics(df.limit(0), COMMON, shared).count() == 0


def test_pages_of_any_length_are_judged_alike(spark, shared, monkeypatch):
    schema = "line_id long, page_id long, line_no int, text string, top double, bottom double, page_height double, extracted_at timestamp"

    def page(p, n, text):
        head = [(p * 10**6 + 900_000, p, 0, "Draft - not for sale", 4.0, 5.0, 800.0, None)]
        return head + [(p * 10**6 + i, p, i, text(i), 200.0 + 0.2 * i, 200.1 + 0.2 * i, 800.0, None) for i in range(1, n)]

    prose = lambda i: f"In {i} the mill {'opens' if i % 2 else 'closes and the bridge opens'} it. The gate is closed."
    rows = page(1, 2000, prose) + page(2, 2000, lambda i: f"• Item of {i}") + page(3, 40, prose) + page(4, 513, prose)
    rows += [(50_000_000 + i, 5, None, f"A loose line of {i} stands here to be read.", None, None, 800.0, None) for i in range(70)]
    df = spark.createDataFrame(rows, schema)
    several = {r.page_id: r for r in Q.page_statistics(df, COMMON, shared).collect()}
    monkeypatch.setattr(Q, "BLOCK_LINES", 1 << 20)
    whole = {r.page_id: r for r in Q.page_statistics(df, COMMON, shared).collect()}
    assert several == whole and several[5].n_lines == 70
    assert {p: (r.not_prose, r.n_lines) for p, r in several.items() if p < 5} == {1: (False, 1999), 2: (True, 1999), 3: (False, 39), 4: (False, 512)}
    alone = {r.page_id: r for r in Q.page_statistics(df.where("page_id < 5"), COMMON, shared).collect()}
    assert alone == {p: r for p, r in several.items() if p < 5}  # the facts made in one pass equal those gathered first


def test_long_chunks_are_judged_in_parts(spark, shared, monkeypatch):
    text = "\n".join(f"In {i} the mill opens it, and the gate of it is closed to the end." if i % 3 else ("" if i % 2 else "the same line stands here twice") for i in range(6000))
    df = spark.createDataFrame([(1, text), (1, text), (2, "x" * 200_000), (3, "the mill of it " * 20_000), (4, None)], "chunk_no long, text string")
    parts = sorted(Q.chunk_statistics(df, COMMON, shared).collect(), key=lambda r: (r.chunk_no, r.n_chars))
    lines = text.split("\n")
    one = Q._row(Q.measure(lines, COMMON).finish())
    assert [r.chunk_no for r in parts] == [1, 1, 2, 3] and all(parts[0][k] == v for k, v in one.items()) and parts[0] == parts[1]
    assert parts[2].n_lines == 4 and parts[3].n_words == 80_000
