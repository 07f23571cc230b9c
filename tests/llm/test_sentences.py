import pytest
from leafline.llm import sentences as S

COMMON = [("en", w) for w in "the of and to in is that it for with as on not by at".split()] + [("de", w) for w in "der die das und in zu den mit von ist im für".split()]
TRAINING = [
    "The mill of Dr. Rova opens the gate. The bridge, see No. 12, is closed. After the storm, Mr. Bako measures the tower, e.g. on weekdays. The map is old. The gate finds Prof. Rova. At night the mill closes.",
    "The clerk from Nova, cf. p. 12, asked for it. The bridge is open. The tower supports the mill. Mr. Nova and Mr. Zubo open the map. On page 12, the gate closes.",
] * 40 + ["Am 3. März öffnet die Mühle von Nova. Die Brücke ist alt. Der Turm misst Frau Dr. Nova, vgl. Nr. 12. Am 21. März schließt das Tor. Die Karte ist für den Turm. Am 8. März."] * 60


@pytest.fixture(scope="module")
def segmenter(spark):
    langs = S.languages(spark.createDataFrame(COMMON, "lang string, word string"))
    return S.segmentation(spark.createDataFrame([(t,) for t in TRAINING] + [(None,)], "text string"), langs).segmenter


def parts(segmenter, text):
    at, out = 0, []
    for e in segmenter.ends(text):
        out.append(text[at:e].strip())
        at = e
    return out


@pytest.mark.parametrize(
    "expected",
    [
        ["The mill of Dr. Rova opens the gate.", "The bridge, see No. 12, is closed."],
        ["“The map is old. The gate is new,” wrote Mr. Nova in reply.", "The mill closes."],
        ["“Is the map old?” asked the clerk.", "The mill closes!", "It is 3.5 metres, e.g. on weekdays."],
        ["Am 3. März öffnet die Mühle von Nova.", "Die Brücke ist alt."],
        ["磨坊关闭桥梁。", "祖诺说：“花园打开桥梁。”", "“春天，渡轮移动合同？”瓦卡问道。"],
        ["「水車小屋は橋を閉じる。港は塔を守る。」とモドゥは書いた。", "弁は炉を開く。"],
        ["नौका पुल को खोलता है।", "“पंप चक्की को मापता है?” बिता पूछते हैं।", "रात में।"],
        ["تغلق الطاحونة الجسر؟", "«تفتح الجسر البرج؟» يسأل بيزو.", "ليلا، تدعم المستودع الميناء."],
        ["โรงเรียนลงทะเบียนคลังสินค้า", "ห้องสมุดย้ายโรงเรียน(ดูหมายเหตุ ของโลวา)", "สัญญา"],
    ],
)
def test_sentences(segmenter, expected):
    assert parts(segmenter, (("" if ord(expected[0][0]) in range(0x3000, 0xA000) or "磨" in expected[0] else " ").join(expected))) == expected


def test_blank_lines_headings_and_line_breaks(segmenter):
    text = "The mill\n\nThe gate is\nopen. The map; a bridge:\nclosed.\n\n– Turn one.\n– “Turn two.”\n\n  "
    assert parts(segmenter, text) == ["The mill", "The gate is\nopen.", "The map; a bridge:\nclosed.", "– Turn one.", "– “Turn two.”"]
    assert segmenter.ends(None) == segmenter.ends("") == segmenter.ends(" \n ") == []
    assert parts(segmenter, "“A quotation left open. Two. Three.") == ["“A quotation left open.", "Two.", "Three."]


def test_learned_entries(segmenter):
    m = segmenter.model
    assert {"dr", "mr"} <= m.abbreviations["en"] and "gate" not in m.abbreviations["en"]
    assert "märz" in m.ordinals["de"] and "the" in m.starters["en"]


def test_operators(spark, segmenter):
    how = S.Segmentation(segmenter.model, segmenter.langs)
    df = spark.createDataFrame([(1, "One is here. Two is not.", 7), (2, None, 7), (3, "", 7), (1, "One is here. Two is not.", 7), (4, "x" * 100_000, 7)], "chunk_no long, text string, end_pos int")
    assert sorted((r.chunk_no, r.end_pos) for r in S.sentence_ends(df, how).collect()) == [(1, 12), (1, 12), (1, 24), (1, 24), (4, 100_000)]
    rows = [r for r in S.sentences(df, how).collect() if r.chunk_no == 1]
    assert {(r.start_pos, r.end_pos, r.sentence) for r in rows} == {(0, 12, "One is here."), (13, 24, "Two is not.")}
    assert S.sentence_ends(df.limit(0), how).count() == 0
    empty = S.train(df.select("text").limit(0), segmenter.langs)
    assert S.Segmenter(empty, segmenter.langs).ends("One. Two.") == [4, 9]


def test_long_paragraphs_take_linear_time(segmenter):
    import time

    unit = "The mill of Dr. Rova opens the gate. “Is the map old?” asked the clerk. "
    began = time.perf_counter()
    few = len(segmenter.ends(unit * 500))
    middle = time.perf_counter()
    many = len(segmenter.ends(unit * 5000))
    assert many == 10 * few and time.perf_counter() - middle < 40 * (middle - began) + 1


def test_a_model_too_large_to_share_gives_the_same_sentences(spark, segmenter):
    texts = spark.createDataFrame([(t,) for t in TRAINING] + [(None,)], "text string")
    small, large = (S.segmentation(texts, segmenter.langs, max_model=n) for n in (10**6, 3))
    assert small.table is None and large.segmenter is None and large.table.count() > 3
    rows = [(i, t) for i, t in enumerate(TRAINING[::37])] + [(900, "Prof.Rova\n\n*** – “Dr. The gate”. (Mr.) 3. März. x"), (900, None), (901, ""), (902, "Am 3. März – 4. Der Turm. vgl. Nr. 5. e.g. the gate.")]
    df = spark.createDataFrame(rows, "chunk_no long, text string")
    ends = [sorted(map(tuple, S.sentence_ends(df, how).collect())) for how in (small, large)]
    assert ends[0] == ends[1] and len(ends[0]) > 10
