import pytest
from leafline.llm import mojibake as M

TEXTS = {
    "de": "Die Mühle schließt das Tor, für zwölf Stunden im März. Die Brücke öffnet früh, „sehr früh“.",
    "fr": "L’école ferme à midi, où la forêt s’arrête. « Déjà vu » dit-elle, près du château.",
    "ru": "Мельница закрывает мост, потому что дорога слишком узкая. Каждый вторник открывает порт.",
    "ja": "水車小屋は橋を閉じる。倉庫は港を支える。夜に、電線は塔を開く。",
    "zh": "磨坊关闭桥梁，因为道路太窄。每个星期二，仓库支持港口。春天，电缆打开高塔。",
    "ar": "تغلق الطاحونة الجسر، لأن الطريق ضيق جدا. كل ثلاثاء، تدعم المستودع الميناء.",
}


@pytest.fixture(scope="module")
def decoder(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS.values() for _ in range(60)] + [("plain text of the mill and the bridge",), (None,), ("",)], "text string")
    return M.Decoder(M.train([df]))


def wrong(text, read_as):
    """UTF-8 read as an encoding; bytes without a character stay as control characters."""
    return "".join(M.byte_table(read_as)[b] for b in text.encode())


@pytest.mark.parametrize("lang", list(TEXTS))
@pytest.mark.parametrize("read_as", ["cp1252", "latin-1", "mac_roman", "cp437", "cp1251"])
def test_utf8_read_wrongly_comes_back(decoder, lang, read_as):
    garbled = wrong(TEXTS[lang], read_as)
    restored, n = decoder.repair(garbled)
    assert n and restored == TEXTS[lang]


def test_twice_wrong_and_old_encodings(decoder):
    assert decoder.repair(wrong(wrong(TEXTS["de"], "cp1252"), "cp1252"))[0] == TEXTS["de"]
    assert decoder.repair(TEXTS["ru"].encode("cp1251").decode("latin-1"))[0] == TEXTS["ru"]
    assert decoder.repair(TEXTS["ja"].encode("cp932").decode("latin-1"))[1] > 0
    assert decoder.repair(TEXTS["zh"].encode("gbk").decode("latin-1"))[1] > 0
    assert decoder.repair(TEXTS["zh"].encode().decode("gbk", "replace"))[1] > 0


@pytest.mark.parametrize("text", [*TEXTS.values(), "The name Âkare and Lo Âga, Zurï, Mokå", "LE CÂBLE", "", "x", "“quoted”“again”", "(cid:12) text", "▒░▒░▒░▒░"])
def test_sound_texts_stay(decoder, text):
    assert decoder.repair(text) == (text, 0)


def test_lost_bytes_are_found_and_filled_from_known_words(decoder):
    text, n = decoder.repair("Die M�hle schlie�t das Tor")
    assert n == 2 and text == "Die Mühle schließt das Tor"
    part, n = decoder.repair(wrong("Die Mühle", "cp1252").replace("¼", "�"))
    assert n


def test_restore_keeps_rows(spark):
    good = [(i, t, "clash") for i, t in enumerate(TEXTS.values())] * 30
    rows = [*good, (90, wrong(TEXTS["de"], "cp1252"), ""), (90, wrong(TEXTS["de"], "cp1252"), ""), (91, None, ""), (92, "", "")]
    df = spark.createDataFrame(rows, "line_id long, text string, restored string")
    got = M.restore([("t", df, "line_id", "text")]).collect()
    assert sorted((r.record_table, r.record_id) for r in got) == [("t", 90), ("t", 90)] and got[0].restored == TEXTS["de"]
    assert M.restore([("t", df.limit(0), "line_id", "text")]).count() == 0


@pytest.mark.parametrize(("lang", "written", "read_as"), [("zh", "utf-8", "gbk"), ("ja", "utf-8", "cp932"), ("zh", "utf-8", "cp932")])
def test_lost_bytes_of_several_byte_channels_are_searched(decoder, lang, written, read_as):
    garbled = TEXTS[lang].encode(written).decode(read_as, "replace")
    restored, n = decoder.repair(garbled)
    assert M.LOST in garbled and n
    same = sum(a == b for a, b in zip(restored, TEXTS[lang]))
    assert len(restored) == len(TEXTS[lang]) and same >= len(restored) - 2 and all(a in (b, M.LOST) for a, b in zip(restored, TEXTS[lang]))


@pytest.mark.parametrize("read_as", ["gbk", "cp932", "big5", "euc_kr"])
def test_western_text_read_with_an_encoding_of_several_bytes(decoder, read_as):
    for text in ("Die Mühle schließt das Tor, für zwölf Stunden im März.", "L’école ferme à midi, où la forêt s’arrête, près du château."):
        garbled = text.encode().decode(read_as, "replace")
        restored, n = decoder.repair(garbled)
        assert n and (M.LOST in garbled or restored == text), (read_as, garbled, restored)


def test_all_passages_of_a_text_come_back_once_its_channel_is_sure(decoder):
    short = "Мельница закрывает мост, а порт открывает в д. и с ним. Мельница закрывает мост"
    for encoding in ("cp1251", "koi8_r"):
        garbled = "".join(M.byte_table("cp1252")[b] for b in short.encode(encoding))
        assert decoder.repair(garbled)[0] == short
    assert decoder.repair(wrong(wrong(wrong(wrong(wrong(TEXTS["de"], "cp1252"), "cp1252"), "cp1252"), "cp1252"), "cp1252"))[0] == TEXTS["de"]


def test_words_decide_about_lost_bytes_in_every_script(decoder):
    for lang in ("ru", "de", "fr"):
        garbled = TEXTS[lang].encode().decode("cp1252", "replace")
        restored, n = decoder.repair(garbled)
        assert n and restored == TEXTS[lang], (lang, restored)
    for lang, word in (("ru", "Мельница"), ("ar", "الطاحونة"), ("ru", "закрывает")):
        for k in range(1, len(word) - 1):
            assert decoder.repair(f"{TEXTS[lang]} {word[:k]}{M.LOST}{word[k + 1 :]}")[0] == f"{TEXTS[lang]} {word}"
    assert decoder.repair(TEXTS["ru"] + " За�������������ет")[1] == 1


def test_two_models_in_one_session_do_not_mix(spark):
    first, second = (M.share([spark.createDataFrame([(t,)] * 60, "text string")]) for t in (TEXTS["de"], TEXTS["ru"]))
    keys = {M.share([spark.createDataFrame([("text",)], "text string")], with_words=False).key for _ in range(8)}
    assert len(keys | {first.key, second.key}) == 10
    df = spark.createDataFrame([(1, "Die M�hle"), (2, "Мельни�а")], "id long, text string").coalesce(1)
    for _ in range(2):
        a, b = ({r.record_id: r.restored for r in M.restore([("t", df, "id", "text")], how).collect()} for how in (first, second))
        assert a == {1: "Die Mühle", 2: "Мельни�а"} and b == {1: "Die M�hle", 2: "Мельница"}


def test_no_reading_or_spelling_is_left_out(spark):
    """A rare character that only the one behind it asks for, and rare letters among thousands of spellings of a word."""
    import random

    draw = random.Random(1)
    often, rare, behind = [chr(0x5100 + k) for k in range(60)], "开", "缀"
    letters, word = "абвгдежзийклмнопрстуфхцчшщъыьэюя", "фъэщж"
    rows = ["".join(draw.choices(often, k=40)) for _ in range(200)] + [f"{rare}{behind}"] * 100
    rows += [" ".join("".join(draw.choices(letters, [3] * 20 + [2] * 12, k=5)) for _ in range(30)) for _ in range(100)] + [word, letters] * 30
    model = M.train([spark.createDataFrame([(t,) for t in rows], "text string")])
    decoder = M.Decoder(model)
    assert decoder._lattice([0xE5, M._ANY, M._ANY, *behind.encode()], "utf-8", (2, 3, 4), " ", " ") == rare + behind
    assert decoder._spelling([["ф"], *[list(letters)] * 4]) == word
    assert decoder.repair(f"ф{M.LOST * 3}ж")[0] == word
    assert decoder.repair(f"ф{M.LOST * 400}ж")[1] == 1
    chars = [*often, rare, behind, *letters, "a", " "]
    points = decoder._columns(chars)
    costs = decoder._follow_costs(points, points)
    assert all(abs(costs[i, j] - model.follow_cost(a, b)) < 1e-9 for i, a in enumerate(chars) for j, b in enumerate(chars))


def test_the_two_best_fillings_equal_all_of_them(decoder):
    from itertools import product

    options = list("абвгдеийклмнопрстуьюя")
    for word in (f"з{M.LOST}кры{M.LOST}{M.LOST}ет", f"{M.LOST}ост", f"п{M.LOST}р{M.LOST}"):
        every = []
        for spelt in product(options, repeat=word.count(M.LOST)):
            given = iter(spelt)
            o = "".join(next(given) if c == M.LOST else c for c in word)
            every.append((sum(decoder.model.word_cost(w) for w in M._words.findall(o)) + decoder.model.cost(o, " ", "."), o))
        got = decoder._fillings(word, " ", ".", options)
        assert got[0][1] == min(every)[1] and all(abs(a[0] - b[0]) < 1e-6 for a, b in zip(got, sorted(every)))


def test_a_passage_is_weighed_once_for_all_channels(decoder, monkeypatch):
    from collections import Counter

    weighed, cost = Counter(), decoder.model.cost
    monkeypatch.setattr(decoder.model, "cost", lambda text, before=" ", after=" ": weighed.update([text]) or cost(text, before, after))
    assert decoder.repair("ÀÁÂÃÄÅ, then ÈÉÊËÌÍ")[1] >= 0
    assert weighed and max(n for run, n in weighed.items() if run in ("ÀÁÂÃÄÅ", "ÈÉÊËÌÍ")) == 1


def test_the_two_best_fillings_with_words_split_by_signs_equal_all_of_them(decoder, monkeypatch):
    from itertools import product

    options = list("üéôßäàç’«„–́")
    for deep in (M.DEEP, 0):  # with the open starts in a queue, and depth first
        monkeypatch.setattr(M, "DEEP", deep)
        for word in (f"M{M.LOST}hle", f"m{M.LOST * 2}rz", f"{M.LOST}{M.LOST}cole", f"d{M.LOST}j{M.LOST}", f"{M.LOST * 3}", f"l{M.LOST * 2}t{M.LOST}x", f"schlie{M.LOST}t"):
            every = []
            for spelt in product(options, repeat=word.count(M.LOST)):
                given = iter(spelt)
                o = "".join(next(given) if c == M.LOST else c for c in word)
                every.append((sum(8.0 if w.isascii() else decoder.model.word_cost(w) for w in M._words.findall(o)) + decoder.model.cost(o, " ", "."), o))
            got = decoder._fillings(word, " ", ".", options)
            assert len(got) == 2 and all(abs(a[0] - b[0]) < 1e-6 for a, b in zip(got, sorted(every))), word
            assert len({o for _, o in got}) == 2 and all(abs(n - dict((b, a) for a, b in every)[o]) < 1e-6 for n, o in got)


def test_a_corpus_of_many_words_does_not_swell_the_search(spark, monkeypatch):
    """With as many words as fill the count sketch, words with many lost letters keep few starts open and known ones are still found."""
    import random
    from types import SimpleNamespace

    draw, plain, high = random.Random(2), "abcdefghijklmnoprstuvz", "äöüßéèçñ"
    letters = plain + high
    words = ["".join([*draw.choices(plain, k=k), draw.choice(high), *draw.choices(plain, k=8 - k)]) for k in draw.choices(range(1, 8), k=60_000)] + ["Mühlenstraße", "größer"] * 300
    model = M.train([spark.createDataFrame([(" ".join(words[k : k + 200]),) for k in range(0, len(words), 200)], "text string")])
    cells = model.words[M.STARTS_AT : M.STARTS_AT + M.SKETCH_COLUMNS]
    assert (cells > 0).mean() > 0.4
    pushed = [0]

    def push(queue, x):
        pushed[0] += 1
        assert pushed[0] < 100_000
        M_heapq.heappush(queue, x)

    M_heapq = M.heapq
    monkeypatch.setattr(M, "heapq", SimpleNamespace(heappush=push, heappop=M_heapq.heappop, nsmallest=M_heapq.nsmallest))
    decoder = M.Decoder(model)
    for word in (f"M{M.LOST * 6}e", f"{M.LOST * 12}a", f"k{M.LOST * 9}", f"{M.LOST * 5}e{M.LOST * 5}"):
        pushed[0] = 0
        assert decoder.repair(f"xx {word} yy")[1] == 1
    assert decoder.repair(f"xx M{M.LOST}hlenstra{M.LOST}e gr{M.LOST * 2}er")[0] == "xx Mühlenstraße größer"
    assert decoder._spelling([list(letters)] * 6) == "größer"
