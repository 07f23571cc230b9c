import random

import numpy as np
import pytest
from leafline.llm import truncation as X

SCHEMA = "doc_id long, source string, text string, target_text string, align_score double, lang string, target_lang string, points double"
NAMES = ["Bako", "Nova", "Zubo", "Rimi", "Tapo", "Lomi"]


def sentence(rng):
    verbs, nouns = ["opens", "closes", "measures", "finances"], ["harbour", "workshop", "committee", "warehouse"]
    tail = rng.choice(["", ", although nobody asked for it", ", because the road is too narrow"])
    return f"The {rng.choice(nouns)} of {rng.choice(NAMES)} {rng.choice(verbs)} the {rng.choice(nouns)}{tail}."


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(5)
    rows, cases = [], {}

    def add(source, text, target="Der Turm ist alt und das Tor bleibt zu.", score=0.9, case=False):
        cases[len(rows)] = case
        rows.append((len(rows), source, text, target, score, "en", "de", 1.0))

    for i in range(400):
        add("plain", f"{sentence(rng)} {sentence(rng)}")
    for i in range(120):
        t = f"{sentence(rng)} {sentence(rng)}"
        add("limited", t[:60], case=True) if i % 2 else add("limited", "The gate is old.")
    for t in ("The harbour of Bako opens the wareh", "The harbour of Nova closes the workshop, because the", "The committee of Rimi measures the", "The workshop of Zubo opens the committee, altho"):
        add("plain", t, case=True)
    add("plain", "The harbour of Bako opens [...]", case=True)
    # No sign but the corpus tells a title from a cut sentence, so there are enough of them to tell.
    for n in NAMES:
        for noun in ("harbour", "workshop", "committee", "warehouse", "archive", "ledger", "permit", "furnace", "garden", "bridge"):
            add("titles", f"The {noun} of {n}", f"Der Hafen von {n}")
    add("plain", "The harbour of Bako closes the workshop, although nobody asked for it", "Der Hafen von Bako schließt die Werkstatt")
    add("plain", "The gate is old. 🙂"), add("plain", None), add("plain", ""), add("plain", "  "), add(None, "The gate is old.", None, None), add("plain", "The committee of Rimi measures the", None, None, True)
    return rows, cases, {r.doc_id: r for r in X.truncated(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_cut_texts(judged):
    rows, cases, got = judged
    wrong = [(rows[i][2], got[i].probability if i in got else None, c) for i, c in cases.items() if (i in got and got[i].is_cut) != c]
    assert not wrong, wrong
    assert not any(rows[i][2] is None or not rows[i][2].strip() for i in got)


def counts_of(spark, texts, repeats=2):
    """(n_on, n_stop) of the values that have a longer copy, and the values."""
    df = spark.createDataFrame([(t,) for t in texts] * repeats, "value string").repartition(5)
    nothing = spark.sparkContext.broadcast(np.zeros(X.SKETCH_WORDS, np.uint64))
    rows = X.prefix_counts(df, nothing).where(f"kind = {X.VALUE}").groupBy("name").agg({"n_on": "sum", "n_stop": "sum"}).collect()
    return {r["name"]: (r["sum(n_on)"], r["sum(n_stop)"]) for r in rows}


@pytest.mark.parametrize("letters", ["ab ", "ab ."])
def test_every_longer_copy_counts_by_what_follows(spark, letters):
    rng = random.Random(1)
    texts = {X.value_of("".join(rng.choice(letters) for _ in range(rng.randint(1, 7)))) for _ in range(300)} | {"x", "xyz" * 1000} | {"The tower" + t for t in ("", ".", " opens", "s open", " (old)")}
    texts = {t for t in texts if t}
    want = {}
    for t in texts:
        counts = [0, 0]
        for o in texts:
            if o != t and o.startswith(t) and not X.finish_of(t)[2]:
                counts[X.what_follows(t, o)] += 1
        if any(counts):
            want[X.key(3, "", t)] = tuple(counts)
    got = counts_of(spark, texts)
    assert got == want and got[X.key(3, "", "The tower")] == (2, 2)


def test_contexts_equal_brute_force_whatever_the_partitions(spark):
    rng = random.Random(3)
    texts = {" ".join(rng.choice(["to", "tower", "tow", "gate.", "old,", "is", "塔は高い。門"]) for _ in range(rng.randint(1, 6))) for _ in range(200)}
    everything = np.full(X.SKETCH_WORDS, -1, np.int64).view(np.uint64)
    counter = X.Counter(everything)
    for t in texts:
        counter.add(t)
    df = spark.createDataFrame([(t,) for t in texts] * 3, "value string").repartition(6)
    rows = X.prefix_counts(df, spark.sparkContext.broadcast(everything)).where(f"kind = {X.PREFIX}").groupBy("name").sum("n_on", "n_stop", "n_final", "n_end").collect()
    assert {r[0]: list(r[1:]) for r in rows} == counter.counts
    plain = [w.strip(".,") for t in texts if "塔" not in t for w in t.split()]
    assert counter.counts[X.key(1, "", "tow")][0] >= plain.count("tower")


def test_a_long_run_of_letters_asks_for_its_wanted_prefixes_only():
    asked = np.zeros(X.SKETCH_WORDS, np.uint64)
    counter = X.Counter(asked)
    counter.add("n" * 200_000)
    assert not counter.counts and counter.totals[X.Counter.ON] == 199_999  # positions count all the same


def test_share_of_cuts_is_the_likeliest(spark):
    rng = np.random.default_rng(4)
    for share in (0.02, 0.5, 0.97):
        cut = rng.random(20_000) < share
        x = np.where(cut, rng.normal(1.0, np.sqrt(2.0), 20_000), rng.normal(-1.0, np.sqrt(2.0), 20_000))  # the nats of two normal laws
        values, n = np.unique(np.round(x, 1), return_counts=True)
        assert abs(X.share_of_cuts(values, n, 0.3, 1.0) - share) < 0.02


def test_shares_and_empty_table(spark, judged):
    df = spark.createDataFrame(judged[0], SCHEMA)
    shares = {r.source: r for r in X.cut_shares(X.truncated(df)).collect()}
    assert shares["limited"].n_cut == 60 and shares["titles"].cut_share == 0.0
    assert X.truncated(df.limit(0)).count() == 0


def test_a_longer_copy_makes_a_case_by_itself(spark):
    cases = {"Blue herons wander": True, "Quiet rivers carry stones": False, "Old lanterns gl": True, "Seven marble stairs": False}
    longer = ["Blue herons wander along the shore.", "Quiet rivers carry stones, as ever.", "Quiet rivers carry stones down.", "Old lanterns glimmer at dusk.", "Seven marble stairs\nlead up."]
    texts = [*cases, *longer]
    rows = [(i, "s", t, None, None, "en", "de", 1.0) for i, t in enumerate(texts)]
    got = {texts[r.doc_id]: r for r in X.truncated(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {t: got[t].is_cut for t in cases} == cases
    assert {t: got[t].n_longer > 0 and got[t].n_whole == 0 for t in cases} == cases
