import math
import re
from collections import Counter

from leafline.functions.tokens import STOPWORDS, tokenize
from leafline.operators import retrieval as R
from pyspark.sql import functions as F

CHUNK = "chunk_no long, chunk_id string, file_id long, chunk_index int, text string, page_range string, created_at timestamp, query_id string"
TEXTS = ["Policies of the well-known harbour", "The harbour harbour is closed", "港口关闭 harbour's map", "", None, "nothing alike", "The ferry opens the mill"]


def corpus(spark, texts=TEXTS):
    return spark.createDataFrame([(i, f"c{i}", 1, i, t, "1", None, "clash") for i, t in enumerate(texts)], CHUNK)


def questions(spark, *qs):
    return spark.createDataFrame([(f"q{i}", q) for i, q in enumerate(qs)], "id string, query string")


def plain_tokens(text):
    out = []
    for t in re.findall(r"[a-z0-9]+(?:[-'][a-z0-9]+)?", (text or "").lower()):
        out += [t, *filter(None, re.split("[-']", t))]
        if t.endswith("ies") and len(t) > 4:
            out.append(t[:-3] + "y")
        elif t.endswith("s") and not t.endswith("ss") and len(t) > 3:
            out.append(t[:-1])
    for run in re.findall("[一-鿿]+", (text or "").lower()):
        out += [*run, *(run[i : i + 2] for i in range(len(run) - 1))]
    return [t for t in out if t not in STOPWORDS]


def test_tokens_equal_the_plain_version(spark):
    texts = [*TEXTS, "X's classes' glass buses -dash", "漢", "ÄÖ 12-3 a'b"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tokenize(F.col("t"))).collect()]
    assert got == [plain_tokens(t) for t in texts]
    assert plain_tokens("policies") == ["policies", "policies", "policy"]


def brute_bm25(texts, query):
    lists = [plain_tokens(t) for t in texts]
    df = Counter(t for x in lists for t in set(x))
    average = max(sum(map(len, lists)) / len(lists), 1.0)
    phrase = " ".join(query.split()).lower()
    out = {}
    for i, (x, t) in enumerate(zip(lists, texts)):
        tf = Counter(x)
        s = sum(math.log(1 + (len(texts) - df[k] + 0.5) / (df[k] + 0.5)) * tf[k] * 2.5 / (tf[k] + 1.5 * (0.25 + 0.75 * len(x) / average)) for k in set(plain_tokens(query)) if tf[k])
        s += 1.5 if len(phrase) >= 3 and phrase in " ".join((t or "").split()).lower() else 0
        if s > 0:
            out[f"c{i}"] = round(s, 4)
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


def test_bm25_equals_brute_force(spark):
    qs = ["harbour map", "the", "港口", "well-known", "zzz", "   ", "The ferry"]
    hits = R.bm25_search(corpus(spark), questions(spark, *qs), 3).collect()
    for i, q in enumerate(qs):
        got = [(r.chunk_id, r.score) for r in sorted(hits, key=lambda r: r.rank) if r.query_id == f"q{i}"]
        assert got == brute_bm25(TEXTS, q)[:3], q
    one = next(r for r in hits if r.query_id == "q0" and r.rank == 1)
    assert one.matched_terms == sorted(set(one.matched_terms)) and "harbour" in one.matched_terms


def test_search_over_nothing(spark):
    assert R.bm25_search(corpus(spark, []), questions(spark, "harbour")).count() == 0
    assert R.bm25_search(corpus(spark), questions(spark).limit(0)).count() == 0
    assert R.tfidf_search(corpus(spark, []), questions(spark, "harbour")).count() == 0


def test_tfidf_keeps_chunks_without_similarity(spark):
    hits = sorted(R.tfidf_search(corpus(spark), questions(spark, "ferry mill"), 3).collect(), key=lambda r: r.rank)
    assert [(r.chunk_id, r.similarity > 0) for r in hits] == [("c6", True), ("c0", False), ("c1", False)]


def test_rewritten_chunk_counts_once(spark):
    twice = corpus(spark).unionByName(corpus(spark).where("chunk_id = 'c1'").withColumns({"created_at": F.lit("2030-01-01").cast("timestamp"), "text": F.lit("replaced"), "chunk_no": F.lit(99).cast("long")}))
    assert {r.chunk_id: r.text for r in R.latest_chunks(twice).collect()}["c1"] == "replaced"
    assert R.latest_chunks(twice).count() == len(TEXTS)


def test_phrases_in_blocks(spark, monkeypatch):
    qs = questions(spark, "harbour harbour", "THE  FERRY", "ab", "港口关闭")
    whole = {tuple(r) for r in R.phrase_matches(corpus(spark), qs).collect()}
    assert whole == {("q0", "c1"), ("q1", "c6"), ("q3", "c2")}
    monkeypatch.setattr(R, "query_blocks", lambda df, key: ([r] for r in df.collect()))
    assert {tuple(r) for r in R.phrase_matches(corpus(spark), qs).collect()} == whole


def test_blocks_cover_every_question_once(spark):
    qs = spark.range(50).select(F.col("id").cast("string").alias("id"))
    for block in (1000, 50, 7):
        got = [[r.id for r in rows] for rows in R.query_blocks(qs, "id", block)]
        assert sorted(i for rows in got for i in rows) == sorted(str(i) for i in range(50)) and (len(got) == 1) == (block >= 50)
    assert list(R.query_blocks(qs.limit(0), "id")) == [[]]


def test_searches_in_blocks_equal_those_in_one(spark, monkeypatch):
    qs = questions(spark, "harbour map", "the", "港口", "well-known", "zzz", "ferry mill", None)
    run = lambda: ([sorted(map(tuple, R.bm25_search(corpus(spark), qs, 2).collect())), sorted(map(tuple, R.tfidf_search(corpus(spark), qs, 2).collect()))])
    whole = run()
    blocks = R.query_blocks
    monkeypatch.setattr(R, "query_blocks", lambda df, key: blocks(df, key, 2))
    assert run() == whole and len(whole[0]) >= 5 and len(whole[1]) == 14


def test_best_places_keep_the_first_of_equal_scores():
    import numpy as np

    rng = np.random.default_rng(2)
    for n in (0, 1, 3, 40):
        scores = rng.integers(0, 4, n).astype(float)
        scores[scores == 0] = -np.inf
        want = sorted(sorted((i for i in range(n) if scores[i] > -np.inf), key=lambda i: (-scores[i], i))[:3])
        assert sorted(R.best_places(scores, 3).tolist()) == want


def test_vectors_of_the_first_chunks_only(spark):
    hits = R.tfidf_search(corpus(spark), questions(spark, "ferry mill"), 3, limit=2).collect()
    assert {r.chunk_id for r in hits} == {"c0", "c1"} and all(r.similarity == 0 for r in hits)


def test_snippets():
    text = "start " + "filler " * 60 + "the harbour gate " + "filler " * 60
    s = R.focused_snippet(text, "harbour gate", [], 60)
    assert "harbour gate" in s and s.startswith("...") and s.endswith("...")
    assert R.focused_snippet(text, "zz", ["gate", "harbour"], 60).count("harbour") == 1
    assert R.focused_snippet("short", "zz", [], 60) == "short" and R.focused_snippet(None, "zz", ["a"], 60) == ""
