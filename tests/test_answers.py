import json

import pytest
from leafline.operators import answers as A
from leafline.operators import dense, evaluate
from leafline.providers import HttpChat

SOURCES = "array<struct<source_id:string,source_pages:array<int>>>"


def contexts(spark, texts, scores=None, **kw):
    hits = spark.createDataFrame([("q", f"c{i}", i + 1, i + 1, 0.5, (scores or [1.0] * len(texts))[i]) for i in range(len(texts))], "query_id string, chunk_id string, rerank_rank int, base_rank int, base_similarity double, rerank_score double")
    chunks = spark.createDataFrame([(f"c{i}", "1", [1], [(1, t)], t) for i, t in enumerate(texts)], "chunk_id string, page_range string, source_pages array<int>, page_segments array<struct<page:int,text:string>>, text string")
    return A.build_contexts(hits, chunks, **kw)


def test_context_keeps_the_budget_and_numbers_kept_sources(spark):
    r = contexts(spark, ["alpha " * 40, "low", "beta " * 40, "gamma " * 40], [3.0, -6.0, 2.0, 1.0], max_context=420).collect()[0]
    assert len(r.context) <= 420
    assert [s.source_id for s in r.sources] == ["S1", "S2"] and [s.chunk_id for s in r.sources] == ["c0", "c2"]
    assert r.sources[1].truncated and r.context.startswith("[S1] chunk=c0 pages=1 rerank=3.000000 base_rank=1\n[p1] alpha")
    assert r.context.endswith("...")
    assert len(contexts(spark, ["word " * 900]).collect()[0].sources[0].text) <= 1200


def test_no_evidence_never_reaches_the_model(spark):
    class Refuses:
        def complete(self, messages, tools=None):
            raise AssertionError("asked")

    queries = spark.createDataFrame([("q", "who?"), ("z", "谁？")], "id string, query string")
    none = contexts(spark, ["x"], [-9.0])
    rows = {r.query_id: r for r in A.answer_questions(queries, none, Refuses()).collect()}
    assert not rows["q"].asked_model and rows["q"].answer.isascii() and not rows["z"].answer.isascii()


@pytest.mark.parametrize(
    ("answer", "count", "invalid"),
    [
        ("Fact [S1, page 2].", 1, []), ("Fact [S1].", 1, []), ("Bad [S9].", 1, ["S9"]), ("Bad [S1, page 7].", 1, ["S1, page 7"]), ("Range [S1, pages 2-4].", 1, []), ("Back [S1, pages 4-2].", 1, ["S1, pages 4-2"]),
        ("Two [S1, p. 2; S2, pp. 5, 6].", 2, []), ("第 [S1, 第 2].", 1, []), ("no citation [x]", 0, []), (None, 0, []), ("low [s1, page 2]", 0, []), ("[S1] [S3, page 1]", 2, ["S3, page 1"]),
        ("[S1, page 99999999999]", 1, ["S1, page 99999999999"]), ("[S1, page ٢]", 1, []), ("[S1, page ٣]", 1, ["S1, page ٣"]), ("见[S1, 第8页]", 1, ["S1, 第8"]), ("[见S1]", 0, []), ("[S1; s2, page 5; S2, page 5]", 3, ["s2, page 5"]),
        ("S1 is a state, see [note 1] and [p12].", 0, []), ("[S1, pages 2 – 4, 9]", 1, ["S1, pages 2 – 4, 9"]),
    ],
)
def test_citations(spark, answer, count, invalid):
    df = spark.createDataFrame([("q", answer, [("S1", [2, 4]), ("S2", [5, 6])])], f"query_id string, answer string, sources {SOURCES}")
    r = A.check_citations(df).collect()[0]
    assert (r.citation_count, list(r.invalid)) == (count, invalid)


def call(name="retrieve_pdf", arguments='{"query": "x"}', **kw):
    return {"choices": [{"message": {"content": None, "tool_calls": [{"id": "1", "type": "function", "function": {"name": name, "arguments": arguments}} | kw]}}]}


GOOD = call()
BAD = [
    None, [], {}, {"choices": []}, {"choices": [1, 2]}, {"choices": [{}]}, {"choices": [{"message": {"tool_calls": []}}]}, {"choices": [{"message": {"content": 3, "tool_calls": GOOD["choices"][0]["message"]["tool_calls"]}}]},
    call("drop"), call(arguments="{}"), call(arguments='{"query": ""}'), call(arguments='{"query": 1}'), call(arguments='{"query": "a", "query": "b"}'), call(arguments='{"query": "a"} x'), call(arguments='{"query": NaN}'),
    call(arguments="[]"), call(arguments={"query": "a"}), call(arguments='{"query": "a", "b": 1}'), call("document_status"), call(id=""), call(type="tool"), call(arguments=json.dumps({"query": "x" * 2001})), call(function=None),
]


def test_tool_calls(spark):
    assert A.parse_tool_call(GOOD)["arguments"] == {"query": "x"}
    assert A.parse_tool_call(call("document_status", "{}"))["arguments"] == {}
    for bad in BAD:
        with pytest.raises(ValueError):
            A.parse_tool_call(bad)
    df = spark.createDataFrame([("a", json.dumps(GOOD)), ("b", "{"), ("c", None), ("d", json.dumps(call("drop")))], "id string, response string")
    rows = {r.id: r for r in A.validate_tool_calls(df).collect()}
    assert (rows["a"].tool, rows["a"].query, rows["a"].error) == ("retrieve_pdf", "x", None)
    assert all(rows[i].error for i in "bcd")


def test_a_bad_response_fails_its_question_alone(spark):
    class Odd:
        def complete(self, messages, tools=None):
            text = messages[1]["content"]
            if "down" in text:
                raise RuntimeError("the endpoint is down")
            return {"choices": []} if "silent" in text else {"choices": [{"message": {"content": " yes [S2] "}}], "usage": {"total_tokens": 3}}

    queries = spark.createDataFrame([("a", "fine"), ("b", "silent"), ("c", "down"), ("d", None)], "id string, query string")
    one = contexts(spark, ["a fact"])
    known = one.select("sources", "context").crossJoin(queries.select("id")).withColumnRenamed("id", "query_id")
    rows = {r.query_id: r for r in A.answers_with_citations(queries, known, Odd()).collect()}
    assert (rows["a"].answer, rows["a"].total_tokens, rows["a"].error, rows["a"].citation_count, rows["a"].invalid) == ("yes [S2]", 3, None, 1, ["S2"])
    assert rows["b"].answer is None and "no answer text" in rows["b"].error and rows["b"].citation_count == 0
    assert rows["c"].error == "the endpoint is down" and rows["d"].answer == "yes [S2]"
    for bad in (None, [], {}, {"choices": {}}, {"choices": [[]]}, {"choices": [{"message": {"content": 3}}]}):
        with pytest.raises(RuntimeError):
            A.extract_answer(bad)


def test_agent_uses_the_users_question_and_two_calls(spark):
    queries = spark.createDataFrame([("q", " what? "), ("n", "other"), ("s", "How many pages?"), ("z", None)], "id string, query string")
    status = spark.createDataFrame([("s", '{"file_name": "a.pdf", "page_count": 3, "chunk_count": 2}')], "query_id string, status string")
    asked = []

    def retrieve(chosen):
        asked.extend(tuple(r) for r in chosen.collect())
        return contexts(spark, ["a fact"])

    rows = {r.query_id: r for r in A.run_agent(queries, retrieve, status).collect()}
    assert rows["q"].tool == "retrieve_pdf" and "[S1, page 1]" in rows["q"].answer and rows["q"].argument == "what?"
    assert rows["q"].citation_count == 1 and not rows["q"].invalid and rows["q"].source_count == 1 and rows["q"].answer_tokens > 0 and rows["q"].planning_tokens == 1
    assert "no evidence" in rows["n"].answer and rows["n"].answer_tokens == 0
    assert rows["s"].tool == "document_status" and rows["s"].answer == "a.pdf: 3 pages, 2 chunks." and rows["s"].argument is None
    assert rows["z"].error and rows["z"].answer is None
    assert sorted(asked) == [("n", "other"), ("q", "what?")]  # retrieval only for those for which it was chosen
    assert A.run_agent(queries, retrieve).where("query_id = 's'").collect()[0].answer == "Nothing is known of the document."


def test_the_tool_result_goes_to_the_model_as_a_message_of_the_tool(spark):
    planned = call(arguments='{"query": "another question"}', id="t7")

    class Reads:
        def complete(self, messages, tools=None):
            from json import loads

            if tools:
                return planned
            roles, told = [m["role"] for m in messages], loads(messages[3]["content"])
            return {"choices": [{"message": {"content": f"{roles[2:]} {messages[3]['tool_call_id']} {told['query']} {told['sources'][0]['source_id']} {'instruction' in told}"}}]}

    r = A.run_agent(spark.createDataFrame([("q", "mine")], "id string, query string"), lambda q: contexts(spark, ["a fact"]), client=Reads()).collect()[0]
    assert r.answer == "['assistant', 'tool'] t7 mine S1 True" and r.error is None


def test_payload_has_temperature_or_effort():
    assert "temperature" in HttpChat("http://x/", "m", "k").payload([]) and HttpChat("http://x/", "m", "k").payload([])["stream"] is False
    assert "temperature" not in HttpChat("http://x", "m", "k", reasoning_effort="high").payload([])


def test_nearest_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.normal(size=(120, 8)).astype("float32")
    v[7] = v[3]
    df = spark.createDataFrame([(i, v[i].tolist()) for i in range(120)] + [(200, None)], "vec_id long, vector array<float>")
    q = df.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in dense.nearest(df, q, 5, "vec_id", exclude_self=True).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    for i in (0, 50, 100):
        s = np.round(v.astype(float) @ v[i].astype(float), 12)
        assert got[i] == [j for j in sorted(range(120), key=lambda j: (-s[j], j)) if j != i][:5]
    bad = spark.createDataFrame([(1, [float("nan")])], "vec_id long, vector array<float>")
    with pytest.raises(Exception, match="finite"):
        dense.nearest(bad, bad.withColumnRenamed("vec_id", "query_id"), 1, "vec_id").collect()


def test_semantic_search_orders_ties_by_place(spark):
    chunks = spark.createDataFrame([("z", 1, 0, "1", "the mill gate"), ("a", 1, 1, "1", "the mill gate"), ("b", 2, 0, "2", None), ("c", 3, 0, "3", "harbour")], "chunk_id string, file_id long, chunk_index int, page_range string, text string")
    asked = spark.createDataFrame([("q", "mill gate"), ("n", None)], "id string, query string")
    rows = dense.semantic_search(chunks, asked, 3, snippet_chars=8).where("query_id = 'q'").orderBy("rank").collect()
    assert [r.chunk_id for r in rows][:2] == ["z", "a"] and rows[0].similarity == rows[1].similarity == round(rows[0].similarity, 6) and rows[0].snippet == "the mill..."
    with pytest.raises(ValueError):
        dense.semantic_search(chunks, asked, 0)
    dense_first = dense.search_two_stages(chunks, asked, 2, 4).where("query_id = 'q'").orderBy("base_rank").collect()
    assert dense_first[0].chunk_id == "z"


def test_metrics(spark):
    cases = spark.createDataFrame([("a", "q", ["c1", "c2"], None), ("b", "q", ["c9"], None), ("n", "q", [], None), ("m", "q", None, None)], "id string, query string, relevant_chunk_ids array<string>, evidence string")
    hits = spark.createDataFrame([("a", "c5", 1), ("a", "c2", 2), ("b", "c1", 1)], "query_id string, chunk_id string, rank int")
    r = evaluate.metrics(evaluate.case_results(hits, cases, 3), "s", 3).collect()[0]
    assert (r.cases, r.hit, r.mrr) == (2, 0.5, 0.25)
    chunks = spark.createDataFrame([("c1",), ("c2",)], "chunk_id string")
    assert [(x.query_id, x.chunk_id) for x in evaluate.unknown_labels(cases, chunks).collect()] == [("b", "c9")]
    assert evaluate.metrics(evaluate.case_results(hits.limit(0), cases.limit(0), 3), "s", 3).collect()[0].hit == 0.0
