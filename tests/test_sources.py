import json

import pytest
from leafline import cli
from leafline.operators import chunking, lines
from leafline.sources import config, jsonio, manual, pdf
from leafline.streaming import ingest
from pyspark.sql import functions as F


def two_pages():
    """A stand-in extractor; local, so that workers get it by value."""

    class TwoPages:
        def pages(self, content):
            if content == b"broken":
                raise OSError("no PDF")
            lines = [{"text": "Some text of the page", "top": 100.0, "bottom": 110.0}]
            return [{"width": 600.0, "height": 800.0, "lines": lines, "extraction_error": None}, {"width": 600.0, "height": 800.0, "lines": [], "extraction_error": "ValueError: bad"}]

    return TwoPages()


def test_pdf_files_to_clean_pages(spark, tmp_path):
    from leafline.operators.lines import clean_pages

    (tmp_path / "a.PDF").write_bytes(b"x")
    (tmp_path / "b.pdf").write_bytes(b"broken")
    (tmp_path / "c.txt").write_bytes(b"x")
    files = pdf.read_files(spark, str(tmp_path))
    assert {r.file_name for r in files.collect()} == {"a.PDF", "b.pdf"}
    pages = clean_pages(*pdf.to_tables(pdf.extract(files, two_pages()), files)).collect()
    assert sorted((p.text, p.extraction_error) for p in pages if p.page_number == 1) == [("", "OSError: no PDF"), ("Some text of the page", None)]
    assert [p.extraction_error for p in pages if p.page_number == 2] == ["ValueError: bad"]


def test_environment_and_precedence(tmp_path):
    (tmp_path / "env").write_text("# note\nA=1\nB='two'\n\nC\n")
    env = {"A": "kept"}
    config.load_env(tmp_path / "env", env)
    config.load_env(tmp_path / "missing", env)
    assert env == {"A": "kept", "B": "two"}
    assert config.setting("x", "A", "d", env) == "x" and config.setting(None, "A", "d", env) == "kept" and config.setting(None, "Z", "d", env) == "d"


def test_model_place(tmp_path):
    folder = tmp_path / "models--a--b"
    (folder / "refs").mkdir(parents=True)
    (folder / "refs" / "main").write_text("abc\n")
    (folder / "snapshots" / "abc").mkdir(parents=True)
    assert config.model_place("a/b", tmp_path).endswith("snapshots/abc")
    assert config.model_place("x/y", tmp_path, True) == "x/y"
    with pytest.raises(FileNotFoundError):
        config.model_place("x/y", tmp_path)


def test_json_files_and_commands(spark, tmp_path, capsys):
    chunks = [{"chunk_id": f"d_{i}", "chunk_index": i, "text": t, "page_range": "1", "source_pages": [1], "page_segments": [{"page": 1, "text": t}]} for i, t in enumerate(["the harbour gate", "a mill"])]
    (tmp_path / "c.json").write_text(json.dumps({"source": {"file_name": "d.pdf"}, "chunks": chunks}))
    (tmp_path / "q.json").write_text(json.dumps({"cases": [{"id": "1", "query": "harbour gate", "relevant_chunk_ids": ["d_0"]}]}))
    (tmp_path / "bad.json").write_text(json.dumps({"cases": [{"id": "1", "query": "x", "relevant_chunk_ids": ["zz"]}]}))
    (tmp_path / "p.json").write_text(json.dumps({"source": {"file_name": "d.pdf"}, "pages": [{"page_number": 1, "text": "A line."}, {"page_number": 2}]}))
    c = str(tmp_path / "c.json")
    assert cli.run(["search", c, "harbour", "gate", "--json"], spark) == 0 and "d_0" in capsys.readouterr().out
    assert cli.run(["ask", c, "harbour gate", "--json"], spark) == 0 and "S1" in capsys.readouterr().out
    assert cli.run(["evaluate", c, str(tmp_path / "q.json"), "--json"], spark) == 0 and '"hit":1.0' in capsys.readouterr().out
    assert cli.run(["evaluate", c, str(tmp_path / "bad.json")], spark) == 1
    assert cli.run(["search", c, "  "], spark) == 1 and cli.run(["search", c, "x", "--top-k", "0"], spark) == 1
    assert cli.run(["chunk", str(tmp_path / "p.json"), str(tmp_path / "out")], spark) == 0
    assert [r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["A line."]
    assert jsonio.pages_path("in/x.pdf") == "parsed/x.json" and jsonio.chunks_path("x_pages.json") == "chunks/x_chunks.json"


def test_stream_appends_and_the_last_batch_counts(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    make = lambda text, at: spark.createDataFrame([(1, 1, text, at)], "file_id long, page_number int, text string, at string").selectExpr("file_id", "page_number", "text", "cast(at as timestamp) parsed_at").write.mode("append").parquet(source)
    for text, at in (("Old text.", "2024-01-01"), ("New text.", "2024-02-01")):
        make(text, at)
        ingest.start(spark, source, target, str(tmp_path / "check")).awaitTermination()
    assert [r.text for r in ingest.latest(spark, target).collect()] == ["New text."]


def test_documents_come_back_as_they_were_written(spark, tmp_path):
    pages = spark.createDataFrame([(1, n, n - 1, f"Text {n}.", 7, 2, True, n == 2, None, 0, 0, 0) for n in (2, 1)] + [(2, 1, 0, "", 0, 0, False, True, "broken", 1, 0, 0)], "file_id long, page_number int, page_index int, text string, char_count int, word_count int, has_text boolean, needs_ocr boolean, extraction_error string, repeated_lines_removed int, low_information_lines_removed int, unmapped_glyphs_removed int")
    files = spark.createDataFrame([(1, "a b.pdf", "/a b.pdf", 5, "x"), (2, "c.pdf", "/c.pdf", 6, "y")], "file_id long, file_name string, path string, size_bytes long, sha256 string")
    jsonio.write_page_documents(pages, files, str(tmp_path / "pages"))
    back = jsonio.read_pages(spark, str(tmp_path / "pages"))
    assert sorted((r.document, r.page_number, r.text, r.needs_ocr) for r in back.collect()) == [("a b", 1, "Text 1.", False), ("a b", 2, "Text 2.", True), ("c", 1, "", True)]
    assert len(list((tmp_path / "pages").glob("part-*.txt"))) == 2
    assert cli.run(["chunk", str(tmp_path / "pages"), str(tmp_path / "chunks"), "--json"], spark) == 0
    chunks = jsonio.read_chunks(spark, str(tmp_path / "chunks")).collect()
    assert [(r.chunk_id, r.text, r.page_range) for r in chunks] == [("a b_chunk_0000", "Text 1.\n\nText 2.", "1-2")]


def test_a_pdf_is_read_chunked_and_asked_in_one_command(spark, tmp_path, capsys, monkeypatch):
    class Reader:
        def pages(self, content):
            lines = [{"text": t, "top": 100.0 + 20 * k, "bottom": 110.0 + 20 * k} for k, t in enumerate(["The harbour gate opens at nine.", "It closes when the ferry has left."])]
            return [{"width": 600.0, "height": 800.0, "lines": lines, "extraction_error": None}, {"width": 600.0, "height": 800.0, "lines": [], "extraction_error": None}]

    monkeypatch.setattr(pdf, "PdfPlumberExtractor", Reader)
    monkeypatch.delenv("CHAT_API_KEY", raising=False)
    (tmp_path / "Guide.PDF").write_bytes(b"%PDF-1.4 test")
    argv = ["ask-pdf", str(tmp_path / "Guide.PDF"), "when", "does the harbour gate open?", "--parsed-dir", str(tmp_path / "p"), "--chunks-dir", str(tmp_path / "c"), "--env-file", str(tmp_path / "none"), "--json"]
    assert cli.run(argv, spark) == 0
    out, err = capsys.readouterr()
    said = json.loads(out)
    assert "[S1, page 1]" in said["answer"] and said["citation_count"] == 1 and said["invalid"] == [] and (said["page_count"], said["pages_needing_ocr"], said["chunk_count"]) == (2, 1, 1) and "stand-in" in err
    assert cli.run(["search", str(tmp_path / "c" / "Guide"), "ferry", "--json"], spark) == 0 and "Guide_chunk_0000" in capsys.readouterr().out
    assert cli.run(["agent", str(tmp_path / "c" / "Guide"), "how many pages are there?", "--pages-file", str(tmp_path / "p" / "Guide"), "--json", "--env-file", "none"], spark) == 0
    assert "Guide: 2 pages, 1 chunks." in capsys.readouterr().out
    for bad in (["ask-pdf", str(tmp_path / "no.pdf"), "x"], [*argv, "--top-k", "9", "--candidate-k", "2"], [*argv, "--max-chars", "10"], [*argv, "--max-context-chars", "0"]):
        assert cli.run(bad, spark) == 1


def test_searches_experiments_and_reports_as_commands(spark, tmp_path, capsys):
    lines_of, pages_of, cases = manual.tables(spark, 4)
    pages = lines.clean_pages(lines_of, pages_of)
    chunks = chunking.build_chunks(pages, 120, 200, 0).selectExpr("*", "concat('m_chunk_', chunk_index) as chunk_id")
    chunks.write.parquet(str(tmp_path / "chunks"))
    c = str(tmp_path / "chunks")
    run = lambda *argv: (cli.run([*argv, "--json"], spark), [json.loads(x) for x in capsys.readouterr().out.splitlines()])
    code, rows = run("semantic-search", c, "logs of the routes service", "--top-k", "2")
    assert code == 0 and [r["rank"] for r in rows] == [1, 2] and len(rows[0]["snippet"]) <= 263
    code, rows = run("vector-search", c, "routes", "--chunk-limit", "3", "--top-k", "3")
    assert code == 0 and len(rows) == 3 and rows[0]["shared_dimensions"][0]["token"] == "routes"
    n = chunks.count()
    code, rows = run("tfidf-experiment", c, "--query", "routes service", "--query", "服务")
    assert code == 0 and len(rows) == 2 * (2 * n + 1) and {r["rank"] for r in rows if r["experiment"] == 2} == set(range(1, n + 2)) and rows[0]["active_dimensions"] == ["route", "routes", "service"]
    code, rows = run("dense-experiment", c)
    assert code == 0 and len(rows) == 5 * (2 * n + 1)
    code, rows = run("context", c, "routes", "--max-context-chars", "150")
    assert code == 0 and len(rows[0]["context"]) <= 150
    code, rows = run("context", c, "routes", "--prompt")
    assert code == 0 and "Question: routes" in rows[0]["prompt"]
    held = {r.page_number: r.text for r in pages.collect()}
    assert all("Handbook" not in t and s["expected"] in t for s, t in zip(manual.sections(4), (held[k] for k in sorted(held))))
    labelled = cases.join(chunks.selectExpr("chunk_id", "explode(source_pages) as page"), F.array_contains("verified_pages", F.col("page"))).groupBy("id", "query", "verified_pages", "expected_in_answer").agg(F.collect_set("chunk_id").alias("relevant_chunk_ids"))
    labelled.withColumns({"evidence": F.lit(None).cast("string"), "not_in_document": F.array().cast("array<string>")}).write.parquet(str(tmp_path / "cases"))
    code, rows = run("evaluate", c, str(tmp_path / "cases"), "--top-k", "2", "--output", str(tmp_path / "r" / "report.json"))
    report = json.loads((tmp_path / "r" / "report.json").read_text())
    assert code == 0 and [m["stage"] for m in report["metrics"]] == ["dense", "reranked"] and len(report["cases"]) == 4
    assert all(len(x["rerank"]["results"]) == 2 and x["rerank"]["results"][0]["rank"] == 1 and {"chunk_id", "score", "page_range"} <= set(x["embedding"]["results"][0]) for x in report["cases"])
    labelled.withColumn("relevant_chunk_ids", F.array().cast("array<string>")).withColumn("evidence", F.lit("")).write.parquet(str(tmp_path / "unlabelled"))
    assert cli.run(["evaluate", c, str(tmp_path / "unlabelled")], spark) == 1
    assert cli.run(["manual", str(tmp_path / "m.html"), "--sections", "3"], spark) == 0 and (tmp_path / "m.html").read_text().count("<section>") == 3


def test_the_chat_model_comes_from_arguments_environment_and_file(tmp_path):
    (tmp_path / ".env").write_text("CHAT_API_KEY=k\nCHAT_BASE_URL=https://a.test/\nCHAT_MODEL=m1\n")
    client = config.chat_client(tmp_path / ".env", environment={})
    assert (client.base_url, client.model, client.api_key, client.temperature) == ("https://a.test", "m1", "k", 0.2)
    client = config.chat_client(tmp_path / ".env", "https://b.test", None, 50, 0.7, "high", 5, {"CHAT_MODEL": "m2"})
    assert (client.base_url, client.model, client.max_tokens, client.timeout) == ("https://b.test", "m2", 50, 5) and "temperature" not in client.payload([])
    assert config.chat_client(tmp_path / "none", environment={}) is None
    with pytest.raises(ValueError):
        config.chat_client(tmp_path / "none", environment={"CHAT_API_KEY": "k"})


def test_chat_over_http(tmp_path):
    import http.server
    import threading

    from leafline.providers import HttpChat

    class Endpoint(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            fine = self.path == "/v1/chat/completions" and self.headers["Authorization"] == "Bearer k"
            body = json.dumps({"choices": [{"message": {"content": asked["messages"][-1]["content"].upper()}}]} if fine else {"error": "no"}).encode()
            self.send_response(200 if fine else 403)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Endpoint)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}/v1"
    assert HttpChat(base, "m", "k").complete([{"role": "user", "content": "yes"}])["choices"][0]["message"]["content"] == "YES"
    with pytest.raises(RuntimeError, match="403"):
        HttpChat(base, "m", "wrong").complete([{"role": "user", "content": "x"}])
    server.shutdown()
    server.server_close()
    with pytest.raises(RuntimeError, match="no connection"):
        HttpChat(base, "m", "k", timeout=2).complete([])
