"""Commands over files. Errors go to stderr and give exit code 1.

parse, chunk, search, vector-search, semantic-search, rerank-search, tfidf-experiment,
dense-experiment, context, ask, agent, ask-pdf, evaluate, manual.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.functions import text as T
from leafline.operators import answers, chunking, dense, evaluate, experiments, lines, retrieval
from leafline.providers import ChatClient, ExtractiveChat
from leafline.session import cut, get_session
from leafline.sources import config, jsonio, manual, pdf

POSITIVE = ("top_k", "candidate_k", "max_context_chars", "max_chunk_chars", "snippet_chars", "chunk_limit", "min_text_chars", "target_chars", "max_chars", "max_tokens", "timeout_seconds", "sections")
_packing = {"target-chars": chunking.TARGET, "max-chars": chunking.MAXIMUM, "overlap-chars": chunking.OVERLAP}
_search = {"snippet-chars": 260}
_stages = {"candidate-k": dense.CANDIDATES}
_budget = {"max-context-chars": answers.MAX_CONTEXT, "max-chunk-chars": answers.MAX_CHUNK}
_model = {"max-tokens": 600, "timeout-seconds": 60}


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="leafline")
    p.add_argument("--master", default="local[*]")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, help: str, places: list[str], numbers: dict[str, int] = {}, query: bool = False, model: bool = False, as_json: bool = True) -> argparse.ArgumentParser:  # noqa: B006
        c = sub.add_parser(name, help=help)
        for place in places:
            c.add_argument(place)
        if query:
            c.add_argument("query", nargs="+")
        for option, default in numbers.items():
            c.add_argument(f"--{option}", type=int, default=default)
        if model:
            c.add_argument("--env-file", default=".env"), c.add_argument("--base-url"), c.add_argument("--llm-model"), c.add_argument("--temperature", type=float, default=0.2)
        if as_json:
            c.add_argument("--json", action="store_true")
        return c

    command("parse", "PDF folder to cleaned pages: parquet, or one JSON file per document", ["folder", "output"], {"min-text-chars": T.MIN_TEXT_CHARS})
    command("chunk", "cleaned pages to chunks: parquet, or one JSON file per document", ["pages", "output"], _packing)
    command("search", "BM25", ["chunks"], {"top-k": 3} | _search, query=True)
    command("vector-search", "TF-IDF over the first chunks", ["chunks"], {"top-k": 3, "chunk-limit": 10} | _search, query=True)
    command("semantic-search", "dense vectors, one stage", ["chunks"], {"top-k": 3} | _search, query=True)
    for name in ("rerank-search", "dense-search"):
        command(name, "dense candidates, reranked", ["chunks"], {"top-k": 3} | _stages, query=True)
    for name in ("tfidf-experiment", "dense-experiment"):
        command(name, "rankings under several wordings, without and with a distractor", ["chunks"]).add_argument("--query", action="append", dest="wordings")
    command("context", "evidence within a budget", ["chunks"], {"top-k": 3} | _stages | _budget, query=True).add_argument("--prompt", action="store_true")
    ask = command("ask", "answer with checked citations", ["chunks"], {"top-k": 2} | _stages | _budget | _model, query=True, model=True)
    command("agent", "answer through one tool call", ["chunks"], {"top-k": 2} | _stages | _budget | _model, query=True, model=True).add_argument("--pages-file", help="cleaned pages, for the document's status")
    whole = command("ask-pdf", "from a PDF file to an answer", ["pdf"], {"min-text-chars": T.MIN_TEXT_CHARS, "top-k": 2} | _packing | _stages | _budget | _model, query=True, model=True)
    whole.add_argument("--parsed-dir", default="parsed"), whole.add_argument("--chunks-dir", default="chunks")
    for c in (ask, whole):
        c.add_argument("--thinking", choices=["disabled", "enabled"], default="disabled"), c.add_argument("--reasoning-effort", choices=["high", "max"], default="high")
    command("evaluate", "Hit and MRR of labelled questions", ["chunks", "cases"], {"top-k": 3} | _stages).add_argument("--output", help="place of the report as JSON")
    command("manual", "write a synthetic manual as HTML", ["output"], {"sections": 36}, as_json=False)
    return p


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of a JSON file, a folder of them, or parquet, each as written last."""
    if path.endswith(".json") or _holds_documents(path):
        df = jsonio.read_chunks(spark, path)
    else:
        df = spark.read.parquet(path)
        missing = {"chunk_no": F.xxhash64("chunk_id"), "created_at": F.lit(None).cast("timestamp")}
        df = df.withColumns({k: v for k, v in missing.items() if k not in df.columns})
    return retrieval.latest_chunks(df)


def _holds_documents(path: str) -> bool:
    """Whether a folder holds JSON documents as the writers leave them."""
    return Path(path).is_dir() and any(Path(path).glob("*.txt"))


def _show(df: DataFrame, as_json: bool) -> None:
    if as_json:
        for r in df.toJSON().toLocalIterator():
            print(r)
    else:
        df.show(truncate=False)


def _client(args: argparse.Namespace) -> ChatClient:
    effort = args.reasoning_effort if getattr(args, "thinking", "disabled") == "enabled" else None
    client = config.chat_client(args.env_file, args.base_url, args.llm_model, args.max_tokens, args.temperature, effort, args.timeout_seconds)
    if client is None:
        print("CHAT_API_KEY is not set: the stand-in answers", file=sys.stderr)
    return client or ExtractiveChat()


def _contexts(args: argparse.Namespace, corpus: DataFrame) -> Callable[[DataFrame], DataFrame]:
    return lambda asked: answers.build_contexts(dense.search_two_stages(corpus, asked, args.top_k, args.candidate_k), corpus, args.max_context_chars, args.max_chunk_chars)


def _answered(args: argparse.Namespace, corpus: DataFrame, asked: DataFrame) -> DataFrame:
    corpus = cut(corpus)
    return answers.answers_with_citations(asked, cut(_contexts(args, corpus)(asked)), _client(args))


def _parse(spark: SparkSession, folder: str, min_text_chars: int) -> tuple[DataFrame, DataFrame]:
    files = cut(pdf.read_files(spark, folder))
    extracted = cut(pdf.extract(files))
    return lines.clean_pages(*pdf.to_tables(extracted, files), min_text_chars), files.withColumn("file_id", F.xxhash64("sha256"))


def _parse_command(args, spark, asked) -> None:
    pages, files = _parse(spark, args.folder, args.min_text_chars)
    if args.json:
        jsonio.write_page_documents(pages, files, args.output)
    else:
        pages.write.mode("overwrite").parquet(args.output)


def _chunk_command(args, spark, asked) -> None:
    named = args.pages.endswith(".json") or _holds_documents(args.pages)
    pages = jsonio.read_pages(spark, args.pages) if named else spark.read.parquet(args.pages)
    name = F.col("document") if named else F.col("file_id").cast("string")
    names = pages.groupBy("file_id").agg(F.max(name).alias("file_name"))
    built = chunking.build_chunks(pages, args.target_chars, args.max_chars, args.overlap_chars)
    chunks = built.join(names, "file_id", "left").withColumn("chunk_id", F.format_string("%s_chunk_%04d", "file_name", "chunk_index")).drop("file_name")
    if args.json:
        nothing = {c: F.lit(None).cast("string") for c in ("path", "size_bytes", "sha256")}
        jsonio.write_chunk_documents(chunks, names.withColumns(nothing), args.output)
    else:
        chunks.write.mode("overwrite").parquet(args.output)


def _vector_search(args, spark, asked) -> None:
    corpus = cut(_chunks(spark, args.chunks))
    hits = cut(retrieval.tfidf_search(corpus, asked, args.top_k, args.chunk_limit))
    first = corpus.orderBy(*retrieval.PLACE).limit(args.chunk_limit)
    shared = retrieval.shared_dimensions(first, asked, hits).groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "token", "contribution"))), lambda x: F.struct(x["token"], x["contribution"])).alias("shared_dimensions"))
    shown = hits.join(first.select("chunk_id", "page_range", T.prefix_snippet(F.coalesce("text", F.lit("")), args.snippet_chars).alias("snippet")), "chunk_id").join(shared, "chunk_id", "left")
    _show(shown.orderBy("rank"), args.json)


def _experiment(args, spark, asked) -> None:
    corpus = cut(_chunks(spark, args.chunks))
    run = experiments.tfidf_experiment if args.command == "tfidf-experiment" else experiments.dense_experiment
    _show(run(corpus, experiments.wordings(spark, args.wordings), corpus.count() + 1).orderBy("experiment", "query_id", "rank"), args.json)


def _context(args, spark, asked) -> None:
    contexts = cut(_contexts(args, cut(_chunks(spark, args.chunks)))(asked))
    _show(answers.prompts(contexts, asked) if args.prompt else contexts.select("context", "sources"), args.json)


def _agent(args, spark, asked) -> None:
    corpus = cut(_chunks(spark, args.chunks))
    count = corpus.agg(F.count("*").alias("chunk_count"), F.max(F.substring_index("chunk_id", "_chunk_", 1)).alias("file_name"))
    known = count
    if args.pages_file:
        pages = jsonio.read_pages(spark, args.pages_file) if args.pages_file.endswith(".json") or _holds_documents(args.pages_file) else spark.read.parquet(args.pages_file)
        known = count.crossJoin(pages.agg(F.count("*").alias("page_count"), F.array_sort(F.collect_list(F.when(F.col("needs_ocr"), F.col("page_number")))).alias("ocr_pages")))  # one row each
    status = known.select(F.lit("q").alias("query_id"), F.to_json(F.struct(*known.columns, F.lit(answers.LIMITS).alias("limitations"))).alias("status"))
    _show(answers.run_agent(asked, _contexts(args, corpus), status, _client(args)), args.json)


def _ask_pdf(args, spark, asked) -> None:
    file = Path(args.pdf)
    if not file.exists() or file.suffix.lower() != ".pdf":
        raise ValueError(f"{file} is no PDF file")
    pages, files = _parse(spark, str(file), args.min_text_chars)
    pages = cut(pages)
    parsed, chunked = (str(Path(folder) / file.stem) for folder in (args.parsed_dir, args.chunks_dir))
    jsonio.write_page_documents(pages, files, parsed)
    chunks = cut(chunking.with_ids(chunking.build_chunks(pages, args.target_chars, args.max_chars, args.overlap_chars), files.withColumn("registered_at", F.current_timestamp())))
    jsonio.write_chunk_documents(chunks, files, chunked)
    counts = pages.agg(F.count("*").alias("page_count"), F.count_if("needs_ocr").alias("pages_needing_ocr")).crossJoin(chunks.agg(F.count("*").alias("chunk_count")))  # one row each
    corpus = retrieval.latest_chunks(chunks.withColumns({"chunk_no": F.xxhash64("chunk_id"), "created_at": F.lit(None).cast("timestamp")}))
    _show(_answered(args, corpus, asked).crossJoin(counts).withColumns({"parsed": F.lit(parsed), "chunks": F.lit(chunked)}), args.json)  # one row


def _evaluate(args, spark, asked) -> None:
    corpus = cut(_chunks(spark, args.chunks))
    cases = cut(jsonio.read_cases(spark, args.cases) if args.cases.endswith(".json") else spark.read.parquet(args.cases))
    unsound = [(r.id, r.reason) for r in evaluate.invalid_cases(cases, True).take(5)] + [tuple(r) for r in evaluate.unknown_labels(cases, corpus).take(5)]
    if unsound or not cases.take(1) or not corpus.take(1):
        raise ValueError(f"the cases are not sound: {unsound or 'there are none, or no chunks'}")
    hits = cut(dense.search_two_stages(corpus, cases, args.candidate_k, args.candidate_k))
    stages = [evaluate.metrics(evaluate.case_results(hits, cases, args.top_k, c), s, args.top_k) for s, c in (("dense", "base_rank"), ("reranked", "rerank_rank"))]
    both = cut(stages[0].unionByName(stages[1]))
    if args.output:
        Path(args.output).parent.mkdir(parents=True, exist_ok=True)
        head = {"input": {"chunks": args.chunks, "cases": args.cases, "chunk_count": corpus.count()}, "method": {"candidate_k": args.candidate_k, "top_k": args.top_k, "uses_llm": False}, "metrics": [r.asDict() for r in both.collect()]}
        with open(args.output, "w", encoding="utf-8") as out:
            out.write(json.dumps(head, ensure_ascii=False)[:-1] + ', "cases": [')
            for k, row in enumerate(evaluate.report(hits, cases, corpus, args.top_k).orderBy("id").toJSON().toLocalIterator()):  # case by case
                out.write((", " if k else "") + row)
            out.write("]}")
    _show(both, args.json)


_COMMANDS: dict[str, Callable] = {
    "parse": _parse_command, "chunk": _chunk_command, "vector-search": _vector_search, "tfidf-experiment": _experiment, "dense-experiment": _experiment, "context": _context, "agent": _agent, "ask-pdf": _ask_pdf, "evaluate": _evaluate,
    "search": lambda a, s, q: _show(retrieval.bm25_search(_chunks(s, a.chunks), q, a.top_k, a.snippet_chars).orderBy("rank"), a.json),
    "semantic-search": lambda a, s, q: _show(dense.semantic_search(_chunks(s, a.chunks), q, a.top_k, a.snippet_chars).orderBy("rank"), a.json),
    "rerank-search": lambda a, s, q: _show(dense.search_two_stages(_chunks(s, a.chunks), q, a.top_k, a.candidate_k).orderBy("rerank_rank"), a.json),
    "ask": lambda a, s, q: _show(_answered(a, _chunks(s, a.chunks), q), a.json),
    "manual": lambda a, s, q: Path(a.output).write_text(manual.html(a.sections), encoding="utf-8"),
}
_COMMANDS["dense-search"] = _COMMANDS["rerank-search"]


def run(argv: list[str], spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    try:
        if wrong := [n for n in POSITIVE if getattr(args, n, 1) <= 0]:
            raise ValueError(f"{wrong[0].replace('_', '-')} must be positive")
        if getattr(args, "top_k", 1) > getattr(args, "candidate_k", getattr(args, "top_k", 1)):
            raise ValueError("top-k must be at most candidate-k")
        if getattr(args, "target_chars", 0) > getattr(args, "max_chars", 0):
            raise ValueError("target-chars must be at most max-chars")
        query = " ".join(getattr(args, "query", ["-"])).strip()
        if not query:
            raise ValueError("the query is empty")
        if args.command == "manual":
            _COMMANDS["manual"](args, None, None)
            return 0
        spark = spark or get_session(master=args.master)
        _COMMANDS[args.command](args, spark, spark.createDataFrame([("q", query)], "id string, query string"))
        return 0
    except Exception as e:  # noqa: BLE001 - a command reports, it does not trace
        print(f"{args.command} failed: {e}", file=sys.stderr)
        return 1


def main() -> int:
    return run(sys.argv[1:])


if __name__ == "__main__":
    raise SystemExit(main())
