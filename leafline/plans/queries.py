"""Named queries over the tables of a data directory, one or more per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.functions import text as T
from leafline.functions.tokens import tokenize
from leafline.operators import answers, chunking, dense, evaluate, experiments, lines, retrieval
from leafline.plans import oracle
from leafline.session import table

Query = Callable[[SparkSession, str], DataFrame]
_registry: dict[str, Query] = {}


def query(f: Query) -> Query:
    _registry[f.__name__] = f
    return f


def _joined(c: str, separator: str = "|"):
    """Arrays as text, so that results compare by value."""
    return F.array_join(F.transform(c, lambda x: x.cast("string")), separator)


def _lines(spark, d):
    return table(spark, d, "extract_page_lines")


def _pages(spark, d):
    return lines.latest_pages(table(spark, d, "parsed_pages"))


def _clean(spark, d):
    return lines.clean_pages(_lines(spark, d), table(spark, d, "parsed_pages"))


def _chunks(spark, d):
    return retrieval.latest_chunks(table(spark, d, "chunks"))


def _cases(spark, d):
    return table(spark, d, "eval_cases")


# ------------------------------------------------------------------ lines and pages


@query
def text_counts(spark, d):
    """Words and size of every line."""
    return _lines(spark, d).where("text is not null").select("line_id", T.count_words(F.col("text")).alias("words"), T.text_size(F.col("text")).alias("size"))


@query
def normalized_lines(spark, d):
    """Every line with glyphs mapped, placeholders removed and blanks at its ends stripped."""
    return _lines(spark, d).where("text is not null").select("line_id", T.normalize_text(T.strip_unmapped_glyphs(F.col("text"))).alias("text"))


@query
def low_information_lines(spark, d):
    """Lines that hold neither a word nor a number nor an ideograph, rows of digits in body size aside."""
    rows = lines.latest_lines(_lines(spark, d))
    return lines.mark_lines(rows, _pages(spark, d)).where("is_low_information").select("line_id", "text")


@query
def body_heights(spark, d):
    """Median line height of each document."""
    return lines.body_heights(lines.latest_lines(_lines(spark, d))).select("file_id", F.round("body_height", 6).alias("body_height"))


@query
def repeated_header_lines(spark, d):
    """Keys of the lines that repeat at head or foot within a document."""
    return lines.repeated_keys(lines.latest_lines(_lines(spark, d)), _pages(spark, d))


@query
def repeated_lines_report(spark, d):
    """Per document the repeated lines, each as first seen."""
    rows = lines.latest_lines(_lines(spark, d))
    return lines.repeated_report(rows, _pages(spark, d)).select("file_id", _joined("repeated_lines", "\n").alias("repeated_lines"))


@query
def paragraph_texts(spark, d):
    """Page texts of all lines, with paragraph gaps."""
    return lines.page_texts(lines.latest_lines(_lines(spark, d)))


@query
def pages_cleaned(spark, d):
    """The record of every page after cleaning."""
    return _clean(spark, d)


@query
def documents_rollup(spark, d):
    """Page counts and removal counters of each document."""
    return lines.documents(_clean(spark, d))


@query
def ocr_pages(spark, d):
    """Page numbers of each document that need OCR."""
    return _clean(spark, d).where("needs_ocr").groupBy("file_id").agg(F.array_sort(F.collect_list("page_number")).alias("p")).select("file_id", _joined("p", ",").alias("pages"))


@query
def source_hashes(spark, d):
    """Files with the digest they are known by, as registered last."""
    files = table(spark, d, "source_files")
    return files.groupBy("file_id").agg(F.max_by("sha256", "registered_at").alias("sha256"), F.max_by("size_bytes", "registered_at").alias("size_bytes"), F.count("*").alias("registrations"))


@query
def content_digests(spark, d):
    """Digest and size in bytes of every chunk's text, made as those of files are."""
    return table(spark, d, "chunks").where("text is not null").select("chunk_no", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"), F.octet_length("text").cast("long").alias("size_bytes"))


# ------------------------------------------------------------------ units and chunks


@query
def unit_starts(spark, d):
    """Lines that open a new unit."""
    return lines.latest_lines(_lines(spark, d)).where(T.starts_unit(F.col("text"))).select("line_id")


@query
def unit_texts(spark, d):
    """Chunk texts as single-line units."""
    return table(spark, d, "chunks").where("text is not null").select("chunk_no", T.normalize_unit(F.col("text")).alias("unit"))


@query
def sentence_splits(spark, d):
    """Chunk texts cut at the marks that close sentences."""
    return table(spark, d, "chunks").where("text is not null").select("chunk_no", F.posexplode(T.split_sentences(F.col("text"))).alias("place", "sentence"))


@query
def page_ranges(spark, d):
    """Page ranges of the chunks by gaps and islands."""
    return chunking.page_ranges(table(spark, d, "chunks"), "chunk_no")


@query
def chunks_built(spark, d):
    """Chunks packed from the cleaned pages."""
    built = chunking.with_ids(chunking.build_chunks(_clean(spark, d)), table(spark, d, "source_files"))
    return built.select("chunk_id", "file_id", "chunk_index", "text", "char_count", "word_count", "page_range", "start_page", "end_page", "overlap_from_previous", F.size("page_segments").alias("n_segments"))


@query
def chunk_pack(spark, d):
    """The lines of each document packed as units, with overlap."""
    rows = lines.latest_lines(_lines(spark, d)).select("line_id", "page_id", "file_id", F.col("line_no").alias("place"), T.normalize_unit(F.col("text")).alias("text"))
    units = rows.where("text != ''").join(_pages(spark, d).select("page_id", "page_number"), "page_id", "left")
    return chunking.pack_units(units).select("file_id", "chunk_index", "text", "char_count", "overlap_from_previous")


@query
def chunk_segments(spark, d):
    """Page segments of the packed chunks, one row each."""
    rows = lines.latest_lines(_lines(spark, d)).select("page_id", "file_id", F.col("line_no").alias("place"), T.normalize_unit(F.col("text")).alias("text"))
    units = rows.where("text != ''").join(_pages(spark, d).select("page_id", "page_number"), "page_id", "left")
    return chunking.pack_units(units).select("file_id", "chunk_index", F.posexplode("page_segments").alias("place", "s"), "page_range", "start_page", "end_page").select("file_id", "chunk_index", "place", "s.page", F.length("s.text").alias("chars"), "page_range", "start_page", "end_page")


NARROW = 60  # a limit at which sentences, clauses and words all have to be cut


@query
def unit_parts(spark, d):
    """Chunk texts in parts within the limit of a chunk."""
    return chunking.split_units(table(spark, d, "chunks"), "chunk_no")


@query
def unit_parts_narrow(spark, d):
    """Chunk texts in parts within a narrow limit."""
    return chunking.split_units(table(spark, d, "chunks"), "chunk_no", limit=NARROW)


@query
def chunk_runs(spark, d):
    """Per document the number of chunks and characters that packing made."""
    return chunking.build_chunks(_clean(spark, d)).groupBy("file_id").agg(F.count("*").alias("chunk_count"), F.sum("char_count").alias("chars"))


# ------------------------------------------------------------------ lexical retrieval


@query
def token_postings(spark, d):
    """Term frequencies of every chunk."""
    return retrieval.postings(_chunks(spark, d), "chunk_id").select("chunk_id", "token", "tf", F.col("n_tokens").cast("long").alias("n_tokens"))


@query
def document_frequencies(spark, d):
    """Number of chunks that hold each token."""
    return retrieval.document_frequency(retrieval.postings(_chunks(spark, d), "chunk_id"))


@query
def corpus_statistics(spark, d):
    """Number of chunks and their average length in tokens."""
    return retrieval.corpus_size(_chunks(spark, d)).select("n_texts", F.round("avg_tokens", 6).alias("avg_tokens"))


@query
def bm25_topk(spark, d):
    """The best three chunks of every evaluation question."""
    hits = retrieval.bm25_search(table(spark, d, "chunks"), _cases(spark, d))
    return hits.select("query_id", "rank", "chunk_id", "score", _joined("matched_terms").alias("matched_terms"), "page_range")


@query
def bm25_snippets(spark, d):
    """Snippets of the best chunks."""
    return retrieval.bm25_search(table(spark, d, "chunks"), _cases(spark, d)).select("query_id", "rank", "snippet")


@query
def phrase_matches(spark, d):
    """Chunks that contain a case's evidence as a phrase of the question's kind."""
    return evaluate.evidence_labels(_cases(spark, d), _chunks(spark, d))


@query
def tfidf_topk(spark, d):
    """The best three chunks by TF-IDF cosine."""
    return retrieval.tfidf_search(table(spark, d, "chunks"), _cases(spark, d))


@query
def tfidf_dimensions(spark, d):
    """The heaviest dimensions of every question's vector."""
    _, q = retrieval.tfidf_vectors(_chunks(spark, d), _cases(spark, d))
    return retrieval.top_dimensions(q, "query_id")


@query
def tfidf_dimension_counts(spark, d):
    """How many dimensions of the corpus each question has."""
    _, q = retrieval.tfidf_vectors(_chunks(spark, d), _cases(spark, d))
    return q.where("weight > 0").groupBy("query_id").agg(F.count("*").alias("dimensions"))


@query
def tfidf_shared_dimensions(spark, d):
    """What the best chunk of each question shares with it."""
    hits = retrieval.tfidf_search(table(spark, d, "chunks"), _cases(spark, d), 1)
    return retrieval.shared_dimensions(table(spark, d, "chunks"), _cases(spark, d), hits)


@query
def distractor_ranks(spark, d):
    """How many questions rank the distractor among their best three, in the corpus with it."""
    corpus = _chunks(spark, d).select("chunk_id", "file_id", "chunk_index", "created_at", "chunk_no", "text")
    other = spark.range(1).select(F.lit("distractor").alias("chunk_id"), F.lit(-1).cast("long").alias("file_id"), F.lit(0).alias("chunk_index"), F.lit(None).cast("timestamp_ntz").alias("created_at"), F.lit(-1).cast("long").alias("chunk_no"), F.lit(oracle.DISTRACTOR).alias("text"))
    hits = retrieval.tfidf_search(corpus.unionByName(other), _cases(spark, d))
    return hits.agg(F.count_if(F.col("chunk_id") == "distractor").alias("distractor_hits"), F.count("*").alias("hits"))


@query
def tfidf_wordings(spark, d):
    """The best three chunks under each wording of one question, without and with a distractor."""
    found = experiments.tfidf_experiment(table(spark, d, "chunks"), experiments.wordings(spark), 3)
    return found.select("experiment", "query_id", _joined("active_dimensions").alias("active_dimensions"), "rank", "chunk_id", "score")


@query
def dense_wordings(spark, d):
    """The same by dense similarity; a stand-in model."""
    return experiments.dense_experiment(table(spark, d, "chunks"), experiments.wordings(spark), 3)


# ------------------------------------------------------------------ dense retrieval, evaluation


@query
def dense_topk(spark, d):
    """Ten nearest vectors of every vector whose id is divisible by 50, itself aside."""
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    found = dense.nearest(v, v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), 10, "vec_id", exclude_self=True)
    return found.select("query_id", "rank", "vec_id", F.round("similarity", 6).alias("similarity"))


@query
def dense_label_metrics(spark, d):
    """Hit and reciprocal rank of the nearest vectors, where an equal label is relevant."""
    v = table(spark, d, "embeddings")
    found = dense.nearest(v.select("vec_id", F.col("embedding").alias("vector")), v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), 3, "vec_id", exclude_self=True)
    own = v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    per = found.join(v.select("vec_id", "label"), "vec_id").join(own, "query_id").groupBy("query_id").agg(F.min(F.when(F.col("label") == F.col("own"), F.col("rank"))).alias("first"))
    return per.agg(F.count("*").alias("queries"), F.round(F.avg(F.col("first").isNotNull().cast("double")), 4).alias("hit"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 4).alias("mrr"))


@query
def semantic_hits(spark, d):
    """One stage of dense search; a stand-in model."""
    return dense.semantic_search(_chunks(spark, d), _cases(spark, d)).select("query_id", "rank", "chunk_id", "chunk_index", "similarity", "page_range", "snippet")


@query
def tfidf_first_chunks(spark, d):
    """The best three of the first ten chunks by TF-IDF cosine, as the demonstration of the vectors ranks them."""
    return retrieval.tfidf_search(table(spark, d, "chunks"), _cases(spark, d), limit=10)


@query
def two_stage_hits(spark, d):
    """Dense candidates reranked; stand-in models."""
    return dense.search_two_stages(_chunks(spark, d), _cases(spark, d))


@query
def evaluation_metrics(spark, d):
    """Hit and MRR of lexical search over the answerable cases."""
    hits = retrieval.bm25_search(table(spark, d, "chunks"), _cases(spark, d))
    return evaluate.metrics(evaluate.case_results(hits, _cases(spark, d), 3), "bm25", 3)


@query
def evaluation_two_stages(spark, d):
    """Hit and MRR of both stages of dense search; stand-in models."""
    corpus, cases = _chunks(spark, d), _cases(spark, d)
    hits = dense.search_two_stages(corpus, cases, dense.CANDIDATES)
    base = evaluate.metrics(evaluate.case_results(hits, cases, 3, "base_rank"), "dense", 3)
    return base.unionByName(evaluate.metrics(evaluate.case_results(hits, cases, 3, "rerank_rank"), "reranked", 3))


@query
def evaluation_report(spark, d):
    """What both stages of dense search found for every labelled case; stand-in models."""
    corpus, cases = _chunks(spark, d), _cases(spark, d)
    return evaluate.report(dense.search_two_stages(corpus, cases, dense.CANDIDATES), cases, corpus, 3).select("id", F.size("relevant_chunk_ids").alias("n_relevant"), F.col("embedding.hit").alias("base_hit"), F.col("rerank.hit").alias("hit"), F.to_json("rerank.results").alias("results"))


@query
def unsound_cases(spark, d):
    """Cases that retrieval cannot be evaluated with, and why."""
    return evaluate.invalid_cases(_cases(spark, d), True)


@query
def unknown_labels(spark, d):
    """Labels of the cases that name no chunk."""
    return evaluate.unknown_labels(_cases(spark, d), _chunks(spark, d))


@query
def evidence_labels(spark, d):
    """Number of chunks that hold each case's evidence."""
    return evaluate.evidence_labels(_cases(spark, d), _chunks(spark, d)).groupBy("query_id").agg(F.count("*").alias("n_chunks"))


# ------------------------------------------------------------------ contexts, answers, agent


def _scored_hits(spark, d, cases=None):
    """BM25 hits as a second stage, with a logit of them that falls on both sides of the floor."""
    hits = retrieval.bm25_search(table(spark, d, "chunks"), _cases(spark, d) if cases is None else cases, 5)
    return hits.select("query_id", "chunk_id", F.col("rank").alias("rerank_rank"), F.col("rank").alias("base_rank"), (F.col("score") - oracle.LOGIT).alias("rerank_score"))


def _contexts(spark, d):
    return answers.build_contexts(_scored_hits(spark, d), _chunks(spark, d))


@query
def context_sources(spark, d):
    """Sources that fit each question's budget."""
    return _contexts(spark, d).select("query_id", F.explode("sources").alias("s")).select("query_id", "s.source_id", "s.chunk_id", "s.included_chars", "s.truncated", F.length("s.header").alias("header_chars"))


@query
def context_budgets(spark, d):
    """Length of each context, which never exceeds the budget."""
    return _contexts(spark, d).select("query_id", F.size("sources").alias("n_sources"), F.length("context").alias("used_chars"))


@query
def prompts(spark, d):
    """Prompts of the questions that have evidence."""
    return answers.prompts(_contexts(spark, d), _cases(spark, d))


@query
def evidence_gate(spark, d):
    """Answers of the stand-in model, and of the gate where there is no evidence."""
    return answers.answer_questions(_cases(spark, d), _contexts(spark, d)).select("query_id", "answer", "asked_model", "total_tokens", "error")


@query
def citation_checks(spark, d):
    """Citations of the answers against their sources, each answer as it is and with sound and broken citations added."""
    contexts = _contexts(spark, d)
    given = answers.answer_questions(_cases(spark, d), contexts).join(contexts.select("query_id", "sources"), "query_id", "left")
    kinds = F.explode(F.array(*[F.struct(F.lit(name).alias("kind"), F.lit(end).alias("end")) for name, end in oracle.CITED_BESIDES]))
    varied = given.select("query_id", "answer", "sources", kinds.alias("v")).select(F.concat_ws("/", "query_id", "v.kind").alias("query_id"), F.concat("answer", "v.end").alias("answer"), "sources")
    return answers.check_citations(varied).select("query_id", "citation_count", _joined("invalid").alias("invalid"))


@query
def answers_checked(spark, d):
    """Answers with the number of their sources and the check of their citations."""
    found = answers.answers_with_citations(_cases(spark, d), _contexts(spark, d))
    return found.select("query_id", "answer", "asked_model", F.coalesce(F.size("sources"), F.lit(0)).alias("n_sources"), "citation_count", _joined("invalid").alias("invalid"))


@query
def answer_outcomes(spark, d):
    """Whether the answers hold the expected words, and whether the unanswerable questions were declined."""
    found = evaluate.answer_checks(answers.answer_questions(_cases(spark, d), _contexts(spark, d)), _cases(spark, d))
    return found.withColumn("has_expected", F.col("has_expected").cast("string"))


@query
def document_status(spark, d):
    """What is known of each file."""
    return answers.document_status(table(spark, d, "source_files"), _pages(spark, d), _chunks(spark, d)).select("file_id", "file_name", "page_count", "chunk_count", _joined("ocr_pages", ",").alias("ocr_pages"), "limitations")


@query
def agent_answers(spark, d):
    """One bounded tool run for each question of the cases and for one question about the pages of each file, with the stand-in model."""
    known = answers.document_status(table(spark, d, "source_files"), _pages(spark, d), _chunks(spark, d))
    about = F.concat(F.lit("file/"), F.col("file_id").cast("string"))
    asked = _cases(spark, d).select("id", "query").unionByName(known.select(about.alias("id"), F.lit("How many pages were read?").alias("query")))
    status = known.select(about.alias("query_id"), F.to_json(F.struct("file_name", "page_count", "chunk_count", "ocr_pages", "limitations")).alias("status"))
    done = answers.run_agent(asked, lambda q: answers.build_contexts(_scored_hits(spark, d, q), _chunks(spark, d)), status)
    return done.select("query_id", "tool", "argument", "answer", "error", "source_count", "citation_count", _joined("invalid").alias("invalid"))


@query
def tool_calls(spark, d):
    """Planning responses checked: for every question a sound one and one of each kind that is refused."""
    q = _cases(spark, d).select("id", F.to_json(F.struct(F.col("query"))).alias("arguments"))
    message = lambda name, arguments: F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(F.lit("c1").alias("id"), F.lit("function").alias("type"), F.struct(F.lit(name).alias("name"), arguments.alias("arguments")).alias("function"))).alias("tool_calls")).alias("message"))).alias("choices")))
    sound = q.select(F.concat("id", F.lit("/sound")).alias("id"), message("retrieve_pdf", F.col("arguments")).alias("response"))
    kinds = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(response).alias("response")) for kind, response, _ in oracle.REFUSED_CALLS]))
    return answers.validate_tool_calls(sound.unionByName(q.select("id", kinds.alias("v")).select(F.concat("id", F.lit("/"), "v.kind").alias("id"), "v.response")))


def queries() -> dict[str, Query]:
    return dict(_registry)


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in oracle.statements().items() if name in _registry}
