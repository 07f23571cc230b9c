"""Labelled questions: checks of the labels, Hit@K and MRR@K."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafline.functions import text as T


def labels(cases: DataFrame) -> DataFrame:
    """(query_id, chunk_id) of the answerable cases; null and empty label lists give none."""
    return cases.select(F.col("id").alias("query_id"), F.explode("relevant_chunk_ids").alias("chunk_id")).where("chunk_id is not null").distinct()


def unknown_labels(cases: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id): labels that name no chunk. Empty for a sound set of cases."""
    return labels(cases).join(chunks.select("chunk_id"), "chunk_id", "left_anti").select("query_id", "chunk_id")


def invalid_cases(cases: DataFrame, labelled: bool = False) -> DataFrame:
    """(id, reason) of cases without id or question; with labelled also of those without a relevant chunk."""
    reason = F.when(F.coalesce(T.strip(F.col("id")), F.lit("")) == "", "no id").when(F.coalesce(T.strip(F.col("query")), F.lit("")) == "", "no query")
    if labelled:
        reason = reason.when(F.coalesce(F.size(F.filter("relevant_chunk_ids", lambda c: T.strip(c) != "")), F.lit(0)) <= 0, "no relevant chunk")
    return cases.select("id", reason.alias("reason")).where("reason is not null")


def compact_results(hits: DataFrame, chunks: DataFrame, k: int, rank_col: str, score_col: str) -> DataFrame:
    """(query_id, results): the k first hits of each question as (rank, chunk_id, score rounded to six digits, page_range)."""
    first = hits.where(F.col(rank_col) <= k).join(chunks.select("chunk_id", "page_range"), "chunk_id", "left")
    item = F.struct(F.col(rank_col).cast("int").alias("rank"), "chunk_id", F.round(score_col, 6).alias("score"), "page_range")
    return first.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("results"))  # k at most


def report(hits: DataFrame, cases: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(id, query, relevant_chunk_ids, verified_pages, embedding, rerank) of every labelled case: what each stage of a two-stage search found, whether that hit, and the reciprocal rank."""
    out = cases.join(labels(cases).select(F.col("query_id").alias("id")).distinct(), "id", "left_semi")
    pages = F.coalesce("verified_pages", F.array().cast("array<int>")) if "verified_pages" in cases.columns else F.array().cast("array<int>")
    out = out.select("id", "query", F.array_sort(F.array_distinct("relevant_chunk_ids")).alias("relevant_chunk_ids"), pages.alias("verified_pages"))
    for stage, rank_col, score_col in (("embedding", "base_rank", "base_similarity"), ("rerank", "rerank_rank", "rerank_score")):
        found = case_results(hits, cases, k, rank_col).join(compact_results(hits, chunks, k, rank_col, score_col), "query_id", "left")
        out = out.join(found.select(F.col("query_id").alias("id"), F.struct("results", "hit", "reciprocal_rank").alias(stage)), "id")
    return out


def case_results(hits: DataFrame, cases: DataFrame, k: int, rank_col: str = "rank") -> DataFrame:
    """(query_id, hit, first_rank, reciprocal_rank) of every answerable case; a case without hits counts as missed."""
    relevant = labels(cases)
    found = hits.where(F.col(rank_col) <= k).join(relevant, ["query_id", "chunk_id"], "left_semi").groupBy("query_id").agg(F.min(rank_col).alias("first_rank"))
    return relevant.select("query_id").distinct().join(found, "query_id", "left").select("query_id", F.col("first_rank").isNotNull().alias("hit"), "first_rank", F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)).alias("reciprocal_rank"))


def metrics(results: DataFrame, stage: str, k: int) -> DataFrame:
    """One row: stage, k, cases, hit and mrr rounded to four digits."""
    return results.agg(F.count("*").alias("cases"), F.round(F.coalesce(F.avg(F.col("hit").cast("double")), F.lit(0.0)), 4).alias("hit"), F.round(F.coalesce(F.avg("reciprocal_rank"), F.lit(0.0)), 4).alias("mrr")).select(F.lit(stage).alias("stage"), F.lit(k).alias("k"), "cases", "hit", "mrr")


def evidence_labels(cases: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id): chunks whose compacted text contains the case's compacted evidence.

    All evidence texts go through each chunk in one pass, as phrases of search do.
    """
    from leafline.operators.retrieval import phrase_matches

    asked = cases.where("evidence is not null").select("id", F.col("evidence").alias("query"))
    return phrase_matches(chunks, asked)


def answer_checks(answers: DataFrame, cases: DataFrame) -> DataFrame:
    """(query_id, answerable, asked_model, has_expected): whether answers hold the expected words and unanswerable cases are declined."""
    rows = answers.join(cases.select(F.col("id").alias("query_id"), "expected_in_answer", "not_in_document", (F.coalesce(F.size("relevant_chunk_ids"), F.lit(0)) > 0).alias("answerable")), "query_id")
    return rows.select("query_id", "answerable", "asked_model", F.when(F.col("expected_in_answer").isNotNull(), F.col("answer").contains(F.col("expected_in_answer"))).alias("has_expected"))
