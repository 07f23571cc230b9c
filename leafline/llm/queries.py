"""Queries of the training-data problems over the tables of a data directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafline.llm import boilerplate, confusables, encoding, mixing, mojibake, quality
from leafline.llm import sentences as sentence_ops
from leafline.llm import splitting, truncation
from leafline.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _records(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame, str, str]]:
    return [("extract_page_lines", table(spark, sf_dir, "extract_page_lines"), "line_id", "text"), ("chunks", table(spark, sf_dir, "chunks"), "chunk_no", "text")]


def _segmenter(spark: SparkSession, sf_dir: str) -> sentence_ops.Segmentation:
    """Learned from the texts of all chunks."""
    return sentence_ops.segmentation(table(spark, sf_dir, "chunks").select("text"), sentence_ops.languages(table(spark, sf_dir, "common_words")))


def _quality(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines, chunks = table(spark, sf_dir, "extract_page_lines"), table(spark, sf_dir, "chunks")
    common = quality.common_set(table(spark, sf_dir, "common_words"))
    shared = mojibake.share([lines.select("text"), chunks.select("text")], with_words=False)
    return quality.page_statistics(lines, common, shared), quality.chunk_statistics(chunks, common, shared)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and chunks whose text is a list, a table or junk."""
    pages, chunks = _quality(spark, sf_dir)
    found = pages.where("not_prose").select(F.lit("parsed_pages").alias("record_table"), F.col("page_id").alias("record_id"))
    return found.unionByName(chunks.where("not_prose").select(F.lit("chunks").alias("record_table"), F.col("chunk_no").alias("record_id")))


def p1_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text statistics of every page and chunk."""
    pages, chunks = _quality(spark, sf_dir)
    return pages.withColumnRenamed("page_id", "record_id").withColumn("record_table", F.lit("parsed_pages")).unionByName(chunks.withColumnRenamed("chunk_no", "record_id").withColumn("record_table", F.lit("chunks")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence ends of the chunks asked for."""
    asked = table(spark, sf_dir, "chunks").join(table(spark, sf_dir, "sentence_sample").select("chunk_no").distinct(), "chunk_no", "left_semi")
    return sentence_ops.sentence_ends(asked, _segmenter(spark, sf_dir))


def p2_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of every chunk, each with its place."""
    return sentence_ops.sentences(table(spark, sf_dir, "chunks"), _segmenter(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines at head or foot whose wording covers at least half of the source's files, and at least three."""
    return boilerplate.repeated_lines(table(spark, sf_dir, "extract_page_lines")).where("covers").select("line_id")


def p3_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without the repeated lines."""
    lines = table(spark, sf_dir, "extract_page_lines")
    return boilerplate.remove_repeated(lines, boilerplate.repeated_lines(lines))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and chunks that look like a reference text but differ from it in characters."""
    return confusables.lookalikes(_records(spark, sf_dir), table(spark, sf_dir, "reference_texts"))


def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and consistent form of every line and chunk."""
    return confusables.record_groups(_records(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks over the limit: those that the splitter cut."""
    return p5_pieces(spark, sf_dir).where("piece_no = 1").select("chunk_no")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the chunks over the limit."""
    return splitting.split_oversized(table(spark, sf_dir, "chunks"), _segmenter(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and chunks that hold a wrongly decoded passage."""
    return mojibake.restore(_records(spark, sf_dir)).select("record_table", "record_id")


def p6_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The affected records with their text restored."""
    return mojibake.restore(_records(spark, sf_dir))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encoding.encode_corpus(table(spark, sf_dir, "documents"))


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    documents, targets = table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")
    return mixing.mix(encoding.count_tokens(documents, keep=("source", "align_score")), targets, weight_col="align_score"), targets


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is used, so that the sources have their shares of all tokens."""
    return _mix(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of every source."""
    return mixing.shares(*_mix(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text was cut."""
    return truncation.truncated(table(spark, sf_dir, "documents")).where("is_cut").select("doc_id")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of cut texts per source."""
    return truncation.cut_shares(truncation.truncated(table(spark, sf_dir, "documents")))


def p9_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence for every document."""
    return truncation.truncated(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    """All queries of this subpackage by name."""
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express over whole tables; the others are tested against brute force, round trips or known cases."""
    return {"p5_found": r"SELECT chunk_no FROM chunks WHERE length(text) + len(regexp_extract_all(text, '[\x{3400}-\x{9fff}\x{f900}-\x{faff}]')) > 1100"}
