"""JSON documents of other tools: page files, chunk files, question files; and their default places."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES_SCHEMA = "source struct<file_name:string,path:string,size_bytes:long,sha256:string>, pages array<struct<page_number:int,page_index:int,text:string,needs_ocr:boolean,extraction_error:string>>"
CHUNKS_SCHEMA = "source struct<file_name:string>, chunks array<struct<chunk_id:string,chunk_index:int,text:string,char_count:int,word_count:int,source_pages:array<int>,page_segments:array<struct<page:int,text:string>>,page_range:string,start_page:int,end_page:int,overlap_from_previous:string>>"
CASES_SCHEMA = "cases array<struct<id:string,query:string,relevant_chunk_ids:array<string>,verified_pages:array<int>,evidence:string,expected_in_answer:string,not_in_document:array<string>>>"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.input_file_name())


def document_id(name: str | None, path: str) -> str:
    """Stem of the source file's name, else of the JSON file's."""
    return PurePosixPath(name or path).stem


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, page_number, text, needs_ocr) of page files; missing keys are null, file_id is a hash of the document's name."""
    stem = F.regexp_replace(F.coalesce("source.file_name", F.element_at(F.split("file", "/"), -1)), r"\.[^.]*$", "")
    rows = _read(spark, path, PAGES_SCHEMA).select(stem.alias("document"), F.explode("pages").alias("p"))
    return rows.select(F.xxhash64("document").alias("file_id"), "document", "p.page_number", F.coalesce("p.text", F.lit("")).alias("text"), "p.needs_ocr")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """One row per chunk of chunk files, with chunk_no and created_at as the chunk tables have them."""
    rows = _read(spark, path, CHUNKS_SCHEMA).select("file", F.explode("chunks").alias("c"))
    return rows.select(F.xxhash64("file").alias("file_id"), "c.*").withColumns({"chunk_no": F.xxhash64("chunk_id"), "created_at": F.lit(None).cast("timestamp"), "text": F.coalesce("text", F.lit(""))})


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Labelled questions; the file holds them under "cases"."""
    return _read(spark, path, CASES_SCHEMA).select(F.explode("cases").alias("c")).select("c.*")


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per line, in UTF-8; parquet is the form between stages."""
    df.write.mode("overwrite").json(path)


def write_page_documents(pages: DataFrame, files: DataFrame, path: str, key: str = "file_id") -> None:
    """A JSON file per document that read_pages reads: its source, its counts, and its pages in order.

    A document is one value of the file format, so it is made in one task; documents are spread.
    """
    page = F.struct("page_number", "page_index", "text", "char_count", "word_count", "has_text", "needs_ocr", "extraction_error")
    counts = F.struct(F.count("*").alias("page_count"), *[F.sum(c).alias(c) for c in ("repeated_lines_removed", "low_information_lines_removed", "unmapped_glyphs_removed")])
    documents = pages.groupBy(key).agg(counts.alias("document"), F.array_sort(F.collect_list(page)).alias("pages"))
    _write_documents(documents.join(_sources(files, key), key, "left").drop(key), path)


def write_chunk_documents(chunks: DataFrame, files: DataFrame, path: str, key: str = "file_id") -> None:
    """A JSON file per document that read_chunks reads: its source, the number of its chunks, and the chunks in order."""
    fields = ["chunk_index", "chunk_id", "text", "char_count", "word_count", "source_pages", "page_segments", "page_range", "start_page", "end_page", "overlap_from_previous"]
    documents = chunks.groupBy(key).agg(F.struct(F.count("*").alias("chunk_count")).alias("document"), F.array_sort(F.collect_list(F.struct(*fields))).alias("chunks"))
    _write_documents(documents.join(_sources(files, key), key, "left").drop(key), path)


def _sources(files: DataFrame, key: str) -> DataFrame:
    return files.select(key, F.struct("file_name", "path", F.col("size_bytes").cast("long").alias("size_bytes"), "sha256").alias("source")).dropDuplicates([key])


def _write_documents(documents: DataFrame, path: str) -> None:
    documents.select(F.to_json(F.struct(*documents.columns)).alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def read_unanswerable(spark: SparkSession, path: str) -> DataFrame:
    """Questions without an answer in the document; the file holds them under "unanswerable"."""
    schema = "unanswerable array<struct<id:string,query:string,not_in_document:array<string>>>"
    return _read(spark, path, schema).select(F.explode("unanswerable").alias("c")).select("c.*")


def pages_path(pdf: str) -> str:
    return f"parsed/{PurePosixPath(pdf).stem}.json"


def chunks_path(pages: str) -> str:
    return f"chunks/{PurePosixPath(pages).stem.replace('_pages', '')}_chunks.json"
