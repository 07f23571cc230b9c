"""Incremental ingestion: new page files are chunked as they arrive. An extension; batch runs need none of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafline.operators.chunking import build_chunks

PAGES = "file_id long, page_number int, text string, parsed_at timestamp"


def start(spark: SparkSession, source: str, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Read parquet page files from source, append the chunks of each micro-batch to target, with its number.

    Documents are written whole by their producer, so packing needs no state between batches; a
    reader that wants the last version of a document takes the greatest batch per file_id (latest).
    The batch number makes a repeated batch overwrite its own folder, so a restart adds nothing twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("file_id", "page_number").agg(F.max_by("text", "parsed_at").alias("text"))
        build_chunks(last).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(PAGES).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream.trigger(processingTime="1 minute")).start()


def latest(spark: SparkSession, target: str) -> DataFrame:
    """The chunks of each document's last batch."""
    chunks = spark.read.parquet(target)
    newest = chunks.groupBy("file_id").agg(F.max("batch").alias("batch"))
    return chunks.join(newest, ["file_id", "batch"], "left_semi").drop("batch")
