"""How rankings change with the wording of a question, and with a chunk that only repeats its words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafline.operators import dense, retrieval
from leafline.providers import Embedder

# One matter asked in several wordings and languages, and a chunk that says nothing but its words.
WORDINGS = [
    "How does retrieval with chunks work?", "In what way are the relevant passages found?", "How are the useful parts of a document chosen for a question?", "What drives a search by meaning?", "系统如何找到与问题有关的段落？",
]
DISTRACTOR = "Retrieval retrieves what the retrieval of chunks has to retrieve."


def with_distractor(chunks: DataFrame, text: str = DISTRACTOR) -> DataFrame:
    """The chunks and, after all others, one more of the given text."""
    columns = {"chunk_no": F.lit(-1).cast("long"), "chunk_id": F.lit("distractor"), "file_id": F.lit((1 << 63) - 1), "chunk_index": F.lit(0), "text": F.lit(text), "page_range": F.lit("experiment"), "created_at": F.lit(None).cast("timestamp")}
    names = [c for c in columns if c in chunks.columns]
    other = chunks.sparkSession.range(1).select(*[columns[c].cast(chunks.schema[c].dataType).alias(c) for c in names])
    return chunks.select(*names).unionByName(other)


def wordings(spark, texts: list[str] | None = None) -> DataFrame:
    return spark.createDataFrame([(f"Q{i}", t) for i, t in enumerate(texts or WORDINGS, 1)], "id string, query string")


def tfidf_experiment(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(experiment, query_id, active_dimensions, rank, chunk_id, score) of the k first chunks of every wording, without (1) and with (2) the distractor.

    active_dimensions are the tokens of the wording that the corpus has.
    """
    out = None
    for number, corpus in ((1, chunks), (2, with_distractor(chunks))):
        _, weights = retrieval.tfidf_vectors(retrieval.latest_chunks(corpus), queries)
        active = weights.where("weight > 0").groupBy("query_id").agg(F.array_sort(F.collect_list("token")).alias("active_dimensions"))
        ranked = retrieval.tfidf_search(corpus, queries, k).join(active, "query_id", "left")
        rows = ranked.select(F.lit(number).alias("experiment"), "query_id", F.coalesce("active_dimensions", F.array().cast("array<string>")).alias("active_dimensions"), "rank", "chunk_id", F.col("similarity").alias("score"))
        out = rows if out is None else out.unionByName(rows)
    return out


def dense_experiment(chunks: DataFrame, queries: DataFrame, k: int, embedder: Embedder | None = None) -> DataFrame:
    """(experiment, query_id, rank, chunk_id, score), likewise by dense similarity; every text is encoded once for both."""
    corpus = retrieval.latest_chunks(with_distractor(chunks))
    passages = retrieval.cut(dense.encode(corpus, "chunk_id", "text", "passage: ", embedder).join(corpus.select(*dense.PLACE), "chunk_id"))
    asked = retrieval.cut(dense.encode(queries.select(F.col("id").alias("query_id"), "query"), "query_id", "query", "query: ", embedder))
    out = None
    for number, own in ((1, passages.where("chunk_id != 'distractor'")), (2, passages)):
        found = dense.nearest(own, asked, k, "chunk_id", ties=dense.PLACE)
        rows = found.select(F.lit(number).alias("experiment"), "query_id", "rank", "chunk_id", F.round("similarity", 6).alias("score"))
        out = rows if out is None else out.unionByName(rows)
    return out
