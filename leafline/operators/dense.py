"""Dense retrieval and two-stage reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from leafline.functions import text as T
from leafline.operators.retrieval import best_places, in_blocks, query_blocks
from leafline.providers import Embedder, HashingEmbedder, OverlapReranker, Reranker

DENSE_K, CANDIDATES = 3, 20


def encode(df: DataFrame, id_col: str, text_col: str, prefix: str, embedder: Embedder | None = None) -> DataFrame:
    """(id, vector): unit vectors of the prefixed texts; a null text is encoded as the prefix alone. Each text is encoded once."""
    model = embedder or HashingEmbedder()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = model.encode([prefix + (t or "") for t in batch.column(1).to_pylist()])
            if not np.isfinite(vectors).all():
                raise ValueError("the embedder returned values that are not finite")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(vectors.astype(np.float32)), pa.list_(pa.float32()))], [id_col, "vector"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, vector array<float>")


TILE = 512  # questions that meet a batch of passages at a time


def nearest(passages: DataFrame, queries: DataFrame, k: int, id_col: str, query_col: str = "query_id", vector_col: str = "vector", exclude_self: bool = False, ties: tuple[str, ...] | None = None, digits: int = 12) -> DataFrame:
    """(query_id, id, similarity, rank): the k passages with the greatest dot product of every question, exactly.

    The stated questions meet all passages in blocks: a task multiplies a batch of passages with a
    tile of questions and keeps the k best of each question, so what is shuffled is k rows per
    question and batch. Products are summed in double precision; equal similarities (to the given
    digits) are ordered by the columns ties, the id if there are none; null vectors are left out,
    vectors that are not finite are an error.
    """
    order = ties or (id_col,)
    kinds = {c: passages.schema[c].dataType for c in dict.fromkeys((id_col, *order))}
    q_kind = queries.schema[query_col].dataType
    rows = passages.where(F.col(vector_col).isNotNull()).select(*kinds, F.col(vector_col))
    schema = ", ".join([f"`{query_col}` {q_kind.simpleString()}", *(f"`{c}` {t.simpleString()}" for c, t in kinds.items()), "similarity double"])

    def scan(asked: list) -> DataFrame:
        names = [r[0] for r in asked]
        matrix = np.asarray([r[1] for r in asked], np.float64).T if asked else np.zeros((0, 0))
        q_type = to_arrow_type(q_kind)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows or not names:
                    continue
                batch = batch.take(pc.sort_indices(batch, [(c, "ascending") for c in order], null_placement="at_start"))
                vectors = batch.column(vector_col).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                if not np.isfinite(vectors).all():
                    raise ValueError("vectors must be finite")
                own = {i: place for place, i in enumerate(batch.column(id_col).to_pylist())} if exclude_self else {}
                found, places, values = [], [], []
                for at in range(0, len(names), TILE):
                    scores = np.round(vectors @ matrix[:, at : at + TILE], digits).T
                    for name, row in zip(names[at : at + TILE], np.ascontiguousarray(scores)):
                        if name in own:
                            row[own[name]] = -np.inf
                        best = best_places(row, k)
                        found += [name] * len(best)
                        places.append(best)
                        values.append(row[best])
                at = pa.array(np.concatenate(places))
                yield pa.RecordBatch.from_arrays([pa.array(found, q_type), *[batch.column(c).take(at) for c in kinds], pa.array(np.concatenate(values))], [query_col, *kinds, "similarity"])

        return rows.mapInArrow(run, schema)

    partial = in_blocks(query_blocks(queries.where(F.col(vector_col).isNotNull()).select(query_col, vector_col), query_col), scan)
    by = Window.partitionBy(query_col).orderBy(F.col("similarity").desc(), *order)
    return partial.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


PLACE = ("file_id", "chunk_index", "chunk_id")


def semantic_search(chunks: DataFrame, queries: DataFrame, k: int = DENSE_K, snippet_chars: int = 260, embedder: Embedder | None = None, limit: int | None = None) -> DataFrame:
    """(query_id, rank, chunk_id, chunk_index, similarity, page_range, snippet): one stage of dense search over the latest chunks, ranked by the similarity rounded to six digits, then by the chunk's place."""
    if k <= 0:
        raise ValueError("k must be positive")
    passages = encode(chunks, "chunk_id", "text", "passage: ", embedder).join(chunks.select(*PLACE), "chunk_id")
    asked = encode(queries.select(F.col("id").cast("string").alias("query_id"), "query"), "query_id", "query", "query: ", embedder)
    found = nearest(passages, asked, k, "chunk_id", ties=PLACE, digits=6)
    shown = found.select("query_id", "rank", "chunk_id", "similarity").join(chunks.select("chunk_id", "chunk_index", "page_range", "text"), "chunk_id")
    return shown.select("query_id", "rank", "chunk_id", "chunk_index", "similarity", "page_range", T.prefix_snippet(F.coalesce("text", F.lit("")), snippet_chars).alias("snippet"))


def candidates(passages: DataFrame, queries: DataFrame, candidate_k: int = CANDIDATES, id_col: str = "chunk_id") -> DataFrame:
    """(query_id, id, base_rank, base_similarity): first stage, ranked by the raw similarity, then by the chunks' places where the passages have them."""
    ties = PLACE if all(c in passages.columns for c in PLACE) else None
    return nearest(passages, queries, candidate_k, id_col, ties=ties).select("query_id", id_col, F.col("rank").alias("base_rank"), F.col("similarity").alias("base_similarity"))


def rerank(found: DataFrame, chunks: DataFrame, queries: DataFrame, k: int, reranker: Reranker | None = None, id_col: str = "chunk_id") -> DataFrame:
    """(query_id, id, base_rank, base_similarity, rerank_rank, rerank_score): second stage over the candidates only, ranked by the raw logit, then by base_rank."""
    model = reranker or OverlapReranker()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            pairs = list(zip(batch.column(names.index("query")).to_pylist(), batch.column(names.index("text")).to_pylist()))
            scores = np.asarray(model.score([(q or "", t or "") for q, t in pairs]), float)
            if not np.isfinite(scores).all():
                raise ValueError("the reranker returned values that are not finite")
            keep = [batch.column(names.index(c)) for c in ("query_id", id_col, "base_rank", "base_similarity")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(scores, pa.float64())], ["query_id", id_col, "base_rank", "base_similarity", "logit"])

    full = found.join(chunks.select(id_col, "text"), id_col).join(queries.select(F.col("id").alias("query_id"), "query"), "query_id")
    scored = full.select("query_id", id_col, F.col("base_rank").cast("int").alias("base_rank"), "base_similarity", "query", "text").mapInArrow(run, f"query_id string, `{id_col}` string, base_rank int, base_similarity double, logit double")
    order = Window.partitionBy("query_id").orderBy(F.col("logit").desc(), "base_rank")
    ranked = scored.withColumn("rerank_rank", F.row_number().over(order)).where(F.col("rerank_rank") <= k)
    return ranked.select("query_id", id_col, "base_rank", F.round("base_similarity", 6).alias("base_similarity"), "rerank_rank", F.round("logit", 6).alias("rerank_score"))


def search_two_stages(chunks: DataFrame, queries: DataFrame, k: int = 2, candidate_k: int = CANDIDATES, embedder: Embedder | None = None, reranker: Reranker | None = None) -> DataFrame:
    """Candidates by dense similarity, then the reranker; the corpus is encoded once for all questions."""
    if not 0 < k <= candidate_k:
        raise ValueError("k must be positive and at most candidate_k")
    passages = encode(chunks, "chunk_id", "text", "passage: ", embedder)
    if all(c in chunks.columns for c in PLACE):
        passages = passages.join(chunks.select(*PLACE), "chunk_id")
    asked = encode(queries.select(F.col("id").alias("query_id"), "query"), "query_id", "query", "query: ", embedder)
    return rerank(candidates(passages, asked, candidate_k), chunks, queries, k, reranker)
