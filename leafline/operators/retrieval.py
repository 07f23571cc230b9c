"""Lexical and TF-IDF retrieval over postings, for all questions of a table at once."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafline.functions import text as T
from leafline.functions.tokens import tokenize
from leafline.session import cut

K1, B, PHRASE_BONUS, PHRASE_CHARS = 1.5, 0.75, 1.5, 3


def latest_chunks(chunks: DataFrame) -> DataFrame:
    """One row per chunk_id: the chunk written last."""
    order = Window.partitionBy("chunk_id").orderBy(F.col("created_at").desc_nulls_last(), F.col("chunk_no").desc())
    return chunks.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def postings(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, token, tf, n_tokens): term frequencies of every text; a text without tokens has no row."""
    tokens = df.select(id_col, tokenize(F.col(text_col)).alias("tokens"))
    rows = tokens.select(id_col, F.size("tokens").alias("n_tokens"), F.explode("tokens").alias("token"))
    return rows.groupBy(id_col, "token").agg(F.count("*").alias("tf"), F.first("n_tokens").alias("n_tokens"))


def document_frequency(posted: DataFrame) -> DataFrame:
    """(token, df) over (id, token) rows that are distinct already."""
    return posted.groupBy("token").agg(F.count("*").alias("df"))


def corpus_size(df: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: n_texts and average length in tokens, at least 1; texts without tokens count."""
    return df.agg(F.count("*").alias("n_texts"), F.greatest(F.coalesce(F.avg(F.size(tokenize(F.col(text_col)))), F.lit(1.0)), F.lit(1.0)).alias("avg_tokens"))


def query_tokens(queries: DataFrame, id_col: str = "id", text_col: str = "query") -> DataFrame:
    """(query_id, token, tf, n_tokens) of the questions."""
    return postings(queries, id_col, text_col).withColumnRenamed(id_col, "query_id")


QUERY_BLOCK = 16384  # stated questions that one pass over the corpus answers; the driver holds two blocks at most


def query_blocks(queries: DataFrame, key: str, block: int = QUERY_BLOCK) -> Iterator[list]:
    """The stated questions in blocks of about the given size. One block, which is usual, is read at once; more are kept in the checkpoint folder and read one by one."""
    first = queries.limit(block + 1).collect()
    if len(first) <= block:
        yield first
        return
    kept = cut(queries.withColumn("_hash", F.hash(key)))
    n = -(-kept.count() // block)
    for i in range(n):
        yield kept.where(F.pmod("_hash", F.lit(n)) == i).drop("_hash").collect()


def in_blocks(blocks: Iterable[list], answer: Callable[[list], DataFrame]) -> DataFrame:
    """The union of the answers to all blocks; an answer is written down before the next but one block is read."""
    parts: list[DataFrame] = []
    for rows in blocks:
        if parts:
            parts[-1] = cut(parts[-1])
        parts.append(answer(rows))
    return reduce(DataFrame.unionByName, parts)


def phrase_of(c: Column) -> Column:
    return T.compact(F.lower(c))


def phrase_matches(chunks: DataFrame, queries: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """(query_id, id) where the compacted lower-case question is part of the chunk's text.

    All phrases of a block of questions are looked for in one pass over each text, so the cost is
    that of reading the chunks once per block, and no pair is formed that does not match.
    """
    phrase = queries.where("query is not null").select(F.col("id").cast("string").alias("query_id"), phrase_of(F.col("query")).alias("phrase")).where(F.length("phrase") >= PHRASE_CHARS)
    texts = chunks.where("text is not null").select(F.col(id_col).cast("string").alias(id_col), phrase_of(F.col("text")).alias("low"))

    def answer(rows: list) -> DataFrame:
        ids, phrases = [r[0] for r in rows], [r[1] for r in rows]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = finder(phrases)
            for batch in batches:
                found = [(ids[i], key) for key, low in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i in find(low)]
                columns = list(zip(*found)) or [[], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["query_id", id_col])

        return texts.mapInArrow(run, f"query_id string, `{id_col}` string")

    return in_blocks(query_blocks(phrase, "query_id"), answer)


def finder(phrases: list[str]) -> Callable[[str], list[int]]:
    """A function from a text to the numbers of the phrases in it; one automaton finds all of them in one pass."""
    import ahocorasick

    by_phrase: dict[str, list[int]] = {}
    for i, p in enumerate(phrases):
        if p:
            by_phrase.setdefault(p, []).append(i)
    if not by_phrase:
        return lambda text: []
    automaton = ahocorasick.Automaton()
    for p in by_phrase:
        automaton.add_word(p, p)
    automaton.make_automaton()
    return lambda text: [i for p in {p for _, p in automaton.iter(text)} for i in by_phrase[p]]


PLACE = ("file_id", "chunk_index", "chunk_id")  # order of the chunks, which decides among equal scores
_CORPUS = "chunk_id string, file_id long, chunk_index int"


def searched_corpus(chunks: DataFrame) -> DataFrame:
    """The latest chunks with their tokens, written down once for all passes of a search."""
    latest = latest_chunks(chunks)
    return cut(latest.select("chunk_id", F.col("file_id").cast("long").alias("file_id"), F.col("chunk_index").cast("int").alias("chunk_index"), *[c for c in ("page_range",) if c in latest.columns], "text", tokenize(F.col("text")).alias("tokens")))


def _frequencies(corpus: DataFrame, tokens: list[str]) -> dict[str, int]:
    """Number of chunks that hold each of the tokens that a block of questions asks for."""
    asked = corpus.sparkSession.createDataFrame([(t,) for t in tokens], "token string")
    found = corpus.select(F.explode(F.array_distinct("tokens")).alias("token")).join(asked, "token", "left_semi").groupBy("token").count()
    return {r[0]: r[1] for r in found.collect()}


class _Occurrences:
    """Where the asked tokens occur in a batch of chunks, by token."""

    def __init__(self, tokens: pa.Array, asked: pa.Array):
        self.lengths = np.diff(tokens.offsets.to_numpy())
        place = pc.index_in(tokens.flatten(), value_set=asked).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        rows = np.repeat(np.arange(len(self.lengths)), self.lengths)
        there = place >= 0
        key, self.tf = np.unique(place[there] * len(self.lengths) + rows[there], return_counts=True)
        token, self.rows = np.divmod(key, max(len(self.lengths), 1))
        self.starts = np.searchsorted(token, np.arange(len(asked) + 1))

    def sums(self, tokens: list[int], parts: np.ndarray, weights: list[float]) -> np.ndarray:
        """For each chunk the sum of the parts of some tokens, each times its weight."""
        spans = [slice(self.starts[t], self.starts[t + 1]) for t in tokens]
        if not spans:
            return np.zeros(len(self.lengths))
        return np.bincount(np.concatenate([self.rows[x] for x in spans]), np.concatenate([parts[x] * w for x, w in zip(spans, weights)]), len(self.lengths)).astype(float)


def best_places(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, the first of equal ones; scores of minus infinity are none."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above, equal = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
        places = np.concatenate([above, equal[: k - len(above)]])
    else:
        places = np.arange(len(scores))
    return places[scores[places] > -np.inf]


def _ordered(batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch.take(pc.sort_indices(batch.select(PLACE), [(c, "ascending") for c in PLACE], null_placement="at_start"))


def _best_of_blocks(corpus: DataFrame, queries: DataFrame, k: int, score: str, prepare: Callable[[list], Callable]) -> DataFrame:
    """(query_id, _CORPUS, score): the k best chunks of every question in each batch of chunks, from which the best of all are ranked.

    queries: (query_id, tokens, phrase). prepare makes, from a block of them, a function from a batch
    to a function from the number of a question to the scores of the batch's chunks. What is sent on
    is k rows for each question and batch, whatever number of chunks shares tokens with it.
    """

    def answer(rows: list) -> DataFrame:
        names, made = [r["query_id"] for r in rows], prepare(rows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = made()
            for batch in batches:
                batch = _ordered(batch)
                scores = scorer(batch)
                asked, places, values = [], [], []
                for i in range(len(names) if batch.num_rows else 0):
                    s = scores(i)
                    best = best_places(s, k)
                    asked += [names[i]] * len(best)
                    places.append(best)
                    values.append(s[best])
                at = pa.array(np.concatenate(places) if places else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(asked, pa.string()), *[batch.column(c).take(at) for c in ("chunk_id", "file_id", "chunk_index")], pa.array(np.concatenate(values) if values else np.zeros(0))], ["query_id", "chunk_id", "file_id", "chunk_index", score])

        return corpus.mapInArrow(run, f"query_id string, {_CORPUS}, {score} double")

    return in_blocks(query_blocks(queries, "query_id"), answer)


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select(F.col("id").cast("string").alias("query_id"), tokenize(F.col("query")).alias("tokens"), F.coalesce(phrase_of(F.col("query")), F.lit("")).alias("phrase"))


def bm25_best(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, _CORPUS, score, rank): the k best of a searched corpus, by the score rounded to four digits.

    Each distinct token of the question counts once. The phrase bonus holds for questions of three
    characters or more and can alone admit a chunk. Null texts are empty texts, which count in the
    number of chunks and in their average length.
    """
    n, average = corpus.agg(F.count("*"), F.avg(F.size("tokens"))).first()
    average = max(average or 1.0, 1.0)

    def prepare(rows: list):
        tokens = sorted({t for r in rows for t in r["tokens"]})
        number, df = {t: i for i, t in enumerate(tokens)}, _frequencies(corpus, tokens)
        idf = np.array([math.log(1 + (n - df.get(t, 0) + 0.5) / (df.get(t, 0) + 0.5)) for t in tokens])
        own = [[number[t] for t in dict.fromkeys(r["tokens"])] for r in rows]
        phrases = [r["phrase"] if len(r["phrase"]) >= PHRASE_CHARS else "" for r in rows]

        def make():
            find, asked = finder(phrases), pa.array(tokens, pa.string())

            def scorer(batch: pa.RecordBatch):
                there = _Occurrences(batch.column("tokens"), asked)
                tf = there.tf.astype(float)
                parts = tf * (K1 + 1) / (tf + K1 * (1 - B + B * there.lengths[there.rows] / average))
                bonus: dict[int, list[int]] = {}
                for place, low in enumerate(batch.column("low").to_pylist()):
                    for i in find(low or ""):
                        bonus.setdefault(i, []).append(place)

                def scores(i: int) -> np.ndarray:
                    s = there.sums(own[i], parts, [idf[t] for t in own[i]])
                    s[np.array(bonus.get(i, []), np.int64)] += PHRASE_BONUS
                    return np.where(s > 0, np.round(s, 4), -np.inf)

                return scores

            return scorer

        return make

    rows = corpus.select(*PLACE, "tokens", phrase_of(F.col("text")).alias("low"))
    return top(_best_of_blocks(rows, _asked(queries), k, "score", prepare), k, "score", *PLACE)


def top(scored: DataFrame, k: int, score: str, *ties: str) -> DataFrame:
    """The k best rows of each question with their rank; ties in the order of the given columns."""
    order = Window.partitionBy("query_id").orderBy(F.col(score).desc(), *ties)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25_search(chunks: DataFrame, queries: DataFrame, k: int = 3, snippet_chars: int = 260) -> DataFrame:
    """(query_id, rank, chunk_id, score, matched_terms, page_range, snippet): ranked by the score rounded to four digits, then by the chunk's place."""
    corpus = searched_corpus(chunks)
    best = bm25_best(corpus, queries, k)
    # Terms and snippets are made for the ranked rows only.
    shown = best.select("query_id", "rank", "chunk_id", "score").join(corpus.select("chunk_id", "page_range", "text", F.col("tokens").alias("held")), "chunk_id")
    shown = shown.join(queries.select(F.col("id").cast("string").alias("query_id"), "query", tokenize(F.col("query")).alias("tokens")), "query_id")
    terms = F.array_sort(F.array_intersect("tokens", "held"))
    return shown.select("query_id", "rank", "chunk_id", "score", terms.alias("matched_terms"), "page_range", snippets(snippet_chars)("text", "query", "tokens").alias("snippet"))


def focused_snippet(text: str, query: str, tokens: list[str], n: int) -> str:
    """Window of n characters around the phrase, else around the place with most distinct tokens near it, the earliest on ties."""
    shown = " ".join((text or "").split())
    low, phrase = shown.lower(), " ".join((query or "").split()).lower()
    at = low.find(phrase) if len(phrase) >= 3 else -1
    if at < 0:
        best = (0, 0)
        distinct = set(tokens or ())
        for token in distinct:
            place = low.find(token)
            while place >= 0:
                begin = max(0, place - n // 4)
                window = low[begin : min(len(low), begin + n)]
                found = (sum(t in window for t in distinct), -place)
                if at < 0 or found > best:
                    best, at = found, place
                place = low.find(token, place + len(token))
    if at < 0:
        return shown[:n]
    begin = max(0, at - n // 3)
    end = min(len(shown), begin + n)
    return ("..." if begin else "") + shown[begin:end].strip() + ("..." if end < len(shown) else "")


def snippets(n: int):
    """focused_snippet as a function of columns, for rows that are left after ranking."""

    @F.pandas_udf("string")
    def run(text: pd.Series, query: pd.Series, tokens: pd.Series) -> pd.Series:
        return pd.Series([focused_snippet(t, q, list(k) if k is not None else [], n) for t, q, k in zip(text, query, tokens)])

    return run


# ------------------------------------------------------------------ TF-IDF


def tfidf_weights(posted: DataFrame, frequencies: DataFrame, n_texts: DataFrame, id_col: str) -> DataFrame:
    """(id, token, weight): share of the text's tokens times ln((N + 1) / (df + 1)) + 1; tokens that the corpus lacks have no weight but count in the share."""
    idf = F.log((F.col("n_texts") + 1) / (F.col("df") + 1)) + 1
    return posted.join(frequencies, "token").crossJoin(F.broadcast(n_texts.select("n_texts"))).select(id_col, "token", (F.col("tf") / F.col("n_tokens") * idf).alias("weight"))


def norms(weights: DataFrame, id_col: str) -> DataFrame:
    return weights.groupBy(id_col).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))


def tfidf_vectors(chunks: DataFrame, queries: DataFrame, id_col: str = "chunk_id") -> tuple[DataFrame, DataFrame]:
    """Weights of the chunks and of the questions over the corpus's vocabulary."""
    posted = cut(postings(chunks, id_col))
    frequencies, n = document_frequency(posted), chunks.agg(F.count("*").alias("n_texts"))
    return tfidf_weights(posted, frequencies, n, id_col), tfidf_weights(query_tokens(queries), frequencies, n, "query_id")


def tfidf_norms(corpus: DataFrame) -> DataFrame:
    """(chunk_id, norm) of a searched corpus's vectors over its whole vocabulary."""
    posted = cut(corpus.select("chunk_id", F.size("tokens").alias("n_tokens"), F.explode("tokens").alias("token")).groupBy("chunk_id", "token").agg(F.count("*").alias("tf"), F.first("n_tokens").alias("n_tokens")))
    return norms(tfidf_weights(posted, document_frequency(posted), corpus.agg(F.count("*").alias("n_texts")), "chunk_id"), "chunk_id")


def tfidf_best(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, _CORPUS, similarity, rank): the k best of a searched corpus with a token in common, by the cosine rounded to six digits."""
    n = corpus.count()

    def prepare(rows: list):
        tokens = sorted({t for r in rows for t in r["tokens"]})
        df = _frequencies(corpus, tokens)
        known = [t for t in tokens if t in df]  # what the corpus lacks has no weight, but counts in the share
        number, idf = {t: i for i, t in enumerate(known)}, np.array([math.log((n + 1) / (df[t] + 1)) + 1 for t in known])
        own = []
        for r in rows:
            counts = Counter(number[t] for t in r["tokens"] if t in number)
            weights = {t: c / len(r["tokens"]) * idf[t] for t, c in counts.items()}
            own.append((list(weights), list(weights.values()), math.sqrt(sum(w * w for w in weights.values()))))

        def make():
            asked = pa.array(known, pa.string())

            def scorer(batch: pa.RecordBatch):
                there = _Occurrences(batch.column("tokens"), asked)
                token = np.repeat(np.arange(len(known)), np.diff(there.starts))
                parts = there.tf / np.maximum(there.lengths[there.rows], 1) * idf[token] if len(known) else there.tf.astype(float)
                norm = batch.column("norm").to_numpy(zero_copy_only=False)

                def scores(i: int) -> np.ndarray:
                    held, weights, length = own[i]
                    dot = there.sums(held, parts, weights)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        return np.where(dot > 0, np.round(dot / (norm * length), 6), -np.inf)

                return scores

            return scorer

        return make

    rows = corpus.select(*PLACE, "tokens").join(tfidf_norms(corpus), "chunk_id")
    return top(_best_of_blocks(rows, _asked(queries), k, "similarity", prepare), k, "similarity", *PLACE)


def tfidf_search(chunks: DataFrame, queries: DataFrame, k: int = 3, limit: int | None = None) -> DataFrame:
    """(query_id, rank, chunk_id, similarity): ranked by the similarity rounded to six digits, then by the chunk's place.

    Chunks with similarity 0 rank after all others in their order; per question at most k of them
    can be needed, so only the first 2 k chunks of the corpus are added as such candidates. limit
    keeps the first chunks of the corpus only, as the demonstration of the vectors does.
    """
    corpus = searched_corpus(chunks)
    if limit is not None:
        corpus = cut(corpus.orderBy(*PLACE).limit(limit))
    leading = cut(tfidf_best(corpus, queries, k).drop("rank"))
    asked = queries.select(F.col("id").cast("string").alias("query_id"))
    short = asked.join(leading.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").where(F.coalesce("n", F.lit(0)) < k).select("query_id")
    first = corpus.select(*PLACE).orderBy(*PLACE).limit(2 * k)
    fill = short.crossJoin(F.broadcast(first)).join(leading.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").withColumn("similarity", F.lit(0.0))  # 2k rows
    return top(leading.unionByName(fill), k, "similarity", *PLACE).select("query_id", "rank", "chunk_id", "similarity")


def top_dimensions(weights: DataFrame, id_col: str, n: int = 12) -> DataFrame:
    """(id, place, token, weight): the heaviest tokens of each vector, rounded to eight digits; ties in code-point order."""
    order = Window.partitionBy(id_col).orderBy(F.round("weight", 12).desc(), "token")
    return weights.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select(id_col, "place", "token", F.round("weight", 8).alias("weight"))


def shared_dimensions(chunks: DataFrame, queries: DataFrame, hits: DataFrame, n: int = 8) -> DataFrame:
    """(query_id, chunk_id, place, token, contribution) of the ranked hits: the largest products of weights."""
    corpus = latest_chunks(chunks)
    c, q = tfidf_vectors(corpus, queries)
    pairs = hits.select("query_id", "chunk_id").join(c, "chunk_id").join(q.withColumnRenamed("weight", "q_weight"), ["query_id", "token"])
    part = pairs.withColumn("contribution", F.col("weight") * F.col("q_weight"))
    order = Window.partitionBy("query_id", "chunk_id").orderBy(F.round("contribution", 12).desc(), "token")
    return part.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select("query_id", "chunk_id", "place", "token", F.round("contribution", 8).alias("contribution"))
