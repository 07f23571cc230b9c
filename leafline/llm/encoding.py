"""Problem 7: token ids of every text under a public byte-level BPE.

The merge loop is our own: symbols of one pre-token form a doubly linked list, candidate
merges wait in a priority queue of (rank, position), and entries whose symbols have changed
since they were queued are skipped when they surface.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER_FILE = "byte_bpe_50k.tiktoken"
CACHE_ENTRIES = 200_000  # pre-tokens remembered per Python worker; a full cache is emptied, results do not depend on it
CACHE_BYTES = 64  # longer pre-tokens are encoded each time


def tokenizer_path(name: str = TOKENIZER_FILE) -> str:
    """Place of a public vocabulary file; the package that holds it is optional."""
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class BytePairEncoder:
    """Encoder and decoder for one rank file (lines of base64 token and rank)."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, rank_file.splitlines()) if t}
        self.vocabulary = {rank: token for token, rank in self.ranks.items()}
        self.pieces = regex.compile(pattern).findall
        self.cache: dict[str, list[int]] = {}

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks = self.ranks
        if data in ranks:
            return [ranks[data]]
        n = len(data)
        symbol = [data[i : i + 1] for i in range(n)]
        left = list(range(-1, n - 1))
        right = [*range(1, n), -1]
        queue = []
        for i in range(n - 1):
            rank = ranks.get(data[i : i + 2])
            if rank is not None:
                queue.append((rank, i, symbol[i], symbol[i + 1]))
        heapq.heapify(queue)
        while queue:
            rank, i, a, b = heapq.heappop(queue)
            j = right[i]
            # Stale: one of the two symbols has been merged away or has grown since the entry was queued.
            if symbol[i] is not a or j < 0 or symbol[j] is not b:
                continue
            symbol[i] = joined = a + b
            symbol[j] = None
            k = right[j]
            right[i] = k
            if k >= 0:
                left[k] = i
                rank = ranks.get(joined + symbol[k])
                if rank is not None:
                    heapq.heappush(queue, (rank, i, joined, symbol[k]))
            h = left[i]
            if h >= 0:
                rank = ranks.get(symbol[h] + joined)
                if rank is not None:
                    heapq.heappush(queue, (rank, h, symbol[h], joined))
        return [ranks[s] for s in symbol if s is not None]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; strings of special tokens are ordinary text, null and empty give []."""
        if not text:
            return []
        cache, out = self.cache, []
        for piece in self.pieces(text):
            ids = cache.get(piece)
            if ids is None:
                ids = self.merge(piece.encode("utf-8", "surrogatepass"))
                if len(piece) <= CACHE_BYTES:
                    if len(cache) >= CACHE_ENTRIES:
                        cache.clear()
                    cache[piece] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids: the vocabulary's strings one after the other."""
        return b"".join(self.vocabulary[i] for i in ids).decode("utf-8", "replace")


_encoders: dict[int, BytePairEncoder] = {}


def _encoder(shared) -> BytePairEncoder:
    """The worker's encoder for a broadcast (rank file, pattern), built once per process."""
    if shared.id not in _encoders:
        _encoders.clear()
        _encoders[shared.id] = BytePairEncoder(*shared.value)
    return _encoders[shared.id]


class _Shared:
    """A broadcast with a stable id to key the per-process cache."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id() if hasattr(broadcast, "_jbroadcast") else id(broadcast)

    @property
    def value(self):
        return self.broadcast.value

    def __getstate__(self):
        return (self.broadcast, self.id)

    def __setstate__(self, state):
        self.broadcast, self.id = state


def share_tokenizer(spark: SparkSession, path: str | None = None, pattern: str | None = None) -> _Shared:
    """Ship the rank file (about 1 MB, a fixed file, so its size has a bound) to the executors."""
    with open(path or tokenizer_path(), "rb") as file:
        content = file.read()
    if len(content) > 64 << 20:
        raise ValueError("the rank file is larger than a broadcast should be")
    return _Shared(spark.sparkContext.broadcast((content, pattern or split_pattern())))


def _map(df: DataFrame, shared: _Shared, id_col: str, text_col: str, counts_only: bool, keep: tuple[str, ...] = ()) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shared).encode
        for batch in batches:
            ids = [encode(t) for t in batch.column(1).to_pylist()]
            values = pa.array([len(x) for x in ids], pa.int64()) if counts_only else pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], values], [id_col, *keep, "n_tokens" if counts_only else "ids"])

    field = T.StructField("n_tokens", T.LongType()) if counts_only else T.StructField("ids", T.ArrayType(T.IntegerType()))
    schema = T.StructType([*(T.StructField(c, df.schema[c].dataType) for c in (id_col, *keep)), field])
    return df.select(F.col(id_col), F.col(text_col).alias("text"), *keep).mapInArrow(run, schema)


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, ids) for every row of df, in one narrow pass without a shuffle.

    Null and empty texts give an empty list, repeated rows are encoded each, an empty table gives
    an empty result, other columns (also ones called ids) are ignored. The cost of a text of n
    bytes is n log n at worst, whatever its script.
    """
    return _map(df, share_tokenizer(df.sparkSession, path, pattern), id_col, text_col, False)


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, columns to keep, n_tokens) for every row of df; null and empty texts have 0 tokens."""
    return _map(df, share_tokenizer(df.sparkSession, path, pattern), id_col, text_col, True, keep)
