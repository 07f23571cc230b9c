"""Problem 3: lines that one source repeats at head and foot of its pages.

The rate of every (source, wording) among the source's lines at head and foot is compared with its
rate among the lines of page bodies, of all other sources and its own, by a log-likelihood ratio
with the false-discovery rate controlled over all of them. Other sources' heads and feet are left
out of the comparison: they are furniture themselves, and with them page numbers, which all
publishers carry, would have no excess anywhere. What has no excess is no furniture, however many
files it is in; of what has one, TESTDATA.md asks for the wordings in enough of the source's files.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafline.llm import mojibake
from leafline.llm.confusables import wording
from leafline.session import cut

BAND, MIN_SHARE, MIN_FILES, FALSE_DISCOVERY = 0.15, 0.5, 3, 0.05
_BIN = 0.05  # width of the bins of log-likelihood ratios; the bound on what reaches the driver is 20000 rows
_BINS = 20000
FLUSH = 200_000  # wordings that a task holds before it writes their counts


def in_band(band: float = BAND) -> Column:
    """At head or foot of the page; null geometry is in neither."""
    return ((F.col("top") <= band * F.col("page_height")) | (F.col("bottom") >= (1 - band) * F.col("page_height"))) & F.col("top").isNotNull() & F.col("bottom").isNotNull()


def edge_lines(lines: DataFrame, shared: mojibake.SharedDecoder, band: float = BAND) -> DataFrame:
    """(line_id, source, file_id, page_id, line_no, wording) of the sound lines in the bands; wording is a 64-bit hash."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair = shared.get().repair
        for batch in batches:
            texts = batch.column(5).to_pylist()
            keys, sound = [], []
            for t in texts:
                fine = not repair(t)[1]
                key = wording(t) if fine else ""
                sound.append(bool(key))
                keys.append(xxhash.xxh64_intdigest(key) - (1 << 63) if key else 0)
            out = pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(keys, pa.int64())], ["line_id", "source", "file_id", "page_id", "line_no", "wording"])
            yield out.filter(pa.array(sound, pa.bool_()))

    rows = lines.where(in_band(band) & F.col("text").isNotNull() & F.col("source").isNotNull()).select(F.col("line_id").cast("long"), "source", F.col("file_id").cast("long"), F.col("page_id").cast("long"), F.col("line_no").cast("long"), "text")
    return rows.mapInArrow(run, "line_id long, source string, file_id long, page_id long, line_no long, wording long")


def body_wordings(lines: DataFrame, band: float = BAND) -> DataFrame:
    """(wording, n) of the lines with a text that are in no band, those without geometry or source among them; partial counts are made per task."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["wording", "n"])

        for batch in batches:
            counts.update(xxhash.xxh64_intdigest(key) - (1 << 63) for t in batch.column(0).to_pylist() if (key := wording(t)))
            if len(counts) > FLUSH:
                yield flush()
                counts.clear()
        yield flush()

    rows = lines.where(~(F.coalesce(in_band(band), F.lit(False)) & F.col("source").isNotNull()) & F.col("text").isNotNull()).select("text")
    return rows.mapInArrow(run, "wording long, n long").groupBy("wording").agg(F.sum("n").alias("n"))


def _xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.log(x)).otherwise(0.0)


def log_likelihood_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Signed G of the table (a of a+b within, c of c+d outside); negative when the rate within is lower."""
    n = a + b + c + d
    g = 2 * (_xlogx(a) + _xlogx(b) + _xlogx(c) + _xlogx(d) + _xlogx(n) - _xlogx(a + b) - _xlogx(c + d) - _xlogx(a + c) - _xlogx(b + d))
    g = F.greatest(g, F.lit(0.0))
    return F.when(a * (c + d) >= c * (a + b), g).otherwise(-g)


def significance_threshold(scores: DataFrame, column: str = "llr", rate: float = FALSE_DISCOVERY) -> float:
    """Least score that Benjamini-Hochberg accepts, from a histogram of the scores (so never more than its bins on the driver)."""
    bins = scores.select(F.least(F.floor(F.greatest(F.col(column), F.lit(0.0)) / _BIN), F.lit(_BINS)).cast("int").alias("bin")).groupBy("bin").count().collect()
    total, above, threshold = sum(r["count"] for r in bins), 0, math.inf
    for r in sorted(bins, key=lambda r: -r["bin"]):
        above += r["count"]
        if math.erfc(math.sqrt(r["bin"] * _BIN / 2)) / 2 <= rate * above / total:  # one-sided: only an excess counts
            threshold = r["bin"] * _BIN
    return threshold


def statistics(edges: DataFrame, lines: DataFrame, band: float = BAND) -> DataFrame:
    """(source, wording, n_files, n_lines, source_files, llr) of every wording at the edges of a source's pages.

    llr compares the wording's share of the source's lines in the bands with its share of the lines
    of all page bodies. Counts of lines and files are combined before each shuffle, so a source with a third of
    all rows costs as many rows as it has (file, wording) pairs, spread over all tasks.
    """
    files = lines.select("source", F.col("file_id").cast("long").alias("file_id")).where(F.col("source").isNotNull()).groupBy("source").agg(F.countDistinct("file_id").alias("source_files"))
    by_file = edges.groupBy("source", "wording", "file_id").agg(F.count("*").alias("n"))
    by_source = cut(by_file.groupBy("source", "wording").agg(F.count("file_id").alias("n_files"), F.sum("n").alias("n_lines")))  # read twice
    edge_lines_of = by_source.groupBy("source").agg(F.sum("n_lines").alias("source_lines"))
    body = cut(body_wordings(lines, band))  # read for the wordings and for their total
    total = body.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("body_lines"))
    joined = by_source.join(body, "wording", "left").join(edge_lines_of, "source").join(files, "source").crossJoin(F.broadcast(total))  # one row
    a, within, outside, everything = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("n_lines", "source_lines", "n", "body_lines"))
    llr = log_likelihood_ratio(a, within - a, outside, everything - outside)
    return joined.select("source", "wording", "n_files", "n_lines", "source_files", llr.alias("llr"))


def _covering(min_share: float, min_files: int) -> Column:
    return (F.col("n_files") >= min_files) & (F.col("n_files") >= min_share * F.col("source_files"))


def repeated_lines(lines: DataFrame, shared: mojibake.SharedDecoder | None = None, band: float = BAND, min_share: float = MIN_SHARE, min_files: int = MIN_FILES, rate: float = FALSE_DISCOVERY) -> DataFrame:
    """(line_id, page_id, line_no, source, wording, n_files, source_files, llr, covers) of the lines that stand out at the edges of their source's pages.

    Rows are the lines in the bands whose wording is in significant excess there, in min_files files
    or more; covers tells those in enough of the source's files. Null texts and geometry, garbled lines and lines of blanks alone
    give no row; lines extracted again are rows each; an empty table gives none.
    """
    shared = shared or mojibake.share([lines.select("text")], with_words=False)
    edges = cut(edge_lines(lines, shared, band))  # used three times; wordings are not made again
    scored = cut(statistics(edges, lines, band))  # read for the threshold and for the rows
    threshold = significance_threshold(scored, rate=rate)
    excess = scored.where((F.col("llr") >= threshold) & (F.col("n_files") >= min_files)).withColumn("covers", _covering(min_share, min_files))
    return edges.join(excess, ["source", "wording"]).select("line_id", "page_id", "line_no", "source", "wording", "n_files", "source_files", "llr", "covers")


def remove_repeated(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """(page_id, file_id, source, text, n_lines, n_removed): pages without the repeated lines, reassembled by position.

    Of lines extracted again the latest stays; lines without a number come first and count each. A
    page whose lines all go keeps its row with an empty text. Lines and the marks of repeated ones
    move once, by page; within it lines are joined in blocks of 512 numbers and the blocks in order,
    so a very long page is never sorted as one array of lines.
    """
    key = F.when(F.col("line_no").isNull(), F.col("line_id"))  # tells lines without a number apart
    own = lines.select(F.col("page_id").cast("long").alias("page_id"), F.col("line_no").cast("long").alias("line_no"), F.col("line_id").cast("long").alias("line_id"), "file_id", "source", "text", "extracted_at", F.lit(False).alias("mark"))
    marks = repeated.select("page_id", "line_no", "line_id").distinct().withColumn("mark", F.lit(True))
    moved = own.unionByName(marks, allowMissingColumns=True).withColumn("key", key).repartition("page_id")
    latest = moved.groupBy("page_id", "line_no", "key").agg(
        F.max_by(F.when(~F.col("mark"), F.struct("line_id", "file_id", "source", "text")), F.when(~F.col("mark"), F.struct("extracted_at", "line_id"))).alias("l"), F.collect_set(F.when(F.col("mark"), F.col("line_id"))).alias("gone")
    )
    rows = latest.where("l is not null").select("page_id", "line_no", "key", "l.*", F.array_contains("gone", F.col("l.line_id")).alias("gone"))
    part = F.when(~F.col("gone") & F.col("text").isNotNull(), F.struct("line_no", "key", "text"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["text"]), "\n").alias("text")
    blocks = rows.groupBy("page_id", F.floor(F.col("line_no") / 512).alias("block")).agg(F.first("file_id").alias("file_id"), F.first("source").alias("source"), F.count("*").alias("n_lines"), F.count_if("gone").alias("n_removed"), joined(part))
    return blocks.groupBy("page_id").agg(
        F.first("file_id").alias("file_id"), F.first("source").alias("source"), joined(F.when(F.col("text") != "", F.struct("block", "text"))), F.sum("n_lines").alias("n_lines"), F.sum("n_removed").alias("n_removed")
    )
