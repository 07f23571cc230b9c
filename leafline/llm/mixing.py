"""Problem 8: a mix of sources with given shares of all tokens.

Efraimidis-Spirakis sampling: every record draws a key -ln(u) / weight; the smallest keys of a
source, taken in order of the key as they fit, fill the rest of its budget after its complete epochs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from leafline.session import cut

PARTS = 128  # ranges of about equal numbers of records, one of which is run through in order
SPREAD = 64  # tasks over which the records of one size are spread
ORDER = ("key", "id", "size", "n")


def plan(available: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, n_records, n_tokens, budget) of every source of the targets.

    available: (source, n_records, n_tokens). Without total_tokens the mix is as large as it can be
    with every share exact: the least, over the sources that have tokens, of tokens * max_repeats /
    share; the shares of sources without tokens go to the others in proportion. With total_tokens
    each source gets its share of it, or all that max_repeats allows. Null or negative shares and
    repeats count as 0.
    """
    t = targets.groupBy("source").agg(F.greatest(F.sum("target_share"), F.lit(0.0)).alias("target_share"), F.greatest(F.max("max_repeats"), F.lit(0)).alias("max_repeats"))
    t = t.join(available, "source", "left").na.fill(0, ["n_records", "n_tokens", "max_repeats"]).na.fill(0.0, ["target_share"])
    everything = Window.partitionBy(F.lit(1))  # one row per source of the targets
    usable = (F.col("n_tokens") > 0) & (F.col("max_repeats") > 0) & (F.col("target_share") > 0)
    t = t.withColumn("share", F.when(usable, F.col("target_share") / F.sum(F.when(usable, F.col("target_share"))).over(everything)).otherwise(0.0))
    cap = F.col("n_tokens") * F.col("max_repeats")
    total = F.lit(float(total_tokens)) if total_tokens is not None else F.min(F.when(usable, cap / F.col("share"))).over(everything)
    return t.withColumn("budget", F.coalesce(F.floor(F.least(cap.cast("double"), total * F.col("share")) + 1e-6), F.lit(0)).cast("long")).drop("share")


def mix(records: DataFrame, targets: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", weight_col: str | None = None, total_tokens: int | None = None, seed: int = 42) -> DataFrame:
    """(id, source, n_tokens, repeats): how often each record is used, 0 for a record that the mix leaves out.

    Every record of a source is used budget // tokens times; of the remaining budget each record, in
    the order of the keys, takes its size if that is still left. Records without tokens, or of a
    source without a budget, have no row; null or non-positive weights count as the least weight;
    equal keys are ordered by id, equal ids by size. Keys depend on id and seed alone, so lost tasks repeat the same draw.

    The order is never run through in one task: the quantiles of its keys cut a source into PARTS
    ranges of about as many records, whatever the weights. Their sums, combined before the shuffle,
    tell in which of them the budget runs out; only that range is run through, and what is left then
    is less than some record's size. As less and less is left, the records of one size that are
    taken from there on are the first ones of that size, no more than would fill what is left
    alone: these are all that is still to be looked at, at most left * (1 + ln left) records.
    """
    weight = F.greatest(F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)), F.lit(1e-3)) if weight_col else F.lit(1.0)
    u = (F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    rows = cut(records.where(F.col(size_col) > 0).select(F.col(id_col).alias("id"), "source", F.col(size_col).cast("long").alias("size"), (-F.log(u) / weight).alias("key"), F.monotonically_increasing_id().alias("n")))
    cuts = F.percentile_approx("key", [k / PARTS for k in range(1, PARTS)], 10000).alias("cuts")
    totals = cut(rows.groupBy("source").agg(F.count("*").alias("n_records"), F.sum("size").alias("n_tokens"), cuts))
    planned = plan(totals.drop("cuts"), targets, total_tokens).where("budget > 0").select("source", F.floor(F.col("budget") / F.col("n_tokens")).alias("epochs"), (F.col("budget") % F.col("n_tokens")).alias("rest"))
    part = F.size(F.filter("cuts", lambda c: c < F.col("key"))).alias("part")
    placed = cut(rows.join(planned.join(totals.select("source", "cuts"), "source"), "source").select("id", "source", "size", "key", "n", "epochs", "rest", part))

    pool = placed.where("size <= rest")
    upto = F.sum("sum").over(Window.partitionBy("source").orderBy("part"))  # PARTS rows per source
    sums = pool.groupBy("source", "rest", "part").agg(F.sum("size").alias("sum")).withColumn("upto", upto)
    first = F.min(F.when(F.col("upto") > F.col("rest"), F.struct("part", (F.col("rest") - F.col("upto") + F.col("sum")).alias("left")))).alias("first")
    edge = cut(sums.groupBy("source").agg(first).select("source", F.coalesce("first.part", F.lit(PARTS)).alias("at"), "first.left"))

    inside = cut(_taken(pool.join(edge, "source").where("part = at")))
    used = inside.groupBy("source").agg(F.sum("size").alias("used"))
    left = cut(edge.join(used, "source", "left").select("source", "at", (F.col("left") - F.coalesce("used", F.lit(0))).alias("left")).where("left > 0"))
    after = pool.join(left, "source").where("part > at and size <= left")
    for by in (["source", "size", F.pmod(F.xxhash64("n"), F.lit(SPREAD))], ["source", "size"]):
        place = F.row_number().over(Window.partitionBy(*by).orderBy(*ORDER))
        after = after.withColumn("place", place).where(F.col("place") * F.col("size") <= F.col("left"))
    taken = inside.unionByName(_taken(after)).select("n", F.lit(True).alias("taken"))

    drawn = placed.join(edge.select("source", "at"), "source", "left").join(taken, "n", "left")
    once = F.coalesce((F.col("part") < F.col("at")) & (F.col("size") <= F.col("rest")), F.lit(False)) | F.coalesce("taken", F.lit(False))
    return drawn.select(F.col("id").alias(id_col), "source", F.col("size").alias("n_tokens"), (F.col("epochs") + once.cast("int")).cast("int").alias("repeats"))


def _taken(pool: DataFrame) -> DataFrame:
    """(source, n, size) of the records that, in their order, still fit what is left of their source; a source in one task, as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, left = None, 0
        for batch in batches:
            taken = []
            for i, (source, size, whole) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("source", "size", "left")))):
                if source != now:
                    now, left = source, whole
                if size <= left:
                    left -= size
                    taken.append(i)
            yield batch.select(["source", "n", "size"]).take(pa.array(taken, pa.int64()))

    ordered = pool.repartition("source").sortWithinPartitions("source", *ORDER)
    return ordered.select("source", "n", "size", "left").mapInArrow(run, "source string, n long, size long")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, tokens, actual_share, most_repeats, n_records) of every source of the targets, used or not."""
    used = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"), F.count_if(F.col("repeats") > 0).alias("n_records"))
    t = targets.groupBy("source").agg(F.sum("target_share").alias("target_share")).join(used, "source", "left").na.fill(0, ["tokens", "most_repeats", "n_records"])
    total = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # one row per source of the targets
    return t.select("source", "target_share", "tokens", F.when(total > 0, F.col("tokens") / total).otherwise(0.0).alias("actual_share"), "most_repeats", "n_records")
