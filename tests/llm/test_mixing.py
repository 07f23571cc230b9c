from leafline.llm import mixing as X
from pyspark.sql import functions as F

TARGETS = [("a", 0.5, 2), ("b", 0.3, 4), ("c", 0.1, 2), ("none", 0.1, 2), (None, 0.0, 1)]


def make(spark, n=3000):
    rows = [(i, "a" if i % 3 else "b" if i % 2 else "c", 1 + i % 17, None if i % 11 == 0 else (i % 5) / 5, 1) for i in range(n)] + [(10**6, "other", 5, 1.0, 1), (10**6 + 1, "a", 0, 1.0, 1), (10**6 + 2, None, 3, 1.0, 1)]
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens int, w double, repeats int"), spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")


def test_shares_are_exact_and_caps_hold(spark):
    df, targets = make(spark)
    out = X.mix(df, targets, weight_col="w")
    rows = {r.source: r for r in X.shares(out, targets).collect()}
    usable = 0.9
    for s, t in (("a", 0.5), ("b", 0.3), ("c", 0.1)):
        assert abs(rows[s].actual_share - t / usable) < 0.005
        assert rows[s].most_repeats <= {"a": 2, "b": 4, "c": 2}[s]
    assert rows["none"].tokens == 0 and out.where("source = 'other' or doc_id = 1000001").count() == 0
    assert out.count() == 3000 and max(r.most_repeats for r in rows.values()) >= 2


def test_the_rounds_equal_a_plain_pass_in_order(spark):
    df, targets = make(spark)
    out = {r.doc_id: r.repeats for r in X.mix(df, targets, weight_col="w", total_tokens=9000).collect()}
    u = (F.pmod(F.xxhash64("doc_id", F.lit(42)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keys = df.where("n_tokens > 0").select("doc_id", "source", "n_tokens", (-F.log(u) / F.greatest(F.coalesce("w", F.lit(0.0)), F.lit(1e-3))).alias("key")).collect()
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.1)):
        own = sorted((r for r in keys if r.source == s), key=lambda r: (r.key, r.doc_id))
        total = sum(r.n_tokens for r in own)
        budget = int(min(total * {"a": 2, "b": 4, "c": 2}[s], 9000 * share / 0.9) + 1e-6)
        left = budget % total
        for r in own:
            fits = r.n_tokens <= left
            left -= r.n_tokens if fits else 0
            assert out[r.doc_id] == budget // total + fits, (s, r)


def test_same_draw_for_any_partitioning_and_nothing_from_nothing(spark):
    df, targets = make(spark, 400)
    a = sorted(map(tuple, X.mix(df, targets).collect()))
    assert a == sorted(map(tuple, X.mix(df.repartition(7), targets).collect()))
    assert X.mix(df.limit(0), targets).count() == 0 and X.mix(df, targets.limit(0)).count() == 0
    assert {r.actual_share for r in X.shares(X.mix(df.limit(0), targets), targets).collect()} == {0.0}


def test_no_range_holds_much_of_a_source_whatever_the_weights(spark):
    """Null weights give keys a thousand times as large, mixed ones keys of all sizes; the ranges follow the keys."""
    n = 20_000
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit(3).alias("n_tokens"), F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, 0.0).otherwise(F.col("id") / n).cast("double").alias("w"))
    for weights in (rows, rows.withColumn("w", F.lit(None).cast("double"))):
        key = -F.log((F.pmod(F.xxhash64("doc_id", F.lit(42)), F.lit(1 << 52)) + 0.5) / float(1 << 52)) / F.greatest(F.coalesce("w", F.lit(0.0)), F.lit(1e-3))
        keyed = weights.withColumn("key", key)
        cuts = keyed.agg(F.percentile_approx("key", [k / X.PARTS for k in range(1, X.PARTS)], 10000)).first()[0]
        most = keyed.groupBy(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("key")))).count().agg(F.max("count")).first()[0]
        assert most <= n / 100
        targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
        for total in (1, 29_999, 3 * n + 4):
            out = X.mix(weights, targets, weight_col="w", total_tokens=total)
            assert (out.agg(F.sum(F.col("n_tokens") * F.col("repeats"))).first()[0] or 0) == total // 3 * 3


def test_one_huge_record_does_not_end_the_draw(spark):
    import math

    rows = [(i, "a", 5000 if i % 50 == 7 else 3 + i % 9) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens int")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    for total in (4000, 9000):
        got = {r.doc_id: r.repeats for r in X.mix(df, targets, total_tokens=total).collect()}
        keys = {r[0]: r[1] for r in df.select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit(42)), F.lit(1 << 52)) + 0.5) / float(1 << 52)).collect()}
        left, want = total, {}
        for i, _, n in sorted(rows, key=lambda r: (-math.log(keys[r[0]]), r[0])):
            want[i] = int(n <= left)
            left -= n * want[i]
        assert got == want and (left < 3 or total == 9000)


def test_equal_keys_and_equal_records(spark):
    df = spark.createDataFrame([(1, "a", 2)] * 50 + [(2, "a", 2)] * 50, "doc_id long, source string, n_tokens int")
    out = X.mix(df, spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int"), total_tokens=120)
    assert out.count() == 100 and out.agg(F.sum(F.col("n_tokens") * F.col("repeats"))).first()[0] >= 100


def test_many_sizes_take_few_jobs(spark):
    """Every record that is passed over may be of another size; none of them costs the driver a round of its own."""
    rows = [(i, s, 1 + (i * 7919) % 4001) for i in range(3000) for s in ("a", "b")]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens int").repartition(3)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    spark.sparkContext.setJobGroup("mix", "mix")
    got = {(r.doc_id, r.source): r.repeats for r in X.mix(df, targets, total_tokens=7_000_001).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("mix"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    keys = {r[0]: r[1] for r in df.select("doc_id", -F.log((F.pmod(F.xxhash64("doc_id", F.lit(42)), F.lit(1 << 52)) + 0.5) / float(1 << 52))).collect()}
    for source in "ab":
        left, passed = 3_500_000, set()
        for i, _, n in sorted((r for r in rows if r[1] == source), key=lambda r: keys[r[0]]):
            assert got[i, source] == (n <= left)
            passed |= {n} if n > left else set()
            left -= n if n <= left else 0
        assert len(passed) > 100
    assert jobs <= 40


def test_records_of_one_id_are_taken_one_by_one(spark):
    df = spark.createDataFrame([(1, "a", 2)] * 50 + [(2, "a", 2)] * 50, "doc_id long, source string, n_tokens int")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert X.mix(df, targets, total_tokens=120).agg(F.sum(F.col("n_tokens") * F.col("repeats"))).first()[0] == 120
