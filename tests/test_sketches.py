from pyspark.sql import functions as F

from reviewloom.operators import sketches as s


def ids(spark, start, stop, parts=4):
    rows = spark.range(start, stop).union(spark.range(start, stop))
    return rows.select(F.concat(F.lit("r"), "id").alias("id"), (F.col("id") % parts).alias("shard"))


def report(*args, **options):
    row = s.approx_leakage_report(*args, **options).first()
    return row.train_unique, row.eval_rows, row.shared


def test_exact_while_ids_fit(spark):
    train, other = s.id_sketches(ids(spark, 0, 5000), "shard"), s.id_sketches(ids(spark, 4000, 6000))
    assert train.count() == 4
    assert report(train, other) == (5000, 2000, 1000)
    assert {r.n for r in train.select(s.distinct_estimate().alias("n")).collect()} == {1250}


def test_error_bound_beyond(spark):
    train = s.id_sketches(ids(spark, 0, 200_000), "shard", log_entries=12)
    other = s.id_sketches(ids(spark, 100_000, 300_000), log_entries=12)
    n, m, both = report(train, other, log_entries=12)
    error = 5 / 2**6  # five standard errors
    assert abs(n - 200_000) < error * 200_000 and abs(m - 200_000) < error * 200_000
    assert abs(both - 100_000) < error * 300_000
    assert max(r.n for r in train.select(F.length("sketch").alias("n")).collect()) < 8 * 2**13


def test_merged_in_any_order_equals_at_once(spark):
    rows = ids(spark, 0, 3000)
    fine = s.id_sketches(rows, "shard")
    halves = s.merge_sketches(fine.withColumn("half", F.col("shard") % 2), "half")
    whole = s.merge_sketches(halves).select(s.distinct_estimate().alias("n")).first().n
    assert whole == s.id_sketches(rows).select(s.distinct_estimate().alias("n")).first().n == 3000


def test_nulls_and_empty_tables(spark):
    rows = spark.createDataFrame([(None, 0), ("a", 0), (None, 1)], "id STRING, shard BIGINT")
    found = s.id_sketches(rows, "shard").select("shard", s.distinct_estimate().alias("n"))
    assert {r.shard: r.n for r in found.collect()} == {0: 1, 1: 0}
    none = s.id_sketches(rows.filter("false"))
    assert report(none, s.id_sketches(rows)) == (0, 1, 0)
    assert report(s.id_sketches(rows.filter("false"), "shard"), none) == (0, 0, 0)
