"""Plans and behaviour under skew."""

from pyspark.sql import functions as F

from reviewloom.functions import stable_id
from reviewloom.operators import filters, selection
from reviewloom.operators.conform import with_id
from reviewloom.runtime import compute_once
from reviewloom.sources.readers import json_lines


def hot_rows(spark, n=60000):
    """A third of the rows have one id."""
    return spark.range(0, n, 1, 12).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("id"),
        F.sha2(F.col("id").cast("string"), 512).alias("text"),
    )


def skew_settings(settings):
    settings(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="50KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.2",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="50KB",
        spark__sql__shuffle__partitions="8",
    )


def test_large_blocklist_splits_a_hot_id(spark, settings):
    skew_settings(settings)
    rows = hot_rows(spark)
    ids = spark.range(0, 60000, 5, 4).select(F.concat(F.lit("k"), "id").alias("id"))
    kept = filters.drop_blocked(rows, ids.distinct())
    kept.collect()
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "skew=true" in plan and "LeftAnti" in plan
    assert kept.count() == 60000 - sum(1 for i in range(0, 60000, 5) if i % 3)


def test_label_merge_splits_a_hot_id(spark, settings):
    skew_settings(settings)
    pool = hot_rows(spark).withColumn("label", F.lit(1))
    human = spark.range(0, 60000, 1, 4).select(
        F.concat(F.lit("k"), "id").alias("id"), F.lit("pos").alias("label"))
    human = human.union(spark.createDataFrame([("hot", "neg")], "id STRING, label STRING"))
    merged = selection.merge_human_labels(pool, human)
    counts = {r.label: r["count"] for r in merged.groupBy("label").count().collect()}
    assert counts == {0: 20000, 2: 40000}
    merged.collect()
    assert "skew=true" in merged._jdf.queryExecution().executedPlan().toString()


def test_ids_are_computed_once(spark, plan_of, tmp_path):
    hot_rows(spark, 10).withColumn("asin", F.lit("A")).drop("id").write.parquet(str(tmp_path / "r"))
    df = spark.read.parquet(str(tmp_path / "r"))
    gold = spark.createDataFrame([("x",)], "id STRING")
    plan = plan_of(filters.drop_labelled(with_id(df), gold))
    assert plan.count("sha1(") == 1
    copied = plan_of(filters.drop_labelled(df.withColumn("id", stable_id()), gold))
    assert copied.count("sha1(") > 1  # what compute_once is for


def test_filters_pass_a_computed_column(spark, plan_of, tmp_path):
    hot_rows(spark, 10).write.parquet(str(tmp_path / "r"))
    df = compute_once(spark.read.parquet(str(tmp_path / "r")), "h", F.sha1("text")).filter("seq > 5")
    plan = plan_of(df.select("h"))
    assert "GreaterThan(seq,5)" in plan and "ReadSchema: struct<seq:bigint,text:string>" in plan


def test_json_is_parsed_once(spark, plan_of):
    lines = spark.createDataFrame([('{"text":"a","rating":"4"}',)], "value STRING")
    assert plan_of(json_lines(lines, {"text": "string", "rating": "double"})).count("parseJson") == 1


def test_category_filter_reaches_the_scan(spark, plan_of, tmp_path):
    df = spark.createDataFrame([("a", "X"), ("b", "Y")], "text STRING, product_category STRING")
    df.write.partitionBy("product_category").parquet(str(tmp_path / "p"))
    plan = plan_of(filters.category_filter(spark.read.parquet(str(tmp_path / "p")), ["X"]))
    assert "PartitionFilters: [isnotnull(product_category" in plan
