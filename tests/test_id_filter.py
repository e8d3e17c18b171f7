import pytest
from pyspark.sql import functions as F

from reviewloom.operators.filters import drop_blocked, drop_labelled
from reviewloom.operators.id_filter import anti_join_filtered, id_filter, maybe_listed


def shuffled_rows(df):
    """Rows that each exchange of the executed plan wrote, by the columns it carried."""
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    found = []

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if name.endswith("QueryStage"):
            return walk(node.plan())
        if name == "Exchange":
            rows = node.metrics().apply("shuffleRecordsWritten").value()
            found.append((node.output().mkString(","), rows))
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(plan)
    return found


@pytest.fixture
def long_list(spark, tmp_path):
    """200,000 rows with texts, a third under one id, and a list of 20,000 ids."""
    rows = spark.range(200_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("r"), "id")).alias("id"),
        F.repeat(F.lit("x"), 50).alias("text"),
    )
    ids = spark.range(20_000).select(
        F.when(F.col("id") < 2_000, F.concat(F.lit("r"), F.col("id") * 3 + 1))
        .otherwise(F.concat(F.lit("other"), "id")).alias("id")
    )
    for name, df in (("rows", rows), ("ids", ids)):
        df.write.parquet(str(tmp_path / name))
    return [spark.read.parquet(str(tmp_path / name)) for name in ("rows", "ids")]


def test_few_rows_reach_the_shuffle(long_list, settings):
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    rows, ids = long_list
    kept = drop_blocked(rows, ids, by_filter=True)
    moved = [n for columns, n in shuffled_rows(kept) if "text" in columns]
    assert moved and 2_000 <= max(moved) < 4_000  # the listed rows and few others
    plain = drop_blocked(rows, ids)
    assert max(n for columns, n in shuffled_rows(plain) if "text" in columns) == 200_000
    assert kept.count() == plain.count() == 198_000
    assert kept.exceptAll(plain).isEmpty()


def test_no_listed_id_is_refused_by_any_size_of_filter(long_list):
    rows, ids = long_list
    for most_bits in (1 << 15, 1 << 17, 1 << 27):
        small = id_filter(ids, "id", most_bits)
        assert small.count() <= most_bits // (1 << 15)
        assert maybe_listed(ids, small, "id", "maybe").filter("NOT maybe").isEmpty()
        assert anti_join_filtered(rows, ids, "id", most_bits).count() == 198_000


def test_a_hot_listed_id_goes_as_a_whole(long_list):
    rows, ids = long_list
    ids = ids.union(rows.filter("id = 'hot'").select("id").limit(1))
    assert drop_blocked(rows, ids, by_filter=True).count() == drop_blocked(rows, ids).count()


def test_nulls_copies_empty_tables_and_types(spark):
    rows = spark.createDataFrame(
        [("a", 1), ("a", 1), (None, 2), ("b", 3), ("b", 3), ("", 4)], "id STRING, n INT")
    ids = spark.createDataFrame([("a",), (None,), ("z",)], "listed STRING")
    got = sorted(r.n for r in anti_join_filtered(rows, ids).collect())
    assert got == [2, 3, 3, 4]
    none = ids.filter("false")
    assert anti_join_filtered(rows, none).count() == 6
    assert anti_join_filtered(rows.filter("false"), ids).count() == 0
    assert anti_join_filtered(rows, ids).columns == rows.columns
    labelled = drop_labelled(rows, rows.filter("n = 3"), by_filter=True)
    assert sorted(r.n for r in labelled.collect()) == [1, 1]
    numbers = spark.createDataFrame([(1.0,), (0.0,)], "id DOUBLE")
    zero = spark.createDataFrame([(-0.0,)], "id DOUBLE")
    assert [r.id for r in anti_join_filtered(numbers, zero).collect()] == [1.0]
    longs = spark.range(5)
    assert anti_join_filtered(longs, spark.range(3).select(F.col("id").cast("int"))).count() == 2
    assert anti_join_filtered(longs, spark.range(1, 3)).count() == 3
