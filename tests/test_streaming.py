import datetime as dt
import random
from collections import Counter

import pytest
from helpers import REVIEW_DDL, make_reviews, py_id, py_label
from pyspark.sql import functions as F

from reviewloom.functions import label_from_rating, stable_id
from reviewloom.operators import sampling, scoring, selection
from reviewloom.operators.filters import drop_blocked
from reviewloom.streaming import operators as ops
from reviewloom.streaming.sources import category_stream, file_stream, finish, run_append, run_batches

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """Reviews with event times, in six files that arrive in random order of ``seq``."""
    rows = make_reviews(600, 21)
    order = rows[:]
    random.Random(2).shuffle(order)
    timed = [(*r, START + dt.timedelta(hours=r[0])) for r in order]
    df = spark.createDataFrame(timed, REVIEW_DDL + ", ts TIMESTAMP")
    path = str(tmp_path_factory.mktemp("stream") / "in")
    for i in range(6):
        part = spark.createDataFrame(timed[i * 100:(i + 1) * 100], df.schema)
        part.coalesce(1).write.mode("append").parquet(path)
    return rows, path, df.schema


@pytest.fixture
def stream(spark, files):
    return file_stream(spark, files[1], files[2], max_files=1)


def test_ingest_runs_in_several_batches(spark, files, stream):
    numbers = []
    assert run_batches(stream, lambda batch, n: numbers.append((n, batch.count())))
    assert [n for n, _ in numbers] == list(range(6)) and sum(c for _, c in numbers) == 600


def test_drop_blocked_equals_batch(spark, files, stream):
    blocked = spark.createDataFrame([(py_id("hot text of all", "a0"),)], "id STRING")
    got = run_append(drop_blocked(stream.withColumn("id", stable_id()), blocked))
    batch = drop_blocked(spark.read.parquet(files[1]).withColumn("id", stable_id()), blocked)
    assert {r.seq for r in got.collect()} == {r.seq for r in batch.collect()}
    assert 0 < got.count() < 600


def first_of(rows):
    first = {}
    for row in sorted(rows):
        first.setdefault(py_id(row[1], row[4]), row)
    return {(rid, row[0], row[2]) for rid, row in first.items()}


def test_exact_dedup_equals_batch(files, stream):
    got = ops.run_first_by_id(stream.withColumn("id", stable_id()).select("id", "seq", "rating"))
    assert {(r.id, r.seq, r.rating) for r in got.collect()} == first_of(files[0])


def test_watermark_dedup(files, stream):
    wide = run_append(ops.dedup_within(stream.withColumn("id", stable_id()), "ts", "60 days"))
    ids = [r.id for r in wide.collect()]
    assert len(ids) == len(set(ids)) == len(first_of(files[0]))


def test_watermark_bounds_the_state(spark, tmp_path):
    """Copies within the delay go, copies long after it pass, rows far behind are dropped."""
    hours = [("a", 0), ("a", 1)], [("b", 30)], [("d", 60)], [("a", 90), ("c", 2)]
    path, seq = str(tmp_path / "in"), 0
    for batch in hours:
        rows = []
        for key, hour in batch:
            rows.append((seq, key, START + dt.timedelta(hours=hour)))
            seq += 1
        df = spark.createDataFrame(rows, "seq BIGINT, id STRING, ts TIMESTAMP")
        df.coalesce(1).write.mode("append").parquet(path)
    for salts in (1, 4):
        stream = file_stream(spark, path, df.schema, max_files=1)
        got = run_append(ops.dedup_within(stream, "ts", "10 hours", salts=salts))
        ids = Counter(r.id for r in got.collect())
        assert ids == {"a": 2, "b": 1, "d": 1}, salts


def test_running_and_daily_counts(files, stream):
    got = ops.run_complete(
        ops.running_counts(stream.withColumn("label", label_from_rating()), "label"))
    assert {r.label: r["rows"] for r in got.collect()} == Counter(py_label(r[2]) for r in files[0])
    days = run_append(ops.daily_counts(stream, "ts", "60 days")).collect()
    assert days == []  # no day is behind the watermark yet
    exact = ops.run_complete(ops.running_counts(stream, F.window("ts", "1 day").alias("day")))
    assert {r["rows"] for r in exact.collect()} == {24}


def scored(df):
    pseudo = F.pmod(F.xxhash64("text"), F.lit(50)) / 50.0
    return df.select("seq", pseudo.alias("uncertainty"), (F.col("seq") % 3).cast("int").alias("pred_label"))


def test_top_k_equals_batch(spark, files, stream):
    quotas = [7, 0, 30]
    got = ops.run_top_k_per_class(scored(stream), quotas).collect()
    batch = selection.top_k_per_class(scored(spark.read.parquet(files[1])), "uncertainty", quotas)
    assert {r.seq for r in got} == {r.seq for r in batch.collect()}


def test_large_quotas_equal_batch(spark, files, stream):
    quotas = [40, 1500, 3]
    got = ops.run_top_k_per_class(scored(stream), quotas).collect()
    batch = selection.top_k_per_class(
        scored(spark.read.parquet(files[1])), "uncertainty", quotas)
    assert {r.seq for r in got} == {r.seq for r in batch.collect()}


def test_sample_equals_batch(spark, files, stream):
    def rows(df):
        return df.select("seq", stable_id().alias("id"), label_from_rating().alias("label"))

    table = ops.VersionedTable(spark)
    got = ops.run_sample_per_class(rows(stream), 20, 5, table=table).collect()
    batch = sampling.sample_per_key(rows(spark.read.parquet(files[1])), "label", 20, 5, ("id", "seq"))
    assert {r.seq for r in got} == {r.seq for r in batch.collect()} and len(got) == 60
    assert table.read(4).count() <= 60 and table.read(5) is not None and table.read(6) is None
    assert table.read(0) is None  # only the last two versions stay


def test_repeated_batch_gives_the_same_version(spark, files):
    table = ops.VersionedTable(spark)
    df = scored(spark.read.parquet(files[1]))
    for _ in range(2):
        table.write(selection.top_k_per_class(df, "uncertainty", [5, 5, 5]), 0)
    assert table.latest().count() == 15
    with pytest.raises(ValueError):
        ops.VersionedTable(spark).latest()


def test_restart_continues_from_the_checkpoint(spark, files, stream, tmp_path):
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    assert run_append(stream.select("seq"), out, progress).count() == 600
    again = file_stream(spark, files[1], files[2]).select("seq")
    assert run_append(again, out, progress).count() == 600


def test_time_limit_stops(spark, files):
    endless = spark.readStream.format("rate").option("rowsPerSecond", 5).load()
    query = endless.writeStream.format("noop").start()
    assert finish(query, seconds=2) is False and not query.isActive


def test_category_stream(spark, tmp_path):
    for category in ("Books", "Toys"):
        spark.createDataFrame([("a", None)], "text STRING, rating DOUBLE").write.json(
            str(tmp_path / f"category={category}"))
    got = run_append(category_stream(spark, str(tmp_path), "text STRING, rating DOUBLE"))
    assert sorted((r.text, r.rating, r.product_category) for r in got.collect()) == [
        ("a", 0.0, "Books"), ("a", 0.0, "Toys")]


def test_seen_sink(spark, files, stream):
    got = run_append(ops.seen_ids(stream))
    assert {r.id for r in got.collect()} == {py_id(r[1], r[4]) for r in files[0]}


def scored_files(spark, folder, files=6, n=3000, seed=4):
    """Scores with ties, NaN and nulls, dealt to files in no order; a third has one class."""
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        score = rng.choice([0.5, rng.random(), -rng.random(), float("nan") if seq % 97 == 0 else 1.5, None])
        rows.append((seq, f"id{seq % 50}", rng.choice([0, 0, 1, 2, None]), score, "t" * (seq % 7) or None))
    rng.shuffle(rows)
    schema = "seq BIGINT, id STRING, pred_label INT, uncertainty DOUBLE, note STRING"
    for i in range(files):
        spark.createDataFrame(rows[i::files], schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.createDataFrame(rows, schema), schema


@pytest.mark.parametrize("quotas", [[20, 30, 10], [0, 1, 2000]])
def test_heaps_give_the_batch_answer_with_bounded_state(spark, tmp_path, quotas):
    batch, schema = scored_files(spark, str(tmp_path / "in"))
    stream = file_stream(spark, str(tmp_path / "in"), schema, max_files=1)
    table = ops.HeapTable(spark, str(tmp_path / "heaps"))
    found = ops.run_top_k_per_class(stream, quotas, table=table, salts=4)
    key = lambda r: (r.seq, r.id, r.pred_label, str(r.uncertainty), r.note)
    wanted = selection.top_k_per_class(batch, "uncertainty", quotas)
    assert sorted(map(key, found.collect()), key=str) == sorted(map(key, wanted.collect()), key=str)
    heaps = table.latest(ops.bounded_heaps(stream, quotas).schema)
    sizes = {(r["class"], r.salt): r["count"] for r in heaps.groupBy("class", "salt").count().collect()}
    assert len(sizes) <= 4 * sum(q > 0 for q in quotas)
    assert all(n <= quotas[c] for (c, _), n in sizes.items())


def test_partial_heaps_can_be_read_while_the_stream_goes_on(spark, tmp_path):
    _, schema = scored_files(spark, str(tmp_path / "in"))
    table = ops.HeapTable(spark, str(tmp_path / "heaps"))
    stream = file_stream(spark, str(tmp_path / "in"), schema, max_files=1)
    ops.run_top_k_per_class(stream, [5, 5, 5], table=table)
    shape = ops.bounded_heaps(stream, [5, 5, 5]).schema
    counts = [table.latest(shape, until=n).count() for n in range(6)]
    assert 0 < counts[0] <= counts[-1] and counts == sorted(counts)


def test_heaps_score_once_for_each_class(spark, files):
    """The filter on the class does not bring copies of the logits with it."""
    def letters(text):
        return [F.length(F.replace(text, F.lit(x), F.lit(""))) for x in "tne"]

    rows = spark.read.parquet(files[1])
    scored_rows = selection.candidate_rows(scoring.expression_scorer(letters)(rows))
    scored_rows = scored_rows.select("seq", "pred_label", "uncertainty")
    heaps = ops.bounded_heaps(scored_rows, [5, 5, 5])
    assert heaps._jdf.queryExecution().optimizedPlan().toString().count("replace(") == 3


def test_few_heaps_take_few_partitions(spark, tmp_path, settings):
    settings(spark__sql__shuffle__partitions="40")
    batch, schema = scored_files(spark, str(tmp_path / "in"), files=2, n=300)
    stream = file_stream(spark, str(tmp_path / "in"), schema, max_files=1)
    progress = tmp_path / "progress"
    found = ops.run_top_k_per_class(stream, [5, 5, 5], salts=3, checkpoint=str(progress))
    wanted = selection.top_k_per_class(batch, "uncertainty", [5, 5, 5])
    assert {r.seq for r in found.collect()} == {r.seq for r in wanted.collect()}
    assert len([x for x in (progress / "state/0").iterdir() if x.name.isdigit()]) == 3
    assert spark.conf.get("spark.sql.shuffle.partitions") == "40"


def test_ordered_batches_come_in_order_also_empty_ones(spark, tmp_path):
    from reviewloom.catalog import stream_queries

    rows = spark.range(3000).selectExpr("id AS doc_id", "repeat(sha2(string(id), 512), 60) AS text")
    rows = rows.filter("doc_id % 6 <> 4").unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) doc_id, 'x' text"))
    seen = []
    stream = stream_queries._in_order(spark, rows, F.col("doc_id") % 6)
    run_batches(stream, lambda batch, n: seen.append({r.doc_id % 6 for r in batch.select("doc_id").collect()}))
    assert seen == [{0}, {1}, {2}, {3}, set(), {5}]


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_sample_is_the_batch_sample_in_any_order(spark, tmp_path, seed):
    batch, schema = scored_files(spark, str(tmp_path / "in"), seed=seed)
    stream = file_stream(spark, str(tmp_path / "in"), schema, max_files=1)
    seen = []
    before, ops.cut_lineage = ops.cut_lineage, lambda df: seen.append(before(df)) or seen[-1]
    try:
        found = ops.run_sample_per_class(stream, 40, 9, by="pred_label")
    finally:
        ops.cut_lineage = before
    wanted = sampling.sample_per_key(batch, "pred_label", 40, 9, ("id", "seq"))
    assert {r.seq for r in found.collect()} == {r.seq for r in wanted.collect()}
    arrived = [df.count() for df in seen]  # 500 new rows a batch, and at most 160 kept ones
    assert arrived[0] == 500 and max(arrived[3:]) < 160 + 150


def test_dedup_state_holds_numbers_only(spark, tmp_path):
    """The same state for short and for long texts; late copies with smaller numbers win."""
    used = {}
    for length in (1, 4000):
        folder = str(tmp_path / f"in{length}")
        rows = [(seq, f"id{seq % 40}", "x" * length) for seq in range(2000)]
        for part in (rows[1000:], rows[:1000]):
            spark.createDataFrame(part, "seq BIGINT, id STRING, text STRING").coalesce(1).write.mode("append").parquet(folder)
        stream = file_stream(spark, folder, "seq BIGINT, id STRING, text STRING", max_files=1)
        found = ops.run_first_numbers(stream, rows=spark.read.parquet(folder)).collect()
        assert {(r.seq, r.id, len(r.text)) for r in found} == {(i, f"id{i}", length) for i in range(40)}
        query = (ops.first_numbers(stream).writeStream.outputMode("update").format("noop")
                 .option("checkpointLocation", str(tmp_path / f"c{length}")).trigger(availableNow=True).start())
        query.awaitTermination()
        used[length] = query.lastProgress["stateOperators"][0]
    assert used[1]["numRowsTotal"] == used[4000]["numRowsTotal"] == 40
    assert abs(used[1]["memoryUsedBytes"] - used[4000]["memoryUsedBytes"]) < 40 * 100
