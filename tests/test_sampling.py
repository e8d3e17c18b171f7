import random
from collections import Counter

import pytest
from helpers import REVIEW_DDL, accepted, make_reviews, py_id, py_label, row_hash
from pyspark.sql import functions as F

from reviewloom.operators import filters, metrics, sampling
from reviewloom.operators.leakage import assert_no_leakage, leakage_ids, leakage_report


@pytest.fixture(scope="module")
def data(spark):
    rows = make_reviews()
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    return rows, spark.createDataFrame(shuffled, REVIEW_DDL).repartition(5).cache()


@pytest.fixture(scope="module")
def blocked(spark, data):
    ids = sorted({py_id(r[1], r[4]) for r in data[0]})[::9] + [py_id("hot text of all", "a0")]
    return set(ids), spark.createDataFrame([(i,) for i in ids], "id STRING").cache()


@pytest.mark.parametrize("dedup", [True, False])
@pytest.mark.parametrize("k", [20, 2000])
def test_balanced_train(data, blocked, dedup, k):
    rows, df = data
    want = {}
    for row, rid in accepted(rows, blocked[0], 3, dedup):
        key = row_hash(rid, 42) if dedup else row_hash(rid, row[0], 42)
        want.setdefault(py_label(row[2]), []).append((key, row[0]))
    chosen = {seq for group in want.values() for _, seq in sorted(group)[:k]}
    got = sampling.balanced_train(df, k, 42, blocked[1], 3, dedup).collect()
    assert {r.seq for r in got} == chosen and len(got) == len(chosen)
    by_seq = {r[0]: r for r in rows}
    for r in got:
        source = by_seq[r.seq]
        assert (r.text, r.rating, r.asin, r.title) == (source[1], source[2], source[4], source[3])
        assert r.id == py_id(source[1], source[4]) and r.label == py_label(source[2])


def test_balanced_train_keeps_given_labels(spark):
    rows = [(i, f"text {i}", 5.0, "", "A", "C", i % 4) for i in range(40)]
    df = spark.createDataFrame(rows, REVIEW_DDL + ", label INT")
    got = sampling.balanced_train(df, 3, 1).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in got} == {0: 3, 1: 3, 2: 3, 3: 3}


def test_split_is_disjoint_and_exact(data, blocked):
    rows, df = data
    groups = {}
    for row, rid in accepted(rows, blocked[0]):
        groups.setdefault(row[5], []).append((row_hash(rid, 7), rid, row[0]))
    want = {}
    for group in groups.values():
        for place, (_, _, seq) in enumerate(sorted(group)[:50]):
            want[seq] = "dev" if place < 15 else "eval"
    got = sampling.split_dev_eval(df, 15, 35, 7, (), blocked[1]).collect()
    assert {r.seq: r.split for r in got} == want
    dev, ev = ({r.id for r in got if r.split == part} for part in ("dev", "eval"))
    assert not dev & ev


def test_split_of_short_and_unlisted_categories(spark):
    rows = [(i, f"text number {i}", 3.0, "", "A", c) for i, c in
            enumerate(["tiny"] * 2 + ["mid"] * 6 + ["other"] * 9)]
    df = spark.createDataFrame(rows, REVIEW_DDL)
    split = sampling.split_dev_eval(df, 4, 4, 1, categories=["tiny", "mid"])
    counts = Counter((r.product_category, r.split) for r in split.collect())
    assert counts == {("tiny", "dev"): 2, ("mid", "dev"): 4, ("mid", "eval"): 2}
    seen = filters.category_filter(df, ["tiny", "mid"])
    report = {r.product_category: r for r in sampling.split_diagnostics(seen, split, 4, 4).collect()}
    assert (report["tiny"].seen, report["tiny"].dev_rows, report["tiny"].eval_rows) == (2, 2, 0)
    assert report["tiny"].short and report["mid"].short


def py_seats(counts, nulls, n):
    total = sum(counts.values()) + nulls
    if n >= total:
        return dict(counts)
    seats = {k: c * n // total for k, c in counts.items()}
    left = min(n, total) - sum(seats.values())
    for k in sorted(counts, key=lambda k: (-(counts[k] * n % total), k)):
        if left > 0:
            seats[k] += 1
            left -= 1
    return seats


@pytest.mark.parametrize("counts,nulls,n", [
    ({0: 5, 1: 5, 2: 5}, 0, 7), ({0: 1, 1: 98, 2: 1}, 0, 10), ({0: 3, 1: 4}, 13, 9),
    ({0: 3, 1: 4}, 0, 7), ({0: 3, 1: 4}, 2, 100), ({0: 10, 1: 10, 2: 10}, 30, 20), ({2: 6}, 0, 1)])
def test_quota_and_stratified_sample(spark, counts, nulls, n):
    labels = [k for k, c in counts.items() for _ in range(c)] + [None] * nulls
    df = spark.createDataFrame([(i, f"id{i}", k) for i, k in enumerate(labels)],
                               "seq BIGINT, id STRING, label INT")
    seats = py_seats(counts, nulls, n)
    got = sampling.allocate_quota(metrics.label_distribution(df), n).collect()
    assert {r.label: r.seats for r in got} == seats
    drawn = [r.label for r in sampling.sample_stratified(df, n, 3).collect()]
    assert len(drawn) == min(n, len(labels))
    for label, places in seats.items():
        assert drawn.count(label) >= places
        if nulls == 0:
            assert drawn.count(label) == places


def test_stratified_without_strata(spark):
    df = spark.range(50).selectExpr("id AS seq", "CAST(id AS STRING) AS id",
                                    "CAST(NULL AS INT) AS label")
    assert sampling.sample_stratified(df, 9).count() == 9
    assert sampling.sample_stratified(df.drop("label"), 9).count() == 9
    assert sampling.sample_stratified(df, 0).count() == 50


def test_samples_are_uniform(spark):
    df = spark.range(2000).selectExpr("id AS seq", "concat('r', id) AS id", "1 AS label")
    hits = Counter()
    for seed in range(20):
        hits.update(r.seq // 500 for r in
                    sampling.sample_per_key(df, "label", 200, seed).select("seq").collect())
    assert all(800 <= hits[part] <= 1200 for part in range(4))


def test_category_counts_and_shuffle(data):
    rows, df = data
    got = {r.product_category: r["rows"] for r in
           metrics.label_distribution(df, "product_category").collect()}
    assert got == Counter(r[5] for r in rows)
    ids = df.withColumn("id", F.col("seq").cast("string"))
    order = [r.seq for r in sampling.shuffle_rows(ids, 4).collect()]
    assert order == [r.seq for r in sampling.shuffle_rows(ids.orderBy("seq"), 4).collect()]
    assert sorted(order) == [r[0] for r in rows]


def test_leakage(spark):
    train = [(0, "Great product", 5.0, "", "A1", "C"), (1, "Bad product", 1.0, "", "A2", "C")]
    other = [(2, "Another text", 3.0, "", "A3", "C")]
    same = [(3, " great  PRODUCT", 5.0, "", "a1 ", "C")]
    table = lambda rows: spark.createDataFrame(rows, REVIEW_DDL)
    assert assert_no_leakage(table(train), table(other)) == {"train_unique": 2, "eval_rows": 1}
    with pytest.raises(ValueError, match="1 ids are on both sides"):
        assert_no_leakage(table(train), table(same + other))
    assert [r.id for r in leakage_ids(table(train), table(same)).collect()] == [
        py_id("great product", "a1")]
    report = leakage_report(table(train * 3), table(same * 2)).first()
    assert tuple(report) == (2, 1, 1)


def test_filters(spark, data, blocked):
    rows, df = data
    ids = df.withColumn("id", F.lit("x"))
    assert filters.min_words(df, 0) is df
    assert filters.category_filter(df, []) is df
    assert filters.head_rows(df, 0) is df
    empty = spark.createDataFrame([("a",), ("",), (None,), ("b",)], "id STRING")
    gold = spark.createDataFrame([("b",)], "id STRING")
    assert [r.id for r in filters.drop_labelled(empty, gold).collect()] == ["a"]
    merged = filters.union_id_sets(gold, empty, gold)
    assert sorted(str(r.id) for r in merged.collect()) == ["", "None", "a", "b"]
    assert filters.drop_blocked(ids, gold).count() == len(rows)
    marked = spark.createDataFrame([(1, 1), (1, 2)], "pred_label INT, label INT")
    assert filters.agreeing_rows(marked).count() == 1


def test_blocklist_join_is_an_anti_join_above_the_dedup(data, blocked, plan_of, settings):
    _, df = data
    assert "LeftAnti" in plan_of(sampling.train_candidates(df, blocked[1]))
    # With a blocklist too large to broadcast, copies are combined before it is joined.
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    plan = plan_of(sampling.train_candidates(df, blocked[1]))
    join = plan.index("LeftAnti")
    assert "SortMergeJoin" in plan[join - 60:join + 10]
    assert plan.index("min_by", join) > join  # the aggregate is below the join


def test_texts_are_not_shuffled_by_sampling(spark, data, plan_of, tmp_path):
    _, df = data
    df.write.parquet(str(tmp_path / "r"))
    stored = spark.read.parquet(str(tmp_path / "r"))
    plan = plan_of(sampling.balanced_train(stored, 5, 1))
    for line in plan.splitlines():
        assert not ("Exchange hashpartitioning" in line and "text" in line)
    assert "BroadcastHashJoin [seq" in plan
    assert "Python" not in plan
