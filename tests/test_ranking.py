"""Ranking against brute force, on groups with heavy skew and ties."""

import hashlib
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from reviewloom.operators import filters, ranking, sampling, selection
from reviewloom.operators.dedup import dedup_keep_first, drop_later_copies, first_arrivals
from reviewloom.operators.ranking import with_rank
from reviewloom.runtime import stored_table as stored


@pytest.fixture(scope="module")
def skewed(spark):
    """6,000 rows; a third share one id, one score and one class."""
    rng = random.Random(5)
    rows = []
    for seq in range(6000):
        if rng.random() < 0.34:
            rows.append((seq, "hot", 1, 0.5, "big"))
        else:
            score = rng.choice([0.5, rng.random() * 2, -rng.random()])
            rows.append((seq, f"id{rng.randrange(2500)}", rng.choice([0, 0, 0, 2, None]), score,
                         rng.choice(["big", "small", None])))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "seq BIGINT, id STRING, label INT, score DOUBLE, cat STRING")
    return rows, df.repartition(7).cache()


def row_hash(*parts):
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


def by_group(rows, position):
    groups = {}
    for row in rows:
        groups.setdefault(row[position], []).append(row)
    return groups


@pytest.mark.parametrize("k", [0, 1, 37, 900, 100000])
def test_sample_per_key(skewed, k):
    rows, df = skewed
    want = set()
    for group in by_group(rows, 2).values():
        ranked = sorted(group, key=lambda r: (row_hash(r[1], r[0], 7), r[1], r[0]))
        want |= {r[0] for r in ranked[:k]}
    got = sampling.sample_per_key(df, "label", k, 7, key=("id", "seq"))
    assert {r.seq for r in got.collect()} == want


@pytest.mark.parametrize("n", [1, 250, 5999, 9000])
def test_head_and_uniform_sample(skewed, n):
    rows, df = skewed
    assert {r.seq for r in filters.head_rows(df, n).collect()} == {
        r[0] for r in sorted(rows)[:n]}
    want = sorted(rows, key=lambda r: (row_hash(r[1], r[0], 3), r[1], r[0]))[:n]
    got = filters.sample_rows(df, n, 3, ("id", "seq"))
    assert {r.seq for r in got.collect()} == {r[0] for r in want}


def test_cap_per_group_ranks(skewed):
    rows, df = skewed
    got = filters.cap_per_group(df, 40, "cat", rank="rank").collect()
    want = {}
    for group in by_group(rows, 4).values():
        want |= {r[0]: i + 1 for i, r in enumerate(sorted(group)[:40])}
    assert {r.seq: r["rank"] for r in got} == want


@pytest.mark.parametrize("k", [0, 1, 500, 2500, 7000])
def test_top_k_with_a_large_tie(skewed, k):
    rows, df = skewed
    want = sorted(rows, key=lambda r: (-r[3], r[0]))[:k]
    got = selection.top_k(df, "score", k).collect()
    assert [r.seq for r in got] == [r[0] for r in want]


@pytest.mark.parametrize("quotas", [[10, 0, 5], [0, 1500, 20], [9000, 9000, 9000]])
def test_top_k_per_class(skewed, quotas):
    rows, df = skewed
    want = set()
    for label, group in by_group(rows, 2).items():
        if label is not None:
            ranked = sorted(group, key=lambda r: (-r[3], r[0]))
            want |= {r[0] for r in ranked[: quotas[label]]}
    got = selection.top_k_per_class(df, "score", quotas, by="label")
    assert {r.seq for r in got.collect()} == want


def test_quota_length_is_checked(skewed):
    with pytest.raises(ValueError, match="three classes"):
        selection.top_k_per_class(skewed[1], "score", [1, 2], by="label")


def test_scores_that_are_no_numbers(spark):
    rows = [(1, 0.5), (2, float("nan")), (3, None), (4, 0.9), (5, float("inf")), (6, float("-inf"))]
    df = spark.createDataFrame(rows, "seq BIGINT, score DOUBLE")
    for k in range(1, 7):
        found = [r.seq for r in selection.top_k(df, "score", k).collect()]
        assert found == [2, 5, 4, 1, 6, 3][:k]


def test_ranks_are_complete(skewed):
    rows, df = skewed
    ranked = with_rank(df, ["cat"], [F.col("score"), F.col("seq")])
    want = {}
    for group in by_group(rows, 4).values():
        want |= {r[0]: i + 1 for i, r in enumerate(sorted(group, key=lambda r: (r[3], r[0])))}
    assert {r.seq: r["rank"] for r in ranked.collect()} == want


@pytest.mark.parametrize("kind", ["bigint", "string", "timestamp", "double"])
@pytest.mark.parametrize("n", [1, 1000, 1001, 9000])
def test_any_type_of_arrival_number(skewed, kind, n):
    """Text numbers share a long prefix, as paths do."""
    rows, df = skewed
    values = {
        "bigint": F.col("seq"),
        "double": F.col("seq") / 7,
        "string": F.concat(F.lit("snapshot/part-"), F.lpad(F.col("seq").cast("string"), 9, "0")),
        "timestamp": F.timestamp_seconds("seq"),
    }
    typed = df.withColumn("number", F.col("seq")).withColumn("seq", values[kind])
    assert {r.number for r in filters.head_rows(typed, n).collect()} == {r[0] for r in sorted(rows)[:n]}
    want = set()
    for group in by_group(rows, 4).values():
        want |= {r[0] for r in sorted(group)[:n]}
    assert {r.number for r in filters.cap_per_group(typed, n, "cat").collect()} == want


@pytest.mark.parametrize("score", ["outlier", "close", "equal"])
def test_no_task_gets_more_than_its_share(spark, settings, score):
    """60,000 rows over 16 ranges: none of them holds a quarter of the rows."""
    settings(spark__sql__shuffle__partitions="16",
             spark__sql__adaptive__coalescePartitions__enabled="false")
    value = {
        "outlier": F.when(F.col("id") == 5, 1e18).otherwise(F.col("id") / 1e9),
        "close": 1 + F.col("id") / 1e12,
        "equal": F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.rand(1)),
    }[score]
    df = spark.range(0, 60000, 1, 8).select(F.col("id").alias("seq"), value.alias("score"))
    seen = []

    def keep(table):
        seen.append(table)
        return stored_table(table)

    from reviewloom.operators import ranking
    from reviewloom.runtime import stored_table

    before, ranking.stored_table = ranking.stored_table, keep
    try:
        ranked = with_rank(df, [], [F.col("score").desc(), F.col("seq")])
        assert ranked.count() == 60000 and ranked.agg(F.max("rank")).first()[0] == 60000
    finally:
        ranking.stored_table = before
    sizes = [r["count"] for r in seen[0].groupBy(F.shiftright("__at", 33)).count().collect()]
    assert len(sizes) > 8 and max(sizes) < 15000


def test_dedup_keeps_first_arrival(skewed):
    rows, df = skewed
    first = {}
    for row in sorted(rows):
        first.setdefault(row[1], row)
    assert {r.seq for r in dedup_keep_first(df).collect()} == {r[0] for r in first.values()}
    assert {r.seq for r in drop_later_copies(df).collect()} == {r[0] for r in first.values()}
    narrow = first_arrivals(df, carry=["label", "cat"]).collect()
    assert {(r.id, r.seq, r.label, r.cat) for r in narrow} == {
        (r[1], r[0], r[2], r[4]) for r in first.values()}


def test_dedup_needs_an_arrival_number(spark):
    with pytest.raises(ValueError, match="seq"):
        dedup_keep_first(spark.createDataFrame([("a",)], "id STRING"))


@pytest.mark.parametrize("partitions", ["1", "13"])
def test_answers_do_not_depend_on_partitioning(skewed, settings, partitions):
    _, df = skewed
    base = {r.seq for r in sampling.sample_per_key(df, "label", 50, 1, ("id", "seq")).collect()}
    settings(spark__sql__shuffle__partitions=partitions)
    other = sampling.sample_per_key(df.orderBy(F.desc("seq")), "label", 50, 1, ("id", "seq"))
    assert {r.seq for r in other.collect()} == base


def test_copies_are_reduced_before_the_shuffle(skewed, plan_of):
    _, df = skewed
    plan = plan_of(dedup_keep_first(df))
    assert plan.index("Exchange hashpartitioning(id") < plan.rindex("WindowGroupLimit")
    assert "Partial" in plan
    assert "partial_min" in plan_of(first_arrivals(df, carry=["label"]))
    assert "SortAggregate" not in plan_of(first_arrivals(df, carry=["label"]))


def large(spark, n, partitions=8):
    """Two thirds in one group, half of these with equal scores, some without one."""
    seq = F.col("id")
    return spark.range(0, n, 1, partitions).select(
        seq.alias("seq"),
        F.when(seq % 3 == 0, F.lit(None)).when(seq % 300 == 1, "small").otherwise("hot").alias("cat"),
        F.when(seq % 2 == 0, 0.5).when(seq % 1001 == 0, float("nan")).when(seq % 1003 == 0, F.lit(None))
        .otherwise((seq * 7919 % n) / n).alias("score"))


@pytest.mark.parametrize("order", [["seq"], ["score desc", "seq"], ["score", "seq desc"]])
def test_cut_before_the_sort(spark, order):
    """Of 3 million rows a few thousand are left to rank, and they hold the wanted ones."""
    df = stored(large(spark, 3_000_000))
    keys = [F.col(o.removesuffix(" desc")) for o in order]
    sort = [k.desc() if o.endswith("desc") else k.asc() for k, o in zip(keys, order)]
    for limit in (1, 100):
        kept, most = ranking.up_to_cut(df, [], order, limit)
        assert kept.count() == most < 3000
        wanted = [r.seq for r in df.orderBy(*sort).limit(limit).collect()]
        found = ranking.top_ranked(df, [], order, limit).orderBy("rank").collect()
        assert [r.seq for r in found] == wanted and [r["rank"] for r in found] == list(range(1, limit + 1))
    kept, most = ranking.up_to_cut(df, ["cat"], order, 100)
    assert most == 10_000 and kept.count() < 3000 * 2 + 10_001  # the small group is left whole
    window = Window.partitionBy("cat").orderBy(*sort)
    wanted = df.withColumn("rank", F.row_number().over(window)).filter("rank <= 100")
    found = ranking.top_ranked(df, ["cat"], order, 100)
    assert {(r.seq, r["rank"]) for r in found.collect()} == {(r.seq, r["rank"]) for r in wanted.collect()}


def test_a_bad_cut_is_mended(spark, monkeypatch):
    """A cut with too few rows before it brings the rest of its group back."""
    df = stored(large(spark, 300_000))
    monkeypatch.setattr(ranking, "_nth_of_sample", lambda limit, rows: F.lit(1))
    found = ranking.top_ranked(df, ["cat"], ["seq"], 5000)
    got = {}
    for r in found.collect():
        got.setdefault(r["cat"], []).append((r["rank"], r.seq))
    seqs = {None: range(0, 300_000, 3), "small": range(1, 300_000, 300)}
    for cat, wanted in seqs.items():
        assert sorted(got[cat]) == list(enumerate([x for x in wanted][:5000], 1))
    assert len(got["hot"]) == 5000


@pytest.mark.parametrize("window_rows", [10, 1 << 18])
def test_both_ways_to_rank_a_remainder(skewed, monkeypatch, window_rows):
    rows, df = skewed
    monkeypatch.setattr(ranking, "WINDOW_ROWS", window_rows)
    monkeypatch.setattr(ranking, "SAMPLE_ROWS", 64)
    for k in (3, 40, 900):
        got = filters.cap_per_group(df, k, "cat", rank="rank").collect()
        want = {}
        for group in by_group(rows, 4).values():
            want |= {r[0]: i + 1 for i, r in enumerate(sorted(group)[:k])}
        assert {r.seq: r["rank"] for r in got} == want
        best = sorted(rows, key=lambda r: (-r[3], r[0]))[:k]
        assert [r.seq for r in selection.top_k(df, "score", k).collect()] == [r[0] for r in best]
