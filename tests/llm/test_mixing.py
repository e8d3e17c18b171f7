import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from reviewloom.llm import mixing

SIZES = "doc_id BIGINT, source STRING, size BIGINT, copies STRING"


def targets(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight; what is above a cap goes to the others, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, free, out = sum(sizes.values()), set(names), {}
    while free:
        share = {s: total * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] >= most * sizes[s]}
        if not above:
            return {**out, **share}
        for s in above:
            out[s] = float(most * sizes[s])
            total -= out[s]
        free -= above
    return out


def run(spark, rows):
    return mixing.mix(spark.createDataFrame(rows, SIZES).repartition(3)).collect()


def test_targets_and_budgets(spark):
    rows = []
    for i in range(3000):
        source = ["a", "b", "c", None, "\U0001f600", "￮"][0 if i % 3 == 0 else i % 6]
        rows.append((i, source, 40 if i % 2 else i % 97, "x"))
    sizes = defaultdict(int)
    for _, s, n, _ in rows:
        sizes[s] += n
    wanted, taken = targets(sizes), defaultdict(int)
    found = run(spark, rows)
    assert len(found) == len(rows)
    for r in found:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(wanted[r.source], rel=1e-9)
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
    for s in sizes:
        assert abs(taken[s] - wanted[s]) <= 20  # half the only size of a source
    assert sorted(found, key=str) == sorted(run(spark, rows[::-1]), key=str)


def test_caps_are_reshared(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 400, "e": 1}
    rows = [(i, s, n, None) for i, (s, n) in enumerate(sizes.items())]
    for r in run(spark, rows):
        assert r.target == pytest.approx(targets(sizes)[r.source])
        assert r.target <= 3 * r.source_size


def test_odd_rows(spark):
    rows = [(1, "a", 0, None), (1, "a", 0, None), (None, "a", 5, None), (2, None, 0, None), (3, "b", 10**7, None)]
    found = run(spark, rows)
    assert len(found) == 5
    assert all(r.target == 0 and r.copies >= 0 for r in found if r.source is None)
    assert run(spark, []) == []
    assert [r.target for r in run(spark, [(1, None, 0, None)])] == [0.0]


def test_counting_words(spark):
    texts = [None, "", "  ", "a b", "x y z q", "\x0b\x0ca\x1cb\x85 c\n", "\U0001f600 " * 3]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    found = [r[0] for r in df.select(mixing.word_count(F.col("t"))).collect()]
    assert found == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def test_query(spark):
    from reviewloom.llm.queries import op3_subset_sum_mixing

    found = op3_subset_sum_mixing(spark, "/root/testdata/sf0.001").collect()
    sums = defaultdict(int)
    for r in found:
        sums[r.target, r.source_size] += r.taken
        assert r.taken <= 3 * r.size
    for (target, _), taken in sums.items():
        assert abs(taken - target) <= 0.02 * target + 1
