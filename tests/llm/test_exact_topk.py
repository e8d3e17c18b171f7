import numpy as np
from pyspark.sql import functions as F

from reviewloom.llm import exact_topk
from reviewloom.llm.common import stored

VECTORS = "vec_id BIGINT, vector ARRAY<BIGINT>, score STRING"


def brute(rows, every, k):
    good = [(i, v) for i, v, *_ in rows if i is not None and v is not None and None not in v]
    out = []
    for q, a in good:
        if q % every == 0:
            sums = [(sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q]
            scores = sorted((-max(-(2**63), min(2**63 - 1, s)), i) for s, i in sums)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def check(spark, rows, k=5, every=10):
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    found = exact_topk.exact_top_k(df, F.col("vec_id") % every == 0, k)
    assert sorted(map(tuple, found.collect())) == brute(rows, every, k)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "SHARD_ROWS", 20)
    monkeypatch.setattr(exact_topk, "TILE_ROWS", 7)
    monkeypatch.setattr(exact_topk, "FAN", 3)
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-99, 99, 8).tolist(), "x") for i in range(300)]
    rows += [(300 + i, [1] * 8, "x") for i in range(150)]
    check(spark, rows)


def test_odd_rows(spark):
    rows = [(0, [1, 2], None), (10, [1, 2], None), (1, [3, None], None), (2, None, None), (None, [1, 1], None),
            (3, [-5, 0], None), (4, [0, 0], None)]
    check(spark, rows)
    check(spark, [(0, [1, 2], None)])
    check(spark, [])


def test_large_components(spark):
    rows = [(i, [(2**40) * (i - 4), 2**33 + i], None) for i in range(9)]
    check(spark, rows, k=3, every=2)


def test_repeated_ids_and_ties(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "SHARD_ROWS", 20)
    monkeypatch.setattr(exact_topk, "TILE_ROWS", 7)
    monkeypatch.setattr(exact_topk, "FAN", 3)
    monkeypatch.setattr(exact_topk, "HELD_ROWS", 30)
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-2, 2, 4).tolist(), "x") for i in range(200)]
    rows += [(10, rng.integers(-40000, 40000, 4).tolist(), "x") for _ in range(30)]
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    found = exact_topk.exact_top_k(df, F.col("vec_id") % 10 == 0, 4).collect()
    every = {q: [] for q in range(0, 200, 10)}
    for q, a, _ in rows:
        if q in every:
            scores = [(-sum(x * y for x, y in zip(a, b)), i) for i, b, _ in rows if i != q]
            every[q] += scores
    wanted = [(q, n + 1, i, -s) for q, x in every.items() for n, (s, i) in enumerate(sorted(x)[:4])]
    assert sorted(map(tuple, found)) == sorted(wanted)


def test_tiles_are_not_copied_to_shards(spark, monkeypatch, plan_of):
    monkeypatch.setattr(exact_topk, "SHARD_ROWS", 1)
    monkeypatch.setattr(exact_topk, "TILE_ROWS", 5)
    files = {}

    def noted(df, name):
        written = stored(df, name)
        files[name] = written.inputFiles()
        return written

    monkeypatch.setattr(exact_topk, "stored", noted)
    df = spark.createDataFrame([(i, [i % 7, 3], "x") for i in range(100)], VECTORS)
    found = exact_topk.exact_top_k(df, F.col("vec_id") % 10 == 0, 2)
    plan = plan_of(found)
    assert "CartesianProduct" in plan and "Broadcast" not in plan and "Generate" not in plan
    assert len(files["tiles"]) == 1 and len(files["shards"]) <= 4  # not one for each of 101 shards
