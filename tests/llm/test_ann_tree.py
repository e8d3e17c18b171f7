import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewloom.llm import ann_tree

VECTORS = "vec_id BIGINT, vector ARRAY<FLOAT>, leaf STRING"


def brute(rows, every, k):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in rows
            if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, a in good:
        if q % every == 0:
            near = sorted((math.sqrt(((a - b) ** 2).sum()), i) for i, b in good if i != q)[:k]
            out[q] = [(n + 1, i, d) for n, (d, i) in enumerate(near)]
    return out


def search(spark, rows, every=10, k=5, **more):
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    out = {}
    for r in ann_tree.nearest_neighbours(df, F.col("vec_id") % every == 0, k, **more).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(x) for q, x in out.items()}


def clusters(n, seed=1, width=16):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, width))
    return [(i, (centers[i % 12] + 0.4 * rng.normal(size=width)).tolist(), "x") for i in range(n)]


def test_recall(spark):
    rows = clusters(3000)
    found, wanted = search(spark, rows), brute(rows, 10, 5)
    assert found.keys() == wanted.keys()
    hits = sum(len({i for _, i, _ in found[q]} & {i for _, i, _ in wanted[q]}) for q in wanted)
    assert hits >= 0.9 * sum(map(len, wanted.values()))
    by_id = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows}
    for q, near in found.items():
        assert [n for n, *_ in near] == [1, 2, 3, 4, 5]
        assert near == sorted(near, key=lambda x: (x[2], x[1]))
        for _, i, score in near:
            assert score == pytest.approx(math.sqrt(((by_id[q] - by_id[i]) ** 2).sum()), rel=1e-12)


def test_all_leaves_are_exact(spark, monkeypatch):
    monkeypatch.setattr(ann_tree, "BLOCK_ROWS", 50)
    rows = clusters(700) + [(700 + i, [1.0] * 16, "x") for i in range(400)]
    assert search(spark, rows, recall=1.0).keys() == brute(rows, 10, 5).keys()
    found, wanted = search(spark, rows, every=7, recall=1.0), brute(rows, 7, 5)
    same = sum([x[1] for x in found[q]] == [x[1] for x in wanted[q]] for q in wanted)
    assert same >= 0.97 * len(wanted)
    assert all([x[:2] for x in found[q]] == [x[:2] for x in wanted[q]] for q in wanted if q >= 700)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], None), (10, [1.0, 0.0], None), (1, [0.0, 0.0], None), (2, None, None), (3, [], None), (4, [nan, 1.0], None),
            (5, [inf, 1.0], None), (6, [None, 1.0], None), (None, [1.0, 1.0], None), (7, [3.0, 0.0], None), (8, [1.0] * 3, None), (20, [2.0, 0.0], None)]
    wanted = brute([r for r in rows if r[0] != 8], 10, 5)
    assert search(spark, rows) == wanted
    assert search(spark, []) == {}
    assert search(spark, [(0, [1.0, 2.0], None)]) == {}


def test_best_bin_first_visits_every_leaf_once():
    sample = np.random.default_rng(3).normal(size=(2000, 8))
    tree = ann_tree.Tree(sample, 40)
    order = list(tree.nearest_first(sample[5]))
    assert sorted(order) == list(range(tree.leaves)) and tree.leaves > 40
    assert order[0] == tree.assign(sample[5:6])[0]


def test_query(spark):
    from reviewloom.llm.queries import op4_kmeans_tree_neighbours

    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, None) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    wanted, found = brute(rows, 100, 10), op4_kmeans_tree_neighbours(spark, sf).collect()
    truth = {(q, i) for q, near in wanted.items() for _, i, _ in near}
    assert len(found) == len(truth) and len(truth & {(r.query_id, r.vec_id) for r in found}) >= 0.9 * len(truth)
