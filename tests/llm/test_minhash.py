import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewloom.llm import minhash
from reviewloom.llm.components import connected_components

DOCS = "doc_id BIGINT, text STRING, node STRING"


def components(n, edges):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def brute(rows, size):
    sets = [minhash.shingles(minhash.words_of(t), size) for _, t, *_ in rows]
    links = [
        (i, j)
        for i, a in enumerate(sets)
        for j, b in enumerate(sets[:i])
        if a and b and 100 * len(a & b) >= 80 * len(a | b)
    ]
    roots = components(len(rows), links)
    least = {}
    for (doc_id, *_), s, r in zip(rows, sets, roots):
        if doc_id is not None:
            least[r] = min(doc_id, least.get(r, doc_id))
    out = []
    for (doc_id, *_), s, r in zip(rows, sets, roots):
        out.append((doc_id, len(s), least.get(r), doc_id is not None and doc_id == least.get(r)))
    return sorted(out, key=str)


def found(spark, rows, size):
    df = minhash.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(3), size)
    return sorted((tuple(r)[1:] for r in df.collect()), key=str)


@pytest.mark.parametrize("edges", [
    [], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 200)], [(5, 5), (None, 2)],
    [(random.Random(i).randrange(300), random.Random(-i).randrange(300)) for i in range(200)]])
def test_components(spark, edges):
    df = connected_components(spark.createDataFrame(edges, "u BIGINT, v BIGINT"))
    rows = {r.node: r.component for r in df.collect()}
    proper = [(a, b) for a, b in edges if a is not None and a != b]
    roots = components(300, proper)
    assert rows == {x: roots[x] for e in proper for x in e}


@pytest.mark.parametrize("task_edges", [3, 50])
def test_components_of_more_edges_than_one_task_unites(spark, monkeypatch, task_edges):
    from reviewloom.llm import components as module

    monkeypatch.setattr(module, "TASK_EDGES", task_edges)
    rng = random.Random(task_edges)
    edges = [(i, i + 1) for i in range(70)] + [(100, i) for i in range(101, 140)]
    edges += [(rng.randrange(150, 300), rng.randrange(150, 300)) for _ in range(90)] + [(7, 7), (None, 3)]
    rows = connected_components(spark.createDataFrame(edges, "u BIGINT, v BIGINT").repartition(5)).collect()
    proper = [(a, b) for a, b in edges if a is not None and a != b]
    roots = components(300, proper)
    assert sorted(map(tuple, rows)) == sorted((x, roots[x]) for x in {x for e in proper for x in e})


def test_few_edges_are_united_without_a_shuffle(spark, plan_of):
    edges = [(i, i + 1) for i in range(60)] + [(5, 5), (None, 2)]
    plan = plan_of(connected_components(spark.createDataFrame(edges, "u BIGINT, v BIGINT").repartition(7)))
    assert "Exchange" not in plan


def edited(rng, words, share):
    return [rng.choice(VOCABULARY) if rng.random() < share else w for w in words]


VOCABULARY = [f"w{i}" for i in range(3000)]


@pytest.mark.parametrize("size", [2, 5])
def test_against_brute_force(spark, size):
    rng = random.Random(size)
    rows = []
    for family in range(6):
        base = rng.choices(VOCABULARY, k=rng.choice([60, 150]))
        for _ in range(40):
            share = rng.choice([0.0, 0.02, 0.04, 0.06]) * 2 / size
            rows.append((rng.randrange(10**6), " ".join(edited(rng, base, share)), "x"))
    rows += [(10**7 + i, " ".join(rng.choices(VOCABULARY, k=80)), None) for i in range(100)]
    assert found(spark, rows, size) == brute(rows, size)


def test_tiles_of_small_size(spark, monkeypatch):
    monkeypatch.setattr(minhash, "TILE_ROWS", 7)
    rng = random.Random(9)
    base = rng.choices(VOCABULARY, k=120)
    rows = [(i, " ".join(edited(rng, base, rng.choice([0.03, 0.05, 0.07]))), "x") for i in range(150)]
    assert found(spark, rows, 2) == brute(rows, 2)


@pytest.mark.parametrize("tile_bytes", [1 << 25, 1800])
def test_no_tile_holds_more_than_two_parts(spark, monkeypatch, tile_bytes):
    monkeypatch.setattr(minhash, "TILE_ROWS", 7)
    monkeypatch.setattr(minhash, "TILE_BYTES", tile_bytes)
    rng = random.Random(3)
    base = rng.choices(VOCABULARY, k=120)
    rows = [(i, " ".join(edited(rng, base, 0.07)), "x") for i in range(80)]  # alike, but for few no link
    rows += [(100 + i, " ".join(edited(rng, base, 0.01)), "x") for i in range(20)]
    tiles, largest = minhash._Linker.tiles, []

    def seen(self):
        made = tiles(self)
        sums = [F.count("*").alias("rows"), F.sum(F.length("text")).alias("bytes")]
        for keys in (["family", "tile", "main"], ["family", "tile"]):
            sizes = made.groupBy(*keys).agg(*sums).collect()
            largest.append((len(sizes), *(max(r[c] for r in sizes if "main" not in r or r.main or r.tile >= 0) for c in ("rows", "bytes"))))
        return made

    monkeypatch.setattr(minhash._Linker, "tiles", seen)
    assert found(spark, rows, 2) == brute(rows, 2)
    (_, part_rows, part_bytes), (n, both_rows, both_bytes) = largest
    most = tile_bytes + max(len(t) for _, t, _ in rows)
    assert n > 20 and part_rows <= 7 and part_bytes <= most
    assert both_rows <= 14 and both_bytes <= 2 * most


def test_buckets_of_two_are_compared_once(spark, monkeypatch):
    rng = random.Random(4)
    rows = []
    for i in range(0, 60, 2):
        base = rng.choices(VOCABULARY, k=120)
        rows += [(i, " ".join(base), "x"), (i + 1, " ".join(edited(rng, base, 0.09)), "x")]
    tiles, left = minhash._Linker.tiles, []
    monkeypatch.setattr(minhash._Linker, "tiles", lambda self: left.append(tiles(self).count()) or tiles(self))
    assert found(spark, rows, 2) == brute(rows, 2)
    assert left == [0]


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", None), (3, " \t ", None), (4, "One", None), (5, "one", None), (None, "ONE", None),
            (6, "a b", None), (6, "A  b", None), (6, "other text", None), (None, "alone here", None), (-7, "É é", None),
            (8, "é é", None), (9, "a\x1cb", None), (10, "long " * 50_000, None), (11, "long " * 3, None)]
    for size in (2, 5):
        assert found(spark, rows, size) == brute(rows, size)
    assert found(spark, [], 2) == []


def test_signature_agreement_follows_similarity():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64))
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 200).astype(np.uint64)])
    agree = (minhash.signature(a) == minhash.signature(np.unique(b))).mean()
    assert abs(agree - 800 / 1200) < 0.12


def test_query(spark):
    from reviewloom.llm.queries import op9_minhash_components

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    result = op9_minhash_components(spark, sf)
    assert sorted(map(tuple, result.collect()), key=str) == brute(rows, 2)
