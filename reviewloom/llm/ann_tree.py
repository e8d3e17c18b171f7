"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .exact_topk import merge_best, usable

#: Vectors that the tree is fitted on; it has at most SAMPLE_ROWS / 16 leaves.
SAMPLE_ROWS = 1 << 16
BRANCHES = 16
#: Vectors that a leaf should have, as long as the sample allows so many leaves.
LEAF_ROWS = 256
#: Queries whose true neighbours say how many leaves to visit, and the recall to reach.
CALIBRATION_ROWS = 256
RECALL = 0.97
#: Vectors, and queries, that one task compares at a time.
BLOCK_ROWS = 1024


def kmeans(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """The cluster of each point, by Lloyd's rounds from different starting points."""
    starts = np.unique(points, axis=0)
    if len(starts) <= k:
        return np.unique(points, axis=0, return_inverse=True)[1].reshape(-1)
    centers = starts[np.sort(rng.choice(len(starts), k, replace=False))]
    for _ in range(rounds):
        near = ((centers**2).sum(1) - 2 * points @ centers.T).argmin(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, points)
        counts = np.bincount(near, minlength=k)
        centers = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)
    return near


class Tree:
    """Nodes with centers; a node without children is a leaf, and leaves are numbered."""

    def __init__(self, sample: np.ndarray, leaf_rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        width = sample.shape[1] if len(sample) else 0
        centers, children = [sample.mean(0) if len(sample) else np.zeros(width)], [[]]
        todo = [(0, np.arange(len(sample)))]
        while todo:
            node, rows = todo.pop()
            if len(rows) <= leaf_rows:
                continue
            near = kmeans(sample[rows], BRANCHES, rng)
            parts = [rows[near == i] for i in np.unique(near)]
            if len(parts) < 2:  # equal vectors stay in one leaf
                continue
            for part in parts:
                children[node].append(len(centers))
                todo.append((len(centers), part))
                centers.append(sample[part].mean(0))
                children.append([])
        self.centers, self.children = np.array(centers), children
        self.leaf = np.full(len(children), -1)
        ends = [i for i, c in enumerate(children) if not c]
        self.leaf[ends] = np.arange(len(ends))
        self.leaves = len(ends)

    def assign(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point: down the tree to the nearest child."""
        at = np.zeros(len(points), int)
        moving = np.arange(len(points))
        while len(moving):
            for node in np.unique(at[moving]):
                if self.children[node]:
                    rows = moving[at[moving] == node]
                    kids = np.array(self.children[node])
                    c = self.centers[kids]
                    at[rows] = kids[((c**2).sum(1) - 2 * points[rows] @ c.T).argmin(1)]
            moving = moving[self.leaf[at[moving]] < 0]
        return self.leaf[at]

    def nearest_first(self, query: np.ndarray) -> Iterator[int]:
        """Leaves in best-bin-first order: the queue holds the nodes beside the paths taken."""
        away = ((self.centers - query) ** 2).sum(1)
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            while self.children[node]:
                kids = sorted((away[kid], kid) for kid in self.children[node])
                for entry in kids[1:]:
                    heapq.heappush(queue, entry)
                node = kids[0][1]
            yield int(self.leaf[node])


def vectors_of(column: pa.Array) -> np.ndarray:
    """A batch's vectors, all of one length, as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def nearest(
    query: np.ndarray, query_id: int, vectors: np.ndarray, ids: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` nearest others by exact Euclidean distance, ties to the smaller id."""
    away = np.sqrt(((vectors - query) ** 2).sum(axis=1))
    away[ids == query_id] = np.inf
    near = np.flatnonzero(away <= np.partition(away, min(k, len(away)) - 1)[min(k, len(away)) - 1])
    near = near[np.isfinite(away[near])]
    near = near[np.lexsort((ids[near], away[near]))][:k]
    return ids[near], away[near]


_FOUND = "query_id bigint, group int, vec_id bigint, score double"


def _found(rows: list[tuple[int, int, np.ndarray, np.ndarray]], names: list[str]) -> dict:
    counts = [len(ids) for _, _, ids, _ in rows]
    return {
        names[0]: pa.array(np.repeat([q for q, *_ in rows], counts).astype(np.int64)),
        names[1]: pa.array(np.repeat([g for _, g, *_ in rows], counts).astype(np.int32)),
        names[2]: pa.array(np.concatenate([x[2] for x in rows] or [[]]).astype(np.int64)),
        names[3]: pa.array(np.concatenate([x[3] for x in rows] or [[]]).astype(np.float64)),
    }


def _true_leaves(rows: DataFrame, queries: np.ndarray, ids: np.ndarray, k: int) -> list[list[int]]:
    """The leaf of each true neighbour of a bounded number of queries, over all rows."""
    shared = rows.sparkSession.sparkContext.broadcast((queries, ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, ids = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, own = vectors_of(batch["vector"]), batch["vec_id"].to_numpy()
            leaf = dict(zip(own.tolist(), batch["leaf"].to_numpy().tolist()))
            best = [nearest(q, i, vectors, own, k) for q, i in zip(queries, ids)]
            out = _found([(i, 0, *x) for i, x in zip(ids, best)], ["query_id", "group", "vec_id", "score"])
            leaves = [leaf[i] for i in out["vec_id"].to_pylist()]
            yield pa.record_batch({**out, "leaf": pa.array(leaves, pa.int32())})

    found = rows.mapInArrow(run, _FOUND + ", leaf int")
    order = [F.col("score").asc(), F.col("vec_id").asc()]
    best = merge_best(found, k, 1, order).select("query_id", "leaf").collect()
    out: dict[int, list[int]] = {int(i): [] for i in ids}
    for r in best:
        out[r["query_id"]].append(r["leaf"])
    return [out[int(i)] for i in ids]


def visits_needed(tree: Tree, queries: np.ndarray, leaves: list[list[int]], recall: float) -> int:
    """How many leaves to visit: one more at a time until ``recall`` of the neighbours is met."""
    met = np.zeros(tree.leaves + 1)
    for query, wanted in zip(queries, leaves):
        order = {leaf: i for i, leaf in enumerate(tree.nearest_first(query))}
        for leaf in wanted:
            met[order[leaf] + 1] += 1
    total, share = met.sum(), np.cumsum(met)
    return int(np.argmax(share >= recall * total)) if total else 1


def nearest_neighbours(vectors: DataFrame, queries: Column, k: int, recall: float = RECALL) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest of each query, by Euclidean distance.

    ``vectors`` has ``vec_id`` and ``vector``; ``queries`` says which rows ask. A row is no
    candidate for itself, nor are rows that share its vec_id. Ties go to the smaller
    vec_id; fewer candidates give fewer rows. Vectors that are null, empty or zero or have null
    or non-finite components take no part, nor do rows without vec_id and vectors of another
    length than most have.

    The tree is fitted on at most ``SAMPLE_ROWS`` vectors; every row is in the index. The number
    of leaves to visit is calibrated on true neighbours over all rows. A query goes on until its
    leaves hold enough rows, so small leaves cost no results. Leaves are split into blocks, and
    a leaf's queries too, so that copies of one vector may be any share of the rows.
    """
    spark = vectors.sparkSession
    zero = F.forall("vector", lambda x: x == 0)
    ok = F.col("vec_id").isNotNull() & usable(F.col("vector")) & ~F.coalesce(zero, F.lit(True))
    rows = vectors.filter(ok).select(
        F.col("vec_id").cast("bigint"), "vector", queries.alias("asks"), F.size("vector").alias("width")
    )
    rows = stored(rows, "vectors")
    widths = rows.groupBy("width").count().orderBy(F.col("count").desc(), "width").first()
    rows = rows.filter(F.col("width") == (widths["width"] if widths else 0)).drop("width")
    n = widths["count"] if widths else 0

    part = F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(1 << 20))
    share = min(1.0, SAMPLE_ROWS / max(n, 1))
    taken = rows.filter(part < int(share * (1 << 20))).limit(SAMPLE_ROWS).select("vector").toArrow()
    sample = vectors_of(taken["vector"].combine_chunks()) if taken.num_rows else np.zeros((0, 0))
    tree = Tree(sample, max(16, int(LEAF_ROWS * share)))
    shared = spark.sparkContext.broadcast(tree)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {name: batch[name] for name in batch.schema.names}
            leaf = shared.value.assign(vectors_of(batch["vector"])) if batch.num_rows else []
            yield pa.record_batch({**columns, "leaf": pa.array(leaf, pa.int32())})

    schema = rows.withColumn("leaf", F.lit(0)).schema
    index = stored(rows.mapInArrow(assign, schema), "index")
    counts = np.zeros(tree.leaves, int)  # one number for each leaf
    for r in index.groupBy("leaf").count().collect():
        counts[r["leaf"]] = r["count"]

    asks = index.filter("asks")
    some = asks.orderBy(F.xxhash64(F.lit(5), "vec_id"), "vec_id").limit(CALIBRATION_ROWS)
    some = some.select("vec_id", "vector").toArrow()
    visits = 1
    if some.num_rows:
        points, ids = vectors_of(some["vector"].combine_chunks()), some["vec_id"].to_numpy()
        ids, first = np.unique(ids, return_index=True)
        points = points[first]
        visits = max(1, visits_needed(tree, points, _true_leaves(index, points, ids, k), recall))

    # Rows that a query's leaves have to hold: repeated rows of its own id do not count.
    least = 4 * (k + 1)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            found = []
            for query in vectors_of(batch["vector"]):
                own, held = [], 0
                for leaf in tree.nearest_first(query):
                    own.append(leaf)
                    held += counts[leaf]
                    if len(own) >= visits and held >= least:
                        break
                found.append(own)
            row = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            yield pa.record_batch(
                {
                    "query_id": batch["vec_id"].take(row),
                    "query": batch["vector"].take(row),
                    "leaf": pa.array(np.concatenate(found), pa.int32()),
                }
            )

    kind = dict(index.dtypes)["vector"]
    visited = stored(
        asks.dropDuplicates(["vec_id"]).select("vec_id", "vector").mapInArrow(
            visit, f"query_id bigint, query {kind}, leaf int"
        ),
        "visits",
    )
    sizes = index.groupBy("leaf").agg(F.count("*").alias("rows"))
    sizes = sizes.join(visited.groupBy("leaf").agg(F.count("*").alias("asked")), "leaf")
    sizes = stored(
        sizes.select(
            "leaf",
            (F.floor(F.col("rows") / BLOCK_ROWS) + 1).cast("int").alias("blocks"),
            (F.floor(F.col("asked") / BLOCK_ROWS) + 1).cast("int").alias("tiles"),
        ),
        "sizes",
    )
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    blocks = index.join(sizes, "leaf").select(
        "leaf",
        F.pmod(F.xxhash64("vec_id", "vector"), F.col("blocks")).cast("int").alias("block"),
        every("tiles").alias("tile"),
        "vec_id",
        "vector",
    )
    tiles = visited.join(sizes, "leaf").select(
        "leaf",
        every("blocks").alias("block"),
        F.pmod(F.xxhash64("query_id"), F.col("tiles")).cast("int").alias("tile"),
        "query_id",
        "query",
    )

    def compare(block: pa.Table, tile: pa.Table) -> pa.Table:
        rows = []
        if block.num_rows and tile.num_rows:
            vectors = vectors_of(block["vector"].combine_chunks())
            ids = block["vec_id"].to_numpy()
            group = block["block"][0].as_py()
            for query_id, query in zip(
                tile["query_id"].to_pylist(), vectors_of(tile["query"].combine_chunks())
            ):
                rows.append((query_id, group, *nearest(query, query_id, vectors, ids, k)))
        return pa.table(_found(rows, ["query_id", "group", "vec_id", "score"]))

    keys = ["leaf", "block", "tile"]
    found = blocks.groupBy(*keys).cogroup(tiles.groupBy(*keys)).applyInArrow(compare, _FOUND)
    most = int(counts.max(initial=0)) // BLOCK_ROWS + 1
    order = [F.col("score").asc(), F.col("vec_id").asc()]
    return merge_best(found, k, most, order).select("query_id", "rank", "vec_id", "score")
