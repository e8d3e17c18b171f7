"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import stored


def _pairs(df: DataFrame, u, v) -> DataFrame:
    """Distinct edges with the larger node first; loops go."""
    return (
        df.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u <> v").distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest node around it."""
    both = edges.union(edges.select("v", "u"))
    smallest = both.groupBy("u").agg(F.min("v").alias("m"))
    smallest = smallest.select("u", F.least("u", "m").alias("m"))
    return _pairs(both.filter("v > u").join(smallest, "u"), F.col("v"), F.col("m"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them."""
    smallest = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(smallest, "u").filter("v <> m").select("v", "m")
    return _pairs(moved.union(smallest.select("u", "m")), F.col("v"), F.col("m"))


#: Edges that one task unites by itself; more are dealt over tasks and united in rounds.
TASK_EDGES = 1 << 18


def _unite(edges: int, roots: bool):
    """Stars in place of a task's edges, ``edges`` of them at a time; ``roots`` adds their centres."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(node: int) -> int:
            while (above := parent.get(node, node)) != node:
                parent[node] = node = parent.get(above, above)
            return node

        def stars() -> pa.RecordBatch:
            found = {node: root(node) for node in list(parent)}
            if roots:
                found |= {centre: centre for centre in found.values()}
            ends = (list(found), list(found.values()))
            return pa.record_batch([pa.array(x, pa.int64()) for x in ends], ["u", "v"])

        for batch in batches:
            for u, v in zip(batch["u"].to_pylist(), batch["v"].to_pylist()):
                one, other = root(u), root(v)
                if one != other:
                    parent[max(one, other)] = min(one, other)
                if len(parent) >= edges and not roots:
                    yield stars()
                    parent.clear()
        yield stars()

    return run


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of the edges ``u, v``; component is the smallest node.

    Null ends and loops are left out; no edges give no rows. Up to ``TASK_EDGES`` edges are
    united by one task, without a shuffle. More are dealt over tasks that unite as many at a
    time, and rounds join what these leave. Each round is a few joins on nodes and is written
    to the shared folder; a node with very many neighbours is reduced to a minimum before its
    join, and its join can be split. Rounds end when a round changes nothing, after about the
    logarithm of the longest path.
    """
    seen = Observation()
    ends = edges.dropna(subset=["u", "v"]).select(
        F.greatest("u", "v").cast("bigint").alias("u"), F.least("u", "v").cast("bigint").alias("v")
    )
    ends = ends.filter("u <> v").observe(seen, F.count(F.lit(1)).alias("n"))
    now = stored(ends, "edges")
    tasks = max(1, -(-seen.get["n"] // TASK_EDGES))
    alone = tasks == 1
    now = now.coalesce(tasks).mapInArrow(_unite(TASK_EDGES, alone), "u bigint, v bigint")
    if alone:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    mark = None
    while True:
        seen = Observation()
        # The figures that tell whether a round changed anything come with its write.
        digest = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("digest")
        now = stored(now.observe(seen, F.count(F.lit(1)).alias("n"), digest), "stars")
        if seen.get == mark or not seen.get["n"]:
            break
        mark = seen.get
        now = _small_star(_large_star(now))
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(now.select("v", "v").distinct())
