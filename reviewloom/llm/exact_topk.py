"""Exact top-k search: tiled matrix products and a merging tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_of, shuffle_partitions, stored

#: Vectors of a shard, and queries of a tile: a product has 4,096 x 1,024 scores.
SHARD_ROWS = 4096
TILE_ROWS = 1024
#: Bytes of long components in a stored file of shards or tiles, unless one of them is larger.
FILE_BYTES = 1 << 23
#: Rows that a task holds of its tiles' best so far, besides those of one tile.
HELD_ROWS = 1 << 20
#: Lists that one merging step puts together.
FAN = 16


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not empty, all components finite."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return F.coalesce(finite & (F.size(vector) > 0), F.lit(False))


def _packed(vectors: np.ndarray) -> np.ndarray:
    """The same whole numbers in the least of two, four or eight bytes each."""
    low, high = int(vectors.min(initial=0)), int(vectors.max(initial=0))
    for kind in (np.int16, np.int32):
        if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max:
            return vectors.astype(kind)
    return vectors


def _tiles(df: DataFrame, rows: int, part: str, vector: str) -> DataFrame:
    """One row per tile: ``part, nth, ids, vectors, width``, at most ``rows`` vectors each.

    A partition's rows come in the order of ``part``; ``nth`` counts the tiles of a partition.
    ``vectors`` are ``width`` bytes a component.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, nth, ids, vectors = None, 0, [], []

        def tile():
            nonlocal nth
            nth += 1
            packed = _packed(np.concatenate(vectors))
            found = pa.record_batch(
                {
                    part: pa.array([number], pa.int32()),
                    "nth": pa.array([nth], pa.int32()),
                    "ids": pa.array([np.concatenate(ids)], pa.list_(pa.int64())),
                    "vectors": pa.array([packed.tobytes()], pa.binary()),
                    "width": pa.array([packed.itemsize], pa.int32()),
                }
            )
            ids.clear()
            vectors.clear()
            return found

        for batch in batches:
            numbers = batch[part].to_numpy()
            new_ids = batch["vec_id"].to_numpy()
            lengths = batch[vector].value_lengths().to_numpy()
            if (lengths != lengths[:1]).any():
                raise ValueError("the vectors differ in length")
            flat = batch[vector].flatten().to_numpy().reshape(len(numbers), lengths[:1].sum())
            begin = 0
            while begin < len(numbers):
                if ids and (number != numbers[begin] or sum(map(len, ids)) == rows):
                    yield tile()
                number = int(numbers[begin])
                end = begin + int(np.searchsorted(numbers[begin:], number, "right"))
                end = min(end, begin + rows - sum(map(len, ids)))
                ids.append(new_ids[begin:end])
                vectors.append(flat[begin:end])
                begin = end
        if ids:
            yield tile()

    return df.select(part, "vec_id", vector).mapInArrow(
        run, f"{part} int, nth int, ids array<bigint>, vectors binary, width int"
    )


def _first(k: int, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> tuple:
    """Of pairs of a query's place and a candidate, the best ``k`` of each place, in order."""
    order = np.lexsort((ids, ~scores, at))  # ~x falls as x rises and has no overflow
    at, ids, scores = at[order], ids[order], scores[order]
    nth = np.arange(len(at)) - np.searchsorted(at, at)
    return at[nth < k], ids[nth < k], scores[nth < k]


def _products(k: int):
    """Scores of each tile and shard, and of them each query's best ``k``.

    A task remembers the best so far of its tiles. Later shards are only searched for scores that
    reach a query's ``k``-th.
    """

    def largest(vectors):
        return max(int(vectors.max(initial=0)), -int(vectors.min(initial=0)))

    def wide(queries, query_ids, shard, ids):
        if largest(queries) * largest(shard) * queries.shape[1] < 2**63:
            scores = queries.astype(np.int64) @ shard.T.astype(np.int64)
        else:
            exact = queries.astype(object) @ shard.T.astype(object)
            scores = np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)
        for place, row in enumerate(scores):
            other = np.flatnonzero(ids != query_ids[place])
            yield _first(k, np.full(len(other), place), ids[other], row[other])

    def exact(kind, queries, query_ids, shard, ids, least):
        columns = shard.T.astype(kind)
        for begin in range(0, len(queries), 256):
            scores = queries[begin : begin + 256].astype(kind) @ columns
            own, bound = query_ids[begin : begin + 256], least[begin : begin + 256].copy()
            for place in np.flatnonzero(np.isin(own, ids)):
                scores[place, ids == own[place]] = -np.inf
            open_rows = np.flatnonzero(bound == -np.inf)
            if len(open_rows) and len(ids) > k:
                at = len(ids) - k
                bound[open_rows] = np.partition(scores[open_rows], at, axis=1)[:, at]
            reach = scores >= np.maximum(bound, np.finfo(kind).min).astype(kind)[:, None]
            places, columns_at = np.nonzero(reach)
            if len(places):
                found = scores[places, columns_at].astype(np.int64)
                yield _first(k, places + begin, ids[columns_at], found)

    def best(queries, query_ids, shard, ids, least):
        # Whole numbers below 2^24 are exact in floats and those below 2^53 in doubles, in any
        # order of summation.
        most = largest(queries) * largest(shard) * queries.shape[1]
        if most < 2**53:
            kind = np.float32 if most < 2**24 else np.float64
            return exact(kind, queries, query_ids, shard, ids, least)
        return wide(queries, query_ids, shard, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}
        group = None

        def rows_of(key):
            query_ids, at, ids, scores, _ = held.pop(key)
            return pa.record_batch(
                {
                    "query_id": pa.array(query_ids[at], pa.int64()),
                    "group": pa.array(np.full(len(at), group, np.int32)),
                    "vec_id": pa.array(ids, pa.int64()),
                    "score": pa.array(scores, pa.int64()),
                }
            )

        def matrix(batch, name, width, i, rows):
            kind = {2: np.int16, 4: np.int32, 8: np.int64}[batch[width][i].as_py()]
            return np.frombuffer(batch[name][i].as_buffer(), kind).reshape(rows, -1)

        for batch in batches:
            for i in range(batch.num_rows):
                group = batch["shard"][i].as_py() if group is None else group
                query_ids = batch["query_ids"][i].values.to_numpy()
                ids = batch["ids"][i].values.to_numpy()
                queries = matrix(batch, "queries", "query_width", i, len(query_ids))
                shard = matrix(batch, "vectors", "width", i, len(ids))
                key = batch["tile"][i].as_py(), batch["nth"][i].as_py()
                if key not in held:
                    none, least = np.zeros(0, np.int64), np.full(len(query_ids), -np.inf)
                    held[key] = query_ids.copy(), none, none, none, least
                own, *kept, least = held[key]
                found = [kept, *best(queries, own, shard, ids, least)]
                if len(found) > 1:
                    kept = _first(k, *map(np.concatenate, zip(*found)))
                    full = np.flatnonzero(np.bincount(kept[0], minlength=len(own)) == k)
                    least[full] = kept[2][np.searchsorted(kept[0], full, "right") - 1]
                    held[key] = own, *kept, least
                if sum(len(x[1]) for x in held.values()) > HELD_ROWS:
                    for old in list(held):
                        yield rows_of(old)
        for key in list(held):
            yield rows_of(key)

    return run


def merge_best(found: DataFrame, k: int, groups: int, order: list[Column]) -> DataFrame:
    """Merge the lists of a query, ``FAN`` groups at a time; adds ``rank`` from 1."""
    while True:
        groups = -(-groups // FAN)
        found = found.withColumn("group", F.floor(F.col("group") / FAN).cast("int"))
        rank = F.row_number().over(Window.partitionBy("query_id", "group").orderBy(*order))
        found = found.withColumn("rank", rank).filter(F.col("rank") <= k)
        if groups <= 1:
            return found.drop("group")
        found = found.drop("rank")


def exact_top_k(vectors: DataFrame, queries: Column, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products of each query.

    ``vectors`` has ``vec_id`` and ``vector`` (whole numbers, one length for all); ``queries``
    says which rows are queries. A row is no candidate for itself, nor are rows that share its
    vec_id. Ties go to the smaller vec_id; fewer candidates give fewer rows. Vectors that
    are null or have null components, and rows without vec_id, take no part. A score beyond a
    long is given as the nearest long.

    Shards hold the vectors by a hash of vec_id. Both they and the tiles of queries are stored, and
    a task reads a few files of either and multiplies each tile by each shard, so that no tile is
    shuffled to the shards and nothing is broadcast. A task holds its tiles and one shard at a time.
    """
    ok = F.col("vec_id").isNotNull() & F.coalesce(
        F.forall("vector", lambda x: x.isNotNull()), F.lit(False)
    )
    rows = stored(vectors.filter(ok).select("vec_id", "vector", queries.alias("asks")), "vectors")
    counts = rows.agg(
        F.count("*").alias("all"),
        F.sum(F.col("asks").cast("int")).alias("asks"),
        F.max(F.size("vector")).alias("components"),
    )
    n, asks, components = counts.first()
    shards = n // SHARD_ROWS + 1
    tiles = (asks or 0) // TILE_ROWS + 1
    wide = 8 * (components or 0)
    files = min(shards, max(shuffle_partitions(vectors.sparkSession), n * wide // FILE_BYTES + 1))
    tile_files = min(tiles, (asks or 0) * wide // FILE_BYTES + 1)

    def dealt(df, parts, files, name):
        numbered = df.withColumn(name, bucket_of(parts, F.lit(parts), "vec_id"))
        return numbered.repartition(files, name).sortWithinPartitions(name)

    shard_table = _tiles(dealt(rows, shards, files, "shard"), SHARD_ROWS, "shard", "vector")
    asked = dealt(rows.filter("asks"), tiles, tile_files, "tile")
    tile_table = _tiles(asked, TILE_ROWS, "tile", "vector")
    tile_table = stored(tile_table, "tiles").select(
        "tile",
        "nth",
        F.col("ids").alias("query_ids"),
        F.col("vectors").alias("queries"),
        F.col("width").alias("query_width"),
    )
    pairs = stored(shard_table.drop("nth"), "shards").crossJoin(tile_table.hint("shuffle_replicate_nl"))
    found = pairs.mapInArrow(
        _products(k), "query_id bigint, group int, vec_id bigint, score bigint"
    )
    order = [F.col("score").desc(), F.col("vec_id").asc()]
    return merge_best(found, k, shards, order).select("query_id", "rank", "vec_id", "score")
