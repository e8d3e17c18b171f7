"""Packing documents into windows of fixed length, by minimum bin slack."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, ranked, shuffle_partitions, slices, stored
from .subset_sum import best_fill
from .tokens import encoder, encoding, texts

#: Rows per bucket at which ranking takes more buckets.
BUCKET_ROWS = 100_000


def patterns(counts: dict[int, int], window: int) -> list[tuple[dict[int, int], int]]:
    """Minimum bin slack over a histogram: ``(lengths in a window, number of such windows)``.

    Each step puts the longest remaining length into a window, fills the rest by the multiset
    that leaves least slack and repeats that window while its lengths last. A step uses up at
    least one length, so there are at most ``window`` steps, however many rows there are.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    found = []
    while left:
        longest = max(left)
        rest = {**left, longest: left[longest] - 1}
        order = sorted((n for n in rest if n <= window - longest), reverse=True)
        taken = best_fill(order, rest, window - longest)
        taken[longest] = taken.get(longest, 0) + 1
        times = min(left[n] // k for n, k in taken.items())
        found.append((taken, times))
        for n, k in taken.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]
    return found


def _places(found: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows ``length, rank from, lengths of that kind in a window, first window, offset``."""
    rows, used, window = [], {}, 0
    for taken, times in found:
        offset = 0
        for n in sorted(taken, reverse=True):
            rows.append((n, used.get(n, 0), taken[n], window, offset))
            used[n] = used.get(n, 0) + times * taken[n]
            offset += n * taken[n]
        window += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _cut(width: str, window: int):
    size = int(width[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            totals = batch["n_tokens"].to_numpy()
            each = -(-totals // window)
            row = np.repeat(np.arange(len(totals)), each)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)) * window
            length = np.minimum(totals[row] - start, window)
            ids = [x.as_buffer() for x in batch["ids"]]
            cut = [ids[r][s * size : (s + n) * size] for r, s, n in zip(row, start, length)]
            yield pa.record_batch(
                {
                    "doc_id": batch["doc_id"].take(pa.array(row)),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int32()),
                    "doc_tokens": pa.array(totals[row], pa.int64()),
                    "ids": pa.array([bytes(x) for x in cut], pa.binary()),
                }
            )

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = 4096) -> DataFrame:
    """``doc_id, start, length, doc_tokens, ids, sequence_id, offset``: one row per piece.

    A text's ids (null: none) and ``end_id`` are cut into pieces of ``window`` ids and a rest;
    pieces are put together into sequences of at most ``window`` ids with the least slack, and
    follow each other in them without a gap. Repeated rows are packed each by itself, a null
    doc_id stays null, an empty table gives no rows. The same rows give the same sequences,
    however they are partitioned. ``ids`` are little-endian unsigned 32-bit integers.

    Only the histogram of lengths (at most ``window`` rows) reaches the driver, and only the
    list of patterns (at most 90 lengths for each of ``window`` steps) is sent to executors.
    """
    spark = docs.sparkSession
    width = encoder(tokenizer).width
    encode, cut = encoding(tokenizer, end_id), _cut(width, window)
    # One Python worker for each task, not one for the ids and another for the pieces.
    pieces = stored(
        texts(docs).mapInArrow(
            lambda batches: cut(encode(batches)),
            "doc_id bigint, start bigint, length int, doc_tokens bigint, ids binary",
        ),
        "pieces",
    )
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    places = spark.sparkContext.broadcast(_places(patterns(histogram, window)))
    total = sum(histogram.values())
    buckets = max(shuffle_partitions(spark), total // BUCKET_ROWS + 1)
    dealt = pieces.withColumn("bucket", bucket_of(buckets, "doc_id", "start"))
    order = [F.xxhash64("doc_id", "start"), "doc_id", "start", "doc_tokens", "ids"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = places.value
        key = rows[:, 0] << 48 | rows[:, 1]
        for batch in slices(batches):
            length = batch["length"].to_numpy().astype(np.int64)
            rank = batch["rank"].to_numpy()
            at = np.searchsorted(key, length << 48 | rank, side="right") - 1
            _, begin, per, first, offset = rows[at].T
            nth = rank - begin
            ids = [
                np.frombuffer(x.as_buffer(), width).astype("<u4").tobytes() for x in batch["ids"]
            ]
            yield pa.record_batch(
                {
                    "doc_id": batch["doc_id"],
                    "start": batch["start"],
                    "length": pa.array(length, pa.int64()),
                    "doc_tokens": batch["doc_tokens"],
                    "ids": pa.array(ids, pa.binary()),
                    "sequence_id": pa.array(first + nth // per, pa.int64()),
                    "offset": pa.array(offset + nth % per * length, pa.int64()),
                }
            )

    return ranked(dealt, ["length"], "bucket", order).mapInArrow(
        place,
        "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary,"
        " sequence_id bigint, offset bigint",
    )
