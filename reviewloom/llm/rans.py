"""Token ids in a compressed binary file: static range asymmetric numeral system (rANS).

File format, version 1. An archive is a folder with two Parquet tables.

``table``: one row per id that occurs: ``id, frequency``. Frequencies add up to 2^20. All
blocks share this table.

``blocks``: one row per block, in files that follow the order of doc_id.

| column | content |
|---|---|
| shard, block | the block's place: shards in ascending doc_id order, blocks within a shard |
| first_token | ids of the shard before this block |
| doc_ids, lengths | the documents of the block, and how many ids each has |
| payload | the coded ids, below |
| crc32 | checksum of the payload |

A payload codes ids in rows of ``lanes``: lane i of row r holds id r x lanes + i. Each lane has
its own 64-bit state in [2^31, 2^63) and all lanes share one stream of 32-bit words, in the
order in which a decoder takes them. Every ``every`` rows there is a checkpoint: all states and
the place in the stream, so parts of a block decode at the same time, and blocks decode
independently. All integers are little-endian: ``b"RNS1"``, ids u64, lanes u32, every u32,
checkpoints u32, words u64, then the checkpoints' word places (u64), their states (u64) and the
words (u32).

Reading checks every block's checksum and count and fails on a damaged one.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import running_base, shuffle_partitions, slices, stored
from .tokens import encoder, tokenize

SCALE_BITS = 20
LOW = np.uint64(1 << 31)
LANES = 256
#: Rows between checkpoints: 65,536 ids.
EVERY = 256
#: Ids after which a block is closed; a longer document has a block to itself.
BLOCK_IDS = 1 << 18
#: Ids after which a further shard is worthwhile.
SHARD_IDS = 1 << 23
_HEAD = struct.Struct("<4sQIIIQ")


def scaled(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Frequencies that add up to 2^20, at least 1 for each id; ids are in ascending order."""
    total = 1 << SCALE_BITS
    if not len(ids):
        return np.zeros(0, np.int64)
    if len(ids) > total:
        raise ValueError(f"more than {total} different ids")
    spare = total - len(ids)
    exact = counts.astype(float) / counts.sum() * spare
    extra = np.floor(exact).astype(np.int64)
    left = int(spare - extra.sum())
    extra[np.argsort(extra - exact, kind="stable")[:left]] += 1
    return extra + 1


class Table:
    """Coding table: frequency and start of each id, and the id of each of the 2^20 slots."""

    def __init__(self, ids, frequencies):
        ids = np.asarray(ids, np.int64)
        size = int(ids.max()) + 1 if len(ids) else 0
        self.frequency = np.zeros(size, np.uint64)
        self.frequency[ids] = frequencies
        self.start = np.cumsum(self.frequency, dtype=np.uint64) - self.frequency
        self.slots = np.repeat(np.arange(size, dtype=np.uint32), self.frequency.astype(np.int64))


def encode_block(ids: np.ndarray, table: Table, lanes: int = LANES, every: int = EVERY) -> bytes:
    """The payload of one block."""
    n = len(ids)
    rows = -(-n // lanes)
    state = np.full(lanes, LOW)
    places, states, words = [], [], []
    bits, half = np.uint64(SCALE_BITS), np.uint64(32)
    frequency, start = table.frequency[ids], table.start[ids]
    limit = frequency << np.uint64(63 - SCALE_BITS)
    for row in range(rows - 1, -1, -1):
        at = slice(row * lanes, min(n, row * lanes + lanes))
        f, now = frequency[at], state[: at.stop - at.start]
        full = now >= limit[at]
        words.append(now[full].astype("<u4"))
        now = np.where(full, now >> half, now)
        quotient = now // f
        state[: at.stop - at.start] = (quotient << bits) + (now - quotient * f) + start[at]
        if row % every == 0:
            states.append(state.copy())
            places.append(len(words))
    sizes = np.array([len(x) for x in words], np.int64)
    before = int(sizes.sum()) - np.cumsum(sizes) if len(sizes) else sizes
    offsets = np.array([before[p - 1] for p in places][::-1], "<u8")
    stream = b"".join(x.tobytes() for x in reversed(words))
    head = _HEAD.pack(b"RNS1", n, lanes, every, len(places), len(stream) // 4)
    return b"".join(
        [head, offsets.tobytes(), *(s.astype("<u8").tobytes() for s in reversed(states)), stream]
    )


def decode_block(payload: bytes, table: Table) -> np.ndarray:
    """The ids of one block; all parts between checkpoints are decoded in step."""
    magic, n, lanes, every, parts, words = _HEAD.unpack_from(payload)
    if magic != b"RNS1":
        raise ValueError("not a block of this format")
    at = _HEAD.size
    place = np.frombuffer(payload, "<u8", parts, at).astype(np.int64)
    at += 8 * parts
    state = np.frombuffer(payload, "<u8", parts * lanes, at).reshape(parts, lanes).copy()
    at += 8 * parts * lanes
    stream = np.append(np.frombuffer(payload, "<u4", words, at).astype(np.uint64), np.uint64(0))
    out = np.zeros((parts, every, lanes), np.uint32)
    bits, half = np.uint64(SCALE_BITS), np.uint64(32)
    low_bits = np.uint64((1 << SCALE_BITS) - 1)
    first = np.arange(parts)[:, None] * (every * lanes) + np.arange(lanes)
    for row in range(min(every, -(-n // lanes))):
        slot = state & low_bits
        ids = table.slots[slot]
        out[:, row] = ids
        after = table.frequency[ids] * (state >> bits) + slot - table.start[ids]
        live = first + row * lanes < n
        empty = live & (after < LOW)
        taken = np.cumsum(empty, axis=1)
        word = stream[np.where(empty, place[:, None] + taken - 1, words)]
        state = np.where(live, np.where(empty, (after << half) | word, after), state)
        place = place + taken[:, -1]
    return out.reshape(-1)[:n]


_BLOCKS = (
    "shard int, block int, first_token bigint, doc_ids array<bigint>, lengths array<bigint>,"
    " payload binary, crc32 bigint"
)


def _counts(width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in slices(batches):
            ids = [np.frombuffer(x.as_buffer(), width) for x in batch["ids"]]
            found = np.bincount(np.concatenate(ids))
            if len(found) > len(total):
                found[: len(total)] += total
                total = found
            else:
                total[: len(found)] += found
        seen = np.flatnonzero(total)
        yield pa.record_batch({"id": pa.array(seen), "n": pa.array(total[seen])})

    return run


def _blocks(width: str, table: Table):
    def close(shard: int, block: int, first: int, docs: list) -> pa.RecordBatch:
        payload = encode_block(np.concatenate([ids for _, ids in docs]), table)
        numbers = pa.list_(pa.int64())
        return pa.record_batch(
            {
                "shard": pa.array([shard], pa.int32()),
                "block": pa.array([block], pa.int32()),
                "first_token": pa.array([first], pa.int64()),
                "doc_ids": pa.array([[doc_id for doc_id, _ in docs]], numbers),
                "lengths": pa.array([[len(ids) for _, ids in docs]], numbers),
                "payload": pa.array([payload], pa.binary()),
                "crc32": pa.array([zlib.crc32(payload)], pa.int64()),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        docs: list = []
        size = 0
        for batch in batches:
            for doc_id, raw in zip(batch["doc_id"].to_pylist(), batch["ids"]):
                ids = np.frombuffer(raw.as_py(), width)
                if docs and size + len(ids) > BLOCK_IDS:
                    yield close(shard, block, first, docs)
                    block, first, docs, size = block + 1, first + size, [], 0
                docs.append((doc_id, ids))
                size += len(ids)
        if docs:
            yield close(shard, block, first, docs)

    return run


def write_archive(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode the texts of ``doc_id, text`` and write them to ``path`` in doc_id order.

    A null text has only the end id; a null doc_id comes first; rows that share a doc_id follow
    each other in the order of their ids. An empty table gives an archive without blocks.
    Memory: a block, or one document if that is longer, and the tables (at most one entry per
    id of the vocabulary, 2^20 at most).
    """
    spark = docs.sparkSession
    width = encoder(tokenizer).width
    tokens = stored(tokenize(docs, tokenizer, end_id), "tokens")
    counts = tokens.select("ids").mapInArrow(_counts(width), "id bigint, n bigint")
    # One row per id of the vocabulary, whatever the size of the input.
    found = counts.groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").toPandas()
    frequencies = scaled(found["id"].to_numpy(), found["n"].to_numpy())
    rows = [(int(i), int(f)) for i, f in zip(found["id"], frequencies)]
    spark.createDataFrame(rows, "id bigint, frequency bigint").coalesce(1).write.parquet(
        f"{path}/table"
    )
    shards = max(shuffle_partitions(spark), int(found["n"].sum()) // SHARD_IDS + 1)
    dealt = tokens.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "ids")
    blocks = dealt.select("doc_id", "ids").mapInArrow(
        _blocks(width, Table(found["id"], frequencies)), _BLOCKS
    )
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids``: every document of an archive.

    ``start`` is the number of ids of all documents before it; ``ids`` are little-endian
    unsigned 32-bit integers.
    """
    rows = spark.read.schema("id bigint, frequency bigint").parquet(f"{path}/table").collect()
    table = Table([r.id for r in rows], [r.frequency for r in rows])
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    sizes = blocks.select(
        "shard", F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n")
    )
    base = running_base(sizes.groupBy("shard").agg(F.sum("n").alias("n")), "shard", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                name = f"block {row['shard']}/{row['block']}"
                lengths = np.array(row["lengths"], np.int64)
                if zlib.crc32(row["payload"]) != row["crc32"]:
                    raise ValueError(f"{name}: wrong checksum")
                ids = decode_block(row["payload"], table).astype("<u4", copy=False)
                if len(ids) != lengths.sum():
                    raise ValueError(f"{name}: wrong number of ids")
                ends = np.cumsum(lengths)
                yield pa.record_batch(
                    {
                        "doc_id": pa.array(row["doc_ids"], pa.int64()),
                        "start": pa.array(row["base"] + row["first_token"] + ends - lengths),
                        "n_tokens": pa.array(lengths),
                        "ids": pa.array(
                            [ids[e - n : e].tobytes() for e, n in zip(ends, lengths)], pa.binary()
                        ),
                    }
                )

    # One row per shard: broadcast, since a shuffled join would write all payloads once more.
    return blocks.join(F.broadcast(base), "shard").mapInArrow(
        run, "doc_id bigint, start bigint, n_tokens bigint, ids binary"
    )
