"""Stream counterparts of the batch operators.

Row-wise operators (filters, anti join with a static table, scoring) are the batch ones. The
stateful ones keep bounded or key-partitioned state.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructField, StructType

from ..operators.conform import with_id
from ..operators.dedup import dedup_keep_first, fetch_rows, require_columns
from ..operators.ranking import sample_hash
from ..operators.sampling import sample_per_key
from ..operators.selection import top_k_per_class
from ..runtime import compute_once, cut_lineage, scratch_path, stored_table
from ..sources.readers import list_names, path_exists, remove_path
from .sources import run_batches


def event_time(column: str) -> Column:
    """A timestamp that watermarks accept."""
    return F.col(column).cast("timestamp")


def dedup_within(
    stream: DataFrame, time: str, delay: str, key: str = "id", spread: str = "seq", salts: int = 16
) -> DataFrame:
    """Drop later copies of an id that arrive within ``delay``; state is bounded by it.

    Copies further apart than the delay may pass again, rows behind the watermark are dropped,
    and which copy of one micro-batch stays is not fixed (``first_by_id`` is exact).

    Spark sends all rows of a key to one task here, so copies are first dropped per key and
    salt (from the column ``spread``): a hot id then brings at most ``salts`` rows together.
    """
    timed = stream.withColumn(time, event_time(time)).withWatermark(time, delay)
    if salts > 1:
        salt = F.pmod(F.xxhash64(spread), F.lit(salts))
        timed = timed.withColumn("__salt", salt).dropDuplicatesWithinWatermark([key, "__salt"])
        timed = timed.drop("__salt")
    return timed.dropDuplicatesWithinWatermark([key])


def first_by_id(stream: DataFrame, seq: str = "seq", key: str = "id") -> DataFrame:
    """Running first arrival per id: exact, with state per distinct id.

    Copies are combined on the map side of every batch, so a hot id sends one row per task.
    """
    others = [c for c in stream.columns if c != key]
    row = F.min_by(F.struct(*others), F.col(seq)).alias("row")
    return stream.groupBy(key).agg(row).select(key, "row.*")


def run_first_by_id(
    stream: DataFrame,
    seq: str = "seq",
    key: str = "id",
    path: str | None = None,
    checkpoint: str | None = None,
) -> DataFrame:
    """Run ``first_by_id`` over what is there now and return one row per id.

    Every batch writes only the ids whose first arrival changed; the reader resolves them.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, "first")
    updates = first_by_id(stream, seq, key)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    run_batches(updates, write, "update", checkpoint)
    return dedup_keep_first(spark.read.schema(updates.schema).parquet(path), key, seq)


def first_numbers(stream: DataFrame, seq: str = "seq", key: str = "id") -> DataFrame:
    """Running first arrival number per id: exact, and the state of an id is that number alone."""
    return stream.groupBy(key).agg(F.min(seq).alias(seq))


def run_first_numbers(
    stream: DataFrame,
    seq: str = "seq",
    key: str = "id",
    rows: DataFrame | None = None,
    path: str | None = None,
    checkpoint: str | None = None,
) -> DataFrame:
    """Run ``first_numbers`` over what is there now: one row per id, with its first number.

    Late copies with a smaller number win as they would in a batch. With ``rows``, the stored
    table that the stream reads, the whole rows are fetched by these numbers; they never pass
    through the state.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, "numbers")
    updates = first_numbers(stream, seq, key)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    run_batches(updates, write, "update", checkpoint)
    changes = spark.read.schema(updates.schema).parquet(path)
    first = changes.groupBy(key).agg(F.min(seq).alias(seq))
    return first if rows is None else fetch_rows(rows, first, seq)


def running_counts(stream: DataFrame, *by: str | Column) -> DataFrame:
    """Rows seen so far per class, category or window."""
    return stream.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))


def daily_counts(stream: DataFrame, time: str, delay: str, *by: str) -> DataFrame:
    """Rows per day; a day is given out once the watermark has passed it."""
    timed = stream.withColumn(time, event_time(time)).withWatermark(time, delay)
    return running_counts(timed, F.window(time, "1 day").alias("day"), *by)


class VersionedTable:
    """A small result that every micro-batch replaces by a new version.

    Version ``n`` is computed from version ``n - 1`` and batch ``n``, so a batch that is run
    again after a failure writes the same version again.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or scratch_path(spark, "versions")

    def _folder(self, number: int) -> str:
        return f"{self.path}/version={number}"

    def read(self, number: int) -> DataFrame | None:
        folder = self._folder(number)
        return self.spark.read.parquet(folder) if path_exists(self.spark, folder) else None

    def write(self, df: DataFrame, number: int) -> None:
        """Write a version; the one before it stays for a batch that runs again, no others."""
        df.write.mode("overwrite").parquet(self._folder(number))
        for name in list_names(self.spark, self.path):
            if name.startswith("version=") and int(name.split("=")[1]) < number - 1:
                remove_path(self.spark, f"{self.path}/{name}")

    def latest(self) -> DataFrame:
        numbers = [int(name.split("=")[1]) for name in list_names(self.spark, self.path)
                   if name.startswith("version=")]
        if not numbers:
            raise ValueError("the stream has not produced a batch yet")
        return self.spark.read.parquet(self._folder(max(numbers)))


def run_complete(stream: DataFrame, checkpoint: str | None = None) -> DataFrame:
    """Run an aggregated stream over what is there now and return its final table."""
    table = VersionedTable(stream.sparkSession)
    run_batches(stream, table.write, "complete", checkpoint)
    return table.latest()


def run_selection(
    stream: DataFrame,
    pick: Callable[[DataFrame], DataFrame],
    table: VersionedTable | None = None,
    checkpoint: str | None = None,
    seconds: float | None = None,
    below: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Keep ``pick`` of everything seen: each batch picks from the last pick and its new rows.

    ``pick`` must be a selection that can be taken in steps, such as a top-k. Each version is
    a partial result that can be read while the stream runs. ``below(batch, last pick)`` may drop
    rows that cannot be picked any more.
    """
    table = table or VersionedTable(stream.sparkSession)

    def step(batch: DataFrame, number: int) -> None:
        before = table.read(number - 1) if number else None
        if before is not None:
            batch = below(batch, before) if below else batch
        rows = batch if before is None else before.unionByName(batch)
        table.write(pick(rows), number)

    run_batches(stream, step, "append", checkpoint, seconds)
    return table.latest()


#: Parts of a class whose heaps are kept apart, so that one class is not one task.
SALTS = 8


def bounded_heaps(
    scored: DataFrame,
    quotas: Sequence[int],
    score: str = "uncertainty",
    by: str = "pred_label",
    seq: str = "seq",
    salts: int = SALTS,
) -> DataFrame:
    """Best rows of each class and salt as keyed state: at most a class's quota in each of them.

    Gives out, after each batch, the whole heap of every key whose heap has changed:
    ``class, salt, kind, value, seq, row``. ``kind`` and ``value`` are the score (2 is NaN, which
    is above all, 0 is null), ``row`` holds the other columns as JSON. Rows that are not among
    the best of a full heap are refused by one comparison with its last row.
    """
    require_columns(scored, score, by, seq)
    if len(quotas) != 3:
        raise ValueError("quotas need one number for each of the three classes")
    wanted = [max(int(q), 0) for q in quotas]
    value = F.col(score).cast("double")
    others = [c for c in scored.columns if c not in (seq, score)]
    # A plain filter on the class would be pushed below the scorer, with many copies of it.
    classed = compute_once(scored, "__class", F.col(by).cast("int"))
    rows = classed.filter(F.col("__class").isin([i for i, q in enumerate(wanted) if q])).select(
        F.col("__class").alias("class"),
        F.pmod(F.xxhash64(seq), F.lit(salts)).cast("int").alias("salt"),
        F.when(F.isnan(value), 2).when(value.isNotNull(), 1).otherwise(0).alias("kind"),
        F.when(~F.isnan(value), value).otherwise(0.0).alias("value"),
        F.col(seq).alias("seq"),
        F.to_json(F.struct(*others)).alias("row"),
    )

    def step(
        key: tuple, frames: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        heap = json.loads(state.get[0]) if state.exists else []
        quota, before = wanted[key[0]], len(heap)
        changed = False
        for frame in frames:
            if len(heap) >= quota:
                kind, last = -heap[-1][0], -heap[-1][1]
                frame = frame[(frame["kind"] > kind) | ((frame["kind"] == kind) & (frame["value"] >= last))]
            new = zip(-frame["kind"], -frame["value"], frame["seq"], frame["row"])
            new = [[int(k), float(v), s.item() if isinstance(s, np.generic) else s, r] for k, v, s, r in new]
            if new:
                merged = sorted(heap + new, key=lambda r: r[:3])[:quota]
                changed |= merged != heap
                heap = merged
        if changed or len(heap) != before:
            state.update((json.dumps(heap),))
            columns = zip(*heap)
            kinds, values, numbers, texts = (list(x) for x in columns)
            yield pd.DataFrame(
                {"class": key[0], "salt": key[1], "kind": [-k for k in kinds],
                 "value": [-v for v in values], "seq": numbers, "row": texts}
            )

    return rows.groupBy("class", "salt").applyInPandasWithState(
        step, rows.schema, "heap string", "update", GroupStateTimeout.NoTimeout
    )


class HeapTable:
    """What ``bounded_heaps`` gave out, a folder per batch; a batch that runs again replaces its own.

    ``latest`` can be read while the stream runs: the newest heap of each key, or as of a batch.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or scratch_path(spark, "heaps")

    def write(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def latest(self, schema: StructType, until: int | None = None) -> DataFrame:
        typed = StructType([*schema.fields, StructField("batch", schema["kind"].dataType)])
        rows = self.spark.read.schema(typed).parquet(self.path)
        rows = rows if until is None else rows.filter(F.col("batch") <= until)
        newest = F.max("batch").over(Window.partitionBy("class", "salt"))
        return rows.withColumn("__newest", newest).filter("batch = __newest").drop("batch", "__newest")


def heap_rows(heaps: DataFrame, schema: StructType, score: str, seq: str = "seq") -> DataFrame:
    """Rows of the streamed table (of ``schema``) from heaps."""
    others = StructType([f for f in schema.fields if f.name not in (seq, score)])
    value = F.when(F.col("kind") == 2, F.lit(float("nan"))).when(F.col("kind") == 1, F.col("value"))
    rows = heaps.select("seq", value.alias("__score"), F.from_json("row", others).alias("row"))
    return rows.select(
        *[
            F.col("seq").alias(f.name) if f.name == seq
            else F.col("__score").cast(f.dataType).alias(f.name) if f.name == score
            else F.col(f"row.{f.name}")
            for f in schema.fields
        ]
    )


def run_top_k_per_class(
    scored: DataFrame,
    quotas: Sequence[int],
    score: str = "uncertainty",
    seq: str = "seq",
    by: str = "pred_label",
    salts: int = SALTS,
    table: HeapTable | None = None,
    checkpoint: str | None = None,
    seconds: float | None = None,
) -> DataFrame:
    """Most uncertain rows per predicted class of a scored stream.

    A first stage keeps heaps per class and salt in the state store (``bounded_heaps``), a second
    one merges their newest versions: at most quota times salts rows of each class. The few heaps
    are kept in as many partitions as there are salts.
    """
    table = table or HeapTable(scored.sparkSession)
    heaps = bounded_heaps(scored, quotas, score, by, seq, salts)
    run_batches(heaps, table.write, "update", checkpoint, seconds, partitions=salts)
    rows = heap_rows(table.latest(heaps.schema), scored.schema, score, seq)
    return top_k_per_class(rows, score, quotas, by, seq)


def run_sample_per_class(
    stream: DataFrame,
    k: int,
    seed: int,
    by: str = "label",
    key: Sequence[str] = ("id", "seq"),
    **run,
) -> DataFrame:
    """Uniform sample of at most ``k`` rows per class of a stream.

    The rows with the lowest seeded hashes, hence the same rows as the batch sample, in any order
    of arrival. The sample is the state; once a class is full its highest hash is a threshold
    that falls as rows arrive, and new rows above it go no further than the task that reads them.
    """

    def pick(rows: DataFrame) -> DataFrame:
        return sample_per_key(cut_lineage(rows), by, k, seed, key, rank="__rank").drop("__rank")

    def below(batch: DataFrame, before: DataFrame) -> DataFrame:
        full = before.withColumn("__hash", sample_hash(seed, *key)).groupBy(F.col(by).alias("__class"))
        full = full.agg(F.count(F.lit(1)).alias("__rows"), F.max("__hash").alias("__most"))
        full = stored_table(full.filter(F.col("__rows") >= k).drop("__rows"))
        marked = batch.join(full, batch[by].eqNullSafe(full["__class"]), "left")
        low = F.col("__most").isNull() | (sample_hash(seed, *key) <= F.col("__most"))
        return marked.filter(low).select(*[batch[c] for c in batch.columns])

    return run_selection(stream, pick, below=below, **run)


def seen_ids(stream: DataFrame) -> DataFrame:
    """Content IDs of a stream, for an append sink."""
    return with_id(stream).select("id")
