"""Helpers that the operators share: stored tables, word splitting, global numbering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..runtime import scratch_path, small_batches

#: What separates words in every contract: the space and the code points 9 to 13. The split
#: of Python's ``bytes`` uses exactly these, so ``text.encode().split()`` gives the words.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the cluster's shared folder and go on from the written table.

    The table cuts the lineage: a lost executor costs the tasks it ran, not the steps before.
    """
    small_batches(df.sparkSession)
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of Arrow data that ``slices`` hands out at once, unless one row is larger.
SLICE_BYTES = 1 << 22


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Parts of Arrow batches, so that Python objects exist for a few rows at a time.

    A part has at most ``rows`` rows, and at most ``SLICE_BYTES`` bytes or one row.
    """
    for batch in batches:
        begin = 0
        while begin < batch.num_rows:
            part = batch.slice(begin, rows)
            while part.num_rows > 1 and part.nbytes > SLICE_BYTES:
                part = part.slice(0, part.num_rows // 2)
            yield part
            begin += part.num_rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_of(buckets: int, *columns: str | Column) -> Column:
    """An even and repeatable bucket number, also where one key holds many rows."""
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


def global_index(df: DataFrame, order: Column, partitions: int, name: str) -> DataFrame:
    """Number the rows 0, 1, 2 ... in ``order`` without bringing them into one task.

    Rows are dealt by range and numbered within their range; only the number of rows of each
    range is added up over all of them.
    """
    schema = StructType(
        [*df.schema.fields, StructField("_part", IntegerType()), StructField("_at", LongType())]
    )

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            columns = {name: batch[name] for name in batch.schema.names}
            columns["_part"] = pa.array(np.full(n, part, np.int32))
            columns["_at"] = pa.array(np.arange(at, at + n, dtype=np.int64))
            yield pa.record_batch(columns)
            at += n

    dealt = df.repartitionByRange(partitions, order).sortWithinPartitions(order)
    numbered = stored(dealt.mapInArrow(number, schema), "numbered")
    base = running_base(numbered.groupBy("_part").agg(F.count("*").alias("_n")), "_part", "_n")
    return (
        numbered.join(base, "_part")
        .withColumn(name, F.col("base") + F.col("_at"))
        .drop("_part", "_at", "base")
    )


def running_base(totals: DataFrame, key: str, amount: str) -> DataFrame:
    """``key, base``: the sum of ``amount`` over all smaller keys.

    ``totals`` has one row per partition of a dealt table, never one per row of it.
    """
    before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(key, F.coalesce(F.sum(amount).over(before), F.lit(0)).alias("base"))


def ranked(df: DataFrame, keys: list[str], bucket: str, order: list[str | Column]) -> DataFrame:
    """Add ``rank`` (from 0) within ``keys``, without bringing a key's rows together.

    Rows of a key are spread over buckets; a row's rank is the number of rows in the buckets
    before its own, and its place in its own. A key with a third of all rows is ranked by as
    many tasks as there are buckets.
    """
    own = [*keys, bucket]
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*own).agg(F.count("*").alias("_n"))
    base = counts.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(own)],
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"),
    )
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(own)]
    condition = same[0]
    for one in same[1:]:
        condition = condition & one
    place = F.row_number().over(Window.partitionBy(*own).orderBy(*order))
    return (
        df.withColumn("_place", place)
        .join(base, condition)
        .withColumn("rank", F.col("_base") + F.col("_place") - 1)
        .drop("_place", "_base", *[f"_k{i}" for i in range(len(own))])
    )
