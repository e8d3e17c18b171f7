"""Shards that all hold the same mixture: proportional stratified interleaving.

The rows of each source are put into a seeded random order. A row's fractional rank is its place
there, as a share of its source; sorted by it, every stretch of the table holds each source in
its overall proportion. The sorted table is cut into shards whose row counts differ by one at
most, so that a shard has its share of every source, up to a row at either end.

Neither step brings a source together: places are counted over random buckets of a source, and
the sorted table is dealt by ranges whose borders Spark samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import global_index, ranked, shuffle_partitions, stored

#: Hexadecimal digits of the shuffle hash that choose a bucket.
BUCKET_DIGITS = 3


def shuffle_hash(seed: int, *keys: Column | str) -> Column:
    """Seeded hash of a row's keys, as text; null keys are empty."""
    columns = [F.col(k) if isinstance(k, str) else k for k in keys]
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    return F.md5(F.concat_ws(":", *parts, F.lit(str(seed))).cast("binary"))


def deal(rows: DataFrame, shards: int, seed: int, key: list[str], source: str = "source") -> DataFrame:
    """``rows`` with ``shard`` (from 0), ``slot`` (gapless from 0 in each shard) and ``place``.

    ``place`` is the row's number in the whole interleaved table; shard i holds the places from
    i * n / shards on, so row counts differ by one at most, and some shards are empty if there
    are fewer rows than shards. ``key`` are the columns that seed a row's hash. A null source
    is a source of its own. Rows that agree in all keys follow each other in any order, so the
    keys should tell rows apart unless these are equal. An empty table gives no rows. Columns
    of ``rows`` with the names of the three new ones are replaced. All columns are moved: pass
    narrow rows where that is enough.
    """
    names = [f"c{i}" for i in range(len(rows.columns))]
    at = {c: names[i] for i, c in enumerate(rows.columns)}
    plain = rows.toDF(*names).withColumn("_hash", shuffle_hash(seed, *[at[k] for k in key]))
    plain = plain.withColumn("_source", F.col(at[source]))
    # Hexadecimal digits sort as numbers do, so buckets of leading digits are in hash order.
    plain = stored(plain.withColumn("_bucket", F.substring("_hash", 1, BUCKET_DIGITS)), "hashed")
    sizes = plain.groupBy(F.col("_source").alias("_of")).agg(F.count("*").alias("_rows"))
    tie = [at[k] for k in key]
    placed = ranked(plain, ["_source"], "_bucket", ["_hash", *tie])
    placed = placed.join(stored(sizes, "sources"), F.col("_source").eqNullSafe(F.col("_of")))
    fraction = (2 * F.col("rank") + 1) / (2 * F.col("_rows"))
    order = F.struct(fraction.alias("fraction"), "_source", "_hash", *tie)
    placed = placed.withColumn("_order", order).drop("_bucket", "rank", "_of", "_rows", "_source")
    spark = rows.sparkSession
    numbered = global_index(placed, F.col("_order"), shuffle_partitions(spark), "_place")
    total = numbered.count()
    cut = numbered.withColumn("_shard", F.expr(f"int(_place * {shards}L div {max(total, 1)}L)"))
    first = F.expr(f"(_shard * {max(total, 1)}L + {shards - 1}L) div {shards}L")
    kept = [F.col(at[c]).alias(c) for c in rows.columns if c not in ("shard", "slot", "place")]
    return cut.select(
        *kept,
        F.col("_shard").alias("shard"),
        (F.col("_place") - first).alias("slot"),
        F.col("_place").alias("place"),
    )


def write_shards(docs: DataFrame, path: str, shards: int, seed: int) -> None:
    """Write ``docs`` as one folder ``shard=i`` for each shard, rows in the order of their slots.

    A shard is written by several tasks where it has many rows: its files are stretches of slots,
    named in their order.
    """
    dealt = deal(docs, shards, seed, ["doc_id", "text"])
    parts = max(shards, shuffle_partitions(docs.sparkSession))
    ordered = dealt.repartitionByRange(parts, "shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.drop("place").write.partitionBy("shard").parquet(path)
