"""Anti join with a long list of ids behind a Bloom filter.

Most rows of a table are on no list. A filter built from the list says so of nearly all of them
before any shuffle; the few others, and the rows that are listed, go through the exact join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import stored_table
from .dedup import lookup_table, require_columns

#: Most bits of a filter: 16 MB, sent to every executor.
FILTER_BITS = 1 << 27
BITS_PER_ID = 16
#: Bits of one bucket of the filter; fixed by Spark's bitmap functions.
BUCKET_BITS = 1 << 15
PROBES = 4
#: Equal values of these types have equal hashes.
_HASHABLE = {"string", "bigint", "int", "smallint", "tinyint", "binary", "date"}


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets))


def _positions(key: str) -> list[Column]:
    """Bits of a key within its bucket: four runs of 15 bits of a second hash."""
    second = F.xxhash64(F.col(key), F.lit(1))
    return [
        F.shiftrightunsigned(second, 15 * i).bitwiseAND(F.lit(BUCKET_BITS - 1))
        for i in range(PROBES)
    ]


def id_filter(ids: DataFrame, key: str = "id", most_bits: int = FILTER_BITS) -> DataFrame:
    """``bucket, bits``: a Bloom filter of the ids, in at most ``most_bits`` / 32768 rows.

    All bits of an id lie in one bucket. Bitmaps are combined on the map side. Null ids are
    left out; a list without ids gives no rows.
    """
    named = ids.select(F.col(ids.columns[0]).alias(key)).filter(F.col(key).isNotNull())
    wanted = min(max(named.count() * BITS_PER_ID, 1), most_bits)
    buckets = max(1, min(-(-wanted // BUCKET_BITS), most_bits // BUCKET_BITS))
    placed = named.select(
        _bucket(key, buckets).alias("bucket"), F.explode(F.array(*_positions(key))).alias("bit")
    )
    bits = placed.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    return stored_table(bits.withColumn("buckets", F.lit(buckets)))


def maybe_listed(df: DataFrame, filtered: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with a flag ``name``: false for rows whose id is surely not in the filter.

    The filter is broadcast; its size is bounded by the bits it was built with.
    """
    one = filtered.select("buckets").first()
    if one is None:
        return df.withColumn(name, F.lit(False))
    small = filtered.select(F.col("bucket").alias("__bucket"), F.col("bits").alias("__bits"))
    bucketed = df.withColumn("__bucket", _bucket(key, one.buckets))
    found = F.col("__bits").isNotNull() & F.col(key).isNotNull()
    for bit in _positions(key):
        byte = F.substr("__bits", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))
        value = F.conv(F.hex(byte), 16, 10).cast("bigint")
        found = found & (F.getbit(value, bit.bitwiseAND(F.lit(7)).cast("int")) == 1)
    joined = bucketed.join(F.broadcast(small), "__bucket", "left")
    return joined.withColumn(name, F.coalesce(found, F.lit(False))).drop("__bucket", "__bits")


def anti_join_filtered(
    df: DataFrame, ids: DataFrame, key: str = "id", most_bits: int = FILTER_BITS
) -> DataFrame:
    """Rows of ``df`` whose id is not in ``ids`` (one column): the rows of a plain anti join.

    For lists too long to broadcast. The list is read twice before the join, ``df`` twice in it:
    once for the rows that the filter refuses, which move nowhere, and once for the rest.
    A list with more ids than the filter has room for only lets more rows through to the join.
    Null ids are never listed, so their rows stay, and so do repeated rows. Key types whose
    equal values may differ in their hash (such as doubles), or that differ between the two
    tables, take the plain join.
    """
    require_columns(df, key)
    listed = ids.select(F.col(ids.columns[0]).alias(key))
    kinds = {dict(df.dtypes)[key], dict(listed.dtypes)[key]}
    if len(kinds) > 1 or not kinds <= _HASHABLE:
        return df.join(listed, key, "left_anti")
    flag = "__maybe"
    rows = maybe_listed(df, id_filter(listed, key, most_bits), key, flag)
    clear = rows.filter(~F.col(flag)).drop(flag)
    rest = rows.filter(F.col(flag)).drop(flag)
    table = lookup_table(listed, key) if kinds <= {"string", "bigint"} else listed
    columns = df.columns
    return clear.select(*columns).unionByName(rest.join(table, key, "left_anti").select(*columns))
