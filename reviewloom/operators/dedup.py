"""Keep the first arrival of each content ID, and fetch full rows by arrival number."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import stored_table


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"the table lacks the columns {missing}")


def lookup_table(df: DataFrame, key: str) -> DataFrame:
    """``df`` for the small side of a join on ``key`` with rows that may be skewed.

    A table that was aggregated by the key would be joined in that partitioning, without a
    shuffle of its own, and adaptive execution could then not split a hot key of the other
    side. A key that is computed anew gives it its own (narrow) shuffle; when it is small
    enough to broadcast nothing changes.
    """
    text = dict(df.dtypes)[key] == "string"
    anew = F.concat(F.col(key), F.lit("")) if text else F.col(key) + F.lit(0)
    return df.withColumn(key, anew)


def dedup_keep_first(df: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """Whole rows, first arrival per key.

    Spark reduces each key to one row per map task before the shuffle, so a key that
    holds a large share of the table does not overload its reduce task.
    """
    require_columns(df, key, seq)
    first = Window.partitionBy(key).orderBy(seq)
    return df.withColumn("__nth", F.row_number().over(first)).filter("__nth = 1").drop("__nth")


def drop_later_copies(df: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """Like ``dedup_keep_first`` for a unique arrival number, without sorting whole rows.

    Keys and arrival numbers alone are compared; the rows whose key has an earlier arrival are
    then dropped by number. Rows without a key are kept as one copy.
    """
    require_columns(df, key, seq)
    narrow = stored_table(df.select(key, seq))
    first = narrow.groupBy(F.col(key).alias("__key")).agg(F.min(seq).alias("__first"))
    same = narrow[key].eqNullSafe(first["__key"])
    later = narrow.join(first, same).filter(F.col(seq) > F.col("__first")).select(seq)
    return df.join(stored_table(later), seq, "left_anti")


def first_arrivals(
    df: DataFrame, key: str = "id", seq: str = "seq", carry: Sequence[str] = ()
) -> DataFrame:
    """Narrow form: key, its smallest arrival number, and the carried columns of that row.

    A plain aggregation, combined on the map side; a hash aggregate when the carried
    columns have fixed width.
    """
    require_columns(df, key, seq, *carry)
    carried = [F.min_by(name, seq).alias(name) for name in carry]
    return df.groupBy(key).agg(F.min(seq).alias(seq), *carried)


def fetch_rows(df: DataFrame, keep: DataFrame, seq: str = "seq") -> DataFrame:
    """Full rows of ``df`` for the arrival numbers in ``keep``, plus the columns of ``keep``.

    ``seq`` must be unique in ``df``. ``keep`` is stored, so that Spark knows its size: while it
    is below the session's limit for broadcasts the big table is only scanned.
    """
    require_columns(df, seq)
    extra = [name for name in keep.columns if name != seq]
    return df.drop(*extra).join(stored_table(keep), seq)
