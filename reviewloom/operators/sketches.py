"""Approximate distinct ids by theta sketches, which merge and intersect.

A sketch of at most ``2 ** log_entries`` hashes (8 bytes each) stands for the ids of a shard, so
distinct and shared ids of any set of shards follow from stored sketches without reading ids
again. Counts are exact up to that many ids; beyond it the relative standard error of a count is
about ``2 ** (-log_entries / 2)``, 0.4 % for the default, and that of an overlap is the same in
relation to both sides together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dedup import require_columns

LOG_ENTRIES = 16


def id_sketches(
    df: DataFrame, *by: str, key: str = "id", log_entries: int = LOG_ENTRIES
) -> DataFrame:
    """A sketch of the distinct ids of each group (``*by, sketch``); null ids do not count.

    Sketches are combined on the map side, so a hot group sends one per task.
    """
    require_columns(df, key, *by)
    return df.groupBy(*by).agg(F.theta_sketch_agg(key, log_entries).alias("sketch"))


def merge_sketches(sketches: DataFrame, *by: str, log_entries: int = LOG_ENTRIES) -> DataFrame:
    """Sketches of coarser groups, or of everything, from those of finer ones."""
    return sketches.groupBy(*by).agg(F.theta_union_agg("sketch", log_entries).alias("sketch"))


def distinct_estimate(sketch: Column | str = "sketch") -> Column:
    """Distinct ids that a sketch stands for; 0 where there is none."""
    return F.coalesce(F.theta_sketch_estimate(sketch), F.lit(0)).cast("bigint")


def approx_leakage_report(
    train: DataFrame, evaluation: DataFrame, log_entries: int = LOG_ENTRIES
) -> DataFrame:
    """``leakage_report`` from sketches of the shards of both sides, without their ids.

    An overlap much smaller than both sides may be estimated as 0; ``assert_no_leakage`` stays
    the exact check.
    """
    sides = train.select("sketch", F.lit(True).alias("t")).unionByName(
        evaluation.select("sketch", F.lit(False).alias("t"))
    )
    merged = sides.agg(
        F.theta_union_agg(F.when(F.col("t"), F.col("sketch")), log_entries).alias("train"),
        F.theta_union_agg(F.when(~F.col("t"), F.col("sketch")), log_entries).alias("eval"),
    )
    return merged.select(
        distinct_estimate("train").alias("train_unique"),
        distinct_estimate("eval").alias("eval_rows"),
        distinct_estimate(F.theta_intersection("train", "eval")).alias("shared"),
    )
