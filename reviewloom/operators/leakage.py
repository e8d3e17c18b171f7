"""Guards against ids that occur on both the train and the eval side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .conform import with_id


def _sides(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """One row per id with the sides it occurs on; one shuffle, combined on the map side."""
    left = with_id(train).select("id", F.lit(1).alias("t"), F.lit(0).alias("e"))
    right = with_id(evaluation).select("id", F.lit(0).alias("t"), F.lit(1).alias("e"))
    return left.unionByName(right).groupBy("id").agg(F.max("t").alias("t"), F.max("e").alias("e"))


def leakage_ids(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """The distinct ids that occur on both sides."""
    return _sides(train, evaluation).filter("t = 1 AND e = 1").select("id")


def leakage_report(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """One row: distinct ids of each side and the number they share."""
    return _sides(train, evaluation).agg(
        F.count_if(F.col("t") == 1).alias("train_unique"),
        F.count_if(F.col("e") == 1).alias("eval_rows"),
        F.count_if((F.col("t") == 1) & (F.col("e") == 1)).alias("shared"),
    )


def assert_no_leakage(train: DataFrame, evaluation: DataFrame) -> dict[str, int]:
    """Raise when the sides share an id; else return the distinct counts."""
    report = leakage_report(train, evaluation).first().asDict()
    if report["shared"]:
        some = [row.id for row in leakage_ids(train, evaluation).orderBy("id").limit(5).collect()]
        raise ValueError(f"{report['shared']} ids are on both sides, such as {some}")
    return {"train_unique": report["train_unique"], "eval_rows": report["eval_rows"]}
