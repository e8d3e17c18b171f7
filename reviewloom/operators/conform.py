"""Bring any review-like table to the fixed columns and defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import label_from_rating, safe_float
from ..functions.text import or_empty, stable_id
from ..runtime import compute_once
from ..schema import REVIEW_COLUMNS


def _rating(df: DataFrame) -> Column:
    if "rating" not in df.columns:
        return F.lit(0.0)
    return safe_float("rating", 0.0, textual=dict(df.dtypes)["rating"] == "string")


def fill_defaults(df: DataFrame) -> DataFrame:
    """NULL text columns become empty and a NULL or unreadable rating becomes 0."""
    changes = {
        name: _rating(df) if name == "rating" else or_empty(name)
        for name in REVIEW_COLUMNS
        if name in df.columns
    }
    return df.withColumns(changes)


def label_column(df: DataFrame) -> Column:
    """The given label where it is readable, else the label the stars imply."""
    derived = label_from_rating(_rating(df))
    if "label" not in df.columns:
        return derived
    return F.coalesce(F.col("label").try_cast("int"), derived)


def ensure_label(df: DataFrame) -> DataFrame:
    return df.withColumn("label", label_column(df))


def conform_schema(
    df: DataFrame, with_label: bool = False, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Exactly the review columns, in order, with defaults for missing ones.

    Other columns are dropped except those named in ``keep`` (an arrival number, an id).
    """
    columns = []
    for name in REVIEW_COLUMNS:
        if name == "rating":
            value = _rating(df)
        else:
            value = or_empty(name) if name in df.columns else F.lit("")
        columns.append(value.alias(name))
    if with_label:
        columns.append(label_column(df).alias("label"))
    return df.select(*keep, *columns)


def rating_to_int(df: DataFrame) -> DataFrame:
    """Stars truncated to whole numbers; unreadable ones become 0."""
    return df.withColumn("rating", F.coalesce(_rating(df).try_cast("int"), F.lit(0)))


def with_id(df: DataFrame, name: str = "id") -> DataFrame:
    """Add the content ID unless the table already stores it."""
    return df if name in df.columns else compute_once(df, name, stable_id("text", "asin"))


def todo_rows(df: DataFrame) -> DataFrame:
    """Rows for human labelling, with an empty label to fill in."""
    return df.select("id", "text", "title", "asin", "product_category", F.lit("").alias("label"))


def gold_rows(df: DataFrame) -> DataFrame:
    """Text, asin and label of labelled rows, with defaults for missing columns."""
    pick = [
        or_empty(name).alias(name) if name in df.columns else F.lit("").alias(name)
        for name in ("text", "asin")
    ]
    label = F.col("label").cast("int") if "label" in df.columns else F.lit(0)
    return df.select(*pick, label.alias("label"))
