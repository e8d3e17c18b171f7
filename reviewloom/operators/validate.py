"""Checks of review tables: a one-row report, and the rows that break a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import parse_number
from ..functions.text import strip_ws
from ..schema import REVIEW_COLUMNS
from .dedup import require_columns


def _blank(name: str) -> Column:
    text = F.col(name).cast("string")
    return text.isNull() | (strip_ws(text) == "")


def _rules(
    df: DataFrame, rating_range: tuple[float, float], allow_empty_title: bool
) -> dict[str, Column]:
    """Rule name to the condition under which a row breaks it."""
    low, high = rating_range
    textual = isinstance(df.schema["rating"].dataType, T.StringType)
    stars = parse_number("rating") if textual else F.col("rating").try_cast("double")
    rules = {
        "rating": stars.isNull() | F.isnan(stars) | (stars < low) | (stars > high),
        "text": _blank("text"),
    }
    if not allow_empty_title:
        rules["title"] = _blank("title")
    return rules


def _metadata_is_text(df: DataFrame) -> bool:
    return all(
        isinstance(df.schema[name].dataType, T.StringType) for name in ("asin", "product_category")
    )


def validate_reviews(
    df: DataFrame,
    rating_range: tuple[float, float] = (1.0, 5.0),
    allow_empty_title: bool = True,
) -> DataFrame:
    """One-row report of a review table, from a single pass. Missing columns are an error.

    Fixed values: the names of the report's columns and of the two options.
    """
    require_columns(df, *REVIEW_COLUMNS)
    rules = _rules(df, rating_range, allow_empty_title)
    report = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(rules["rating"]).alias("bad_ratings"),
        F.count_if(rules["text"]).alias("empty_texts"),
        F.count_if(_blank("title")).alias("empty_titles"),
        F.count_distinct("product_category").alias("categories"),
    )
    title_ok = F.lit(True) if allow_empty_title else F.col("empty_titles") == 0
    return report.withColumns(
        {
            "columns_present": F.lit(True),
            "rating_range_ok": F.col("bad_ratings") == 0,
            "text_nonempty": F.col("empty_texts") == 0,
            "title_ok": title_ok,
            "metadata_types_ok": F.lit(_metadata_is_text(df)),
            "categories_present": F.col("categories") > 0,
        }
    )


def invalid_rows(
    df: DataFrame,
    rating_range: tuple[float, float] = (1.0, 5.0),
    allow_empty_title: bool = True,
) -> DataFrame:
    """Rows that break a rule, with the names of the broken rules in ``reasons``."""
    require_columns(df, *REVIEW_COLUMNS)
    rules = _rules(df, rating_range, allow_empty_title)
    reasons = F.array_compact(
        F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()])
    )
    return df.withColumn("reasons", reasons).filter(F.size("reasons") > 0)


def assert_valid(df: DataFrame, seq: str | None = None, **options) -> dict:
    """Raise on the first broken rule, naming up to five rows; else return the report."""
    report = validate_reviews(df, **options).first().asDict()
    if all(report[k] for k in ("rating_range_ok", "text_nonempty", "title_ok")):
        return report
    broken = invalid_rows(df, **options)
    if seq:
        some = [(row[seq], row.reasons) for row in broken.orderBy(seq).limit(5).collect()]
    else:
        some = [row.reasons for row in broken.select("reasons").limit(5).collect()]
    raise ValueError(f"invalid review rows (e.g. {some})")


def check_split(df: DataFrame, rating_range: tuple[float, float] = (0.0, 5.0)) -> DataFrame:
    """One row of post-conditions on a split: all zero when it is sound."""
    require_columns(df, *REVIEW_COLUMNS)
    low, high = rating_range
    has_null = F.lit(False)
    for name in REVIEW_COLUMNS:
        has_null = has_null | F.col(name).isNull()
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(has_null).alias("null_rows"),
        F.count_if(~F.col("rating").between(low, high)).alias("rating_out_of_range"),
        F.count_if(F.length("text") == 0).alias("empty_texts"),
    )
