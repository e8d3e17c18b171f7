"""Label expressions: stars to classes, class names, human label spellings, safe casts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WHITESPACE, _col, strip_ws

# Class ids and their names.
CLASS_NAMES = {0: "negative", 1: "neutral", 2: "positive"}
CLASSES = tuple(CLASS_NAMES)
ABSTAIN = "abstain"

# Spellings accepted from human labellers.
HUMAN_SPELLINGS = {
    "neg": 0, "negative": 0, "0": 0,
    "neu": 1, "neutral": 1, "1": 1,
    "pos": 2, "positive": 2, "2": 2,
}

# Plain decimal spellings; Spark alone would also read suffixes such as "4d".
_NUMBER = (
    r"^" + WHITESPACE + r"*[+-]?"
    r"(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:nan|inf|infinity))"
    + WHITESPACE + r"*$"
)


def parse_number(value: Column | str) -> Column:
    """String to DOUBLE; NULL when it is not a plain number, "nan" or "inf"."""
    text = _col(value).cast("string")
    return F.when(text.rlike(_NUMBER), strip_ws(text).try_cast("double"))


def safe_float(value: Column | str, default: float = 0.0, *, textual: bool = False) -> Column:
    """DOUBLE with a default for NULL or unreadable values."""
    number = parse_number(value) if textual else _col(value).try_cast("double")
    return F.coalesce(number, F.lit(float(default)))


def safe_int(value: Column | str, default: int, *, textual: bool = False) -> Column:
    """INT (truncated toward zero) with a default for NULL, NaN or unreadable values."""
    number = parse_number(value) if textual else _col(value).try_cast("double")
    return F.coalesce(number.try_cast("int"), F.lit(int(default)))


def _stars(rating: Column) -> Column:
    # NaN sorts above every number in Spark, so it needs its own branch first.
    return (
        F.when(F.isnan(rating), F.lit(1))
        .when(rating <= 2, F.lit(0))
        .when(rating >= 4, F.lit(2))
        .otherwise(F.lit(1))
    )


def label_from_rating(rating: Column | str = "rating", *, textual: bool = False) -> Column:
    """Lenient: up to 2 stars is 0, from 4 stars on is 2, else 1; unreadable counts as 0 stars."""
    return _stars(safe_float(rating, 0.0, textual=textual))


def rating_to_class(rating: Column | str = "rating", mode: str = "permissive") -> Column:
    """Strict: only 1 to 5 stars have a class.

    ``permissive`` gives NULL for other ratings, ``strict`` fails the job.
    """
    stars = _col(rating).try_cast("double")
    valid = stars.isNotNull() & ~F.isnan(stars) & stars.between(1.0, 5.0)
    if mode == "permissive":
        return F.when(valid, _stars(stars))
    if mode == "strict":
        message = F.concat(
            F.lit("no class for rating "), F.coalesce(stars.cast("string"), F.lit("null"))
        )
        return F.when(valid, _stars(stars)).otherwise(F.raise_error(message).cast("int"))
    raise ValueError(f"unknown mode: {mode}")


def label_or_null(rating: Column | str = "rating", *, textual: bool = False) -> Column:
    """Default label shown to a labeller; NULL when there is no readable rating."""
    stars = parse_number(rating) if textual else _col(rating).try_cast("double")
    return F.when(stars.isNotNull(), _stars(stars))


def class_to_text(class_id: Column | str, mode: str = "permissive") -> Column:
    """Class id to class name; other ids give "unknown" or, in ``strict`` mode, an error."""
    column = _col(class_id)
    branches = None
    for number, name in CLASS_NAMES.items():
        hit = column == F.lit(number)
        branches = F.when(hit, name) if branches is None else branches.when(hit, name)
    if mode == "strict":
        message = F.concat(
            F.lit("no name for class "), F.coalesce(column.cast("string"), F.lit("null"))
        )
        return branches.otherwise(F.raise_error(message).cast("string"))
    return branches.otherwise("unknown")


def normalize_human_label(value: Column | str) -> Column:
    """Human label spelling to class id; NULL when it is none of the known spellings."""
    pairs = [F.lit(part) for pair in HUMAN_SPELLINGS.items() for part in pair]
    spelling = F.lower(strip_ws(_col(value).cast("string")))
    return F.try_element_at(F.create_map(*pairs), spelling)
