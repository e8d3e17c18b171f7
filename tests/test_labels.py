import math

import pytest

from reviewloom import functions as fn


def values(spark, kind, rows, column):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"n INT, x {kind}")
    return [r[0] for r in df.orderBy("n").select(column).collect()]


def test_stars_to_label(spark):
    stars = [1.0, 2.0, 3.0, 4.0, 5.0, 2.5, 3.5, 0.0, 6.0, -1.0, None, math.nan, math.inf, -math.inf]
    want = [0, 0, 1, 2, 2, 1, 1, 0, 2, 0, 0, 1, 2, 0]
    assert values(spark, "DOUBLE", stars, fn.label_from_rating("x")) == want


RATING_TEXTS = ["4", "4.0", " 4 ", "4d", "4f", "nan", "inf", "1_0", "1e1", "0x10", "abc", "", None,
                "2.5", ".5", "5.", "+3", "-2", "1e400", "٤", "　4 ", "4 4"]


def test_rating_text_to_number(spark):
    got = values(spark, "STRING", RATING_TEXTS, fn.parse_number("x"))
    want = [4.0, 4.0, 4.0, None, None, math.nan, math.inf, None, 10.0, None, None, None, None,
            2.5, 0.5, 5.0, 3.0, -2.0, math.inf, None, 4.0, None]
    for text, a, b in zip(RATING_TEXTS, got, want):
        assert a == b or (a is not None and math.isnan(a) and math.isnan(b)), text


def test_default_label_is_null_without_rating(spark):
    got = values(spark, "STRING", ["5", "1", "3", "x", None], fn.label_or_null("x", textual=True))
    assert got == [2, 0, 1, None, None]


def test_strict_class(spark):
    stars = [1.0, 2.0, 3.0, 4.0, 5.0, 0.5, 6.0, None, math.nan]
    assert values(spark, "DOUBLE", stars, fn.rating_to_class("x")) == [0, 0, 1, 2, 2] + [None] * 4
    for bad in (0.0, 6.0, None, math.nan):
        with pytest.raises(Exception, match="no class for rating"):
            values(spark, "DOUBLE", [bad], fn.rating_to_class("x", mode="strict"))
    with pytest.raises(ValueError):
        fn.rating_to_class("x", mode="other")


def test_class_names(spark):
    assert values(spark, "INT", [0, 1, 2, 3, None], fn.class_to_text("x")) == [
        "negative", "neutral", "positive", "unknown", "unknown"]
    with pytest.raises(Exception, match="no name for class"):
        values(spark, "INT", [9], fn.class_to_text("x", mode="strict"))


def test_human_labels(spark):
    given = ["neg", " POS ", "Neutral", "1", "7", "2.0", "", None, "　negative\n"]
    assert values(spark, "STRING", given, fn.normalize_human_label("x")) == [
        0, 2, 1, 1, None, None, None, None, 0]


def test_safe_casts(spark):
    given = ["3.7", "-3.7", "x", None, "nan", "1e30"]
    assert values(spark, "STRING", given, fn.safe_int("x", -1, textual=True)) == [3, -3, -1, -1, -1, -1]
    assert values(spark, "DOUBLE", [1.5, None], fn.safe_float("x", 9.0)) == [1.5, 9.0]


def test_sql_label_functions(spark):
    fn.register_functions(spark)
    row = spark.sql(
        "SELECT label_from_rating(CAST('nan' AS DOUBLE)) a, label_from_rating(NULL) b,"
        " rating_to_class(6D) c, label_or_null(NULL) d, class_to_text(2) e,"
        " normalize_human_label(' Pos ') f, parse_number('4d') g, parse_number(' 4 ') h"
    ).first()
    assert tuple(row) == (1, 0, None, None, "positive", 2, None, 4.0)
