"""The scalar functions for SQL users, as temporary SQL functions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .labels import _NUMBER, HUMAN_SPELLINGS
from .probs import ABSTAIN_THRESHOLD, BATCH_EPS, STREAM_EPS
from .text import WHITESPACE, WHITESPACE_CODE_POINTS

_CHARS = "concat(" + ", ".join(f"char({c})" if c < 256 else f"'{chr(c)}'"
                               for c in WHITESPACE_CODE_POINTS) + ")"
_STARS = "CASE WHEN isnan(r) THEN 1 WHEN r <= 2 THEN 0 WHEN r >= 4 THEN 2 ELSE 1 END"
_SPELLINGS = ", ".join(f"'{name}', {number}" for name, number in HUMAN_SPELLINGS.items())
_ENTROPY = (
    "aggregate(p, CAST(0 AS DOUBLE), (t, x) -> t - greatest(least(x, 1D), {eps})"
    " * ln(greatest(least(x, 1D), {eps})))"
)


def _definitions() -> list[tuple[str, str, str]]:
    """(signature, result type, body) of every function, helpers first."""
    return [
        ("strip_ws(s STRING)", "STRING", f"btrim(s, {_CHARS})"),
        ("collapse_ws(s STRING)", "STRING", f"btrim(regexp_replace(s, r'{WHITESPACE}+', ' '))"),
        ("normalize_text(s STRING)", "STRING", "lower(collapse_ws(coalesce(s, '')))"),
        ("word_count(s STRING)", "INT",
         "length(collapse_ws(coalesce(s, ''))) - length(replace(collapse_ws(coalesce(s, '')), ' ',"
         " '')) + CAST(collapse_ws(coalesce(s, '')) <> '' AS INT)"),
        ("stable_id(txt STRING, asin STRING)", "STRING",
         "sha1(CAST(concat(normalize_text(txt), char(1),"
         " lower(strip_ws(coalesce(asin, '')))) AS BINARY))"),
        ("parse_number(s STRING)", "DOUBLE",
         f"CASE WHEN s RLIKE r'{_NUMBER}' THEN try_cast(strip_ws(s) AS DOUBLE) END"),
        ("label_of_stars(r DOUBLE)", "INT", _STARS),
        ("label_from_rating(x DOUBLE)", "INT", "label_of_stars(coalesce(x, 0D))"),
        ("rating_to_class(x DOUBLE)", "INT",
         "CASE WHEN NOT isnan(x) AND x BETWEEN 1 AND 5 THEN label_of_stars(x) END"),
        ("label_or_null(x DOUBLE)", "INT",
         "CASE WHEN x IS NOT NULL THEN label_of_stars(x) END"),
        ("class_to_text(i INT)", "STRING",
         "CASE i WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' WHEN 2 THEN 'positive'"
         " ELSE 'unknown' END"),
        ("normalize_human_label(s STRING)", "INT",
         f"try_element_at(map({_SPELLINGS}), lower(strip_ws(s)))"),
        ("prob_argmax(p ARRAY<DOUBLE>)", "INT",
         "CAST(array_position(p, array_max(p)) - 1 AS INT)"),
        ("prob_margin(p ARRAY<DOUBLE>)", "DOUBLE",
         "CASE WHEN size(p) < 2 THEN 1D ELSE get(sort_array(p, false), 0)"
         " - get(sort_array(p, false), 1) END"),
        ("prob_entropy(p ARRAY<DOUBLE>)", "DOUBLE", _ENTROPY.format(eps=f"{STREAM_EPS!r}D")),
        ("prob_uncertainty(p ARRAY<DOUBLE>)", "DOUBLE",
         "prob_entropy(p) + (1D - prob_margin(p))"),
        ("abstain_label(p ARRAY<DOUBLE>, threshold DOUBLE)", "STRING",
         "CASE WHEN array_max(p) < threshold THEN 'abstain'"
         " ELSE class_to_text(prob_argmax(p)) END"),
        ("predict_label(p ARRAY<DOUBLE>)", "STRING", f"abstain_label(p, {ABSTAIN_THRESHOLD}D)"),
        ("score_least_confidence(p ARRAY<DOUBLE>)", "DOUBLE", "1D - array_max(p)"),
        ("score_margin(p ARRAY<DOUBLE>)", "DOUBLE", "-prob_margin(p)"),
        ("score_entropy(p ARRAY<DOUBLE>)", "DOUBLE", _ENTROPY.format(eps=f"{BATCH_EPS!r}D")),
    ]


def register_functions(spark: SparkSession) -> list[str]:
    """Create the temporary functions in ``spark`` and return their names."""
    names = []
    for signature, result, body in _definitions():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {result} RETURN {body}"
        )
        names.append(signature.split("(")[0])
    return names
