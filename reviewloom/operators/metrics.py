"""Evaluation, class weights and distributions, each from one aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import CLASSES
from ..functions.probs import argmax, confidence, cross_entropy
from ..functions.text import _col
from .ranking import with_rank


def label_distribution(df: DataFrame, *by: str) -> DataFrame:
    """Rows per label (and per split or other columns)."""
    return df.groupBy(*(by or ("label",))).agg(F.count(F.lit(1)).alias("rows"))


def class_weights(
    df: DataFrame,
    label: str = "label",
    configured: Sequence[float] | None = None,
    classes: Sequence[int] = CLASSES,
) -> DataFrame:
    """Weight per class, inverse to its rows and averaging 1; configured weights win.

    Classes without rows count as one row. The table has one row per class.
    """
    counts = [F.count_if(F.col(label) == c) for c in classes]
    totals = df.agg(*[n.alias(f"n{c}") for c, n in zip(classes, counts)])
    floors = [F.greatest(F.col(f"n{c}"), F.lit(1)).cast("double") for c in classes]
    mean = sum((1.0 / n for n in floors), F.lit(0.0)) / float(len(classes))
    entries = []
    for position, c in enumerate(classes):
        weight = (
            F.lit(float(configured[position])) if configured else (1.0 / floors[position]) / mean
        )
        entries.append(
            F.struct(F.lit(c).alias("label"), F.col(f"n{c}").alias("rows"), weight.alias("weight"))
        )
    return totals.select(F.inline(F.array(*entries)))


def class_weight_list(df: DataFrame, label: str = "label", **options) -> list[float]:
    """The class weights as numbers, one per class."""
    return [row.weight for row in class_weights(df, label, **options).orderBy("label").collect()]


def _cells(classes: Sequence[int]) -> list[tuple[int, int, str]]:
    return [(t, p, f"c_{t}_{p}") for t in classes for p in classes]


def _cell_counts(
    label: Column, predicted: Column, classes: Sequence[int]
) -> list[Column]:
    return [
        F.count_if((label == t) & (predicted == p)).alias(name) for t, p, name in _cells(classes)
    ]


def _total(names: Sequence[str]) -> Column:
    return sum((F.col(name) for name in names), F.lit(0).cast("long"))


def _f1_macro(classes: Sequence[int]) -> Column:
    """Mean F1 over the classes that occur as label or prediction; undefined F1 counts as 0."""
    present, scores = F.lit(0), F.lit(0.0)
    for c in classes:
        row = _total([f"c_{c}_{p}" for p in classes])
        column = _total([f"c_{t}_{c}" for t in classes])
        support = row + column
        present = present + F.when(support > 0, 1).otherwise(0)
        scores = scores + F.coalesce(
            F.try_divide(2.0 * F.col(f"c_{c}_{c}"), support.cast("double")), F.lit(0.0)
        )
    return F.coalesce(F.try_divide(scores, present.cast("double")), F.lit(0.0))


def _matrix(classes: Sequence[int]) -> Column:
    return F.array(
        *[F.array(*[F.col(f"c_{t}_{p}") for p in classes]) for t in classes]
    )


def evaluate(
    df: DataFrame,
    label: str = "label",
    predicted: str = "pred_label",
    probs: str | None = None,
    class_weights: Sequence[float] | None = None,
    classes: Sequence[int] = CLASSES,
) -> DataFrame:
    """One row: rows, accuracy, macro-F1, confusion matrix and, with ``probs``, the mean loss.

    A single aggregation without grouping: every task sends one row of counters.
    """
    truth, guess = F.col(label), F.col(predicted)
    counters = [F.count(F.lit(1)).alias("rows"), *_cell_counts(truth, guess, classes)]
    if probs is not None:
        counters.append(F.avg(cross_entropy(probs, label, class_weights)).alias("loss"))
    totals = df.agg(*counters)
    hits = _total([f"c_{c}_{c}" for c in classes])
    columns = [
        F.col("rows"),
        F.coalesce(F.try_divide(hits.cast("double"), F.col("rows").cast("double")), F.lit(0.0))
        .alias("accuracy"),
        _f1_macro(classes).alias("f1_macro"),
        _matrix(classes).alias("confusion_matrix"),
    ]
    if probs is not None:
        columns.append(F.coalesce(F.col("loss"), F.lit(0.0)).alias("loss"))
    return totals.select(*columns)


def confusion_matrix(
    df: DataFrame,
    label: str = "label",
    predicted: str = "pred_label",
    classes: Sequence[int] = CLASSES,
) -> DataFrame:
    """Long form over the classes that occur as label or prediction, zero cells included."""
    totals = df.agg(*_cell_counts(F.col(label), F.col(predicted), classes))
    present = {
        c: _total([f"c_{c}_{p}" for p in classes]) + _total([f"c_{t}_{c}" for t in classes]) > 0
        for c in classes
    }
    entries = [
        F.when(
            present[t] & present[p],
            F.struct(F.lit(t).alias("label"), F.lit(p).alias("pred_label"),
                     F.col(name).alias("rows")),
        )
        for t, p, name in _cells(classes)
    ]
    return totals.select(F.inline(F.array_compact(F.array(*entries))))


def coverage(
    df: DataFrame, thresholds: Sequence[float], probs: str = "probs", label: str = "label"
) -> DataFrame:
    """Per abstain threshold: answered share, abstain share and accuracy among the answered."""
    sure = confidence(probs)
    right = argmax(probs) == F.col(label)
    counters = [F.count(F.lit(1)).alias("rows")]
    for i, t in enumerate(thresholds):
        counters.append(F.count_if(sure >= t).alias(f"a{i}"))
        counters.append(F.count_if((sure >= t) & right).alias(f"r{i}"))
    total = F.col("rows").cast("double")
    entries = [
        F.struct(
            F.lit(float(t)).alias("threshold"),
            F.col(f"a{i}").alias("answered"),
            F.try_divide(F.col(f"a{i}").cast("double"), total).alias("coverage"),
            (F.lit(1.0) - F.try_divide(F.col(f"a{i}").cast("double"), total)).alias("abstain_rate"),
            F.coalesce(
                F.try_divide(F.col(f"r{i}").cast("double"), F.col(f"a{i}").cast("double")),
                F.lit(0.0),
            ).alias("answered_accuracy"),
        )
        for i, t in enumerate(thresholds)
    ]
    return df.agg(*counters).select(F.inline(F.array(*entries)))


def mean_loss(
    df: DataFrame,
    probs: str = "probs",
    label: str = "label",
    class_weights: Sequence[float] | None = None,
    sample_weight: str | None = None,
) -> DataFrame:
    """Mean of the weighted row losses over all rows (not over the weights)."""
    extra = _col(sample_weight) if sample_weight else None
    loss = cross_entropy(probs, label, class_weights, extra)
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.avg(loss), F.lit(0.0)).alias("loss")
    )


def exact_quantiles(
    df: DataFrame, by: str, value: str, fractions: dict[str, float]
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group.

    Values are ranked within their groups by ``with_rank``, which spreads a group over tasks,
    however close its values are; the ranks next to each wanted position are picked out.
    """
    values = df.select(by, F.col(value).cast("double").alias("__v")).filter("__v IS NOT NULL")
    placed = with_rank(values, [by], [F.col("__v")], rank="__rank")
    totals = values.groupBy(F.col(by).alias("__by")).agg(F.count(F.lit(1)).alias("__total"))
    placed = placed.join(totals, placed[by].eqNullSafe(totals["__by"])).drop("__by")
    picked = []
    for name, fraction in fractions.items():
        at = (F.col("__total") - 1) * F.lit(fraction)
        low, part = F.floor(at), at - F.floor(at)
        low_value = F.max(F.when(F.col("__rank") == low + 1, F.col("__v")))
        high_value = F.max(F.when(F.col("__rank") == F.ceil(at) + 1, F.col("__v")))
        picked.append((low_value + F.max(part) * (high_value - low_value)).alias(name))
    return placed.groupBy(by).agg(*picked)


def latency_summary(
    df: DataFrame, by: str, value: str, exact: bool = True, accuracy: int = 10_000
) -> DataFrame:
    """Count, mean, median and 95th percentile per group."""
    basic = [
        F.count(value).alias("rows"),
        F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"),
    ]
    if not exact:
        return df.groupBy(by).agg(
            *basic,
            F.percentile_approx(value, 0.5, accuracy).alias("p50"),
            F.percentile_approx(value, 0.95, accuracy).alias("p95"),
        )
    means = df.groupBy(by).agg(*basic).withColumnRenamed(by, "__key")
    points = exact_quantiles(df, by, value, {"p50": 0.5, "p95": 0.95})
    joined = means.join(points, means["__key"].eqNullSafe(points[by]), "left")
    return joined.select(
        F.col("__key").alias(by),
        "rows",
        "mean",
        F.coalesce("p50", F.lit(0.0)).alias("p50"),
        F.coalesce("p95", F.lit(0.0)).alias("p95"),
    )
