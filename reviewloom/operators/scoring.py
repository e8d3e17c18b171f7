"""Classifiers as pluggable scorers, and everything computed from their probabilities.

A scorer takes a table with ``text`` and returns it with ``probs ARRAY<DOUBLE>`` added. Every
input row comes back exactly once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import CLASSES, rating_to_class
from ..functions.probs import (
    ABSTAIN_THRESHOLD,
    abstain_label,
    argmax,
    confidence,
    instance_weight,
)
from ..functions.text import WHITESPACE, or_empty
from ..runtime import small_batches, stored_table
from .conform import ensure_label
from .metrics import class_weight_list, evaluate

Scorer = Callable[[DataFrame], DataFrame]


def expression_scorer(logits: Callable[[Column], Sequence[Column]]) -> Scorer:
    """Scorer from column expressions: ``logits`` maps the text column to one logit per class.

    The steps are separate projections over scalar columns, so each logit is computed once
    and the arithmetic stays in generated code.
    """

    def score_rows(df: DataFrame) -> DataFrame:
        values = [value.cast("double") for value in logits(or_empty("text"))]
        z = [f"__z{i}" for i in range(len(values))]
        rows = df.withColumns(dict(zip(z, values)))
        top = F.greatest(*z) if len(z) > 1 else F.col(z[0])
        rows = rows.withColumns({name: F.exp(F.col(name) - top) for name in z})
        total = sum((F.col(name) for name in z), F.lit(0.0))
        return rows.withColumn("probs", F.array(*[F.col(name) / total for name in z])).drop(*z)

    return score_rows


def pandas_scorer(
    load_model: Callable[[], Callable[[pd.Series], Sequence[Sequence[float]]]],
) -> Scorer:
    """Scorer around any Python model.

    ``load_model`` runs once per Python worker task and returns a function from a batch of
    texts to one list of probabilities per text. Batches are Arrow batches; their size is
    ``spark.sql.execution.arrow.maxRecordsPerBatch`` and ``maxBytesPerBatch``, which are set to
    512 rows and 4 MB in the session unless the user has set them.
    """

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model()
        for texts in batches:
            probs = np.asarray(model(texts), dtype=np.float64)
            if len(probs) != len(texts):
                raise ValueError("the model returned a different number of rows")
            yield pd.Series(list(probs), index=texts.index)  # a row of the array each

    def score_rows(df: DataFrame) -> DataFrame:
        small_batches(df.sparkSession)
        return df.withColumn("probs", run(or_empty("text")))

    return score_rows


def model_scorer(model: PipelineModel) -> Scorer:
    """Scorer from a fitted Spark ML classifier with a ``probability`` output."""

    def score_rows(df: DataFrame) -> DataFrame:
        scored = model.transform(df.withColumn("text", or_empty("text")))
        return scored.withColumn("probs", vector_to_array("probability")).select(
            *df.columns, "probs"
        )

    return score_rows


def score(df: DataFrame, scorer: Scorer) -> DataFrame:
    """Probabilities per class as an array and as three columns."""
    return scorer(df).withColumns(
        {
            name: F.get(F.col("probs"), position)
            for position, name in enumerate(("p_neg", "p_neu", "p_pos"))
        }
    )


def predict(
    df: DataFrame, scorer: Scorer | None = None, threshold: float = ABSTAIN_THRESHOLD
) -> DataFrame:
    """Label (or "abstain"), confidence and probabilities for every row."""
    scored = df if scorer is None else score(df, scorer)
    return scored.withColumns(
        {
            "label": abstain_label("probs", threshold),
            "confidence": confidence("probs"),
        }
    )


def weight_rows(df: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """Adds ``sample_weight``; the class comes from the stars when there is no label."""
    scored = df if scorer is None else scorer(df)
    if "label" not in scored.columns:
        scored = scored.withColumn("label", rating_to_class("rating", mode="strict"))
    stars = F.col("rating") if "rating" in scored.columns else None
    agrees = argmax("probs") == F.col("label")
    return scored.withColumn("sample_weight", instance_weight(confidence("probs"), agrees, stars))


def text_features(num_features: int = 1 << 18, max_tokens: int = 0, min_docs: int = 0) -> list:
    """Stages from ``text`` to a TF-IDF vector in ``features``.

    ``max_tokens`` limits a text to its first tokens, as sequence models do; 0 uses whole texts.
    """
    stages = [
        RegexTokenizer(
            inputCol="text", outputCol="tokens", pattern=WHITESPACE + "+", toLowercase=True
        )
    ]
    tokens = "tokens"
    if max_tokens > 0:
        stages.append(
            SQLTransformer(
                statement=f"SELECT *, slice(tokens, 1, {int(max_tokens)}) AS kept FROM __THIS__"
            )
        )
        tokens = "kept"
    stages.append(HashingTF(inputCol=tokens, outputCol="tf", numFeatures=num_features))
    stages.append(IDF(inputCol="tf", outputCol="features", minDocFreq=min_docs))
    return stages


def _training_rows(
    df: DataFrame, sample_weight: str | None, class_weights: Sequence[float] | None
) -> DataFrame:
    """Text, label and row weight (class weight times sample weight) of the labelled rows."""
    rows = ensure_label(df).withColumn("text", or_empty("text"))
    return _weighted_rows(rows, "text", sample_weight, class_weights)


def _weighted_rows(
    rows: DataFrame, content: str, sample_weight: str | None, class_weights: Sequence[float] | None
) -> DataFrame:
    rows = rows.filter(F.col("label").isin(*CLASSES))
    weights = list(class_weights) if class_weights else class_weight_list(rows)
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("label"))
    if sample_weight:
        weight = weight * F.col(sample_weight).cast("double")
    return rows.select(
        content, F.col("label").cast("double").alias("label"), weight.alias("weight")
    )


def _classifier(reg_param: float, max_iter: int) -> LogisticRegression:
    return LogisticRegression(
        featuresCol="features",
        labelCol="label",
        weightCol="weight",
        family="multinomial",
        regParam=reg_param,
        maxIter=max_iter,
    )


def train_classifier(
    df: DataFrame,
    sample_weight: str | None = None,
    class_weights: Sequence[float] | None = None,
    num_features: int = 1 << 18,
    max_tokens: int = 0,
    reg_param: float = 0.01,
    max_iter: int = 50,
) -> PipelineModel:
    """Multinomial logistic regression on TF-IDF, weighted by class and by row.

    The row weight is the class weight times ``sample_weight``. Without given class weights
    they are derived from the class counts.

    Texts are split once; word counts and features are stored. Every step of the fit starts from
    the features, so its tasks carry neither texts nor the fitted weights of words.
    """
    prepared = _training_rows(df, sample_weight, class_weights)
    *stages, weigh = text_features(num_features, max_tokens)
    words = PipelineModel(stages)  # none of these has anything to fit
    counted = stored_table(words.transform(prepared).select("tf", "label", "weight"))
    weigh = weigh.fit(counted)
    rows = stored_table(weigh.transform(counted).select("features", "label", "weight"))
    return PipelineModel([*stages, weigh, _classifier(reg_param, max_iter).fit(rows)])


def evaluate_scorer(
    df: DataFrame, scorer: Scorer, class_weights: Sequence[float] | None = None
) -> DataFrame:
    """Metrics of a scorer on a labelled table."""
    scored = scorer(ensure_label(df)).withColumn("pred_label", argmax("probs"))
    return evaluate(scored, probs="probs", class_weights=class_weights)


def best_of(
    train: DataFrame,
    dev: DataFrame,
    grid: Sequence[dict],
    sample_weight: str | None = None,
    class_weights: Sequence[float] | None = None,
    num_features: int = 1 << 18,
    max_tokens: int = 0,
) -> tuple[PipelineModel, dict, float]:
    """Fit one model per set of ``reg_param`` and ``max_iter``; keep the best macro-F1 on ``dev``.

    The features are fitted once for the whole grid. Both tables are read once, their word
    counts are stored, so they outlive executors, and every fit and score starts from these.
    """
    if not grid:
        raise ValueError("the parameter grid is empty")
    *stages, weigh = text_features(num_features, max_tokens)
    words = PipelineModel(stages)  # none of these has anything to fit

    def counted(df: DataFrame, *others: str) -> DataFrame:
        rows = ensure_label(df).withColumn("text", or_empty("text"))
        return stored_table(words.transform(rows).select("tf", "label", *others))

    fit_rows = counted(train, *([sample_weight] if sample_weight else []))
    fit_rows = _weighted_rows(fit_rows, "tf", sample_weight, class_weights)
    weigh = weigh.fit(fit_rows)
    fit_rows = weigh.transform(fit_rows)
    dev_rows = weigh.transform(counted(dev)).select("features", "label")
    best = None
    for options in grid:
        fitted = _classifier(**{"reg_param": 0.01, "max_iter": 50, **options}).fit(fit_rows)
        scored = fitted.transform(dev_rows).select(
            F.col("label").cast("int").alias("label"),
            F.col("prediction").cast("int").alias("pred_label"),
        )
        f1 = evaluate(scored).first().f1_macro
        if best is None or f1 > best[2]:
            best = (PipelineModel([*stages, weigh, fitted]), options, f1)
    return best
