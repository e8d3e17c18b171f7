"""Expressions over class probabilities: softmax, confidence, uncertainty, weights, loss."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import ABSTAIN, class_to_text
from .text import WHITESPACE, _col, strip_ws

# Confidence below which a prediction abstains; clip points of the entropy.
ABSTAIN_THRESHOLD = 0.65
STREAM_EPS = 1e-12
BATCH_EPS = 1e-8


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(logits: Column | str) -> Column:
    """Probabilities from an array of logits, shifted by the row maximum."""

    def shares(powers: Column) -> Column:
        return _let(_sum(powers), lambda total: F.transform(powers, lambda e: e / total))

    def shifted(z: Column) -> Column:
        return F.transform(z, lambda x: F.exp(x - F.array_max(z)))

    return _let(_let(_col(logits), shifted), shares)


def softmax3(z0: Column, z1: Column, z2: Column) -> tuple[Column, Column, Column]:
    """Softmax over three scalar columns; stays in generated code without arrays."""
    top = F.greatest(z0, z1, z2)
    e0, e1, e2 = F.exp(z0 - top), F.exp(z1 - top), F.exp(z2 - top)
    total = e0 + e1 + e2
    return e0 / total, e1 / total, e2 / total


def argmax(probs: Column | str) -> Column:
    """Index of the largest probability, the first one on ties."""
    p = _col(probs)
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def confidence(probs: Column | str) -> Column:
    return F.array_max(_col(probs))


def abstain_label(probs: Column | str, threshold: float = ABSTAIN_THRESHOLD) -> Column:
    """Class name, or "abstain" when the confidence is below ``threshold``."""
    return F.when(confidence(probs) < threshold, F.lit(ABSTAIN)).otherwise(
        class_to_text(argmax(probs))
    )


def entropy(probs: Column | str, eps: float = STREAM_EPS) -> Column:
    """Shannon entropy in nats over probabilities clipped to [eps, 1]."""

    def term(x: Column) -> Column:
        clipped = F.least(F.greatest(x, F.lit(eps)), F.lit(1.0))
        return -clipped * F.ln(clipped)

    return _sum(F.transform(_col(probs), term))


def margin(probs: Column | str) -> Column:
    """Gap between the two largest probabilities; 1.0 when there are fewer than two."""
    ranked = F.sort_array(_col(probs), asc=False)
    return F.when(F.size(ranked) < 2, F.lit(1.0)).otherwise(F.get(ranked, 0) - F.get(ranked, 1))


def uncertainty(probs: Column | str) -> Column:
    """Entropy plus the closeness of the two best classes; larger is less certain."""
    return entropy(probs, STREAM_EPS) + (F.lit(1.0) - margin(probs))


#: Scores for a labelling batch by strategy name; larger is more uncertain.
STRATEGIES: dict[str, Callable[[Column], Column]] = {
    "least_confidence": lambda p: F.lit(1.0) - confidence(p),
    "margin": lambda p: -margin(p),
    "entropy": lambda p: entropy(p, BATCH_EPS),
}


def strategy_score(name: str, probs: Column | str) -> Column:
    key = name.lower()
    if key not in STRATEGIES:
        raise ValueError(f"no such strategy: {name}")
    return STRATEGIES[key](_col(probs))


def normalize_probs(value: Column | str) -> Column:
    """Probabilities given as JSON text or as comma-separated text; empty when unreadable."""
    text = strip_ws(_col(value).cast("string"))
    as_json = F.from_json(text, "array<double>")
    parts = F.transform(F.split(text, WHITESPACE + "*," + WHITESPACE + "*"),
                        lambda part: part.try_cast("double"))
    as_list = F.when(F.forall(parts, lambda x: x.isNotNull()), parts)
    return F.coalesce(as_json, as_list, F.array().cast("array<double>"))


def instance_weight(conf: Column | str, agrees: Column, rating: Column | None = None) -> Column:
    """Training weight of a row: confident and agreeing rows count more, 3-star rows less."""
    weight = F.lit(0.3) + F.lit(0.7) * _col(conf)
    weight = weight * F.when(agrees, 1.0).otherwise(0.5)
    if rating is not None:
        weight = weight * F.when(rating == 3, 0.8).otherwise(1.0)
    return weight


def _pick(values: Sequence[float], index: Column) -> Column:
    array = F.array(*[F.lit(float(v)) for v in values])
    return F.get(array, index)


def cross_entropy(
    probs: Column | str,
    label: Column | str,
    class_weights: Sequence[float] | None = None,
    sample_weight: Column | None = None,
) -> Column:
    """Per-row loss ``-ln p[label]``, times class weight and sample weight where given."""
    target = _col(label).cast("int")
    loss = -F.ln(F.get(_col(probs), target))
    if class_weights is not None:
        loss = loss * _pick(class_weights, target)
    return loss * sample_weight if sample_weight is not None else loss


def cross_entropy_from_logits(logits: Column | str, label: Column | str) -> Column:
    """The same loss from logits by log-sum-exp, exact where a probability underflows."""
    target = _col(label).cast("int")

    def loss(z: Column) -> Column:
        total = _sum(F.transform(z, lambda x: F.exp(x - F.array_max(z))))
        return F.ln(total) + F.array_max(z) - F.get(z, target)

    return _let(_col(logits), loss)
