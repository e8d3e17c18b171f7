"""Scalar functions on columns."""

from .labels import (
    ABSTAIN,
    CLASS_NAMES,
    CLASSES,
    class_to_text,
    label_from_rating,
    label_or_null,
    normalize_human_label,
    parse_number,
    rating_to_class,
    safe_float,
    safe_int,
)
from .probs import (
    STRATEGIES,
    abstain_label,
    argmax,
    confidence,
    cross_entropy,
    cross_entropy_from_logits,
    entropy,
    instance_weight,
    margin,
    normalize_probs,
    softmax,
    softmax3,
    strategy_score,
    uncertainty,
)
from .sql import register_functions
from .text import (
    collapse_ws,
    display_text,
    normalize_text,
    or_empty,
    stable_id,
    strip_ws,
    word_count,
)

__all__ = [name for name in dir() if not name.startswith("_")]
