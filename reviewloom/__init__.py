"""Review curation on Spark: clean, sample, split, score and label product reviews."""

from .functions import class_to_text, rating_to_class, register_functions, stable_id
from .operators.leakage import assert_no_leakage
from .operators.sampling import balanced_train, sample_stratified, split_dev_eval
from .operators.selection import prepare_batch, select_uncertain
from .operators.scoring import predict

__all__ = [
    "assert_no_leakage",
    "balanced_train",
    "class_to_text",
    "predict",
    "prepare_batch",
    "rating_to_class",
    "register_functions",
    "sample_stratified",
    "select_uncertain",
    "split_dev_eval",
    "stable_id",
]
