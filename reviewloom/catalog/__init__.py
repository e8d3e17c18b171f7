"""Named queries over the test tables."""

from . import io_queries, row_queries, sample_queries, score_queries, stream_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
