"""Choose the rows a human should label next, and merge the labels back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import normalize_human_label, safe_float
from ..functions.probs import argmax, strategy_score, uncertainty
from ..functions.text import or_empty
from ..runtime import stored_table
from .conform import todo_rows, with_id
from .dedup import (
    drop_later_copies,
    fetch_rows,
    first_arrivals,
    lookup_table,
    require_columns,
)
from .filters import cap_per_group, drop_blocked, head_rows, min_words
from .ranking import top_ranked
from .scoring import Scorer


def top_k(df: DataFrame, score: str, k: int, seq: str = "seq") -> DataFrame:
    """The ``k`` highest scores in falling order; ties go to the first arrival.

    Nulls come last and NaN first. Scores and arrival numbers alone are ranked; they are read
    twice and the rows once more, so pass stored scores, not a costly scorer.
    """
    require_columns(df, score, seq)
    order = [f"{score} desc", seq]
    if k <= 0:
        return df.filter(F.lit(False))
    best = top_ranked(df.select(score, seq), [], order, k, rank="__rank")
    return fetch_rows(df, best.select(seq, "__rank"), seq).orderBy("__rank").drop("__rank")


def top_k_per_class(
    df: DataFrame,
    score: str,
    quotas: Sequence[int],
    by: str = "pred_label",
    seq: str = "seq",
) -> DataFrame:
    """Highest scores per predicted class, up to the quota of each of the three classes."""
    require_columns(df, score, by, seq)
    if len(quotas) != 3:
        raise ValueError("quotas need one number for each of the three classes")
    quota = F.coalesce(
        F.get(F.array(*[F.lit(max(int(q), 0)) for q in quotas]), F.col(by)), F.lit(0)
    )
    # No filter on the class before ranking: it would be pushed below the scorer and run twice.
    order = [f"{score} desc", seq]
    best = top_ranked(df.select(by, score, seq), [by], order, quota, rank="__rank")
    return fetch_rows(df, best.select(seq), seq)


def prepare_batch(
    scored: DataFrame, k: int, strategy: str, seq: str = "id"
) -> DataFrame:
    """The ``k`` rows a strategy finds least certain, as rows to label. Ties go to the lower id."""
    name = strategy.lower()
    if "probs" not in scored.columns:
        scored = scored.withColumn("probs", F.array("p_neg", "p_neu", "p_pos"))
    ranked = scored.withColumn("score", strategy_score(name, "probs"))
    return todo_rows(top_k(ranked, "score", k, seq))


def candidate_rows(scored: DataFrame) -> DataFrame:
    """Predicted class and uncertainty of scored rows."""
    return scored.withColumns(
        {"pred_label": argmax("probs"), "uncertainty": uncertainty("probs")}
    )


def accepted_rows(
    pool: DataFrame,
    blocked: DataFrame | None = None,
    words: int = 0,
    dedup: bool = True,
    per_category: int = 0,
    total: int = 0,
    seq: str = "seq",
) -> DataFrame:
    """Rows that may be scored: long enough, not blocked, first arrival, within the caps.

    Caps count accepted rows in arrival order. With caps the choice is made on a narrow
    table and the texts are fetched for the chosen rows only.
    """
    require_columns(pool, "text", "asin", "product_category", seq)
    rows = min_words(pool, words)
    if per_category <= 0 and total <= 0:
        rows = with_id(rows)
        rows = drop_later_copies(rows, "id", seq) if dedup else rows
        return drop_blocked(rows, blocked) if blocked is not None else rows
    narrow = with_id(rows).select("id", seq, "product_category")
    if dedup:
        narrow = first_arrivals(narrow, "id", seq, ["product_category"])
    if blocked is not None:
        narrow = drop_blocked(narrow, blocked)
    narrow = stored_table(narrow)  # ranked in several passes; the ids are computed once
    narrow = cap_per_group(narrow, per_category, "product_category", seq)
    narrow = head_rows(narrow, total, seq)
    return fetch_rows(pool, narrow.select("id", seq), seq)


def select_uncertain(
    pool: DataFrame,
    scorer: Scorer,
    quotas: Sequence[int] | None = None,
    k: int = 0,
    blocked: DataFrame | None = None,
    words: int = 0,
    dedup: bool = True,
    per_category: int = 0,
    total: int = 0,
    seq: str = "seq",
) -> DataFrame:
    """The most uncertain rows of a pool: per predicted class with ``quotas``, else the top ``k``."""
    if quotas is None and k <= 0:
        raise ValueError("give quotas per class or a total k")
    rows = accepted_rows(pool, blocked, words, dedup, per_category, total, seq)
    rows = rows.withColumn("rating", safe_float("rating"))
    # Ranking looks at the scores more than once: score once, keep what ranking needs.
    scored = candidate_rows(scorer(rows)).select("id", seq, "probs", "pred_label", "uncertainty")
    scored = stored_table(scored)
    narrow = (
        top_k_per_class(scored, "uncertainty", quotas, seq=seq)
        if quotas is not None
        else top_k(scored, "uncertainty", k, seq)
    )
    picked = fetch_rows(pool, narrow, seq).withColumn("rating", safe_float("rating"))
    return picked.select(
        "id",
        seq,
        *[or_empty(c).alias(c) for c in ("text", "title", "asin", "product_category")],
        "rating",
        "pred_label",
        "probs",
        "uncertainty",
    )


def quarantine_labels(labels: DataFrame, label: str = "label") -> DataFrame:
    """Labelled rows whose label is none of the known spellings."""
    return labels.filter(normalize_human_label(label).isNull())


def newest_labels(
    labels: DataFrame, key: str = "id", batch: str | None = None
) -> DataFrame:
    """One readable label per key; with a batch number the newest batch wins, then the lower class."""
    clean = labels.withColumn("__label", normalize_human_label("label")).filter(
        F.col("__label").isNotNull()
    )
    newest = F.struct((-F.col(batch)) if batch else F.lit(0), F.col("__label"))
    return clean.groupBy(key).agg(F.min_by("__label", newest).alias("human_label"))


def merge_human_labels(
    pool: DataFrame, labels: DataFrame, key: str = "id", batch: str | None = None
) -> DataFrame:
    """The pool with human labels put over its own; ``label_source`` says which one a row has."""
    require_columns(pool, key, "label")
    human = lookup_table(newest_labels(labels, key, batch), key)
    merged = pool.join(human, key, "left")
    return merged.withColumns(
        {
            "label_source": F.when(F.col("human_label").isNotNull(), "human").otherwise("pool"),
            "label": F.coalesce("human_label", F.col("label").cast("int")),
        }
    ).drop("human_label")
