"""Row filters, ID sets and limits in arrival order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_words
from .dedup import fetch_rows, lookup_table, require_columns
from .id_filter import anti_join_filtered
from .ranking import sample_hash, top_ranked


def min_words(df: DataFrame, n: int, text: str = "text") -> DataFrame:
    """Rows with at least ``n`` words; 0 switches the filter off."""
    return df.filter(has_words(text, n)) if n > 0 else df


def category_filter(
    df: DataFrame, categories: Sequence[str] = (), column: str = "product_category"
) -> DataFrame:
    """Rows of the listed categories; an empty list keeps all."""
    return df.filter(F.col(column).isin(list(categories))) if categories else df


def drop_blocked(
    df: DataFrame, ids: DataFrame, key: str = "id", by_filter: bool = False
) -> DataFrame:
    """Rows whose id is not in ``ids``. Works on batch tables and on streams.

    No broadcast is forced: a seen set can outgrow memory, and the optimizer broadcasts it
    by itself while it is small. With ``by_filter`` (batch tables, for longer lists) a Bloom
    filter of bounded size passes most rows before the shuffle; see ``anti_join_filtered``.
    """
    require_columns(df, key)
    if by_filter:
        return anti_join_filtered(df, ids, key)
    blocked = ids.select(F.col(ids.columns[0]).alias(key))
    return df.join(lookup_table(blocked, key), key, "left_anti")


def drop_labelled(
    df: DataFrame, gold: DataFrame, key: str = "id", by_filter: bool = False
) -> DataFrame:
    """Rows that still need a label: a usable id that the labelled table does not have."""
    require_columns(df, key)
    usable = df.filter(F.col(key).isNotNull() & (F.col(key) != ""))
    if by_filter:
        return anti_join_filtered(usable, gold.select(key), key)
    return usable.join(lookup_table(gold.select(key), key), key, "left_anti")


def union_id_sets(*sets: DataFrame) -> DataFrame:
    """Distinct ids of all the given one-column tables."""
    merged = sets[0].select(F.col(sets[0].columns[0]).alias("id"))
    for other in sets[1:]:
        merged = merged.unionByName(other.select(F.col(other.columns[0]).alias("id")))
    return merged.distinct()


def agreeing_rows(df: DataFrame, predicted: str = "pred_label", label: str = "label") -> DataFrame:
    """Rows whose prediction equals the given label."""
    return df.filter(F.col(predicted) == F.col(label))


def head_rows(df: DataFrame, n: int, seq: str = "seq") -> DataFrame:
    """The first ``n`` rows by arrival; ``n`` <= 0 keeps all rows.

    Arrival numbers alone are ranked; the rows are fetched by them.
    """
    require_columns(df, seq)
    if n <= 0:
        return df
    first = top_ranked(df.select(seq), [], [seq], n, rank="__rank")
    return fetch_rows(df, first.drop("__rank"), seq)


def sample_rows(
    df: DataFrame, n: int, seed: int, key: Sequence[str] = ("id",)
) -> DataFrame:
    """A uniform sample of ``n`` rows: the first ``n`` of a seeded shuffle."""
    require_columns(df, *key)
    if n <= 0:
        return df
    hashed = df.withColumn("__hash", sample_hash(seed, *key))
    return top_ranked(hashed, [], ["__hash", *key], n, rank="__rank").drop("__hash", "__rank")


def cap_per_group(
    df: DataFrame,
    n: int,
    by: str = "product_category",
    seq: str = "seq",
    rank: str | None = None,
) -> DataFrame:
    """The first ``n`` rows of each group by arrival; ``n`` <= 0 keeps all rows.

    Groups and arrival numbers alone are ranked; the rows are fetched by arrival number.
    """
    require_columns(df, by, seq)
    if n <= 0:
        return df
    name = rank or "__rank"
    first = top_ranked(df.select(by, seq), [by], [seq], n, rank=name)
    return fetch_rows(df, first.select(seq, *([rank] if rank else [])), seq)
